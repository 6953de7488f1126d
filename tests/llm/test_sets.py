"""N-gram join and line dedup against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, awkward, linked, repeated, words
from pyspark.sql import functions as F

from sessionlode.llm import hashing as H
from sessionlode.llm import line_dedup, ngram_join, set_index
from sessionlode.llm.components import components
from sessionlode.llm.scratch import Scratch


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 8, 10)])
def test_link(spark, width, num, den):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "tokens": F.lit(1), "n": F.lit(2)})
    got = ngram_join.link(docs, width=width, num=num, den=den).collect()
    want = linked(rows, width, num, den)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_rows_that_share_a_doc_id(spark):
    """Different texts under one id, in any order and number of partitions: the same answer."""
    rng = random.Random(2)
    text = lambda k: " ".join(f"w{k}_{i}" for i in range(60))
    near = lambda t: t.replace("w0_30", "other")
    rows = [(1, text(0)), (1, text(1)), (1, text(2)), (2, near(text(0))), (3, text(1)), (4, near(text(2)).replace("w2_30", "other")), (5, text(5))]
    seen = set()
    for k in (1, 3, 5):
        rng.shuffle(rows)
        got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(k), num=8).collect()
        seen.add(tuple(sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)))
    assert len(seen) == 1
    last = {d: c for d, _, c in next(iter(seen))}
    assert last[1] == last[3] == 1 and last[5] == 5


def test_link_large_groups(spark):
    """Hundreds of near copies around the threshold, chained, and a shared passage."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((i * 7 % 311, " ".join(w), None, None, 0))
    rows += [(1000 + i, " ".join(base[:40] + [f"u{i}_{k}" for k in range(200)]), None, None, 0) for i in range(40)]
    got = ngram_join.link(spark.createDataFrame(rows, SCHEMA)).collect()
    want = linked(rows, 3, 9, 10)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) > 45


def test_dedup_lines(spark):
    rows = awkward(2)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lines", F.lit("mine"))
    want = repeated(rows)
    got = line_dedup.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["removed"]) == want.get(r["doc_id"], []) and r["n_removed"] == len(r["removed"])
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    texts = {r["doc_id"]: r["text"] for r in kept if r["doc_id"] is not None}
    for d, text, *_ in rows:
        if d is None:
            continue
        lines = [x for k, x in enumerate((text or "").split("\n")) if k not in want.get(d, [])]
        if d in want and not words("\n".join(lines)):
            assert d not in texts
        else:
            assert texts[d] == (None if text is None else "\n".join(lines))
    assert sum(r["doc_id"] is None for r in kept) == 2 and all(r["lines"] == "mine" for r in kept)


def test_dedup_lines_long_and_close(spark):
    """Lines over the long mark, in a chain of edits, against brute force."""
    rng = random.Random(9)
    rows, line = [], [f"w{i}" for i in range(150)]
    for i in range(80):
        line = list(line)
        for _ in range(4):
            line[rng.randrange(len(line))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(line) + "\n" + " ".join(line[:20]), None, None, 0))
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = repeated(rows)
    assert got == {d: want.get(d, []) for d in got} and any(want.values())


@pytest.mark.parametrize("run", [ngram_join.link, line_dedup.report, line_dedup.dedup])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, None)]
    got = {r[0]: r[1] for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}


def test_hashes_follow_words():
    texts = ["", "a", " A  b\tc\x0bd\n", "x" * 9000 + " y", None, "é ß", "a b c"]
    (row, data, starts), *rest = H.text_slices(pa.array(texts))
    hashes, bounds = H.word_hashes(data, starts, fold=True)
    assert not rest and np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for w, h in zip(words(t, True), hashes[bounds[i] : bounds[i + 1]], strict=True):
            assert seen.setdefault(w, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)
    parts = list(H.text_slices(pa.array(["ab"] * 10), limit=5))
    assert sum(len(s) - 1 for _, _, s in parts) == 10 and len(parts) > 1


def test_walk_loses_no_pair():
    rng = np.random.default_rng(3)
    for num, den in ((8, 10), (9, 10)):
        run, size = np.sort(rng.integers(0, 30, 600)), rng.integers(1, 40, 600)
        place = rng.integers(0, np.maximum(1, size // 3))
        order = np.lexsort((place, size, run))
        run, size, place = run[order], size[order], place[order]
        got = {(int(a), int(b)) for i, j in set_index.walk(run, size, place, num, den) for a, b in zip(i, j, strict=True)}
        want = set()
        for i in range(600):
            for j in range(i + 1, 600):
                if run[i] == run[j] and min(size[i] - place[i], size[j] - place[j]) >= -(-num * (size[i] + size[j]) // (num + den)) and size[j] * num <= size[i] * den:
                    want.add((i, j))
        assert got == want


def test_leaders_and_probes():
    rng = np.random.default_rng(4)
    for num, den in ((8, 10), (9, 10)):
        run, size = np.sort(rng.integers(0, 8, 300)), rng.integers(1, 40, 300)
        place = rng.integers(0, np.maximum(1, size // 3))
        order = np.lexsort((place, size, run))
        run, size, place = run[order], size[order], place[order]
        i, j = np.triu_indices(300, 1)
        i, j = i[run[i] == run[j]], j[run[i] == run[j]]
        ok = set_index.passes(i, j, size, place, num, den)
        want = set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
        probes = rng.random(300) < 0.3
        got = [tuple(sorted((int(a), int(b)))) for x, y in set_index.walk(run, size, place, num, den, None, probes) for a, b in zip(x, y, strict=True)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if probes[a] or probes[b]}
        room = set_index.reachable(run, size, place, num, den)
        assert all(room[a] and room[b] for a, b in want)
        first, group = rng.integers(0, 300, 300), rng.integers(0, 5, 300)
        for lead, of in ((set_index.leaders(run, size, place, first, num, den), first), (set_index.leaders(run, size, place, first, num, den, group), group)):
            at = np.flatnonzero(lead >= 0)
            assert len(at) and (of[at] != of[lead[at]]).all() and {tuple(sorted(x)) for x in zip(at.tolist(), lead[at].tolist(), strict=True)} <= want


def test_a_list_of_entries_alike_takes_one_pass():
    n = 1 << 16
    x = {"key": np.zeros(n, np.uint64), "owner": np.random.default_rng(1).permutation(n), "size": np.full(n, 40), "place": np.zeros(n, np.int64)}
    start = time.perf_counter()
    out = ngram_join._open_lists(9, 10)(pa.table({"pid": pa.array([0], pa.int32()), "block": pa.array([set_index.pack(**x)])}))
    assert out.num_rows == n and set(out.column("leader").to_pylist()) == {0, None}
    assert not ngram_join._minor(np.zeros(n, np.int64), np.zeros(n, np.int64)).any()
    y = {k: v for k, v in x.items() if k != "owner"} | {"doc": x["owner"], "line": np.zeros(n, np.int32), "bits": np.zeros(n, np.uint64)}
    blocks = {"kind": ["entry"], "pid": pa.array([0], pa.int32()), "block": pa.array([set_index.pack(**y)])}
    out = line_dedup._lists(8, 10)(pa.table(blocks))
    near = out.filter(pa.array([k == "near" for k in out.column("kind").to_pylist()]))
    assert near.num_rows == n - 1 and set(near.column("to_doc").to_pylist()) == {0}
    assert time.perf_counter() - start < 20


def test_heavy_lists_are_cut(monkeypatch):
    """With lists of 16 at most, every two entries still meet."""
    monkeypatch.setattr(set_index, "HEAVY", 16)
    tokens = np.array([5, 1 << 50], dtype=np.uint64)
    sketch = np.zeros(1 << 20, dtype=np.int64)
    sketch[0] = 80
    for lengths in (set_index.Lengths(sketch), set_index.Lengths(sketch, tokens[:1], np.array([80]))):
        keys, index = set_index.spread(tokens, np.arange(2), lengths)
        assert len(keys) == 6 and (index == 0).sum() == 5
        lists = [set(set_index.spread(tokens[:1], np.array([owner]), lengths)[0].tolist()) for owner in range(40)]
        assert all(a & b for a in lists for b in lists)
    none = set_index.Lengths(sketch, np.zeros(0, np.uint64), np.zeros(0, np.int64))  # a heavy slot without a heavy token
    assert len(set_index.spread(tokens, np.arange(2), none)[0]) == 2


def test_short_lists_lose_nothing(spark, monkeypatch):
    """Hundreds of near copies with lists of 8 at most, cut by exact counts and by the sketch alone."""
    monkeypatch.setattr(set_index, "HEAVY", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        rows.append((i * 7 % 151, " ".join(w) + "\n" + " ".join(w[:9]), None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    links, lines = linked(rows, 3, 9, 10), repeated(rows)
    for most in (1 << 22, 0):
        monkeypatch.setattr(set_index, "MOST_HEAVY", most)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs).collect()} == links
        assert {r["doc_id"]: list(r["removed"]) for r in line_dedup.report(docs).collect()} == {d: lines.get(d, []) for d in links}


def test_long_texts_go_in_pieces(monkeypatch):
    text = "Ab c\td " * 3000 + "x" * 9000 + " y" * 500
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.array([0, len(data)])
    words_want, _ = H.word_hashes(data, starts, fold=True)
    want, _ = H.shingle_hashes(words_want, np.array([0, len(words_want)]), 3)
    monkeypatch.setattr(H, "SLICE_BYTES", 100)
    words_got, bounds = H.word_hashes(data, starts, fold=True)
    got, out_bounds = H.shingle_hashes(words_got, bounds, 3)
    assert (words_got == words_want).all() and (got == want).all() and bounds.tolist() == [0, len(words_want)] and out_bounds.tolist() == [0, len(want)]

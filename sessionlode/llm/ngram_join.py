"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds the 64-bit fingerprints of its distinct word shingles. Documents of one set are one node from the
start. Sets that reach the threshold share a rare shingle within their prefixes (see ``set_index``), so the prefix index
finds every link. Two relations between sets save work:

- within a list, the length and positional filters skip whole blocks of entries;
- between sets: a set that links with another takes over that one's class, the answers known so far, and only looks beyond
  it. First every entry of a list is compared with one leader, then with one entry of another class; both choices take one
  pass over a list. What is left are entries of different classes; a list with one class is skipped, and in others the
  entries outside the largest class are walked against all. Where two sets were both compared with one leader, their overlap
  follows from their small differences to it, without either set.

Links inside a class are implied, so copies and near copies are never expanded into pairs; no link between classes is lost.
Lists are cut at a fixed length (see ``set_index``), and pairs leave a task in lots of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlode.llm import hashing as H
from sessionlode.llm import set_index as S
from sessionlode.llm.components import components
from sessionlode.llm.scratch import Scratch, small_batches
from sessionlode.llm.sketches import Bloom, exact_counts, frequencies, slot

NUM, DEN = 9, 10
ENTRIES_A_LIST_GROUP = 300_000
#: Sets that a task remembers, to give the prefix of equal ones once.
SEEN_BITS = 16
SALTS = 16


def _sets(batch: pa.RecordBatch, at: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, all shingles, sorted distinct shingles, their row bounds) by slices of the text column."""
    for row, data, starts in H.text_slices(batch.column(at)):
        shingles, bounds = H.shingle_hashes(*H.word_hashes(data, starts, fold=True), width)
        yield row, shingles, *H.distinct_in_rows(shingles, bounds)


def _prefix(values: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix of one sorted set in the global order: by frequency, then by value."""
    n = int(S.prefix_size(len(values), num, den))
    load = counts[slot(values)]
    if n < len(values):
        near = np.flatnonzero(load <= np.partition(load, n - 1)[n - 1])
        values, load = values[near], load[near]
    return values[np.argsort(load, kind="stable")[:n]]


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (size of its set) and component_id (least doc_id linked, itself too).

    Words are runs outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased; a text of fewer than ``width`` words is one shingle,
    one without words (or null) has an empty set and is linked with nothing. Documents link at Jaccard >= num / den.
    A row without a doc_id gets its n_shingles, takes no part in links, and has a null component_id. Rows that share a
    doc_id are one document and share its component; if their texts differ, each gets its own n_shingles, copies of any of
    them link, and for near copies the text of the least set digest stands for it. Whole texts are read, a very long one in
    pieces. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _link(docs, doc_id, text, width, num, den)


def _link(docs: DataFrame, doc_id: str, text: str, width: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = frequencies(rows.select("text"), lambda b: (x for _, x, _, _ in _raw(b, width)))
    shared = spark.sparkContext.broadcast(counts)

    signed = scratch.table(rows.mapInArrow(_index(shared, width, num, den), "doc_id long, n long, d1 long, d2 long, prefix binary"), "signed", wide=True, packed=True)
    sets = signed.drop("prefix")
    prefixes = signed.where("prefix is not null").select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "prefix", "d1", "d2")
    entries, tokens = prefixes.select("prefix"), lambda b: (np.frombuffer(x, dtype=np.uint64) for x in b.column(0).to_pylist())
    lengths, groups = list_lengths(entries, tokens, ENTRIES_A_LIST_GROUP)
    blocks = prefixes.mapInArrow(_blocks(lengths, groups), "pid int, block binary")
    found = scratch.table(blocks.groupBy("pid").applyInArrow(_open_lists(num, den), "pid int, key long, owner long, size int, place int, leader long"), "found", wide=True)

    named = sets.where("n > 0 and doc_id is not null")
    least = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # Only sets with copies are joined; each has SALTS rows, so that a set of very many copies meets in as many tasks.
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = scratch.table(salted.join(least, ["d1", "d2", "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "copies")

    starred = found.where("leader is not null").groupBy(F.col("owner").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("votes"))
    starred = _plausible(starred, prefixes, shared, num, den)
    first = scratch.table(starred.groupBy("a").agg((-F.max(F.struct("votes", (-F.col("b")).alias("b")))["b"]).alias("b")), "first")
    ids = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"))
    arrays = _fetch(rows, ids(first), width)
    compared = scratch.table(_compare(first, arrays, num, den), "compared")
    edges = copies.unionByName(compared.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = components(scratch, edges)

    for every in (False, True):
        open_pairs = scratch.table(_plausible(_across(found, classes, every, num, den), prefixes, shared, num, den), f"open-{every}")
        near, rest = _derive(open_pairs, compared, num, den)
        rest = scratch.table(rest, f"rest-{every}")
        linked = near.unionByName(_compare(rest, _fetch(rows, ids(rest), width), num, den).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        edges = classes.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(linked)
        classes = components(scratch, edges)

    result = sets.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    result = scratch.table(result, "result")
    scratch.keep_only("result")
    return result


def list_lengths(entries: DataFrame, tokens, group_size: int) -> tuple:
    """(a broadcast of the lists' lengths, groups of lists so that each has about ``group_size`` entries) of all index
    entries, given as batches of tokens."""
    spark = entries.sparkSession
    sketch = frequencies(entries, tokens)
    heavy = (sketch > S.HEAVY).any() and exact_counts(entries, tokens, sketch > S.HEAVY, S.HEAVY, S.MOST_HEAVY)
    lengths = S.Lengths(sketch, *heavy) if heavy else S.Lengths(sketch)
    # A list of n entries that is cut into c chunks has about n * c entries.
    extra = int((lengths.counts * (-(-lengths.counts // lengths.heavy) - 1)).sum()) if heavy else 0
    groups = max(2 * spark.sparkContext.defaultParallelism, (int(sketch.sum()) + extra) // group_size)
    return spark.sparkContext.broadcast(lengths), groups


def _raw(batch: pa.RecordBatch, width: int):
    for row, data, starts in H.text_slices(batch.column(0)):
        shingles, bounds = H.shingle_hashes(*H.word_hashes(data, starts, fold=True), width)
        yield row, shingles, bounds, None


def _index(shared, width: int, num: int, den: int):
    """A row per document: size and two fingerprints of its set, and the set's prefix in the global order.

    Of documents with one set, each task gives a prefix for the first only.
    """

    def run(batches):
        counts = shared.value
        seen = np.zeros((1 << SEEN_BITS, 2), dtype=np.uint64)
        for batch in batches:
            ids, null = batch.column(0), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, _, values, bounds in _sets(batch, 1, width):
                n = len(bounds) - 1
                full = np.flatnonzero(np.diff(bounds))
                d1, d2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                if len(full):
                    d1[full] = np.add.reduceat(H.mix(values), bounds[full])
                    d2[full] = np.add.reduceat(H.mix(values * H.STEP + np.uint64(1)), bounds[full])
                prefix: list[bytes | None] = [None] * n
                for i in full[~null[row + full]]:
                    place = int(d1[i]) & ((1 << SEEN_BITS) - 1)
                    if seen[place, 0] == d1[i] and seen[place, 1] == d2[i]:
                        continue
                    seen[place] = d1[i], d2[i]
                    prefix[i] = _prefix(values[bounds[i] : bounds[i + 1]], counts, num, den).tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.array(np.diff(bounds)), pa.array(H.to_signed(d1)), pa.array(H.to_signed(d2)), pa.array(prefix, pa.binary())], names=["doc_id", "n", "d1", "d2", "prefix"])
        H.release_memory()

    return run


def _blocks(lengths, groups: int):
    """The index entries of a batch of prefixes (id, size, prefix), packed by group of lists."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in parts])
            tokens = np.concatenate(parts)
            owner, size = np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            keys, index = S.spread(tokens, owner, lengths.value)
            pid = (keys % np.uint64(groups)).astype(np.int32)
            order = np.argsort(pid, kind="stable")
            keys, index, pid = keys[order], index[order], pid[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(pid)) + 1))
            ends = np.append(starts[1:], len(pid))
            packed = [S.pack(key=(keys[s:e] // np.uint64(groups)) & np.uint64(0xFFFFFFFF), owner=owner[index[s:e]], size=size[index[s:e]], place=place[index[s:e]]) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pid[starts]), pa.array(packed, pa.binary())], names=["pid", "block"])

    return run


def _sorted_lists(key, size, place):
    """Order by list, size and position, and the list numbers in that order."""
    order = np.lexsort((place, size, key))
    key = key[order]
    return order, np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)


def _open_lists(num: int, den: int):
    """Keeps the entries that have room for a partner in their list; each names as leader an entry with a lesser owner."""

    def run(table: pa.Table) -> pa.Table:
        x = S.unpack(table.column("block").to_pylist(), {"key": "uint64", "owner": "int64", "size": "int64", "place": "int64"})
        pid = table.column("pid")[0].as_py()
        _, inverse, many = np.unique(x["key"], return_inverse=True, return_counts=True)
        many = many[inverse] > 1
        x = {k: v[many] for k, v in x.items()}
        order, lists = _sorted_lists(x["key"], x["size"], x["place"])
        x = {k: v[order] for k, v in x.items()}
        used = S.reachable(lists, x["size"], x["place"], num, den)
        leader = S.leaders(lists, x["size"], x["place"], x["owner"], num, den)
        none = (leader < 0) | (x["owner"][leader] >= x["owner"])
        leader = np.where(none, 0, x["owner"][leader])
        at = np.flatnonzero(used)
        return pa.table({"pid": pa.array(np.full(len(at), pid, dtype=np.int32)), "key": H.to_signed(np.ascontiguousarray(x["key"][at])), "owner": x["owner"][at], "size": x["size"][at].astype(np.int32), "place": x["place"][at].astype(np.int32), "leader": pa.array(leader[at], mask=none[at])})

    return run


def _plausible(pairs: DataFrame, prefixes: DataFrame, shared, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) whose prefixes leave room for the threshold.

    Up to the lesser of the two last prefix tokens both sets are fully known, so they share what their prefixes share there,
    and beyond it at most what is left of the smaller one. Sets that share a rare token by chance end here, at the cost of
    a tenth of a set.
    """
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    one = prefixes.groupBy("id").agg(F.min(F.struct("d1", "d2", "size", "prefix")).alias("p")).select("id", "p.size", "p.prefix")
    side = lambda x, y: one.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("prefix").alias(y))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y", "size_a", "size_b", "a", "b", *rest)

    def run(batches):
        counts = shared.value
        for batch in batches:
            ok = []
            for x, y, m, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                end_x, end_y = (int(counts[slot(x[-1:])][0]), int(x[-1])), (int(counts[slot(y[-1:])][0]), int(y[-1]))
                if end_x > end_y:
                    x, y, m, n, end_x = y, x, n, m, end_y
                load = counts[slot(y)]
                y = y[(load < end_x[0]) | (load == end_x[0]) & (y <= np.uint64(end_x[1]))]
                shared_now = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((num + den) * (shared_now + min(m - len(x), n - len(y))) >= num * (m + n))
            yield pa.RecordBatch.from_arrays(batch.columns[4:], names=batch.schema.names[4:]).filter(pa.array(ok, pa.bool_()))

    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return both.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in ("a", "b", *rest)))


def _fetch(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, sorted set) of the documents in ``ids``, made from their texts again; a Bloom filter keeps the rest back."""
    needed = rows.sparkSession.sparkContext.broadcast(Bloom.of(ids, lambda b: H.to_unsigned(b.column(0).to_numpy())))
    arrays = rows.where("doc_id is not null").mapInArrow(_arrays(needed, width), "id long, d1 long, d2 long, tokens binary")
    return arrays.groupBy("id").agg(F.min(F.struct("d1", "d2", "tokens")).alias("t")).select("id", "t.tokens")


def _arrays(needed, width: int):
    def run(batches):
        for batch in batches:
            hit = needed.value.hits(H.to_unsigned(batch.column(0).to_numpy()))
            batch = batch.filter(pa.array(hit))
            for row, _, values, bounds in _sets(batch, 1, width):
                sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                digests = [pa.array([int(H.mix(f(x)).sum().view(np.int64)) for x in sets], pa.int64()) for f in (lambda x: x, lambda x: x * H.STEP + H.U64(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), *digests, pa.array([x.tobytes() for x in sets], type=pa.binary())], names=["id", "d1", "d2", "tokens"])
        H.release_memory()

    return run


def _across(found: DataFrame, classes: DataFrame, every: bool, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of owners in different classes that pass the filters; unless ``every``, one partner for an entry only."""
    labelled = found.join(classes.withColumnRenamed("node", "owner"), "owner", "left").select("pid", "key", "owner", "size", "place", F.coalesce("component", "owner").alias("class"))
    names = ["a", "b"]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # a group of lists of bounded size
        x = {k: table.column(k).to_numpy().astype(np.int64) for k in ("key", "owner", "size", "place", "class")}
        if not table.num_rows:
            return
        order = np.lexsort((x["place"], x["size"], x["key"]))
        x = {k: v[order] for k, v in x.items()}
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(x["key"])) + 1))
        mixed = np.minimum.reduceat(x["class"], cuts) != np.maximum.reduceat(x["class"], cuts)
        live = np.repeat(mixed, np.diff(np.append(cuts, len(order))))
        x = {k: v[live] for k, v in x.items()}
        if not live.any():
            return
        lists = np.concatenate(([0], np.cumsum(np.diff(x["key"]) != 0)))
        if not every:
            partner = S.leaders(lists, x["size"], x["place"], x["owner"], num, den, x["class"])
            at = np.flatnonzero(partner >= 0)
            if len(at):
                yield pairs(x["owner"][at], x["owner"][partner[at]])
            return
        for i, j in S.walk(lists, x["size"], x["place"], num, den, lambda i, j: x["class"][i] != x["class"][j], _minor(lists, x["class"])):
            yield pairs(x["owner"][i], x["owner"][j])

    return labelled.groupBy("pid").applyInArrow(run, "a long, b long").distinct()


def _minor(lists: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which entries are outside the largest class of their list."""
    order = np.lexsort((classes, lists))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(lists[order]) != 0) | (np.diff(classes[order]) != 0)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order)))
    rank = np.lexsort((n, lists[order][at]))  # of each list the largest class comes last
    last = np.append(np.diff(lists[order][at][rank]) != 0, True)
    largest = np.zeros(len(at), dtype=bool)
    largest[rank[last]] = True
    out = np.empty(len(order), dtype=bool)
    out[order] = ~np.repeat(largest, n)
    return out


def _difference(x: bytes, y: bytes) -> np.ndarray:
    """The symmetric difference of two sorted sets."""
    z = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)]))
    twin = z[1:] == z[:-1]
    keep = np.ones(len(z), dtype=bool)
    keep[1:] &= ~twin
    keep[:-1] &= ~twin
    return z[keep]


def _reach(size_a, size_b, apart, num: int, den: int):
    """Whether sets of these sizes that differ in ``apart`` shingles reach the threshold."""
    inter = (size_a + size_b - apart) // 2
    return den * inter >= num * (size_a + size_b - inter)


def _compare(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, size_a, size_b, apart, linked): pairs with both sets at hand, and how they differ."""
    both = pairs.join(arrays.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(arrays.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            a, b, apart, linked = batch.column(0), batch.column(1), [], []
            sizes = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                d = _difference(x, y)
                apart.append(d.tobytes())
                sizes[0].append(len(x) // 8)
                sizes[1].append(len(y) // 8)
                linked.append(_reach(len(x) // 8, len(y) // 8, len(d), num, den))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sizes[0], pa.int32()), pa.array(sizes[1], pa.int32()), pa.array([d if 3 * len(d) <= 8 * s else None for d, s in zip(apart, sizes[0], strict=True)], pa.binary()), pa.array(linked, pa.bool_())], names=["a", "b", "size_a", "size_b", "apart", "linked"])

    return both.mapInArrow(run, "a long, b long, size_a int, size_b int, apart binary, linked boolean")


def _derive(pairs: DataFrame, compared: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) among ``pairs`` whose sets were both compared with one leader: their differences to it tell them apart.

    And the other pairs, which need their sets.
    """
    known = compared.where("apart is not null").select(F.col("a").alias("id"), F.col("b").alias("leader"), F.col("size_a").alias("size"), "apart")
    side = lambda s: known.select(*[F.col(c).alias(f"{c}_{s}") for c in known.columns])
    looked = pairs.join(side("a"), F.col("a") == F.col("id_a"), "left").join(side("b"), F.col("b") == F.col("id_b"), "left")
    same = F.coalesce(F.col("leader_a") == F.col("leader_b"), F.lit(False))

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = [bool(_reach(int(p), int(q), len(_difference(x, y)), num, den)) for p, q, x, y in zip(*sizes, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    near = looked.where(same).select("a", "b", "size_a", "size_b", "apart_a", "apart_b").mapInArrow(run, "u long, v long")
    return near, looked.where(~same).select("a", "b")

"""Line dedup by an exact set-similarity join.

A line's set holds its distinct words. A line goes if an earlier line, by (doc_id, place in the document), has a set with
Jaccard >= num / den; whether that earlier line itself stays does not matter. Lines without words always stay.

1. Lines of one set: the first stays. A task remembers sets that it has seen lately and ships a line of such a set as a
   number only, so a line that makes up a third of all rows has one index entry a task.
2. Other lines: words are ordered by rarity; the prefix index (``set_index``) applies the prefix, length and positional
   filters, and a parity bitmap (64 bits, 256 for long lines) bounds how many words two lines can share. In each list a line
   first tries the earliest line of all, else of its size, else of the next smaller one, which takes one pass over the list. Lines that
   pass the filters with it are settled for now; only the others are walked against the whole list, each naming its earliest
   candidate. The best-named candidate of a line is verified exactly, then the others that lists have named; only for lines that
   fail them all are all candidates listed and verified. So thousands of lines that are alike cost one pass; lines of a list that are not alike cost a walk.

Entries of words that are too rare to fill a list go to their lists at once. Those of other words are kept aside, counted by list,
and dealt then, as lists are cut at a fixed length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlode.llm import hashing as H
from sessionlode.llm import set_index as S
from sessionlode.llm.scratch import Scratch, small_batches
from sessionlode.llm.ngram_join import list_lengths
from sessionlode.llm.sketches import Bloom, frequencies, slot

NUM, DEN = 8, 10
ENTRIES_A_LIST_GROUP = 250_000
#: Sets that a task remembers.
SEEN_BITS = 16
#: Index entries that a task gathers before it packs them by group.
GATHERED = 200_000
#: Lines of more words carry a bitmap of 256 bits instead of 64.
LONG = 96
WIDE = ("w1", "w2", "w3")
ENTRY = {"key": "uint64", "doc": "int64", "line": "int32", "size": "int32", "place": "int32", "bits": "uint64"}
LONG_ENTRY = ENTRY | {w: "uint64" for w in WIDE}
NONE = np.iinfo(np.int64).max


def _lines(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line starts (with the end appended), each line's row, and its place in the row, from 0."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate((np.arange(len(starts) - 1), np.searchsorted(starts, breaks, side="right") - 1))
    start = np.concatenate((starts[:-1], breaks + 1))
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.searchsorted(row, np.arange(len(starts) - 1))
    return np.append(start, len(data)), row, (np.arange(len(row)) - first[row]).astype(np.int32)


def _line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return H.mix(H.to_unsigned(doc)) + line.astype(np.uint64) * H.STEP


def _doc_key(doc: np.ndarray) -> np.ndarray:
    return H.mix(H.to_unsigned(doc)) ^ H.STEP


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Of rows (doc, line): the keys of the lines and of their documents."""
    doc, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return np.concatenate([_line_key(doc, line), _doc_key(doc)])


def _word_slices(batch: pa.RecordBatch):
    for _, data, starts in H.text_slices(batch.column(0)):
        yield H.word_hashes(data, starts)[0]


def _prefixes(values: np.ndarray, bounds: np.ndarray, counts: np.ndarray, num: int, den: int):
    """(index into values, row, place) of all rows' prefixes in the global order, by frequency, then by value."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    load = np.minimum(counts[slot(values)], (1 << 40) - 1).astype(np.uint64)
    order = np.argsort((row.astype(np.uint64) << H.U64(40)) | load, kind="stable")
    place = np.arange(len(values)) - bounds[row]
    keep = place < S.prefix_size(sizes, num, den)[row]
    return order[keep], row[keep], place[keep]


#: Index entries that are kept aside, with their whole token.
RAW = {k: v for k, v in ENTRY.items() if k != "key"} | {"token": "uint64"}
RAW_LONG = RAW | {w: "uint64" for w in WIDE}


class _Seen:
    """A table of fixed size of the sets seen lately, with the first line of each."""

    def __init__(self):
        n = 1 << SEEN_BITS
        self.d1, self.d2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.doc, self.line = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int32)

    def fresh(self, d1: np.ndarray, d2: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lines that are the first of their set so far, lines that come after another of their set), as indices."""
        order = np.lexsort((line, doc, d2, d1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
        head = order[new]
        of = head[np.cumsum(new) - 1]  # for each line in this order the first of its set
        gone = order[(doc[order] != doc[of]) | (line[order] != line[of])]
        at = (d1[head] & H.U64((1 << SEEN_BITS) - 1)).astype(np.int64)
        known = (self.line[at] >= 0) & (self.d1[at] == d1[head]) & (self.d2[at] == d2[head])
        past_doc, past_line = self.doc[at], self.line[at]
        older = known & ((past_doc < doc[head]) | (past_doc == doc[head]) & (past_line < line[head]))
        same = known & (past_doc == doc[head]) & (past_line == line[head])
        first = head[~older & ~same]
        at = at[~older & ~same]
        self.d1[at], self.d2[at], self.doc[at], self.line[at] = d1[first], d2[first], doc[first], line[first]
        return np.sort(first), np.concatenate([gone, head[older]])


def _key(tokens: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of lists, and list in it."""
    return (tokens % H.U64(groups)).astype(np.int32), (tokens // H.U64(groups)) & H.U64(0xFFFFFFFF)


def _index(shared, groups: int, aside: int, heavy: int, num: int, den: int):
    """Rows (pid, kind, block): lines that repeat an earlier set, first lines of sets, and index entries of the latter.

    The groups of lists from ``groups`` on, ``aside`` of them, hold entries of words that occur more than ``heavy`` times.
    """

    def block(pid, kind, **columns):
        order = np.argsort(pid, kind="stable")
        pid = pid[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(pid)) + 1))
        ends = np.append(starts[1:], len(pid))
        blocks = [S.pack(**{k: v[order[s:e]] for k, v in columns.items()}) for s, e in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(pid[starts].astype(np.int32)), pa.array([kind] * len(blocks), pa.string()), pa.array(blocks, pa.binary())], names=["pid", "kind", "block"])

    def flush(gathered):
        for kind, parts in gathered.items():
            if parts:
                pid, columns = zip(*parts, strict=True)
                yield block(np.concatenate(pid), kind, **{k: np.concatenate([c[k] for c in columns]) for k in columns[0]})
                parts.clear()

    def run(batches):
        counts, seen = shared.value, _Seen()
        gathered: dict[str, list] = {k: [] for k in ("gone", "set", "entry", "long", "raw entry", "raw long")}
        held = 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            for at, data, starts in H.text_slices(batch.column(1)):
                if held >= GATHERED:
                    yield from flush(gathered)
                    held = 0
                line_starts, row, place = _lines(data, starts)
                values, bounds = H.distinct_in_rows(*H.word_hashes(data, line_starts))
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                once, twice = H.mix(values), H.mix(values * H.STEP + H.U64(1))
                d1, d2 = np.add.reduceat(once, bounds[full]), np.add.reduceat(twice, bounds[full])
                doc, line = ids[at + row[full]], place[full]
                fresh, gone = seen.fresh(d1, d2, doc, line)
                if len(gone):
                    gathered["gone"].append(((_line_key(doc[gone], line[gone]) % H.U64(groups)).astype(np.int32), {"doc": doc[gone], "line": line[gone]}))
                    held += len(gone)
                if not len(fresh):
                    continue
                gathered["set"].append(((d1[fresh] % H.U64(groups)).astype(np.int32), {"d1": d1[fresh], "d2": d2[fresh], "doc": doc[fresh], "line": line[fresh]}))
                sizes = np.diff(bounds)
                mask = np.zeros(len(sizes), dtype=bool)
                mask[full[fresh]] = True
                values = values[np.repeat(mask, sizes)]
                sizes = sizes[full[fresh]]
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                one = H.U64(1) << (values & H.U64(63))
                bits = np.bitwise_xor.reduceat(one, bounds[:-1])
                word = (values >> H.U64(6)) & H.U64(3)
                wide = [np.bitwise_xor.reduceat(np.where(word == H.U64(k), one, H.U64(0)), bounds[:-1]) for k in (1, 2, 3)]
                index, of, rank = _prefixes(values, bounds, counts, num, den)
                tokens, long = values[index], sizes[of] > LONG
                often = counts[slot(tokens)] > heavy
                for kind, some in (("entry", ~long & ~often), ("long", long & ~often), ("raw entry", ~long & often), ("raw long", long & often)):
                    some = np.flatnonzero(some)
                    if len(some):
                        o = of[some]
                        if kind.startswith("raw"):
                            pid, key = (groups + H.mix(tokens[some] ^ d1[fresh][o]) % H.U64(aside)).astype(np.int32), {"token": tokens[some]}
                        else:
                            pid, key = _key(tokens[some], groups)
                            key = {"key": key}
                        more = {w: b[o] for w, b in zip(WIDE, wide, strict=True)} if kind.endswith("long") else {}
                        gathered[kind].append((pid, key | {"doc": doc[fresh][o], "line": line[fresh][o], "size": sizes[o], "place": rank[some], "bits": bits[o]} | more))
                        held += len(some)
        yield from flush(gathered)
        H.release_memory()

    return run


def _tokens(batch: pa.RecordBatch):
    for block in batch.column(0).to_pylist():
        yield S.unpack([block], {"token": "uint64"})["token"]


def _deal(lengths, groups: int):
    """Index entries to their lists: rows (pid, kind, block) for blocks of entries (kind, block)."""

    def flush(kind, blocks):
        x = S.unpack(blocks, RAW_LONG if kind == "long" else RAW)
        keys, index = S.spread(x.pop("token"), _line_key(x["doc"], x["line"]), lengths.value)
        pid, keys = _key(keys, groups)
        order = np.argsort(pid, kind="stable")
        keys, index, pid = keys[order], index[order], pid[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(pid)) + 1))
        ends = np.append(starts[1:], len(pid))
        x = {k: v[index] for k, v in x.items()}
        packed = [S.pack(key=keys[s:e], **{k: v[s:e] for k, v in x.items()}) for s, e in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(pid[starts]), pa.array([kind] * len(packed), pa.string()), pa.array(packed, pa.binary())], names=["pid", "kind", "block"])

    def run(batches):
        held: dict[str, list[bytes]] = {"entry": [], "long": []}
        for batch in batches:
            for kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = kind.removeprefix("raw ")
                held[kind].append(block)
                if sum(map(len, held[kind])) >= GATHERED * 16:
                    yield flush(kind, held[kind])
                    held[kind] = []
        for kind, blocks in held.items():
            if blocks:
                yield flush(kind, blocks)
        H.release_memory()

    return run


def _sorted(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the entries by list, size and place; gives their lists and the age of each entry's line."""
    order = np.lexsort((x["place"], x["size"], x["key"]))
    for k in x:
        x[k] = x[k][order]
    lists = np.concatenate(([0], np.cumsum(x["key"][1:] != x["key"][:-1]))) if len(order) else np.zeros(0, dtype=np.int64)
    oldest = np.lexsort((x["line"], x["doc"]))
    age = np.empty(len(order), dtype=np.int64)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(x["doc"][oldest]) != 0) | (np.diff(x["line"][oldest]) != 0)
    age[oldest] = np.cumsum(new)
    return lists, age


def _filter(x: dict[str, np.ndarray], age: np.ndarray, num: int, den: int):
    """What the bitmaps say of pairs of entries."""
    size, bits = x["size"].astype(np.int64), x["bits"]
    first = bits ^ x["w1"] ^ x["w2"] ^ x["w3"]
    words = [first, *(x[w] for w in WIDE)]

    def keep(i, j):
        apart = size[i] + size[j] - 2 * S.required(size[i], size[j], num, den)
        ok = (np.bitwise_count(bits[i] ^ bits[j]) <= apart) & (age[i] != age[j])
        both = np.flatnonzero(ok & (size[i] > LONG) & (size[j] > LONG))
        if len(both):
            a, b = i[both], j[both]
            ok[both] = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words) <= apart[both]
        return ok

    return keep


def _walk(x: dict[str, np.ndarray], lists: np.ndarray, age: np.ndarray, keep, wanted: np.ndarray, num: int, den: int):
    """Pairs (later, earlier) that pass all filters, with the later one in ``wanted``."""

    def late(i, j):
        return wanted[np.where(age[i] > age[j], i, j)]

    def both(i, j):
        ok = late(i, j)
        ok[ok] = keep(i[ok], j[ok])
        return ok

    for i, j in S.walk(lists, x["size"].astype(np.int64), x["place"].astype(np.int64), num, den, both, wanted):
        yield np.where(age[i] > age[j], i, j), np.where(age[i] > age[j], j, i)


_found = "kind string, doc long, line int, to_doc long, to_line int, more boolean, pid int, block binary"


def _found_table(kind, doc=None, line=None, to_doc=None, to_line=None, more=None, pid=None, block=None):
    n = len(doc) if doc is not None else len(block)
    fill = lambda v, t: pa.nulls(n, t) if v is None else pa.array(v, t)
    return pa.table([pa.array([kind] * n, pa.string()), fill(doc, pa.int64()), fill(line, pa.int32()), fill(to_doc, pa.int64()), fill(to_line, pa.int32()), fill(more, pa.bool_()), fill(pid, pa.int32()), fill(block, pa.binary())], names=[c.split()[0] for c in _found.split(", ")])


def _lists(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        pid, out = table.column("pid")[0].as_py(), []
        parts: dict[str, list[bytes]] = {"gone": [], "set": [], "entry": [], "long": []}
        for kind, block in zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), strict=True):
            if kind.startswith("raw"):
                out.append(_found_table(kind, pid=[pid], block=[block]))
            else:
                parts[kind].append(block)
        x = S.unpack(parts["gone"], {"doc": "int64", "line": "int32"})
        out.append(_found_table("gone", x["doc"], x["line"]))
        x = S.unpack(parts["set"], {"d1": "uint64", "d2": "uint64", "doc": "int64", "line": "int32"})
        order = np.lexsort((x["line"], x["doc"], x["d2"], x["d1"]))
        x = {k: v[order] for k, v in x.items()}
        if len(order):
            new = np.ones(len(order), dtype=bool)
            new[1:] = (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (x["doc"] != x["doc"][head]) | (x["line"] != x["line"][head])
            out.append(_found_table("gone", x["doc"][late], x["line"][late]))
        x, y = S.unpack(parts["entry"], ENTRY), S.unpack(parts["long"], LONG_ENTRY)
        x |= {w: np.zeros(len(x["key"]), dtype=np.uint64) for w in WIDE}
        x = {k: np.concatenate([x[k], y[k]]) for k in LONG_ENTRY}
        _, inverse, many = np.unique(x["key"], return_inverse=True, return_counts=True)
        x = {k: v[many[inverse] > 1] for k, v in x.items()}
        lists, age = _sorted(x)
        size, place = x["size"].astype(np.int64), x["place"].astype(np.int64)
        keep = _filter(x, age, num, den)
        to = S.leaders(lists, size, place, age, num, den, None, lambda i, j: (age[j] < age[i]) & keep(i, j))
        at = np.flatnonzero(to >= 0)
        settled = np.zeros(len(age), dtype=bool)
        settled[at] = True
        # A list of two has no other candidate than the one tried.
        length = np.bincount(lists)[lists] if len(lists) else lists
        out.append(_found_table("near", x["doc"][at], x["line"][at], x["doc"][to[at]], x["line"][to[at]], length[at] > 2))
        open_lists = np.zeros(int(lists[-1]) + 1 if len(lists) else 0, dtype=bool)
        open_lists[lists[at[length[at] > 2]]] = True
        first, n = np.full(len(age), NONE), np.zeros(len(age), dtype=np.int64)
        for late, early in _walk(x, lists, age, keep, ~settled, num, den):
            np.minimum.at(first, late, age[early])
            n += np.bincount(late, minlength=len(n))
        at = np.flatnonzero(n)
        by_age = np.zeros(int(age.max(initial=0)) + 1, dtype=np.int64)
        by_age[age] = np.arange(len(age))
        to = by_age[first[at]]
        out.append(_found_table("near", x["doc"][at], x["line"][at], x["doc"][to], x["line"][to], n[at] > 1))
        open_lists[lists[n > 1]] = True
        stay = S.reachable(lists, size, place, num, den) & open_lists[lists] if len(lists) else settled
        if stay.any():
            out.append(_found_table("open", pid=[pid], block=[S.pack(**{k: v[stay] for k, v in x.items()})]))
        return pa.concat_tables(out)

    return run


def _more(hits, num: int, den: int):
    """All candidates of the lines that ``hits`` names."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                x = S.unpack([block], LONG_ENTRY)
                lists, age = _sorted(x)
                wanted = hits.value.hits(_line_key(x["doc"], x["line"]))
                for late, early in _walk(x, lists, age, _filter(x, age, num, den), wanted, num, den):
                    once = np.unique(age[late] * len(age) + age[early], return_index=True)[1]  # two lines can meet in several lists
                    late, early = late[once], early[once]
                    yield pa.RecordBatch.from_arrays([pa.array(x["doc"][late]), pa.array(x["line"][late]), pa.array(x["doc"][early]), pa.array(x["line"][early])], names=["doc", "line", "to_doc", "to_line"])

    return run


def _arrays(needed):
    """(doc, line, sorted word fingerprints) of the lines that the Bloom filter names; other lines are not even hashed, and
    documents without such lines are not looked into."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(needed.value.hits(_doc_key(batch.column(0).to_numpy()))))
            ids = batch.column(0).to_numpy()
            for at, data, starts in H.text_slices(batch.column(1)):
                line_starts, row, place = _lines(data, starts)
                doc = ids[at + row]
                want = np.flatnonzero(needed.value.hits(_line_key(doc, place)))
                if not len(want):
                    continue
                begin, end = line_starts[want], line_starts[want + 1]
                part = np.concatenate([data[b:e] for b, e in zip(begin, end, strict=True)])
                values, bounds = H.distinct_in_rows(*H.word_hashes(part, np.concatenate(([0], np.cumsum(end - begin)))))
                yield pa.RecordBatch.from_arrays([pa.array(doc[want]), pa.array(place[want]), pa.array([values[b:e].tobytes() for b, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc", "line", "words"])
        H.release_memory()

    return run


def _verify(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line) of the pairs (doc, line, to_doc, to_line) that reach the threshold."""
    both = pairs.join(arrays.withColumnRenamed("words", "x"), ["doc", "line"]).join(arrays.select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("y")), ["to_doc", "to_line"])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sides = [np.frombuffer(b"".join(c), dtype=np.uint64) for c in (batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            sizes = [np.array([len(v) // 8 for v in batch.column(k).to_pylist()], dtype=np.int64) for k in (2, 3)]
            owner = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
            words = np.concatenate(sides)
            order = np.lexsort((words, owner))
            words, owner = words[order], owner[order]
            twin = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
            inter = np.bincount(owner[1:][twin], minlength=n)
            ok = den * inter >= num * (sizes[0] + sizes[1] - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc", "line"]).filter(pa.array(ok))

    return both.select("doc", "line", "x", "y").mapInArrow(run, "doc long, line int")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, line): the lines of ``docs`` that match an earlier one; line counts the \\n-separated lines from 0.

    Rows without a doc_id, and null or empty texts, have no such lines. Rows that repeat a doc_id count as one document:
    equal lines at one place are one line. Whole texts are read, a very long one or a very long line in pieces. Other
    columns, whatever their names, are not looked at. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _repeated_lines(docs, doc_id, text, num, den, Scratch(docs.sparkSession, "line-dedup"))


def _repeated_lines(docs: DataFrame, doc_id: str, text: str, num: int, den: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    counts = frequencies(rows.select("text"), _word_slices)
    share, fields = spark.sparkContext.broadcast, "pid int, kind string, block binary"
    entries = lambda load: int(load) * (den - num) // den // ENTRIES_A_LIST_GROUP
    groups = max(2 * spark.sparkContext.defaultParallelism, entries(counts.sum()))
    often = counts > S.HEAVY
    aside = max(2 * spark.sparkContext.defaultParallelism, entries(counts[often].sum()))
    indexed = rows.mapInArrow(_index(share(counts), groups, aside, S.HEAVY, num, den), fields)
    found = scratch.table(indexed.groupBy("pid").applyInArrow(_lists(num, den), _found), "found", wide=True)
    if often.any():
        raw = found.where("kind in ('raw entry', 'raw long')")
        lengths, groups = list_lengths(raw.select("block"), _tokens, ENTRIES_A_LIST_GROUP)
        dealt = raw.select("kind", "block").mapInArrow(_deal(lengths, groups), fields)
        more = scratch.table(dealt.groupBy("pid").applyInArrow(_lists(num, den), _found), "found-often", wide=True)
        found = found.where("kind not in ('raw entry', 'raw long')").unionByName(more)

    gone = found.where("kind = 'gone'").select("doc", "line")
    near = found.where("kind = 'near'").join(gone, ["doc", "line"], "left_anti")
    named = near.select(F.inline(F.array(F.struct("doc", "line"), F.struct(F.col("to_doc").alias("doc"), F.col("to_line").alias("line")))))
    votes = near.groupBy("doc", "line", "to_doc", "to_line").agg(F.count("*").alias("n"), F.bool_or("more").alias("more"))
    best = scratch.table(
        votes.groupBy("doc", "line").agg(F.max(F.struct("n", (-F.col("to_doc")).alias("d"), (-F.col("to_line")).alias("l"))).alias("top"), (F.bool_or("more") | (F.count("*") > 1)).alias("more"))
        .select("doc", "line", (-F.col("top.d")).alias("to_doc"), (-F.col("top.l")).alias("to_line"), "more"),
        "best",
    )
    arrays = scratch.hold(rows.mapInArrow(_arrays(share(Bloom.of(named, _keys))), "doc long, line int, words binary").dropDuplicates(["doc", "line"]))
    matched = scratch.table(_verify(best.drop("more"), arrays, num, den), "matched")

    pair = ["doc", "line", "to_doc", "to_line"]
    left = best.where("more").join(matched, ["doc", "line"], "left_anti").select("doc", "line", F.col("to_doc").alias("tried_doc"), F.col("to_line").alias("tried_line"))
    left = scratch.table(left, "left")
    # Then what other lists have named, and only for lines that fail that as well all candidates.
    second = near.join(left, ["doc", "line"]).where("to_doc <> tried_doc or to_line <> tried_line").select(*pair).distinct()
    again = scratch.table(_verify(second, arrays, num, den).distinct(), "again")
    left = scratch.table(left.join(again, ["doc", "line"], "left_anti"), "left-again")
    others = found.where("kind = 'open'").select("block").mapInArrow(_more(share(Bloom.of(left.select("doc", "line"), _keys)), num, den), "doc long, line int, to_doc long, to_line int")
    # One row a pair before the join: two lines can meet in several lists.
    others = others.distinct().join(left, ["doc", "line"]).where("to_doc <> tried_doc or to_line <> tried_line").select(*pair)
    others = scratch.table(others, "others")
    extra = Bloom.of(others.select(F.inline(F.array(F.struct("doc", "line"), F.struct(F.col("to_doc").alias("doc"), F.col("to_line").alias("line"))))), _keys)
    more_arrays = rows.mapInArrow(_arrays(share(extra)), "doc long, line int, words binary").dropDuplicates(["doc", "line"])
    late = _verify(others, more_arrays, num, den)
    result = scratch.table(gone.unionByName(matched).unionByName(again).unionByName(late).distinct().select(F.col("doc").alias("doc_id"), "line"), "lines")
    scratch.release()
    scratch.keep_only("lines")
    return result


def _strip(batches):
    """Columns: lines to remove, text, then anything."""
    for batch in batches:
        texts = []
        for lines, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lines:
                gone = set(lines)
                text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array([len(x or ()) for x in batch.column(0).to_pylist()], pa.int32()), pa.array(texts, pa.string()), *batch.columns[2:]], names=batch.schema.names)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the repeated lines in ``text``. All other columns pass through, whatever their names.

    ``drop_emptied``: a document that loses lines and keeps no word goes as well; it repeats earlier documents throughout.
    Null and empty texts stay as they are.
    """
    lines = repeated_lines(docs, doc_id, text, num, den).groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    lines = lines.select(F.col("doc_id").alias("k"), "lines")
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = kept.join(lines, F.col(names[doc_id]).cast("long") == F.col("k"), "left")
    others = [n for c, n in names.items() if c != text]
    sent = joined.select("lines", names[text], *others)
    fields = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    out = sent.mapInArrow(_strip, ", ".join(["lines int", *[f"{n} {fields[n]}" for n in (names[text], *others)]]))
    if drop_emptied:
        out = out.where((F.col("lines") == 0) | F.col(names[text]).rlike(r"[^ \t-\r]"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (long; null text: 0), removed (sorted line numbers from 0), n_removed (long) for each row of ``docs``."""
    lines = repeated_lines(docs, doc_id, text).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.size(F.split(f"`{text}`", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(lines, "doc_id", "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))

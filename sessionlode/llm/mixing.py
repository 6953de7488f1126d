"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal size; time is cut into slots of one block. A source with the weight w gets
the share w / W of each slot, W being the weights of the sources that are not used up yet; so k of its blocks are due at a
time t(k). Block k is released at floor(t(k)) and due at ceil(t(k + 1)). In each slot the released block with the earliest
deadline runs. The shares add up to 1, so every block meets its deadline, and at any time of the whole mix, before and after
sources run out, a source is less than one block away from its share. All times come from the weights as given, in whole
numbers of any length, so nothing is rounded but release and deadline. No document is dropped or repeated.

The driver knows the sources, goes through the slots once (some microseconds a block) and keeps 8 bytes for each block;
documents meet the slots of their blocks in a join. ``block`` should grow with the mix: 10 million blocks take about a minute.

Native: SQL functions, one shuffle of the documents by (source, hash range). No task holds a source: a source's documents
are ranked within hash ranges of about a thousand, whose sizes are then summed up.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: Blocks of a source in a row of the table of slots.
PERIOD = 4096
#: A table of slots for more blocks than that is not broadcast.
BROADCAST_BLOCKS = 4_000_000
MAX_STREAMS = 256
RANGE_ROWS = 1024
PLACES = ("mix_block", "mix_slot", "mix_position")


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    ratios = [w.as_integer_ratio() for w in weights]
    scale = max((q for _, q in ratios), default=1)  # all are powers of two
    out = [p * (scale // q) for p, q in ratios]
    common = math.gcd(*out) or 1
    return [x // common for x in out]


def timetable(weights: list[float], blocks: list[int]) -> list[array]:
    """For each source the slots of its blocks, by earliest deadline first."""
    w = whole(weights)
    slots = [array("q") for _ in blocks]
    live = sorted((s for s, n in enumerate(blocks) if n), key=lambda s: Fraction(blocks[s], w[s]))  # in the order in which they run out
    ends = [blocks[s] / w[s] for s in live]
    done, loads = [0], [sum(w[s] for s in live)]  # before each of these ends: blocks of those that have run out, weights of the others
    for s in live:
        done.append(done[-1] + blocks[s])
        loads.append(loads[-1] - w[s])

    def due(s: int, k: int) -> int:
        """t(k), times w[s]."""
        at = min(bisect_left(ends, k / w[s]), len(live) - 1)
        while at and blocks[live[at - 1]] * w[s] > k * w[live[at - 1]]:
            at -= 1
        while blocks[live[at]] * w[s] < k * w[live[at]]:
            at += 1
        return done[at] * w[s] + k * loads[at]

    waiting = [(0, s) for s in sorted(live)]  # (release, source)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, release of its next block)
    for now in range(done[-1]):
        while waiting and waiting[0][0] <= now:
            _, s = heapq.heappop(waiting)
            t = due(s, len(slots[s]) + 1)
            heapq.heappush(ready, (-(-t // w[s]), s, t // w[s]))
        _, s, release = heapq.heappop(ready)
        slots[s].append(now)
        if len(slots[s]) < blocks[s]:
            heapq.heappush(waiting, (release, s))
    return slots


def phases(weights: list[float], blocks: list[int], period: int = PERIOD) -> list[tuple[int, int, int, int, int, int, array]]:
    """Rows (stream, first block, end block, first slot, blocks, slots, slot of each block from the first on) of the whole
    schedule. A row has ``period`` blocks of its stream, the last one what is left.
    """
    rows = []
    for s, at in enumerate(timetable(weights, blocks)):
        for first in range(0, len(at), period):
            part = at[first : first + period]
            rows.append((s, first, first + len(part), part[0], len(part), part[-1] - part[0] + 1, array("q", [x - part[0] for x in part])))
    return rows


def tied(docs: DataFrame) -> Column:
    """A hash of all columns but maps and variants: the order of rows that share a doc_id."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if c not in PLACES and "map<" not in kind and "variant" not in kind])


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, period: int = PERIOD, max_streams: int = MAX_STREAMS, tie: str | None = None) -> DataFrame:
    """``docs`` with the columns mix_block, mix_slot and mix_position (long; columns of these names are replaced).

    mix_slot counts blocks over the whole mix, mix_block within the source; mix_position orders documents (slot * block +
    place in the block). Within a source the order is by a hash of doc_id, or of the row where that is null. ``weights``: target weights by source; without
    them, the square root of a source's documents. Every source that occurs and has a positive weight is a stream of its own,
    however many there are; their table is broadcast up to ``max_streams`` sources, beyond that Spark chooses by its size.
    Only a null source and sources without a positive weight, which have no target, share one stream, in the same hash
    order, with the least weight of the others.
    Every row comes back once; repeated rows and rows without a doc_id keep places of their own, in the order of the
    column ``tie`` (without one, of ``tied``), so the same rows always get the same places. An empty table stays empty.
    """
    spark = docs.sparkSession
    names = {c: f"c{k}" for k, c in enumerate(c for c in docs.columns if c not in PLACES)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *([] if tie else [tied(docs).alias("mix_tie")]))
    id_col, source_col = F.col(names[doc_id]), F.col(names[source]).cast("string")
    sizes = rows.groupBy(source_col.alias("source")).count().toArrow()
    sizes = list(zip(sizes.column("source").to_pylist(), sizes.column("count").to_pylist(), strict=True))
    if weights is None:
        loads = {name: math.sqrt(n) for name, n in sizes if name is not None}
    else:
        loads = {str(k): float(v) for k, v in weights.items() if v > 0}
    own = sorted(((name, n, loads[name]) for name, n in sizes if name in loads), key=lambda x: (-x[2], -x[1], x[0]))
    other = sum(n for name, n in sizes if name not in loads)
    counts, loads = [n for _, n, _ in own] + [other], [w for _, _, w in own] + [min((w for _, _, w in own), default=1.0)]
    plan = phases(loads, [-(-n // block) for n in counts], period)

    bits = [max(0, (n // RANGE_ROWS).bit_length()) for n in counts]
    streams = spark.createDataFrame(pa.table({"mix_source": pa.array([name for name, _, _ in own], pa.string()), "stream": pa.array(range(len(own)), pa.int32()), "bits": pa.array(bits[:-1], pa.int32())}))
    if len(own) <= max_streams:
        streams = F.broadcast(streams)
    rows = rows.withColumn("mix_h", F.when(id_col.isNull(), F.xxhash64(F.col(names[tie]) if tie else "mix_tie")).otherwise(F.xxhash64(id_col)))
    rows = rows.join(streams, source_col == F.col("mix_source"), "left").drop("mix_source")
    rows = rows.withColumn("stream", F.coalesce("stream", F.lit(len(own)))).withColumn("bits", F.coalesce("bits", F.lit(bits[-1])))
    rows = rows.withColumn("range", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(mix_h, 64 - bits)"))).drop("bits")

    ranges = rows.groupBy("stream", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stream").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("stream", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("stream", "range").orderBy("mix_h", id_col, F.col(names[tie]) if tie else "mix_tie")
    ranked_rows = rows.withColumn("rank", F.row_number().over(within) - 1).join(ranges, ["stream", "range"]).withColumn("rank", F.col("rank") + F.col("offset")).drop("offset", "range", "mix_h")
    ranked_rows = ranked_rows.withColumn("mix_block", F.expr(f"rank div {int(block)}"))

    lots = pa.table({"stream": pa.array([r[0] for r in plan], pa.int32()), "lot": pa.array([r[1] // period for r in plan], pa.int64()), "base": pa.array([r[3] for r in plan], pa.int64()), "slots": pa.array([np.frombuffer(r[6], dtype=np.int64) for r in plan], pa.list_(pa.int64()))})
    table = spark.createDataFrame(lots)
    if sum(r[4] for r in plan) <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    placed = ranked_rows.withColumn("lot", F.expr(f"mix_block div {int(period)}")).join(table, ["stream", "lot"])
    slot = F.col("base") + F.get("slots", (F.col("mix_block") % int(period)).cast("int"))
    placed = placed.withColumn("mix_slot", slot.cast("long")).withColumn("mix_position", F.col("mix_slot") * block + F.col("rank") % block)
    return placed.select(*[F.col(n).alias(c) for c, n in names.items()], "mix_block", "mix_slot", F.col("mix_position").cast("long").alias("mix_position"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` in the order of the mix, as a range-partitioned sort by position; the columns stay as they are."""
    return schedule(docs, **settings).orderBy("mix_position").select(*[c for c in docs.columns if c not in PLACES])

"""Variable-capacity best-fit packing over the histogram of lengths.

Pieces of one length are interchangeable, so best-fit decreasing is run on counts by length: a table of at most
max(capacities) rows, whatever the corpus. When no open bin holds a piece, the size is opened whose cost a token is
least once it is filled from the lengths still to come. The sizes that may be opened are chosen jointly: a plan is made
for every run of neighbouring sizes, all are downsized to the permitted sizes, and the one of least total cost stays. It
says how many bins take how many pieces of each length; the pieces are then ranked within their length in parallel and
look their bin up by rank.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import cut

#: Permitted sequence lengths, and what opening a bin costs beside its capacity.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 16
#: Pieces of one length are ranked in parts of about so many, out of at most 2**SALT_BITS parts.
PART_PIECES, SALT_BITS = 1 << 17, 20


@dataclass
class Group:
    """Bins first .. first + count - 1, all with the same capacity and the same room left."""

    first: int
    count: int
    capacity: int
    room: int


@dataclass
class Plan:
    """For each length, runs (rank of the first piece, first bin, pieces a bin, offset in the bin); groups of like bins."""

    runs: dict[int, list[tuple[int, int, int, int]]]
    bin_first: np.ndarray
    bin_count: np.ndarray
    bin_capacity: np.ndarray
    bin_used: np.ndarray


def opening_capacity(length: int, shorter: list[tuple[int, int]], capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity that costs least a token when it is opened for pieces of ``length``; ties: the larger.

    It takes as many of these as fit, then the lengths still to come, ``shorter`` (ascending, with their counts),
    longest first; its cost is that of the capacity plus ``overhead``.
    """

    def rate(capacity: int) -> float:
        room, at = capacity % length, len(shorter)
        while room and (at := bisect_right(shorter, (room, float("inf")), 0, at)):
            at -= 1
            n, count = shorter[at]
            room -= min(count, room // n) * n
        return (capacity + overhead) / (capacity - room)

    return min((c for c in capacities if c >= length), key=lambda c: (rate(c), -c))


def best_fit_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The plan of least cost over every run of neighbouring capacities that holds the longest piece; ties: more and larger ones."""
    sizes = tuple(sorted(capacities))
    longest = max(histogram, default=1)
    runs = [sizes[a:b] for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1) if sizes[b - 1] >= longest]
    runs.sort(key=lambda r: (-len(r), -r[-1]))
    return min((_best_fit(histogram, run, sizes, overhead) for run in runs), key=lambda p: plan_cost(p, overhead))


def plan_cost(plan: Plan, overhead: int) -> int:
    return int(((plan.bin_capacity + overhead) * plan.bin_count).sum())


def _best_fit(histogram: dict[int, int], opened: tuple[int, ...], sizes: tuple[int, ...], overhead: int) -> Plan:
    """Best-fit decreasing on counts. A piece goes to the bin with the least room that still holds it; of bins with
    the same room to the one of the larger capacity, then to the one opened first."""
    rooms: list[int] = []  # sorted, distinct
    groups: dict[int, list[Group]] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    closed: list[Group] = []
    bins = 0
    lengths = sorted(histogram.items())

    def put(group: Group) -> None:
        if not group.room:
            closed.append(group)
            return
        if group.room not in groups:
            insort(rooms, group.room)
            groups[group.room] = []
        insort(groups[group.room], group, key=lambda g: (g.capacity, -g.first))

    for k, (length, left) in reversed(list(enumerate(lengths))):
        rank = 0
        out = runs.setdefault(length, [])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                stack = groups[rooms[at]]
                group = stack.pop()
                if not stack:
                    del groups[rooms.pop(at)]
            else:
                capacity = opening_capacity(length, lengths[:k], opened, overhead)
                count = -(-left // (capacity // length))
                group = Group(bins, count, capacity, capacity)
                bins += count
            each = group.room // length
            full = min(group.count, left // each)
            offset = group.capacity - group.room
            if full:
                out.append((rank, group.first, each, offset))
                rank, left = rank + full * each, left - full * each
                put(Group(group.first, full, group.capacity, group.room - each * length))
            if full < group.count:
                rest = Group(group.first + full, group.count - full, group.capacity, group.room)
                if left:  # fewer than one bin takes
                    out.append((rank, rest.first, left, offset))
                    put(Group(rest.first, 1, rest.capacity, rest.room - left * length))
                    rest = Group(rest.first + 1, rest.count - 1, rest.capacity, rest.room)
                    left = 0
                if rest.count:
                    put(rest)
    done = sorted([g for stack in groups.values() for g in stack] + closed, key=lambda g: g.first)
    used = np.array([g.capacity - g.room for g in done], np.int64)
    permitted = np.array(sizes, np.int64)
    return Plan(
        runs, np.array([g.first for g in done], np.int64), np.array([g.count for g in done], np.int64),
        permitted[np.searchsorted(permitted, used)] if done else used, used,
    )


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length: words and one end mark, cut into pieces of at most ``largest``."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")) + 1
    return (
        docs.select(F.col("doc_id").cast("bigint"), n.cast("bigint").alias("n"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {largest})")))
        .select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("length"))
    )


def best_fit_pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, capacity, bin_used, bin_offset.

    A document's length is its words and one end mark; the part of a document beyond the largest capacity goes
    into further pieces, so no token is lost, however long a text is. Null and empty texts have length 1. Repeated
    rows are packed each. No documents give no rows. Other columns are not read, so their names may clash. The plan
    and its look-up tables grow with the largest capacity only; ranks within a length are numbered in parts, as many
    as the number of pieces asks for, and offset by the parts' counts. A piece's bin depends on the documents only.
    """
    spark = docs.sparkSession
    capacities = tuple(sorted(capacities))
    cells = cut(pieces(docs, capacities[-1]).withColumn("salt", F.xxhash64("doc_id", "piece")))
    parts = 1 << min(SALT_BITS, max(6, (cells.count() // PART_PIECES).bit_length()))
    cells = cells.withColumn("salt", F.pmod("salt", F.lit(parts)).cast("int"))
    counts = cells.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(histogram, capacities, overhead))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = cells.withColumn("rank", rank).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("rank") + F.col("before")).alias("rank"))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        table = {n: np.array(r, np.int64).T for n, r in p.runs.items()}
        for part in parts:
            length, rank = part.column(3).to_numpy(), part.column(4).to_numpy()
            bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, start, each, filled = table[int(n)]
                k = np.searchsorted(first, rank[at], "right") - 1
                into = rank[at] - first[k]
                bins[at] = start[k] + into // each[k]
                offset[at] = filled[k] + into % each[k] * n
            g = np.searchsorted(p.bin_first, bins, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array(bins), pa.array(p.bin_capacity[g]), pa.array(p.bin_used[g]), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "bin_id", "capacity", "bin_used", "bin_offset"],
            )

    schema = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id bigint, capacity bigint, bin_used bigint, bin_offset bigint"
    return ranked.mapInArrow(place, schema)

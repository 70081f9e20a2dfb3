"""Best-fit packing by linear grouping.

Documents become token sequences (their ids and an end id); longer ones are cut
into pieces of exactly ``capacity``, the first piece taking what is left over.
Pieces are then packed into as few sequences of ``capacity`` as possible:

1. *Linear grouping.* Pieces above ``small`` tokens are ordered by length and
   dealt into groups of equal cardinality; each is rounded up to the largest
   length of its group, so few sizes remain.
2. *Few-size configurations.* Over those sizes the cutting-stock relaxation is
   solved by column generation: a column is a multiset of sizes that fits, a
   bounded knapsack finds the next one. The solution is rounded down and the
   remainder goes to step 4 with its own lengths.
3. *Substitution.* Every place of a configuration takes the longest actual
   piece left in its group, which is no longer than the place; the last place
   takes the longest piece of any group that still fits, so that what rounding
   up left free is used.
4. *Best fit.* Small pieces and whatever is left go, longest first, where the
   least room remains; new sequences open only when nothing fits.

All four steps need only how many pieces there are of each length: at most
``capacity`` numbers, whatever the corpus. The driver makes a plan from that
histogram; its rows say "the r-th to s-th pieces of length l go to sequences
q, q+1, ... at offset o". Pieces learn their rank among those of their length
from counts per partition, and find their place by one join.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vocab
from .common import exact, materialize
from .common import pieces as cut_batches

CAPACITY = 2048
END_ID = 0

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_rank", T.LongType()),
    ]
)


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document (doc_id, text).

    A null or empty text is the end id alone. ``part`` and ``part_rank`` number
    the pieces of one length within a task; they mean something only in a
    written table. ``with_ids`` adds the ids themselves.
    Repeated doc_ids are packed as often as they occur.
    """
    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    names = schema.fieldNames()
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "part_rank": pa.int64(), "ids": pa.binary()}
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in cut_batches(batches):
            out: dict[str, list] = {n: [] for n in names}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([vocab.encode_fast(path, text or ""), end])
                first = len(ids) % capacity or capacity
                for k, (s, e) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    raw, n = ids[s:e].tobytes(), e - s
                    for name, x in zip(names, (doc, k, s, n, zlib.crc32(raw), part, seen[n], raw), strict=False):
                        out[name].append(x)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[n]) for n in names], names=names)

    return exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


@dataclass
class Plan:
    """Rows (length, rank from, rank to exclusive, first sequence, offset); sequences in all."""

    runs: list[tuple[int, int, int, int, int]]
    sequences: int
    lower_bound: int


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack over the capacity."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for c in range(smallest, capacity + 1):
        fits = sizes <= c
        got = np.where(fits, value[c - np.where(fits, sizes, 0)] + worth, -1.0)
        k = int(got.argmax())
        if got[k] > value[c - 1] + 1e-12:
            value[c], took[c] = got[k], k
        else:
            value[c], took[c] = value[c - 1], -2
    column, c = np.zeros(len(sizes), np.int64), capacity
    while c >= smallest and took[c] != -1:
        if took[c] == -2:
            c -= 1
        else:
            column[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(value[capacity]), column


def _relaxation(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Column generation for min sum(x) with columns covering ``need``: (column, how often) of the basis.

    The basis holds one column per size; it is kept as a dense matrix, since
    there are few sizes.
    """
    n = len(sizes)
    basis = np.zeros((n, n))
    for i in range(n):
        basis[i, i] = capacity // sizes[i]
    x = need / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        best, column = _best_column(sizes, np.maximum(duals, 0), capacity)
        if best <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        up = step > 1e-11
        if not up.any():
            break
        ratio = np.full(n, np.inf)
        ratio[up] = np.maximum(x[up], 0) / step[up]
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].astype(np.int64), max(0.0, float(x[j]))) for j in range(n)]


#: Shares of the capacity up to which lengths may count as small.
SMALL = (8, 4, 3, 2)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 32, small: int | None = None) -> Plan:
    """The plan for so many pieces of each length; see the module's text for the four steps.

    ``groups``: how many sizes the large lengths are rounded up to. ``small``:
    lengths up to this are left to best fit; by default the shares in SMALL are
    tried, since a plan costs the driver less than a second, and the fewest
    sequences win (of equal plans the one that leaves least to best fit).
    """
    if small is None:
        return min((plan_packing(histogram, capacity, groups, capacity // k) for k in SMALL), key=lambda p: p.sequences)
    histogram = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError("a length is outside 1..capacity")
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0
    #: sequences with room: room -> [first sequence, how many]
    rooms: dict[int, list[list[int]]] = defaultdict(list)

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + count, sequence, offset))
        used[length] += count

    if n := histogram.pop(capacity, 0):
        put(capacity, n, 0, 0)
        made += n
    left = dict(histogram)
    large = sorted(((k, v) for k, v in left.items() if k > small), reverse=True)
    total = sum(v for _, v in large)
    if total:
        # 1. Groups of equal cardinality, longest first; a length is in one group.
        each = -(-total // groups)
        members: list[list[int]] = [[]]
        room = each
        for length, count in large:
            if room <= 0:
                members.append([])
                room = each
            members[-1].append(length)
            room -= count
        by_size = {g[0]: g for g in members}
        sizes = np.array(sorted(by_size, reverse=True))
        need = np.array([sum(left[k] for k in by_size[s]) for s in sizes.tolist()])
        unplaced = 0
        for length, _ in large:
            unplaced |= 1 << length
        # 2. and 3. Whole configurations only, the fullest first.
        found = [(c, int(x + 1e-6)) for c, x in _relaxation(sizes, need.astype(float), capacity)]
        for column, times in sorted(found, key=lambda f: -int(f[0] @ sizes)):
            places = [s for s, c in zip(sizes.tolist(), column.tolist(), strict=True) for _ in range(c)]
            while times > 0 and places:
                # The longest pieces of each place's group; the last place takes the longest piece of any group that still fits.
                chosen: dict[int, int] = defaultdict(int)
                order, used_up = [], 0
                for s in places[:-1]:
                    length = next((k for k in by_size[s] if left[k] > chosen.get(k, 0)), None)
                    if length is None:
                        break
                    chosen[length] += 1
                    order.append(length)
                    used_up += length
                fits = unplaced & ((2 << (capacity - used_up)) - 1)
                while fits and left[last := fits.bit_length() - 1] <= chosen.get(last, 0):
                    fits ^= 1 << last
                if len(order) < len(places) - 1 or not fits:
                    break
                chosen[last] += 1
                order.append(last)
                now = min(times, *(left[k] // c for k, c in chosen.items()))
                offset = 0
                for length in order:
                    put(length, now, made, offset)
                    left[length] -= now
                    if not left[length]:
                        unplaced &= ~(1 << length)
                    offset += length
                rooms[capacity - offset].append([made, now])
                made, times = made + now, times - now
    # 4. Best fit, longest first. Rooms are a bit set, so the least room that is enough is found at once.
    have_room = 0
    for r, where in rooms.items():
        if where:
            have_room |= 1 << r
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        count = left[length]
        while count:
            enough = have_room >> length
            if enough:
                r = length + (enough & -enough).bit_length() - 1
                first, many = rooms[r].pop()
                # A sequence takes as many of this length as the room holds.
                fit = r // length
                if count >= fit and (k := min(many, count // fit)):
                    for j in range(fit):
                        put(length, k, first, capacity - r + j * length)
                    rest, count = r - fit * length, count - k * fit
                else:
                    k, fit = 1, min(fit, count)
                    for j in range(fit):
                        put(length, 1, first, capacity - r + j * length)
                    rest, count = r - fit * length, count - fit
                if many > k:
                    rooms[r].append([first + k, many - k])
                if not rooms[r]:
                    have_room &= ~(1 << r)
                if rest:
                    rooms[rest].append([first, k])
                    have_room |= 1 << rest
            else:
                fit = capacity // length
                k = max(1, count // fit)
                rooms[capacity].append([made, k])
                have_room |= 1 << capacity
                made += k
    tokens = sum(k * v for k, v in histogram.items()) + n * capacity
    over_half = sum(v for k, v in histogram.items() if 2 * k > capacity) + n
    return Plan(runs, made, max(-(-tokens // capacity), over_half))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = 32, with_ids: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text): one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids). Within a sequence offsets are gapless from 0. Empty table: empty
    result. Null or empty text: the end id alone. Null doc_id: kept as null.
    """
    spark = docs.sparkSession
    table = materialize(tokenized_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = materialize(table.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_packing(histogram, capacity, groups)
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), F.coalesce("base", F.lit(0)).alias("base"), "n")
    runs = spark.createDataFrame(plan.runs or [(0, 0, 0, 0, 0)], "r_length long, r_from long, r_to long, r_sequence long, r_offset long")
    # The plan's runs meet the counts per partition first: both are small, and every piece then has exactly one range to fall into.
    spans = base.join(runs, (F.col("b_length") == F.col("r_length")) & (F.col("r_from") < F.col("base") + F.col("n")) & (F.col("r_to") > F.col("base"))).select(
        "b_length", "b_part", (F.greatest("r_from", "base") - F.col("base")).alias("lo"), (F.least("r_to", F.col("base") + F.col("n")) - F.col("base")).alias("hi"), (F.col("r_sequence") + F.greatest("r_from", "base") - F.col("r_from")).alias("seq0"), "r_offset"
    )
    spans = materialize(spans.groupBy("b_length", "b_part").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "seq0", "r_offset"))).alias("spans")), "spans")
    found = F.element_at(F.filter("spans", lambda s: (s["lo"] <= F.col("part_rank")) & (F.col("part_rank") < s["hi"])), 1)
    placed = table.join(spans, (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part"))).withColumn("at", found)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("at.seq0") + F.col("part_rank") - F.col("at.lo")).alias("sequence_id"), F.col("at.r_offset").alias("offset")]
    return placed.select(*keep, *(["ids"] if with_ids else []))

"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of the XXH64 values
of its word shingles have it. Documents whose fingerprints differ in at most
``distance`` bits are linked; classes are the connected components.

Copies fall together first: every later step sees distinct fingerprints only.

Routing. The 64 bits are four blocks of 16. Two fingerprints that differ in at
most two bits agree in two whole blocks, so each fingerprint goes to six
tables, one for each pair of blocks, keyed by those 32 bits. A bucket is what
shares a key.

Index. Within a bucket the fingerprints stand in order of their Gray rank, in
which neighbours share most bits. Runs of them become leaves; a leaf's node
holds the mask of the bits that all its members share and their pattern, and
runs of nodes get nodes above them, up to the root. A search carries leaves
down: it adds up the differences on the masked bits, which every member below
has too, and drops the whole group as soon as they exceed the distance. What
reaches the leaves is compared bit by bit.

Buckets of more than ``bucket`` fingerprints (a group of thousands of near
copies) are not searched by one task, nor cut off: their fingerprints take an
exact other way. Two fingerprints are within two bits if and only if some
64-bit pattern is within one bit of both; each emits itself and its 64
one-bit neighbours, and those that meet at a pattern are linked. At most 65
distinct fingerprints can meet at one, so no group is hot.

A bucket reports a spanning forest of its links, fewer rows than it has
members, never all pairs.

``close`` is the same index with a wide radius, for callers that verify what it
finds: more and shorter blocks, of which any three are a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, exact, keeping_columns, materialize, pieces, sieve

SEED = 42
WORDS = 3
DISTANCE = 2
BUCKET = 1024
#: Members of a leaf and children of a node.
FAN = 16
BLOCKS = 4
#: Shingles whose bits are counted at a time.
STEP = 65536
#: The wide index: bits that may differ, blocks, and how many of them make a key.
WIDE, WIDE_BLOCKS, WIDE_AGREE = 12, 8, 3


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes; of none: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), STEP):
        ones += np.unpackbits(np.ascontiguousarray(h[i : i + STEP]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a whole text; null or without words: zero."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxh64_intdigest(b" ".join(found), seed)
    ones, n = np.zeros(64, np.int64), len(found) - words + 1
    for i in range(0, n, STEP):
        part = found[i : i + STEP + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp: long, the fingerprint's bits) of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h = np.fromiter((fingerprint(t, words, seed) for t in b.column(1).to_pylist()), "<u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(h.view("<i8"))], names=["doc_id", "text_hash", "fp"])

    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index of one bucket's distinct fingerprints."""

    def __init__(self, fps: np.ndarray, fan: int = FAN):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps, self.fan = fps[self.order], fan
        #: From the leaves' nodes up: (mask of shared bits, their pattern).
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        both, any_ = self.fps, self.fps
        while True:
            cuts = np.arange(0, len(both), fan)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            self.levels.append((~(both ^ any_), both))
            if len(both) == 1:
                break

    def _down(self, pairs: tuple[np.ndarray, np.ndarray], below: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children (in order) of pairs of nodes; ``below``: how many children there are in all."""
        k = np.arange(self.fan)
        a = (pairs[0][:, None] * self.fan + k)[:, :, None]
        b = (pairs[1][:, None] * self.fan + k)[:, None, :]
        a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
        keep = (a <= b) & (b < below)
        return a[keep], b[keep]

    def links(self, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places in the bucket whose fingerprints differ in 1..distance bits."""
        pairs = (np.zeros(1, np.int64), np.zeros(1, np.int64))
        for level in range(len(self.levels) - 2, -1, -1):
            mask, pattern = self.levels[level]
            a, b = self._down(pairs, len(mask))
            # The differences on what both groups share are those of every pair of their members.
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            pairs = a[near], b[near]
        out_a, out_b = [], []
        for i in range(0, len(pairs[0]), 4096):
            a, b = self._down((pairs[0][i : i + 4096], pairs[1][i : i + 4096]), len(self.fps))
            near = (a < b) & (np.bitwise_count(self.fps[a] ^ self.fps[b]) <= distance)
            out_a.append(a[near])
            out_b.append(b[near])
        return self.order[np.concatenate(out_a)], self.order[np.concatenate(out_b)]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something new, in order."""
    up, out = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = x, y
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Buckets (table, bits, fp, node), sorted by the first two -> links (a, b) between nodes."""
    held: list[np.ndarray] = []

    def found(key: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
        edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1 if len(key) else []
        a, b = [], []
        for s, e in zip([0, *edges], [*edges, len(key)], strict=True):
            if e - s < 2:
                continue
            if e - s == 2:
                if int(fps[s] ^ fps[s + 1]).bit_count() <= distance:
                    a.append(int(nodes[s]))
                    b.append(int(nodes[s + 1]))
                continue
            at = nodes[s:e]
            for x, y in spanning_forest(e - s, *GrayIndex(fps[s:e]).links(distance)):
                a.append(int(at[x]))
                b.append(int(at[y]))
        return a, b

    def out(rows: np.ndarray) -> pa.RecordBatch:
        a, b = found(rows[:, :2], rows[:, 2].view(np.uint64), rows[:, 3])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c, np.int64) for c in batch.columns], 1)
        rows = np.concatenate([*held, rows]) if held else rows
        # The last bucket may go on in the next batch; it holds `bucket` rows at most.
        start = len(rows) - int((rows[::-1, :2] == rows[-1, :2]).all(1).cumprod().sum())
        if start:
            yield out(np.ascontiguousarray(rows[:start]))
        held = [rows[start:]]
    if held:
        yield out(np.ascontiguousarray(held[0]))


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp, node) within ``distance`` bits.

    Not all of them: within a bucket a spanning forest, which has the same components.
    """
    if distance != 2:
        raise ValueError("four blocks and one-bit neighbours serve a distance of two bits")
    width = 64 // BLOCKS
    block = [F.shiftright("fp", i * width).bitwiseAND((1 << width) - 1) for i in range(BLOCKS)]
    keys = [F.struct(F.lit(t).cast("long").alias("table"), (block[i] * (1 << width) + block[j]).alias("bits")) for t, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    rows = nodes.select(F.explode(F.array(*keys)).alias("k"), "fp", "node").select("k.table", "k.bits", "fp", "node")
    sizes = materialize(rows.groupBy("table", "bits").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = materialize(rows.join(sizes, ["table", "bits"]), "bucketed")
    searched = shared.where(F.col("n") <= bucket).select("table", "bits", "fp", "node").repartition("table", "bits").sortWithinPartitions("table", "bits")
    near = searched.mapInArrow(lambda batches: _search(batches, distance), "a long, b long")
    crowded = shared.where(F.col("n") > bucket).select("fp", "node").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    at = F.array_append(flips, F.col("fp"))
    met = crowded.select("node", F.explode(at).alias("pattern")).groupBy("pattern").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
    other = met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return near.unionByName(other)


def close(fps: DataFrame, distance: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that agree in three of eight blocks and differ in at most ``distance`` bits.

    Of each bucket a spanning forest. A bucket of more than ``bucket``
    fingerprints is cut into runs in Gray order, each searched by itself, so
    links between runs may be missing: whoever needs all has to look for them
    in another way (``similar``).
    """
    width = 64 // WIDE_BLOCKS
    tables = list(combinations(range(WIDE_BLOCKS), WIDE_AGREE))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0), np.int64).view(np.uint64)
            block = [fp >> np.uint64(i * width) & np.uint64((1 << width) - 1) for i in range(WIDE_BLOCKS)]
            rank = pa.array(gray_rank(fp).view(np.int64))
            for t, chosen in enumerate(tables):
                key = np.full(len(fp), t, np.uint64)
                for i in chosen:
                    key = key << np.uint64(width) | block[i]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rank], names=["key", "rank"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, rank), sorted -> what ``_search`` reads, the second column being the run."""
        last, before = None, 0
        for b in batches:
            key, rank = (np.asarray(c, np.int64) for c in b.columns)
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
            if key[0] == last:
                place[key == last] += before
            last, before = key[-1], int(place[-1]) + 1
            rank = rank.view(np.uint64)
            fp = pa.array((rank ^ rank >> np.uint64(1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place // bucket), fp, fp], names=["table", "bits", "fp", "node"])

    routed = fps.select("fp").mapInArrow(route, "key long, rank long").repartition("key").sortWithinPartitions("key", "rank")
    return routed.mapInArrow(lambda batches: _search(runs(batches), distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, distance: int = DISTANCE, bucket: int = BUCKET, with_hash: bool = False) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (and text_hash).

    component_id is the least doc_id reachable through links. Null or empty
    text, or one without words: fingerprint zero, linked like any other. A row
    without a doc_id gets the class of its fingerprint, and null where only
    such rows have it. Repeated rows are returned as often. Empty table: empty
    result.
    """
    fps = materialize(fingerprints(docs, words, seed), "fingerprints")
    known = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    classes = connected_components(links(known, distance, bucket))
    of_fp = materialize(known.join(classes, "node", "left").select(F.col("fp").alias("f"), F.coalesce("component", "node").alias("component_id")), "classes")
    joined = fps.join(of_fp, fps["fp"] == of_fp["f"], "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["text_hash"] if with_hash else []))


@keeping_columns("doc_id", "text")
def representatives(docs: DataFrame, classes_of: Callable[..., DataFrame] | None = None, **how) -> DataFrame:
    """The documents that stay: of each class one whose doc_id is the class's id, all columns kept.

    ``classes_of`` gives doc_id, text_hash and component_id of every row; if
    unset, ``near_duplicates`` does, with the settings in ``how``. Rows without a doc_id stay. Decisions are tables of ids and hashes. Texts
    stay where they are: a sieve of the rows that go tells most that stay; those
    that stay and yet pass it are counted out beforehand and looked up, as are
    rows that occur several times.
    """
    found = classes_of(docs, **how) if classes_of else near_duplicates(docs, **how, with_hash=True)
    classes = materialize(found.where("doc_id is not null").select("doc_id", "text_hash", "component_id"), "members")
    of_row = classes.groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    chosen = of_row.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("first_hash"))
    judged = of_row.join(chosen.withColumnRenamed("doc_id", "chosen_id"), F.col("doc_id") == F.col("chosen_id"), "left")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    judged = materialize(judged.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), stays.alias("stays"), "n"), "judged")
    names = docs.columns
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    # No semi joins below: they would be pushed under the sieves. What is looked up is there once in its table.
    of_docs, of_judged = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), F.xxhash64("_doc", "_hash")
    gone = sieve(materialize(judged.where("not stays or n > 1").select(of_judged.alias("key")), "gone"))
    doubtful = materialize(judged.where("stays and n = 1").transform(gone, of_judged).select("_doc", "_hash"), "doubtful")
    known = docs.where(F.col("doc_id").cast("long").isNotNull())
    once = docs.where(F.col("doc_id").cast("long").isNull()).unionByName(gone(known, of_docs, passing=False))
    looked_up = sieve(doubtful.select(of_judged))(gone(known, of_docs), of_docs).join(doubtful, same)
    # Rows that occur several times, of which one stays, are few; only they are grouped.
    repeated = materialize(judged.where("stays and n > 1").select("_doc", "_hash"), "repeated")
    first = sieve(repeated.select(of_judged))(known, of_docs).join(repeated, same).dropDuplicates(["doc_id"])
    return once.select(*names).unionByName(looked_up.select(*names)).unionByName(first.select(*names))

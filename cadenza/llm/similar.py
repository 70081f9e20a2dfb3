"""Near duplicates by SimHash and the similarity of whole texts, exact.

Two documents are linked if their sets of word shingles share at least
``SIMILARITY`` of what either has (Jaccard); classes are the connected
components.

Index. Each set has a SimHash fingerprint; the Gray-order hierarchical index
(``simhash.close``) finds those that differ in a few bits, and what it finds is
verified set against set. That settles most classes. Fingerprints cannot promise
all: texts of similarity 0.8 differ in some ten of 64 bits, with no upper bound,
and no block of bits is left that such pairs are sure to share. So the links
between classes that the index leaves apart are looked for exactly.

The rest. In one fixed order of all shingles, two sets of similarity t share
one of the first n - ceil(t n) + 1 of each (the prefix filter), so sets that
share no such shingle need no comparison. The order is free; shingles that are
common in a bounded sample come last, so that passages of many documents are
seldom in a prefix. The sample decides on speed only, never on the result.
Prefix shingles are dealt and sorted once; a scan drops those that one set
alone has, nearly all of them, and those members of a group that have too
little left after the shingle to be alike any other (the position filter): most
of the texts that share five words by chance. The members of a common shingle, of which there
is a bounded number, learn their group's least member without a shuffle.

Comparing. Equal sets fall together first. Each set has parity bits, 1024 or, if
it is large, some four for a shingle, which rule out most pairs before any set is sent anywhere; what is left is compared
set against set. First every member of a group with the group's least member,
which settles most groups whatever their size. In the others the pairs of
different classes that a quarter of the bits leave possible are looked for, chunk against
chunk: first a spanning forest of them, then, between classes still apart, all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, exact, materialize, pieces, sieve
from .simhash import close, of_hashes, spanning_forest

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Members of a chunk of a group; two chunks meet in a task.
CHUNK = 512
#: Documents of the sample (in expectation), how many of them make a shingle common, and how many such shingles there are at most.
SAMPLE, COMMON, LISTED = 5000, 3, 200_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    parts = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), "<u8").view("<i8"))


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set of which a set as similar must have one in its own prefix: rare ones, common ones."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
    if not len(common):
        return h[:n], h[:0]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    often = np.where(common[at] == h, counts[at], 0)
    first = np.lexsort((h, often))[:n]
    return h[first[often[first] == 0]], h[first[often[first] > 0]]


def parities(h: np.ndarray, least: int = 1024, each: int = 4) -> bytes:
    """Whether an odd number of a set's shingles falls on each of 1024 bits, or of more for a larger set. Two sets differ in as many shingles as bits, at least."""
    n = least
    while n < each * len(h):
        n *= 2
    return np.packbits(np.bincount(h & n - 1, minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(raw: list[bytes], size: int) -> np.ndarray:
    """Parity bits of one length as 64-bit words, folded to ``size`` bytes: the parities that so many bits would have had."""
    x = np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)
    while x.shape[1] * 8 > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _most(x_size: np.ndarray, y_size: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles sets of such sizes may differ."""
    return (1 - similarity) / (1 + similarity) * (x_size + y_size) + 1e-6


def _alike_sizes(x_size: np.ndarray, y_size: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(x_size, y_size) >= similarity * np.maximum(x_size, y_size) - 1e-9


def possible_pairs(x: list[bytes], y: list[bytes], x_size: np.ndarray, y_size: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) the parity bits and the sizes of their sets leave possible."""
    keep = _alike_sizes(x_size, y_size, similarity)
    lengths = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
    for p, q in np.unique(lengths[keep], axis=0):
        at = np.flatnonzero(keep & (lengths == (p, q)).all(1))
        low = int(min(p, q))
        differ = np.bitwise_count(_folded([x[i] for i in at], low) ^ _folded([y[i] for i in at], low)).sum(1, dtype=np.int64)
        keep[at] = differ <= _most(x_size[at], y_size[at], similarity)
    return keep


def possible(x: list[bytes], y: list[bytes], x_size: np.ndarray, y_size: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """(n, m): the same of all pairs of x and y, some at a time."""
    near = _alike_sizes(x_size[:, None], y_size[None], similarity)
    x_length, y_length = (np.array([len(r) for r in z]) for z in (x, y))
    for p in np.unique(x_length):
        for q in np.unique(y_length):
            rows, columns = np.flatnonzero(x_length == p), np.flatnonzero(y_length == q)
            a, b = np.nonzero(near[np.ix_(rows, columns)])
            if not len(a):
                continue
            low = int(min(p, q))
            u, v = _folded([x[i] for i in rows], low), _folded([y[i] for i in columns], low)
            step = max(1, (1 << 23) // low)
            for s in range(0, len(a), step):
                i, j = a[s : s + step], b[s : s + step]
                near[rows[i], columns[j]] = np.bitwise_count(u[i] ^ v[j]).sum(1, dtype=np.int64) <= _most(x_size[rows[i]], y_size[columns[j]], similarity)
    return near


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a bounded sample have, sorted, and how many."""
    n = max(1, rows.count())
    place = (F.pmod(F.col("text_hash"), F.lit(1 << 20)) / (1 << 20)).cast("double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, words) for t in b.column(0).to_pylist()]))], names=["s"])

    seen = rows.where(place < min(1.0, SAMPLE / n)).select("text").distinct().mapInArrow(run, "s long")
    found = seen.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(LISTED).toPandas()
    order = np.argsort(found["s"].to_numpy(np.int64))
    return found["s"].to_numpy(np.int64)[order], found["n"].to_numpy(np.int64)[order]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, node, ...), sorted -> (shingle, node, hub, ...) of shingles that several nodes have; the hub is the least one.

    Carries one group's shingle, hub (with its other columns) and last node from batch to batch.
    """
    shingle = hub = last = None
    told = False
    for batch in batches:
        s, *x = (np.asarray(c) for c in batch.columns)
        if not len(s):
            continue
        out: list[tuple[np.ndarray, ...]] = []
        k = int(np.searchsorted(s, shingle, "right")) if shingle is not None and s[0] == shingle else 0
        if k:
            fresh = np.diff(x[0][:k], prepend=last) != 0
            if fresh.any():
                last = int(x[0][:k][fresh][-1])
                rows = [c[:k][fresh] if told else np.concatenate([[h], c[:k][fresh]]) for c, h in zip(x, hub, strict=True)]
                out.append((np.full(len(rows[0]), shingle), rows[0], np.full(len(rows[0]), hub[0]), *rows[1:]))
                told = True
        s, x = s[k:], [c[k:] for c in x]
        if len(s):
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (x[0][1:] != x[0][:-1])
            s, x = s[keep], [c[keep] for c in x]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sizes = np.diff(np.append(starts, len(s)))
            several = np.repeat(sizes > 1, sizes)
            out.append((s[several], x[0][several], np.repeat(x[0][starts], sizes)[several], *(c[several] for c in x[1:])))
            shingle, hub, last, told = int(s[-1]), [int(c[starts[-1]]) for c in x], int(x[0][-1]), bool(sizes[-1] > 1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["shingle", "node", "hub", *batch.schema.names[2:]])


def _partnered(batches: Iterator[pa.RecordBatch], similarity: float, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, node, hub, size, place), sorted -> (shingle, node, hub, many) of those that may be alike another of their group.

    ``many`` is 1 where more than two are left: of two, comparing with the hub says all.

    ``place``: how many shingles of the set come before this one in the order
    of all. If it is the first that two sets share, they share no more than
    what follows in either. Pairs that fail at their first shared shingle are
    not similar, and the others pass there, whatever becomes of them elsewhere.
    Groups of more than ``chunk`` members pass whole.
    """
    share = similarity / (1 + similarity)

    def found(rows: np.ndarray) -> np.ndarray:
        """The members of whole groups that have a partner, with their new hubs."""
        shingle, node, _, size, place = rows
        rest = size - place
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        n = np.diff(np.append(starts, len(shingle)))
        keep = np.repeat(n > chunk, n)
        two = starts[n == 2]
        near = two[np.minimum(rest[two], rest[two + 1]) >= share * (size[two] + size[two + 1]) - 1e-6]
        keep[near] = keep[near + 1] = True
        for s, e in zip(starts[(n > 2) & (n <= chunk)].tolist(), (starts + n)[(n > 2) & (n <= chunk)].tolist(), strict=True):
            alone = np.minimum(rest[s:e, None], rest[None, s:e]) >= share * (size[s:e, None] + size[None, s:e]) - 1e-6
            np.fill_diagonal(alone, False)
            keep[s:e] = alone.any(1)
        shingle, node = shingle[keep], node[keep]
        starts = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] ^ 1))
        n = np.diff(np.append(starts, len(shingle)))
        return np.stack([shingle, node, np.repeat(node[starts], n), np.repeat(n > 2, n)])

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["shingle", "node", "hub", "many"])

    def whole(rows: np.ndarray) -> np.ndarray:
        return np.stack([*rows[:3], np.ones(rows.shape[1], np.int64)])

    held, passing = np.empty((5, 0), np.int64), None
    for batch in batches:
        rows = np.concatenate([held, np.stack([np.asarray(c, np.int64) for c in batch.columns])], axis=1)
        if passing is not None:
            k = int((rows[0] == passing).cumprod().sum())
            yield out(whole(rows[:, :k]))
            rows = rows[:, k:]
        if not rows.shape[1]:
            held = rows
            continue
        start = rows.shape[1] - int((rows[0, ::-1] == rows[0, -1]).cumprod().sum())
        if start:
            yield out(found(rows[:, :start]))
        held, passing = rows[:, start:], None
        if held.shape[1] > chunk:
            passing = int(held[0, 0])
            yield out(whole(held))
            held = held[:, :0]
    if held.shape[1]:
        yield out(found(held))


def _pairs_of_chunks(batches: Iterator[pa.RecordBatch], similarity: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, lo, hi, chunk, node, component, size, bits), sorted by the first three -> possible pairs of different classes.

    ``forest``: only as many of them as connect the classes that they could connect.
    """

    def found(rows: tuple[np.ndarray, ...], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, lo, hi, chunk, node, component, size = rows
        own = np.flatnonzero(chunk == lo)
        other = own if lo[0] == hi[0] else np.flatnonzero(chunk == hi)
        near = possible([raw[i] for i in own], [raw[i] for i in other], size[own], size[other], similarity) & (component[own][:, None] != component[other][None])
        a, b = np.nonzero(near)
        a, b = own[a], other[b]
        if lo[0] == hi[0]:
            a, b = a[a < b], b[a < b]
        if forest and len(a):
            names, place = np.unique(np.concatenate([component[a], component[b]]), return_inverse=True)
            # One pair for each pair of classes is enough to ask for.
            _, first = np.unique(np.minimum(place[: len(a)], place[len(a) :]) * len(names) + np.maximum(place[: len(a)], place[len(a) :]), return_index=True)
            x, y = place[: len(a)][first], place[len(a) :][first]
            where = {(int(p), int(q)): int(f) for p, q, f in zip(x, y, first, strict=True)}
            picked = [where[e] for e in spanning_forest(len(names), x, y)]
            a, b = a[picked], b[picked]
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    held: tuple[list[np.ndarray], list[bytes]] | None = None

    def out(columns: list[np.ndarray], raw: list[bytes]) -> pa.RecordBatch:
        key = np.stack(columns[:3], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        ends = [found(tuple(c[s:e] for c in columns), raw[s:e]) for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[i] for e in ends]).astype(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns, raw = [np.asarray(batch.column(i)) for i in range(7)], batch.column(7).to_pylist()
        if held:
            columns, raw = [np.concatenate([p, q]) for p, q in zip(held[0], columns, strict=True)], held[1] + raw
        key = np.stack(columns[:3], 1)
        start = len(key) - int((key[::-1] == key[-1]).all(1).cumprod().sum())
        if start:
            yield out([c[:start] for c in columns], raw[:start])
        held = ([c[start:] for c in columns], raw[start:])
    if held:
        yield out(*held)


class _Texts:
    """Verifies pairs of nodes by their sets, which are made anew from one text of each node that is needed."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, words: int, similarity: float):
        self.rows, self.nodes, self.words, self.similarity = rows, nodes, words, similarity

    def apart(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes those of different classes."""
        for end in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}")), end, "left")
        return pairs.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")

    def ruled_in(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes those that sizes and parity bits leave possible."""
        for end, bits in (("a", "s"), ("b", "t")):
            pairs = pairs.join(self.nodes.select(F.col("node").alias(end), F.col("bits").alias(bits), F.col("size").alias(f"{bits}_size")), end)
        pairs = pairs.where(F.least("s_size", "t_size") >= F.lit(self.similarity) * F.greatest("s_size", "t_size") - 1e-9)
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                keep = possible_pairs(b.column(2).to_pylist(), b.column(3).to_pylist(), np.asarray(b.column(4)), np.asarray(b.column(5)), similarity)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

        return pairs.select("a", "b", "s", "t", "s_size", "t_size").mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), a written table, those that are similar enough, as a written table."""
        words, similarity = self.words, self.similarity

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "members"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                x, y = (b.column(i).to_pylist() for i in (2, 3))
                keep = pa.array([alike(np.frombuffer(p, "<i8"), np.frombuffer(q, "<i8"), similarity) for p, q in zip(x, y, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)

        # Few sets are needed; the others are neither made nor sent. Texts stay where they are, but for those on the list where it is long.
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        one = materialize(self.nodes.join(needed, "node", "left_semi").select("node", "doc", "hash"), "needed")
        listed = sieve(one.select(F.xxhash64("doc", "hash")))(self.rows, F.xxhash64("doc_id", "text_hash"))
        read = listed.join(one, (F.col("doc_id") == F.col("doc")) & (F.col("text_hash") == F.col("hash"))).select("node", "text")
        # Repeated rows of a text give the same set once more.
        sets = materialize(read.mapInArrow(members, "node long, members binary"), "sets")
        first = sets.dropDuplicates(["node"]).select(F.col("node").alias("a"), F.col("members").alias("x"))
        second = sets.dropDuplicates(["node"]).select(F.col("node").alias("b"), F.col("members").alias("y"))
        return materialize(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def index_links(sketched: DataFrame) -> DataFrame:
    """Candidates (a, b): nodes of (doc_id, node, fp) with equal fingerprints, and with close ones by the index over all of them."""
    known = sketched.where("doc_id is not null").select("fp", "node").distinct()
    known = materialize(known, "fingerprints")
    first = materialize(known.groupBy("fp").agg(F.min("node").alias("node")), "distinct")
    equal = known.join(first.withColumnRenamed("node", "a"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    found = materialize(close(first), "close")
    for end in ("a", "b"):
        found = found.withColumnRenamed(end, "fp").join(first.withColumnRenamed("node", f"node_{end}"), "fp").drop("fp")
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).unionByName(equal)


def _unsettled(shared: DataFrame, nodes: DataFrame, classes: DataFrame, chunk: int) -> DataFrame:
    """The members of groups with several classes, dealt to tasks of two chunks: the input of ``_pairs_of_chunks``."""
    inside = shared.where("many = 1").select("shingle", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    inside = materialize(inside, "inside")
    # A passage's shingles have the same members; one of such groups stands for all.
    marks = [F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark2")]
    several = inside.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"), *marks).where("n > 2 and least <> most")
    several = materialize(several.groupBy("n", "mark", "mark2").agg(F.min("shingle").alias("shingle")).select("shingle", "n"), "several")
    parts = F.ceil(F.col("n") / chunk)
    left = inside.join(several, "shingle").withColumn("chunk", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    left = left.join(nodes.select("node", "size", F.col("short").alias("bits")), "node")
    left = left.select("shingle", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "component", "size", "bits")
    return left.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, component_id, text_hash.

    component_id is the least doc_id reachable through links. Texts without
    words are equal. A row without a doc_id gets the class of its text, and null
    where only such rows have it. Empty table: empty result.
    """
    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    common, counts = _common(rows, words)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        for b in pieces(batches):
            rare, often, nodes, sizes, bits, short, fps = [], [], [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = shingles(text, words)
                node = xxh64_intdigest(h.tobytes(), SEED)
                # Copies in a task tell their shingles once.
                new = doc is not None and node not in seen
                if new:
                    seen.add(node)
                    if len(seen) > 1_000_000:
                        seen.clear()
                first = prefix(h, common, counts, similarity) if new else (h[:0], h[:0])
                for column, x in zip((rare, often, nodes, sizes, bits, short, fps), (*first, node, len(h), parities(h), parities(h, 64, 1), of_hashes(h)), strict=True):
                    column.append(x)
            ids, fps = (pa.array(np.array(c, "<u8").view("<i8")) for c in (nodes, fps))
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (rare, often)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), ids, pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(short, pa.binary()), fps, *lists], names=["doc_id", "text_hash", "node", "size", "bits", "short", "fp", "rare", "often"])

    sketched = materialize(rows.mapInArrow(sketch, "doc_id long, text_hash long, node long, size long, bits binary, short binary, fp long, rare array<long>, often array<long>"), "sketches")
    dealt = sketched.select(F.posexplode("rare").alias("place", "shingle"), "node", "size").select("shingle", "node", "size", F.col("place").cast("long")).repartition("shingle").sortWithinPartitions("shingle", "node")
    shared = dealt.mapInArrow(lambda batches: _partnered(_shared(batches), similarity, chunk), "shingle long, node long, hub long, many long")
    # At most LISTED shingles are common: the table of their hubs has a bounded size and can be sent to every task.
    often = sketched.select(F.explode("often").alias("shingle"), "node").distinct()
    hubs = materialize(often.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").select("shingle", "hub"), "hubs")
    shared = materialize(shared.unionByName(often.join(F.broadcast(hubs), "shingle").select("shingle", "node", "hub", F.lit(1).cast("long").alias("many"))), "shared")

    in_groups = materialize(shared.select("node").distinct(), "grouped")
    nodes = sketched.where("doc_id is not null").join(in_groups, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("short").alias("short"))
    nodes = materialize(nodes.select("node", F.col("r.doc_id").alias("doc"), F.col("r.text_hash").alias("hash"), "size", "bits", "short"), "nodes")
    texts = _Texts(rows, nodes, words, similarity)
    # Nodes that share no prefix shingle with any other have no link; candidates of theirs end at the table of nodes.
    links = texts.verified(materialize(texts.ruled_in(index_links(sketched)), "possible"))
    every = materialize(connected_components(links), "components")
    # Most rows are those of pairs that are settled by now, which share many shingles.
    stars = texts.apart(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), every).distinct()
    links = links.unionByName(texts.verified(materialize(texts.ruled_in(stars), "possible")))
    every = materialize(connected_components(links), "components")
    for forest in (True, False):
        left = _unsettled(shared, nodes, every, chunk)
        pairs = materialize(left.mapInArrow(lambda batches, forest=forest: _pairs_of_chunks(batches, similarity, forest), "a long, b long").distinct(), "pairs")
        if pairs.isEmpty():
            break
        links = links.unionByName(texts.verified(materialize(texts.ruled_in(pairs), "possible")))
        every = materialize(connected_components(links), "components")

    of_node = sketched.select("doc_id", "text_hash", "node").join(every, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))
    of_node = materialize(of_node, "classes")
    least = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return of_node.join(least, "component").select("doc_id", "component_id", "text_hash")

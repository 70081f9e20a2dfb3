"""Near-duplicate embeddings by E8 lattice hashing.

Equal vectors fall together first. Each distinct vector, scaled to unit length,
is projected by ``tables`` independent Gaussian matrices to ``blocks`` times
eight dimensions, and each block is decoded to the nearest point of the E8
lattice there: together they are its cell in that table. It also probes the
``probes`` neighbouring cells nearest to its projection, which differ in one
block. Vectors that share a cell, or whose probe meets another's cell, are
candidates; their cosine is verified in double precision.

``index_for`` chooses cells by the number of distinct vectors, so that a vector
meets some 2500 unrelated ones at most however large the table: more blocks
make unrelated vectors meet rarely, more tables keep the recall.

A pair met several times counts once: the first meeting in the order of tables
(own cell, then probe of the lesser id, then probe of the greater) owns it, and
every task can tell from the two vectors alone whether its meeting is the
first. So tasks return counts per vector and a spanning forest, never pairs.

Cells with very many members or probes are cut into chunks, and pairs of chunks
become tasks of their own; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, exact, materialize
from .simhash import spanning_forest

THRESHOLD = 0.9


class Index(NamedTuple):
    """How vectors are hashed; ``scale`` is the projected length of a unit vector in a block: the larger, the finer the cells."""

    tables: int
    probes: int
    scale: float
    blocks: int


#: Up to so many distinct vectors, such an index. From the simulated chance that one table brings a pair of cosine 0.9
#: together, the tables find 0.97 of such pairs. They bring up 2e-2 and 1.2e-3 (simulated), 1e-5, 1.4e-6 and 1e-7
#: (computed from the chance that unrelated vectors share one block) of the unrelated pairs.
LEVELS = (
    (100_000, Index(6, 5, 2.0, 1)),
    (2_000_000, Index(11, 5, 1.5, 2)),
    (200_000_000, Index(39, 5, 1.5, 3)),
    (2_000_000_000, Index(79, 5, 1.7, 3)),
    (None, Index(151, 5, 1.5, 4)),
)


def index_for(n: int) -> Index:
    """The index for ``n`` distinct vectors."""
    return next(index for most, index in LEVELS if most is None or n <= most)


#: Members, or probes, of one chunk of a cell.
CHUNK = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst entry the other way."""
    f = np.rint(y)
    off = y - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest lattice points: E8 is D8 and D8 shifted by a half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


class Hasher:
    """Cells and probed cells of vectors of one dimension, as 64-bit keys."""

    def __init__(self, dim: int, index: Index, seed: int = 8):
        rng = np.random.default_rng([seed, dim])
        self.blocks, self.probes, self.around = index.blocks, index.probes, minimal_vectors()
        width = 8 * index.blocks
        self.matrix = rng.normal(size=(index.tables, dim, width)) * (index.scale / np.sqrt(8))
        self.mix = rng.integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        #: What a step to a neighbour, by block and neighbour, adds to the sum of a cell.
        self.steps = np.concatenate([self._sum(np.pad(self.around, ((0, 0), (8 * k, width - 8 * k - 8)))) for k in range(index.blocks)])

    def _sum(self, points: np.ndarray) -> np.ndarray:
        twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
        return (twice * self.mix).sum(-1, dtype=np.uint64)

    @staticmethod
    def _key(table: int, sums: np.ndarray) -> np.ndarray:
        h = sums + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) own cells and (n, tables, probes) probed cells."""
        own, near = [], []
        for t, m in enumerate(self.matrix):
            y = (unit @ m).reshape(-1, 8)
            at = nearest_e8(y)
            gain = ((y - at) @ self.around.T).reshape(len(unit), -1)
            best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            sums = self._sum(at.reshape(len(unit), -1))
            own.append(self._key(t, sums))
            near.append(self._key(t, sums[:, None] + self.steps[best]))
        return np.stack(own, 1), np.stack(near, 1)


@lru_cache(maxsize=8)
def hasher(dim: int, index: Index) -> Hasher:
    return Hasher(dim, index)


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _signatures(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """(node, dim, vector) -> (node, dim, cell, is_probe)."""
    for b in batches:
        nodes, dims = np.asarray(b.column(0)), np.asarray(b.column(1))
        raw = b.column(2).to_pylist()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for i in range(0, len(at), 512):
                part = at[i : i + 512]
                own, near = hasher(int(d), index).keys(_units([raw[k] for k in part]))
                cells = np.concatenate([own.reshape(len(part), -1), near.reshape(len(part), -1)], 1)
                probe = np.tile(np.repeat([False, True], [index.tables, index.tables * index.probes]), len(part))
                n = cells.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[part], n)), pa.array(np.full(len(part) * n, d, np.int32)), pa.array(cells.ravel()), pa.array(probe)], names=["node", "dim", "cell", "is_probe"])


class _Verifier:
    """Blocks of candidates -> counts and forest edges of a batch."""

    def __init__(self, threshold: float, index: Index):
        self.threshold, self.index = threshold, index

    def run(self, rows: dict[str, np.ndarray], raw: list[bytes]) -> pa.RecordBatch:
        """Rows of whole blocks, ordered by block (dim, cell, kind, i, j)."""
        key = np.stack([rows[c] for c in ("dim", "cell", "kind", "i", "j")], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        counts: dict[int, int] = {}
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if e - s < 2:
                continue
            kind, i, j = key[s, 2:]
            part = slice(s, e)
            probe, chunk = rows["is_probe"][part], rows["chunk"][part]
            home, asks = np.flatnonzero(~probe), np.flatnonzero(probe)
            if not len(home):
                continue
            node, copies, unit = rows["node"][part], rows["copies"][part], _units(raw[s:e])
            sides = []
            if kind == 2 or kind == 0:
                sides.append((asks, home, False, False))
            if kind == 0 or (kind == 1 and i == j):
                sides.append((home, home, True, True))
            elif kind == 1:
                sides.append((home[chunk[home] == i], home[chunk[home] == j], True, False))
            for a, b, own, same in sides:
                for k in range(0, len(a), CHUNK):
                    self._pairs(a[k : k + CHUNK], b, own, same, node, copies, unit, int(key[s, 0]), int(key[s, 1]), counts, ends)
        forest = []
        if ends:
            a, b = np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends])
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = [(int(names[x]), int(names[y])) for x, y in spanning_forest(len(names), place[: len(a)], place[len(a) :])]
        n, m = len(counts), len(forest)
        first = pa.array([*counts, *(a for a, _ in forest)], pa.int64())
        second = pa.array([None] * n + [b for _, b in forest], pa.int64())
        return pa.RecordBatch.from_arrays([first, second, pa.array([*counts.values(), *[0] * m], pa.int64())], names=["a", "b", "n"])

    def _pairs(self, a, b, own, both, node, copies, unit, dim, cell, counts, ends) -> None:
        x, y = np.nonzero(unit[a] @ unit[b].T >= self.threshold)
        x, y = a[x], b[y]
        # Members against themselves bring up both orders of a pair; one is kept.
        keep = node[x] < node[y] if both else node[x] != node[y]
        x, y = x[keep], y[keep]
        if not len(x):
            return
        used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        mine, near = hasher(dim, self.index).keys(unit[used])
        table = self._table(mine, near, cell)
        places = place[: len(x)], place[len(x) :]
        for s in range(0, len(x), 200_000):
            px, py = (p[s : s + 200_000] for p in places)
            swap = node[used[px]] > node[used[py]]
            lo, hi = np.where(swap, py, px), np.where(swap, px, py)
            # 0: own cell; 1: the lesser id probed; 2: the greater did.
            way = np.zeros(len(px), np.int64) if own else np.where(swap, 2, 1)
            alive = np.ones(len(px), bool)
            for t in range(table + 1):
                k = np.flatnonzero(alive)
                if not len(k):
                    break
                same = mine[lo[k], t] == mine[hi[k], t]
                first = same if t < table else same & (way[k] > 0)
                alive[k[first]] = False
                k = k[~first]
                if t == table:
                    k = k[way[k] > 1]
                lesser = (near[lo[k], t] == mine[hi[k], t][:, None]).any(1)
                alive[k[lesser]] = False
                if t < table:
                    k = k[~lesser]
                    greater = (near[hi[k], t] == mine[lo[k], t][:, None]).any(1)
                    alive[k[greater]] = False
            lo, hi = used[lo[alive]], used[hi[alive]]
            if not len(lo):
                continue
            ends.append((node[lo], node[hi]))
            who, at = np.unique(np.concatenate([node[lo], node[hi]]), return_inverse=True)
            more = np.bincount(at, weights=np.concatenate([copies[hi], copies[lo]]), minlength=len(who))
            for w, m in zip(who.tolist(), more.tolist(), strict=True):
                counts[w] = counts.get(w, 0) + int(m)

    @staticmethod
    def _table(mine: np.ndarray, near: np.ndarray, cell: int) -> int:
        """Which table a cell's key belongs to: that of any vector in it."""
        at = np.flatnonzero((mine == cell).any(0))
        return int(at[0]) if len(at) else int(np.flatnonzero((near == cell).any((0, 2)))[0])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, index: Index) -> Iterator[pa.RecordBatch]:
    names = ["dim", "cell", "kind", "i", "j", "chunk", "is_probe", "node", "copies"]
    verifier = _Verifier(threshold, index)
    held: tuple[dict[str, np.ndarray], list[bytes]] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = {n: np.asarray(b.column(k)) if n != "is_probe" else np.asarray(b.column(k).to_pylist(), bool) for k, n in enumerate(names)}
        raw = b.column(len(names)).to_pylist()
        if held:
            rows, raw = {n: np.concatenate([held[0][n], x]) for n, x in rows.items()}, held[1] + raw
        key = np.stack([rows[c] for c in names[:5]], 1)
        start = len(key) - int((key[::-1] == key[-1]).all(1).cumprod().sum())
        if start:
            yield verifier.run({n: x[:start] for n, x in rows.items()}, raw[:start])
        held = ({n: x[start:] for n, x in rows.items()}, raw[start:])
    if held:
        yield verifier.run(*held)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, index: Index | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    A vector that is null, empty or zero, or holds null, NaN or infinity, links
    with nothing, as does a row without a vec_id; vectors of different
    dimension never link. Equal vectors link, each repeated row counting as a
    vector. Rows that share a vec_id but not their vector are vectors of their
    own, linked only if their vectors are. Empty table: empty result. Without an
    ``index`` the number of distinct vectors chooses one.
    """
    rows = exact(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.coalesce(fine, F.lit(False)))
    equal = usable.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # Nodes are numbers of distinct vectors, fixed once the table is written; ids may be shared.
    equal = materialize(equal.withColumn("node", F.monotonically_increasing_id()), "equal")

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            dims = np.diff(np.asarray(lists.offsets)).astype(np.int32)
            flat, ends = np.asarray(lists.flatten()).astype("<f8"), np.cumsum(dims)
            raw = [flat[e - d : e].tobytes() for d, e in zip(dims.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(dims), pa.array(raw, pa.binary())], names=["node", "copies", "dim", "vector"])

    distinct = materialize(equal.select("v", "node", "copies").mapInArrow(as_bytes, "node long, copies long, dim int, vector binary"), "vectors")
    how = index or index_for(distinct.count())
    signed = distinct.select("node", "dim", "vector").mapInArrow(lambda x: _signatures(x, how), "node long, dim int, cell long, is_probe boolean")
    signed = materialize(signed, "cells")
    sizes = signed.groupBy("dim", "cell").agg(F.count_if(~F.col("is_probe")).alias("members"), F.count_if("is_probe").alias("asks"))
    sizes = materialize(sizes.where("members > 0 and members + asks > 1"), "sizes")
    met = signed.join(sizes, ["dim", "cell"])
    parts = lambda n: F.ceil(F.col(n) / F.lit(chunk)).cast("int")
    met = met.withColumn("m", F.greatest(parts("members"), F.lit(1))).withColumn("q", F.greatest(parts("asks"), F.lit(1)))
    mixed = F.pmod(F.xxhash64("node"), F.when(F.col("is_probe"), F.col("q")).otherwise(F.col("m"))).cast("int")
    met = met.withColumn("chunk", mixed)
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    zero, up_to = F.lit(0), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    against = F.transform(up_to("q"), lambda j: at(2, F.col("chunk"), j))
    within = F.transform(up_to("m"), lambda j: at(1, F.least("chunk", j), F.greatest("chunk", j)))
    blocks = F.when((F.col("m") == 1) & (F.col("q") == 1), F.array(at(0, zero, zero))).when(F.col("is_probe"), F.transform(up_to("m"), lambda i: at(2, i, F.col("chunk")))).otherwise(F.concat(against, within))
    dealt = met.select("dim", "cell", F.explode(blocks).alias("block"), "chunk", "is_probe", "node").select("dim", "cell", "block.*", "chunk", "is_probe", "node")
    full = dealt.join(distinct.select("node", "copies", "vector"), "node").select("dim", "cell", "kind", "i", "j", "chunk", "is_probe", "node", "copies", "vector")
    by = ["dim", "cell", "kind", "i", "j"]
    found = materialize(full.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda x: _verify(x, threshold, how), "a long, b long, n long"), "found")
    classes = connected_components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    of_node = equal.select("node", "first_id", "copies").join(linked, F.col("node") == F.col("a"), "left").join(classes, "node", "left")
    of_node = of_node.select("node", "first_id", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    of_node = materialize(of_node, "classes")
    least = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = materialize(of_node.join(least, "component").select("node", "first_id", "copies", "n_links", "component_id"), "named")
    # A vector that one row has is known by its table's id; the others' rows find their class through the vector.
    once = of_node.where("copies = 1").select(F.col("first_id").alias("vec_id"), "n_links", "component_id")
    several = usable.join(equal.where("copies > 1").select(F.col("v").alias("w"), "node"), F.col("v") == F.col("w")).select("vec_id", "node")
    done = once.unionByName(several.join(of_node.select("node", "n_links", "component_id"), "node").select("vec_id", "n_links", "component_id"))
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import common, lattice, similar, simhash

from .conftest import EDGES


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Node -> least node reachable, by brute force."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints(spark):
    texts = [t for _, t in EDGES] + ["ABC def ghi jkl", "a\x0bb\x1cc d e f g", "É à Ü ß words here"]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    native = spark.createDataFrame([("a b c",)], "t string").selectExpr("xxhash64(t) as h").first()["h"]
    assert native & (2**64 - 1) == simhash.fingerprint("A b C")


def test_gray_rank():
    x = np.array([i ^ i >> 1 for i in range(300)], np.uint64)
    assert simhash.gray_rank(x).tolist() == list(range(300))


@pytest.mark.parametrize(("n", "flips"), [(1, 0), (2, 1), (17, 2), (300, 3), (900, 2)])
def test_index_against_brute_force(n, flips):
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(max(1, n // 8))]
    fps = set()
    while len(fps) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, flips + 2)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    f = np.array(sorted(fps), np.uint64)
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in simhash.GrayIndex(f).links(2)), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if int(f[i] ^ f[j]).bit_count() <= 2}


@pytest.mark.parametrize("bucket", [1024, 8])
def test_links_keep_all_classes(spark, bucket):
    """Also where buckets are crowded and take the other way."""
    r = random.Random(9)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(r.randint(0, 3)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    got = [(e["a"], e["b"]) for e in simhash.links(df, bucket=bucket).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in got)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert components(range(len(fps)), got) == components(range(len(fps)), pairs)


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(r.randrange(600, 900), r.randrange(600, 900)) for _ in range(200)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    got = {x["node"]: x["component"] for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and set(want) - set(got) == {7}
    assert common.connected_components(spark.createDataFrame(edges, "a long, b long").limit(0)).count() == 0


def near(text, r, k=1):
    words = text.split()
    for _ in range(k):
        words[r.randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    rows, n = list(EDGES), 100
    for _ in range(25):
        text = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randrange(50)) for _ in range(300))
        for copy in [text, text, near(text, r), near(text, r, 3)]:
            rows.append((n, copy))
            n += 1
    return rows


def test_documents_against_brute_force(make_docs, corpus):
    got = simhash.near_duplicates(make_docs(corpus)).collect()
    assert len(got) == len(corpus)
    fps = [slow_fingerprint(t) for _, t in corpus]
    known = [i for i, (d, _) in enumerate(corpus) if d is not None]
    linked = [(i, j) for i in known for j in known if j < i and (fps[i] ^ fps[j]).bit_count() <= 2]
    place = components(known, linked)
    least = {}
    for i in known:
        least[place[i]] = min(least.get(place[i], 1 << 60), corpus[i][0])
    want = sorted((corpus[i][0], f"{fps[i]:016x}", least[place[i]]) for i in known)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == want


def test_representatives(make_docs, corpus, empty):
    docs = make_docs(corpus)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    classes = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({c for d, c in classes.items() if d is not None})
    assert ids.count(None) == 2
    assert simhash.representatives(empty).count() == simhash.near_duplicates(empty).count() == 0


@pytest.fixture(scope="module")
def altered(corpus):
    """Texts with 1 to 12 of 300 words changed, and a crowd of variants of one text with common lines."""
    r, rows = random.Random(5), list(corpus)
    for _ in range(6):
        text = " ".join(f"w{r.randrange(400)}" for _ in range(300))
        rows += [(len(rows) + 1000, near(text, r, k)) for k in (0, 3, 5, 7, 9, 12)]
    text = " ".join(f"v{r.randrange(400)}" for _ in range(120))
    rows += [(len(rows) + 1000, near(text, r, r.randrange(6))) for _ in range(60)]
    line = " ".join(f"line{k}" for k in range(20))
    return rows + [(len(rows) + 2000 + k, f"{line} " + " ".join(f"u{r.randrange(3000)}" for _ in range(8))) for k in range(60)]


def of_five(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def test_parities_rule_out_no_similar_pair():
    """Whatever the sizes: pairs that are alike stay possible, singly and in blocks, and most others go."""
    rng = np.random.default_rng(2)
    sets = [np.empty(0, np.int64)]
    for n in (1, 2, 5, 40, 255, 257, 300, 1000, 5000, 5100):
        h = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        sets.append(h)
        for share in (0.02, 0.08, 0.1, 0.12, 0.2):
            k = max(1, int(share * n))
            sets += [np.unique(np.concatenate([h[k:], rng.integers(-(1 << 63), 1 << 63, k)])), h[k:], np.unique(np.concatenate([h, rng.integers(-(1 << 63), 1 << 63, k)]))]
    raw, sizes = [similar.parities(h) for h in sets], np.array([len(h) for h in sets])
    block = similar.possible(raw, raw, sizes, sizes)
    x, y = (z.ravel() for z in np.indices(block.shape))
    single = similar.possible_pairs([raw[i] for i in x], [raw[i] for i in y], sizes[x], sizes[y])
    assert (single == block.ravel()).all()
    same = np.array([[similar.alike(a, b) for b in sets] for a in sets])
    assert block[same].all() and block.sum() < 1.3 * same.sum()


def test_groups_across_batches():
    """Whatever the batches' borders: repeated nodes once, lonely shingles not at all, the least node as the hub."""
    r = random.Random(6)
    rows = sorted((r.randrange(40), r.randrange(30)) for _ in range(150)) + [(99, 1)]
    want = sorted((s, x, min(y for q, y in rows if q == s)) for s, x in set(rows) if len({y for q, y in rows if q == s}) > 1)
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([c[k] for c in rows[i : i + size]], pa.int64()) for k in (0, 1)], names=["shingle", "node"]) for i in range(0, len(rows), size)]
        assert sorted(x for b in similar._shared(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)) == want


def test_wide_index(spark):
    """All pairs of a wide radius that agree in three of eight blocks; a crowded bucket cut into runs finds fewer and none besides."""
    r = random.Random(12)
    fps = set()
    for _ in range(60):
        base = r.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(14))) for _ in range(6)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    bits = {(a, b): (a ^ b) & (1 << 64) - 1 for a in fps for b in fps if a < b}
    linked = [p for p, x in bits.items() if x.bit_count() <= 12 and sum(not x >> 8 * i & 255 for i in range(8)) >= 3]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [tuple(sorted(x)) for x in simhash.close(df).collect()]
    assert set(got) <= set(linked) and components(fps, got) == components(fps, linked)
    assert {tuple(sorted(x)) for x in simhash.close(df, bucket=2).collect()} <= set(linked)


def test_similar_texts_come_from_the_index(spark, altered):
    """The stage's index over SimHash fingerprints finds close copies by itself."""
    sets = {d: of_five(t) for d, t in altered if d is not None}
    fps = [(d, d, np.array([simhash.of_hashes(similar.shingles(t))], "<u8").view("<i8")[0].item()) for d, t in altered if d is not None]
    got = [(x["a"], x["b"]) for x in similar.index_links(spark.createDataFrame(fps, "doc_id long, node long, fp long")).collect()]
    place = components(sets, got)
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.93 * len(sets[a] | sets[b])]
    assert len(near) > 20 and sum(place[a] == place[b] for a, b in near) >= 0.9 * len(near)


@pytest.mark.parametrize("chunk", [512, 4])
def test_members_without_a_partner_go(chunk):
    """Whatever the batches' borders: similar sets meet at their first shared shingle, sets that share one by chance do not."""
    rng = np.random.default_rng(8)
    sets = []
    for n in (1, 5, 30, 100, 200):
        for _ in range(8):
            h = rng.integers(0, 1 << 60, n)
            sets += [np.unique(np.concatenate([h[k:], rng.integers(0, 1 << 60, k), [7, 1 << 59][: n > 5]])) for k in (0, n // 20, n // 12, n // 4)]
    none = np.empty(0, np.int64)
    rows = sorted((int(s), x, len(h), place) for x, h in enumerate(sets) for place, s in enumerate(similar.prefix(h, none, none)[0]))
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if similar.alike(sets[a], sets[b])]
    for size in (1, 7, 100, 100_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["shingle", "node", "size", "place"]) for i in range(0, len(rows), size)]
        got = [x for b in similar._partnered(similar._shared(iter(batches)), 0.8, chunk) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        members = {}
        for s, x, hub, many in got:
            members.setdefault(s, set()).add(x)
            assert chunk == 4 or hub == min(y for q, y, *_ in got if q == s) and many == (sum(q == s for q, *_ in got) > 2)
        assert all(any(a in m and b in m for m in members.values()) for a, b in alike)
        if chunk == 512:
            assert all(len(m) > 1 for m in members.values())
            shared = [s for s, *_ in rows]
            assert len(got) < 0.9 * sum(shared.count(s) > 1 for s in shared)


@pytest.mark.parametrize("chunk", [512, 8])
def test_similar_texts_against_brute_force(make_docs, altered, empty, chunk):
    sets = [(d, of_five(t)) for d, t in altered if d is not None]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) >= 0.8 * len(x | y)]
    want = components({d for d, _ in sets}, linked)
    got = similar.near_duplicates(make_docs(altered), chunk=chunk).collect()
    assert len(got) == len(altered)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert similar.near_duplicates(empty).count() == 0


def test_stage_drops_near_copies(spark, make_docs, altered):
    """Copies of similarity 0.8 go, also where fingerprints differ in more than two bits."""
    sets = {d: of_five(t) for d, t in altered if d is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, make_docs(altered), "").collect()]
    assert sorted(d for d in kept if d is not None) == sorted(set(components(sets, linked).values()))


def test_sieve(spark):
    """Keys all pass, and at the usual size few others; a full sieve lets all pass."""
    rng = np.random.default_rng(6)
    values = rng.integers(-(1 << 63), 1 << 63, 21_000).tolist()
    keys = common.materialize(spark.createDataFrame([(v,) for v in values[:1000]], "h long"))
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, h long")
    for most, share in ((common.SIEVE_MOST, 0.03), (1 << 12, 0.8), (64, 1.0)):
        told = common.sieve(keys, most)
        passed = {r["k"] for r in told(rows, F.col("h")).collect()}
        assert {r["k"] for r in told(rows, F.col("h"), passing=False).collect()} == set(range(21_000)) - passed
        assert passed >= set(range(1000)) and len(passed) - 1000 <= share * 20_000
    none = common.sieve(keys.limit(0))
    assert none(rows, F.col("h")).count() == 0 and none(rows, F.col("h"), passing=False).count() == 21_000


def shuffled(spark, df):
    """Bytes that writing ``df`` shuffles if no table is broadcast."""
    sc, limit = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sc.setJobGroup("shuffled", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        sc._jsc.clearJobGroup()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("shuffled") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("bits", [common.SIEVE_MOST, 1 << 10, 64])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, bits):
    """However long the list of rows that go; with a sieve that lets more or all pass, the same rows stay."""
    rng = np.random.default_rng(7)
    texts = [rng.bytes(4000).hex() for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(40)] + [(7, texts[7]), (1001, texts[1]), (None, texts[9]), (None, None), (5, texts[6] + " x")]
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")
    least = {}
    for d, t in reversed(rows[:440]):
        least[t] = d
    classes = spark.createDataFrame([(d, least.get(t, d)) for d, t in rows], "doc_id long, component_id long").distinct()
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(classes, "doc_id")
    monkeypatch.setattr(simhash, "sieve", lambda keys: common.sieve(keys, bits))
    kept = simhash.representatives(docs, lambda _: found)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(d for d in ids if d is not None) == list(range(400)) and ids.count(None) == 2
    if bits == common.SIEVE_MOST:
        assert shuffled(spark, kept) < 400_000 < 8000 * 400 / 2


def brute_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(good)
    linked = [(a, b) for a in range(n) for b in range(a) if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.9]
    return good, linked


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for k in range(60):
        c = rng.normal(size=32)
        for _ in range(1 if k % 3 else 8):
            rows.append((n, (c + 0.15 * rng.normal(size=32)).astype(np.float32).tolist()))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 1, rows[0][1])]
    return rows + [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] + [1.0] * 31), (9005, [float("inf")] * 32), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, [1.0] * 32)]


@pytest.mark.parametrize(("chunk", "index"), [(1024, None), (3, None), (3, lattice.LEVELS[1][1])])
def test_vectors_against_brute_force(spark, vectors, chunk, index):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, VEC_ID string")
    got = lattice.near_duplicates(df, index=index, chunk=chunk).collect()
    assert len(got) == len(vectors)
    good, linked = brute_vectors(vectors)
    links = [0] * len(good)
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    place = components(range(len(good)), linked)
    least = {}
    for a in range(len(good)):
        least[place[a]] = min(least.get(place[a], 1 << 60), good[a][0])
    want = {good[a][0]: (links[a], least[place[a]]) for a in range(len(good))}
    known = {r["vec_id"]: r for r in got if r["vec_id"] in want}
    assert sum(r["n_links"] for r in known.values()) >= 0.97 * sum(x[0] for x in want.values())
    assert all(r["n_links"] <= want[i][0] for i, r in known.items())
    assert sum((r["component_id"]) == want[i][1] for i, r in known.items()) >= 0.97 * len(known)
    for r in got:
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
        if r["vec_id"] is None or 9000 <= r["vec_id"] < 9006:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("index", [index for _, index in lattice.LEVELS])
def test_recall_at_the_threshold(index):
    """Pairs whose cosine is 0.9 exactly: what one table misses another finds."""
    rng = np.random.default_rng(0)
    u = rng.normal(size=(1000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(1000, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9 * u + np.sqrt(1 - 0.81) * w
    h = lattice.Hasher(64, index)
    (a, pa), (b, pb) = h.keys(u), h.keys(v)
    met = ((a == b) | (pa == b[:, :, None]).any(2) | (pb == a[:, :, None]).any(2)).any(1)
    assert met.mean() >= 0.95


def test_candidates_do_not_grow_with_the_table():
    """Unrelated vectors that one vector meets, in tables of the size at which each index is used last."""
    rng = np.random.default_rng(5)
    for most, index in lattice.LEVELS[:2]:
        u = rng.normal(size=(2000, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        own, near = lattice.Hasher(64, index).keys(u)
        met = np.zeros((2000, 2000), bool)
        for t in range(index.tables):
            met |= own[:, t][:, None] == own[:, t]
            for p in range(index.probes):
                met |= near[:, t, p][:, None] == own[:, t]
        met |= met.T
        np.fill_diagonal(met, False)
        assert met.mean() * most <= 3000


def test_index_grows_with_the_table():
    assert [lattice.index_for(n).blocks for n in (0, 100_000, 100_001, 2_000_001, 10**9, 10**11)] == [1, 1, 2, 3, 3, 4]


def test_lattice_points():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(500, 8)) * 3
    p = lattice.nearest_e8(y)
    twice = np.rint(p * 2).astype(int)
    assert (np.abs(p * 2 - twice) < 1e-9).all() and ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (np.rint(p.sum(1)) % 2 == 0).all()
    around = lattice.minimal_vectors()
    assert around.shape == (240, 8) and np.allclose((around**2).sum(1), 2)
    d = ((y - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all() and (d[:, None] <= ((y[:, None] - p[:, None] - around) ** 2).sum(2) + 1e-9).all()


def test_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]

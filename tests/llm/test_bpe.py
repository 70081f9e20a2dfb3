from __future__ import annotations

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadenza.llm import bpe, common, packing, token_files, vocab

from .conftest import EDGES

PATH = vocab.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_every_code_point(library):
    for start in range(0, 0x110000, 50_000):
        points = [c for c in range(start, min(start + 50_000, 0x110000)) if not 0xD800 <= c < 0xE000]
        texts = [f"b{chr(c)}b 1{chr(c)}1 .{chr(c)}.{chr(c)} {chr(c)}" for c in points]
        for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert vocab.encode_fast(PATH, text).tolist() == e.ids


def test_transducer_on_assigned_code_points(library, encoder):
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    for start in range(0, len(points), 500):
        text = "\x01".join(f"b{c}b .{c} " for c in points[start : start + 500])
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


PARTS = ["a", "b", "ab", "é", "日", "ÃÂ", " ", "\n", "  ", "0", "1", "'s", "'", "-", "--", "=", "😀", "the", "xx", "\t", "<|endoftext|>", "́"]


def test_random_texts(library, encoder):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "-" * 3000, "ÃÂ" * 2000, " " * 4000, "ab" * 2000, "".join(r.choice("abcdeinst") for _ in range(9000)), "".join(r.choice("-=*_") for _ in range(5000))]
    for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert ids_of(encoder, text) == e.ids == vocab.encode_fast(PATH, text).tolist()


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "\u3000"])
@pytest.mark.parametrize("after", ["", "a", "!", "7", "<|endoftext|>b", "'s"])
def test_very_long_white_space(library, run, after):
    n = 2_000_000 if run in " \n\t" and after == "a" else 1_200_000 if run in " \n" and not after else 70_000
    text = "x" + run * (n // len(run)) + after
    assert vocab.encode_fast(PATH, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_several_long_runs(library, encoder):
    text = " " * 70_000 + "one" + "\n" * 80_000 + " two" + "\r\n" * 66_000
    assert vocab.encode_fast(PATH, text).tolist() == library.encode(text, add_special_tokens=False).ids == ids_of(encoder, text)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    encoder = bpe.encoder(PATH)
    ids = ids_of(encoder, text)
    assert ids == vocab.encode_fast(PATH, text).tolist()
    d = bpe.Decoder(PATH)
    assert "".join(d.feed([i]) for i in ids) + d.close() == text


def test_decoder_on_any_ids(library):
    r = random.Random(4)
    d = bpe.Decoder(PATH)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 40))]
        assert "".join(d.feed([i]) for i in ids) + d.close() == library.decode(ids, skip_special_tokens=False)


def test_stream_memory_is_bounded(encoder):
    """A long part leaves the window early, and the same tokens come out."""
    data = ("abcdefghij" * 3000).encode()
    read = 0

    def feed():
        nonlocal read
        for b in data:
            read += 1
            yield b

    stream = encoder.transducer.stream(feed())
    next(stream)
    assert read <= 5 * encoder.transducer.window
    assert encoder.transducer.window == 128


def test_window_stays_bounded(encoder):
    """How far the transducer reads ahead of the tokens that it has given out, over long parts of many kinds."""
    r = random.Random(8)
    n = 20_000
    kinds = ["a" * n, "-" * n, "ab" * (n // 2), "ÃÂ" * (n // 4), "=" * 63 + "-" * n]
    kinds += ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "abcdeinst", "-=", "-=*_", "the", "日本語", "0123456789")]
    t = encoder.transducer
    for text in kinds:
        data, read, given = text.encode(), 0, 0

        def feed(data=data):
            nonlocal read
            for b in data:
                read += 1
                yield b

        ids = []
        for token in t.stream(feed()):
            assert read - given <= 6 * t.window
            given += t.length[token]
            ids.append(token)
        assert given == len(data) and b"".join(encoder_bytes(ids)) == data


def encoder_bytes(ids):
    table = vocab.vocabulary(PATH).bytes_of
    return [table[i] for i in ids]


def test_text_in_blocks(library, encoder):
    r = random.Random(9)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 200))) for _ in range(600)] + ["", " " * 500, "a" * 500, "x \n  y" * 90]
    for text, e in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        size = r.randint(1, 40)
        got = b"".join(encoder.stream(text[i : i + size] for i in range(0, len(text), size)))
        assert np.frombuffer(got, "<u4").tolist() == e.ids


def test_memory_does_not_grow_with_a_text(encoder):
    import tracemalloc

    line = "Whatever comes in blocks leaves in blocks; 12 of them,\n and some  more.\t"

    def peak(times):
        tracemalloc.start()
        ids = sum(len(x) // 4 for x in encoder.stream(line * 100 for _ in range(times)))
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return ids, used

    peak(10)
    (few, small), (many, large) = peak(20), peak(400)
    assert many > 15 * few and large < 1.5 * small


def test_round_trip_edges(edges, empty, library):
    got = bpe.round_trip(edges, with_ids=True).collect()
    assert len(got) == len(EDGES)
    by_text = {}
    for (doc, text), r in zip(EDGES, got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r["doc_id"] == doc and r["n_tokens"] == len(ids) and r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        by_text.setdefault(text, set()).add(r["ids_sha256"])
    assert all(len(v) == 1 for v in by_text.values())
    assert bpe.round_trip(empty).count() == 0


def test_token_files_write_ids_once(edges, monkeypatch):
    """Beside the files themselves only their manifest is written."""
    written = []
    monkeypatch.setattr(token_files, "materialize", lambda df, what: (written.append(what), common.materialize(df, what))[1])
    assert token_files.write_token_files(edges, row_length=64).count() and written == ["manifest"]


def test_token_files(edges, empty, spark, library):
    import zlib

    manifest = token_files.write_token_files(edges, row_length=64)
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    known = [r for r in got if r["doc_id"] is not None]
    assert [r["doc_id"] for r in known] == sorted(d for d, _ in EDGES if d is not None)
    assert got[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    want = sorted((-1 if d is None else d, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in EDGES)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == want
    f = token_files.TokenFile(manifest.orderBy("part").first()["path"])
    ids, mask = f.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    f.close()
    assert token_files.token_table(empty).count() == 0


def check_plan(histogram, capacity=packing.CAPACITY):
    plan = packing.plan_packing(histogram, capacity)
    seen, where = {}, {}
    for length, a, b, sequence, offset in sorted(plan.runs, key=lambda r: (r[0], r[1])):
        assert seen.get(length, 0) == a < b
        seen[length] = b
        for k in range(b - a):
            where.setdefault(sequence + k, []).append((offset, length))
    assert seen == {k: v for k, v in histogram.items() if v}
    for places in where.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(where) == plan.sequences >= plan.lower_bound
    return plan


@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_plans(histogram):
    plan = check_plan(histogram)
    assert plan.sequences <= 1.25 * plan.lower_bound + 6


def test_plan_is_tight():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 20000), np.clip(rng.lognormal(6.5, 1, 50000), 1, 2048).astype(int)):
        values, counts = np.unique(lengths, return_counts=True)
        plan = check_plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        assert plan.sequences <= 1.006 * plan.lower_bound


def test_pack_edges(edges, empty, library):
    got = packing.pack(edges, with_ids=True).collect()
    per = {}
    for r in got:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in per.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    docs = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 8:
            docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids"]))
    for doc, text in EDGES:
        if doc in (None, 8):
            continue
        pieces = sorted(docs[doc])
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert b"".join(bytes(p[3]) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert all(p[2] == 2048 for p in pieces[1:])
        assert [p[1] for p in pieces] == np.cumsum([0] + [p[2] for p in pieces])[:-1].tolist()
    assert sum(r["doc_id"] == 8 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 2
    assert packing.pack(empty).count() == 0

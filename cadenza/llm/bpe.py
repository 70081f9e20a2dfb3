"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding. Text is read a block of characters at a time and split by the
vocabulary's pattern up to the last place where a part is sure to begin; what
follows waits for the next block. Within a split part bytes go through ``Transducer`` one at a time. After each byte there is exactly one
last token of the encoding of the prefix read so far: the token that ends here
and is *compatible* with the last token of the prefix before it (no merge
across their border would have come first). So the state is, for each recent
place, where its last token began. Nothing older than the longest token can be
the start of a token to come: ``lookahead(merges)``, computed from the merge
list, is how far back a state must reach. Once the paths that lead back from
all places within the lookahead meet in one place, the tokens before it are
stable whatever follows, and are emitted. Memory is that window, a block of
characters, and the longest stretch without a border of text and white space.

Decoding. ``Decoder`` takes ids one at a time and turns bytes into text as soon
as a character is complete, holding three bytes at most; what cannot become a
character is U+FFFD, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import exact, pieces

#: Entries of each memo of a worker, in two generations; the older one goes when the younger is full.
MEMO = 600_000


def lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes that a state must reach back: the length of the longest token any chain of merges builds."""
    return max((len(a) + len(b) for a, b in merges), default=1)


class Transducer:
    """Bytes of one split part in, token ids out, in constant memory."""

    def __init__(self, v: vocab.Vocabulary):
        import ahocorasick

        self.ids = v.ids
        self.window = lookahead(v.merges)
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(v.merges):
            x, y, made = v.ids[a], v.ids[b], v.ids[a + b]
            if self.rank.setdefault(x << 32 | y, r) == r:
                self.halves.setdefault(made, (x, y))
        self.formed = {t: self.rank[x << 32 | y] for t, (x, y) in self.halves.items()}
        self.length = {t: len(x) for x, t in v.ids.items()}
        self._compatible: dict[int, bool] = {}
        #: Tokens whose own bytes merge into them; others never occur.
        self.sound = {t for t in v.ids.values() if t not in self.halves}
        for t in sorted(self.halves, key=self.formed.__getitem__):
            x, y = self.halves[t]
            if x in self.sound and y in self.sound and self._undisturbed(x, y, self.formed[t]):
                self.sound.add(t)
        self.ending = ahocorasick.Automaton()
        for data, t in v.ids.items():
            if t in self.sound:
                self.ending.add_word(data.decode("latin-1"), (t, len(data)))
        self.ending.make_automaton()

    def _undisturbed(self, x: int, y: int, limit: int) -> bool:
        """Whether no merge across the border of ``x`` and ``y`` comes before merge number ``limit``.

        The border is undone merge by merge, latest first, down to two bytes.
        A pair across it that would merge before the merge just undone stands
        in the way; of two equal merges the left one comes first.
        """
        rank, formed, halves = self.rank, self.formed, self.halves
        tie = -1
        while True:
            r = rank.get(x << 32 | y)
            if r is not None and (r < limit or r == tie):
                return False
            fx, fy = formed.get(x, -1), formed.get(y, -1)
            if fx < 0 and fy < 0:
                return True
            if fx > fy:
                limit, tie, x = fx, -1, halves[x][1]
            else:
                limit, tie, y = fy, fy, halves[y][0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and then ``b`` are encoded as just these two tokens."""
        memo, key = self._compatible, a << 32 | b
        known = memo.get(key)
        if known is None:
            if len(memo) >= MEMO:
                memo.clear()
            known = memo[key] = self._undisturbed(a, b, len(self.rank))
        return known

    def part(self, data: bytes) -> Iterable[int]:
        """The tokens of one split part.

        Up to the window's length nothing has to be given out early: an
        automaton of all tokens tells which ones end at each byte, longest
        first, and the compatible one among them is the state's next entry.
        """
        n = len(data)
        if n > self.window:
            return self.stream(data)
        memo, compatible = self._compatible, self.compatible
        last, done = [-1] * (n + 1), 0
        for place, (token, length) in self.ending.iter(data.decode("latin-1")):
            place += 1
            if place == done:
                continue
            if place != length:
                before = last[place - length]
                ok = memo.get(before << 32 | token)
                if ok is None:
                    ok = compatible(before, token)
                if not ok:
                    continue
            last[place] = token
            done = place
        if last[n] < 0:
            raise ValueError("the vocabulary lacks a byte")
        out, size = [], self.length
        while n:
            token = last[n]
            out.append(token)
            n -= size[token]
        return out[::-1]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Emits each token as soon as no further byte can change it.

        Bytes are read a window at a time; the automaton keeps its place
        between them.
        """
        window, memo, compatible = self.window, self._compatible, self.compatible
        begin: list[int] = [0]  # for each place since `base`: where its last token began, counted from `base`
        last: list[int] = [-1]  # and that token; -1 only before the first byte
        base = 0
        source, found = iter(data), None
        while block := bytes(islice(source, window)):
            text = block.decode("latin-1")
            if found is None:
                found = self.ending.iter(text)
            else:
                found.set(text)
            for place, (token, length) in found:
                end = place + 1 - base
                if end < len(last):
                    continue
                at = end - length
                before = last[at]
                if before >= 0:
                    ok = memo.get(before << 32 | token)
                    if ok is None:
                        ok = compatible(before, token)
                    if not ok:
                        continue
                begin.append(at)
                last.append(token)
            end = len(last) - 1
            if end >= 4 * window:
                # Do the paths back from all places that a token to come may start at meet after `base`?
                alive = set(range(end - window + 1, end + 1))
                while len(alive) > 1:
                    top = max(alive)
                    alive.remove(top)
                    alive.add(begin[top])
                meet = alive.pop()
                if meet > 0:
                    yield from self._back(begin, last, meet)
                    last, base = last[meet:], base + meet
                    begin = [max(0, p - meet) for p in begin[meet:]]
        yield from self._back(begin, last, len(last) - 1)

    @staticmethod
    def _back(begin: list[int], last: list[int], place: int) -> list[int]:
        """The tokens between `base` and a place."""
        out = []
        while place > 0:
            out.append(last[place])
            place = begin[place]
        return out[::-1]


def _as_bytes(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Texts to ids: special strings, split parts, then the transducer, with a bounded memo of parts."""

    def __init__(self, path: str | None):
        import regex

        v = vocab.vocabulary(path)
        self.special = v.special
        self.split = regex.compile(vocab.PATTERN)
        #: White space after something else: no part, and no special string of a public vocabulary, goes on across it.
        self.border = regex.compile(r"(?r)(?<=\S)\s")
        self.borders_are_safe = not any(map(self.border.search, v.special))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.transducer = Transducer(v)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _segment(self, text: str) -> list[bytes]:
        parts = self.split.findall(text)
        out = list(map(self.memo.get, parts))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    out[i] = self._part(parts[i])
        return out

    def _part(self, word: str) -> bytes:
        known = self.memo.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                known = _as_bytes(self.transducer.part(word.encode()))
            if len(word) <= 64:
                if len(self.memo) >= MEMO // 2:
                    self.memo, self.older = {}, self.memo
                self.memo[word] = known
        return known

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in blocks, as ``encode`` gives them, block by block."""
        held, tried = "", 0
        for block in blocks:
            held += block
            # A stretch without a border is sought again only when it has doubled.
            if not self.borders_are_safe or len(held) < 2 * tried:
                continue
            border = self.border.search(held)
            if border is None:
                tried = len(held)
                continue
            yield self.encode(held[: border.start()])
            held, tried = held[border.start() :], 0
        yield self.encode(held)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_split is None or not any(s in text for s in self.special):
            return b"".join(self._segment(text))
        out = []
        for piece in self.special_split.split(text):
            out += [self.special[piece].to_bytes(4, "little")] if piece in self.special else self._segment(piece)
        return b"".join(out)


class Decoder:
    """Ids to text, step by step: ``feed`` returns the text that is complete, ``close`` the rest."""

    def __init__(self, path: str | None):
        import codecs

        table = vocab.vocabulary(path).bytes_of
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]
        self._new = codecs.getincrementaldecoder("utf-8")
        self.state = self._new("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def close(self) -> str:
        rest = self.state.decode(b"", True)
        self.state = self._new("replace")
        return rest


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str | None) -> Decoder:
    return Decoder(path)


#: Characters that are encoded at a time.
BLOCK = 65536


def blocks_of(text: str) -> Iterator[str]:
    """A text, a block at a time; an empty one is one empty block."""
    for i in range(0, max(len(text), 1), BLOCK):
        yield text[i : i + BLOCK]


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text of (doc_id, text) and decodes it again.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids: array<int>).
    A text goes through block by block, and ids are kept only ``with_ids``; so
    beside the text itself memory does not grow with its length. Null text: as
    an empty one, which has no ids. Repeated rows and null doc_id: a row each.
    Empty table: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc, dec = encoder(path), decoder(path)
        for b in pieces(batches):
            out: list[list] = [[], [], [], []]
            for text in b.column(1).to_pylist():
                count, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for raw in enc.stream(blocks_of(text or "")):
                    ids = np.frombuffer(raw, "<u4")
                    count += len(ids)
                    of_ids.update(raw)
                    of_text.update(dec.feed(ids.tolist()).encode())
                    if with_ids:
                        kept.append(ids.astype("<i4"))
                of_text.update(dec.close().encode())
                for c, x in zip(out, (count, of_ids.hexdigest(), of_text.hexdigest(), np.concatenate(kept) if with_ids else None), strict=True):
                    c.append(x)
            columns = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(out[3], pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))

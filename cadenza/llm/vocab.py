"""Loading a public byte-level BPE vocabulary in the executors.

``encode_fast`` gives the ids that the tokenizers library gives for the same
vocabulary file (``add_special_tokens=False``, strings of special tokens in a
text becoming their id), through tiktoken's core, several times faster. The
tests compare the two over every Unicode code point. That core's pattern engine
gives up on a run of white space of about a million characters, so texts are cut
at long runs first, just where the pattern itself would cut them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"

#: Fixed value: the pattern that splits text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: what the pattern's white-space class matches.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space in a row that is cut out of a text before the pattern sees it.
LONG_RUN = 65536
_LONG_SPACE = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")


def default_path() -> str:
    """The vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files: character -> byte.

    Printable Latin-1 bytes stand for themselves, the others take the
    characters from U+0100 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        to_byte = byte_alphabet()
        model = d["model"]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        self.ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.ids[bytes(to_byte[c] for c in token)] = i
        self.merges: list[tuple[bytes, bytes]] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((bytes(to_byte[c] for c in a), bytes(to_byte[c] for c in b)))
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))


@lru_cache(maxsize=4)
def vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary of a file; of the default one, wherever this process has it, if there is no path."""
    return Vocabulary(path or default_path())


@lru_cache(maxsize=4)
def encoder(path: str | None):
    """tiktoken's core over the same vocabulary; its merge order is that of the ids."""
    import tiktoken

    v = vocabulary(path)
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)


def cut_long_space(text: str, special: tuple[str, ...]) -> Iterator[tuple[bool, str]]:
    """Pieces of a text whose ids, one after the other, are those of the text; true for a piece that is one split part.

    The pattern takes a run of white space as a whole where nothing but the end
    (or a special string) follows, and all but its last character where
    anything else does.
    """
    at = 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(special, m.end()) else m.end() - 1
        yield False, text[at : m.start()]
        yield True, text[m.start() : end]
        at = end
    yield False, text[at:]


def encode_fast(path: str | None, text: str) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers, whatever its length and what it holds."""
    if not text:
        return np.empty(0, "<u4")
    core = encoder(path)
    if len(text) < LONG_RUN or not _LONG_SPACE.search(text):
        return core.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    from . import bpe

    out = []
    for is_part, piece in cut_long_space(text, tuple(vocabulary(path).special)):
        if is_part:
            out.append(np.fromiter(bpe.encoder(path).transducer.part(piece.encode()), "<u4"))
        elif piece:
            out.append(core.encode_to_numpy(piece, allowed_special="all").astype("<u4", copy=False))
    return np.concatenate(out)

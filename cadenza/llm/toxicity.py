"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

*Restoring.* Words that may be disguised (a symbol and a letter in a run, a
letter repeated, single letters set apart, separators inside) become character
lattices, whatever their length and neighbours: a symbol
may stand for the letters it resembles, a run of a letter for one or two of it,
a separator for nothing. A Viterbi search takes the reading that a character
trigram model of the corpus's words finds likeliest together with the channel's
costs. Restored words stand beside the words as written.

*Scoring.* A logistic model over words and word beginnings. Its features are
chosen by how much likelier they are in documents labelled toxic (a
log-likelihood ratio), its weights are fitted on the driver.

Labels are learnt from at most ``SAMPLE`` labelled rows of each class, taken by
a hash of doc_id, and never from rows held out. The trigram model, which uses
no labels, counts all documents. Neither labels nor lang,
source or doc_id are inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, keeping_columns, materialize, pieces

#: Labelled rows of each class that a model is fitted on, at most (in expectation: a hash decides).
SAMPLE = 5000
#: Features of a model at most, and the least evidence for one (a likelihood ratio, as a chi-square value).
FEATURES, EVIDENCE = 512, 16.0
THRESHOLD = 0.3
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6)
MEMO = 300_000

#: Letters that symbols stand for.
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}

_SYMBOLS = re.escape("".join(LEET))
WORD = re.compile(r"[^\W\d_]+")
#: Runs of letters, digits and symbols, which may be words in disguise if they have a symbol and a letter.
CHUNK = re.compile(rf"[\w{_SYMBOLS}]+")
LETTER = re.compile(r"[^\W\d_]")
REPEATED = re.compile(r"([^\W\d_])\1")
#: Single letters set apart, and runs with separators inside.
SPACED = re.compile(rf"(?<![\w{_SYMBOLS}])[\w{_SYMBOLS}](?:[ .\-_*/\n\t\r]{{1,3}}[\w{_SYMBOLS}]){{2,}}(?![\w{_SYMBOLS}])")
BROKEN = re.compile(rf"[\w{_SYMBOLS}]+(?:[.\-_*/]{{1,3}}[\w{_SYMBOLS}]+)+")
_SEPARATORS = " .-_*/\n\t\r"


@dataclass
class CharModel:
    """Trigram log probabilities, none under the floor that unseen ones have; ^ begins and $ ends a word."""

    logp: dict[str, float] = field(default_factory=dict)
    floor: float = -7.0

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharModel:
        context: Counter = Counter()
        for t, n in counts.items():
            context[t[:2]] += n
        return cls({t: max(cls.floor, math.log(n / (context[t[:2]] + 5.0))) for t, n in counts.items()})

    def step(self, context: str, c: str) -> float:
        return self.logp.get(context + c, self.floor)


def trigrams(word: str) -> list[str]:
    w = f"^^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters: what it may stand for, and the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        if c in _SEPARATORS:
            out.append([("", 0.0)])
        elif c in LEET:
            ways = [(x * k, -1.0 - 0.5 * (k - 1)) for x in LEET[c] for k in (1, 2) if k <= n]
            out.append([*ways, ("", -4.0)])
        elif n == 1:
            out.append([(c, 0.0)])
        elif n == 2:
            out.append([(c * 2, 0.0), (c, -2.0)])
        else:
            out.append([(c, -0.5), (c * 2, -1.0)])
        i = j
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a disguised token: Viterbi over (lattice place, last two characters)."""
    # A reading is a chain of (reading before, letters), so that long tokens cost no more a step than short ones.
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for ways in _lattice(token):
        reached: dict[str, tuple[float, tuple | None]] = {}
        for context, (score, chain) in states.items():
            for letters, cost in ways:
                s, c = score + cost, context
                for x in letters:
                    s += model.step(c, x)
                    c = c[1] + x
                if c not in reached or s > reached[c][0]:
                    reached[c] = (s, (chain, letters) if letters else chain)
        states = reached
    best = max(states, key=lambda c: (states[c][0] + model.step(c, "$"), c))
    out, chain = [], states[best][1]
    while chain is not None:
        chain, letters = chain
        out.append(letters)
    return "".join(reversed(out))


_SYMBOL = re.compile(f"[{_SYMBOLS}]")
_BREAK = re.compile(r"[.\-_*/]")


def leeted(text: str) -> Iterator[re.Match]:
    """Runs with a symbol and a letter, wherever they stand and however long they are."""
    return (m for m in CHUNK.finditer(text) if _SYMBOL.search(m.group()) and LETTER.search(m.group()))


def stretched(text: str) -> Iterator[re.Match]:
    """Words with a letter twice or more in a row."""
    return (m for m in WORD.finditer(text) if REPEATED.search(m.group()))


def spaced(text: str) -> Iterator[re.Match]:
    """Three or more single letters set apart, some of them letters as written."""
    return (m for m in SPACED.finditer(text) if LETTER.search(m.group()))


def likelihood(words: list[str], model: CharModel) -> float:
    return sum(model.logp.get(t, model.floor) for w in words for t in trigrams(w))


def joined(text: str, model: CharModel) -> Iterator[tuple[re.Match, str]]:
    """Runs with separators inside that are likelier as one word than as the parts that are written, and that word."""
    for m in BROKEN.finditer(text):
        parts = WORD.findall(m.group())
        if parts:
            reading = restore(m.group(), model)
            if likelihood(WORD.findall(reading), model) > likelihood(parts, model):
                yield m, reading


class Reader:
    """Distinct words of texts, the restored ones included.

    Texts are read token by token (between white space) with a bounded memo, so
    a token is looked into once; only letters set apart span tokens. ``wanted``
    says which words are of interest, and ``hopeful`` of which stretched words
    any reading can be one.
    """

    def __init__(self, model: CharModel, wanted: Callable[[str], bool] | None = None, hopeful: Callable[[str], bool] | None = None):
        self.model, self.wanted, self.hopeful, self.memo = model, wanted, hopeful, {}

    def _words(self, token: str) -> tuple[str, ...]:
        plain = token.isalpha()
        found = [token] if plain else WORD.findall(token)
        if not plain and _SYMBOL.search(token):
            for m in leeted(token):
                found += WORD.findall(restore(m.group(), self.model))
        if REPEATED.search(token):
            found += [restore(m.group(), self.model) for m in stretched(token) if self.hopeful is None or self.hopeful(m.group())]
        if not plain and _BREAK.search(token):
            for _, reading in joined(token, self.model):
                found += WORD.findall(reading)
        return tuple(w for w in found if self.wanted(w)) if self.wanted else tuple(found)

    def words(self, text: str) -> set[str]:
        low, memo, out = text.lower(), self.memo, set()
        for token in set(low.split()):
            known = memo.get(token)
            if known is None:
                if len(memo) >= MEMO:
                    memo.clear()
                known = memo[token] = self._words(token)
            if known:
                out.update(known)
        for m in spaced(low):
            read = WORD.findall(restore(m.group().strip(_SEPARATORS), self.model))
            out.update(w for w in read if self.wanted(w)) if self.wanted else out.update(read)
        return out

    def restored_text(self, text: str) -> str:
        """The text, lower case, with disguised parts replaced by their readings."""
        low = text.lower()
        for find in (spaced, lambda x: joined(x, self.model), leeted, stretched):
            out, at = [], 0
            for m in find(low):
                m, reading = m if isinstance(m, tuple) else (m, restore(m.group().strip(_SEPARATORS), self.model))
                out += [low[at : m.start()], reading]
                at = m.end()
            low = "".join([*out, low[at:]])
        return low


_RUN = re.compile(r"(.)\1+")


def collapsed(word: str) -> str:
    """The word with every run of a letter written once; all readings of a stretched word have the same one."""
    return _RUN.sub(r"\1", word)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Callable[[str], float]:
        """text -> probability; a feature counts once per distinct word, at most three times."""
        weights = self.weights
        whole = {f for f in weights if not f.endswith("-")}
        begun = [(n, {f[:n] for f in weights if f.endswith("-") and len(f) == n + 1}) for n in BEGINNINGS]
        begun = [(n, known) for n, known in begun if known]

        def wanted(w: str) -> bool:
            if w in whole:
                return True
            for n, known in begun:
                if w[:n] in known and len(w) > n:
                    return True
            return False

        # What a wanted word begins with once its runs are collapsed.
        starts = {collapsed(f.rstrip("-"))[:3] for f in weights}

        def hopeful(w: str) -> bool:
            c = collapsed(w)
            return c[:3] in starts or c[:2] in starts or c[:1] in starts

        reader = Reader(self.chars, wanted, hopeful)

        def score(text: str) -> float:
            hits = Counter(f for w in reader.words(text) for f in features(w) if f in weights)
            # In a fixed order: equal texts get equal scores to the last bit.
            z = self.bias + sum(weights[f] * min(hits[f], 3) for f in sorted(hits))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _fit(rows: list[tuple[int, list[int]]], n: int, importance: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge, by accelerated gradient steps."""
    x = np.zeros((len(rows), n), np.float32)
    for i, (_, hits) in enumerate(rows):
        for h, c in Counter(hits).items():
            x[i, h] = min(c, 3)
    y = np.array([t for t, _ in rows], np.float32)
    share = np.where(y > 0, importance[1], importance[0]).astype(np.float32)
    share /= share.sum()
    w, b = np.zeros(n, np.float32), float(np.log((share @ y + 1e-3) / (1 - share @ y + 1e-3)))
    look_w, look_b, t = w.copy(), b, 1.0
    step = 1.0 / (0.25 * float((share * ((x * x).sum(1) + 1)).sum()) + 1e-4)
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(x @ look_w + look_b, -30, 30)))
        err = share * (p - y)
        new_w = look_w - step * (x.T @ err + 1e-4 * look_w)
        new_b = look_b - step * float(err.sum())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return w, b


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); without usable labels one that gives every text 0.1."""
    spark = docs.sparkSession
    known = exact(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(CharModel(), {}, math.log(0.1 / 0.9))
    share = {t: min(1.0, sample / n[t]) for t in (0, 1)}
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).cast("double")
    taken = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    texts = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # `taken` holds about `sample` rows of each class whatever the corpus, so sending it to every task is bounded.
    rows = materialize(texts.join(F.broadcast(taken), "doc_id").select("toxic", "text"), "sample")

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Counter(), Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                words.update(set(WORD.findall(text.lower())))
            if len(words) > 200_000:
                for w, n in words.items():
                    for t in trigrams(w):
                        seen[t] += n
                words.clear()
            if len(seen) > 500_000:
                yield told()
                seen.clear()
        for w, n in words.items():
            for t in trigrams(w):
                seen[t] += n
        yield told()

    # The language model needs no labels: it counts each word once a document, over all documents. Its table has at
    # most the trigrams that the corpus's scripts have; each task sends sums.
    counted = texts.select("text").mapInArrow(count_trigrams, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    chars = CharModel.of({r["t"]: r["n"] for r in counted.toLocalIterator()})

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(chars), Counter()

        def told():
            names = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64())], names=["f", "n"])

        for b in pieces(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if toxic:
                    seen.update({f for w in reader.words(text) for f in features(w)})
            if len(seen) > 500_000:
                yield told()
                seen = Counter()
        yield told()

    likely = rows.where("toxic = 1").mapInArrow(count_features, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    # Candidates: features that enough toxic documents share, the most frequent 40 times as many as a model may have.
    candidates = {r["f"]: r["n"] for r in likely.where(F.col("n") >= max(3, int(0.002 * min(n[1], sample)))).orderBy(F.desc("n"), "f").limit(40 * FEATURES).collect()}
    order = {f: i for i, f in enumerate(sorted(candidates))}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars)
        for b in pieces(batches):
            found = [[order[f] for w in reader.words(t) for f in features(w) if f in order] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "hits"])

    held = materialize(rows.mapInArrow(hits, "toxic int, hits array<int>"), "hits")
    each = held.select("toxic", F.explode(F.array_distinct("hits")).alias("h")).groupBy("h").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    npos, nneg = size.get(1, 0), size.get(0, 0)
    if not npos or not nneg:
        return Model(chars, {}, math.log(0.1 / 0.9))
    scored = []
    for r in each.collect():  # at most as many rows as there are candidates
        a, b = r["a"], r["b"]
        if a / npos > 3 * (b + 0.5) / nneg:
            expected = (a + b) * npos / (npos + nneg)
            ratio = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))
            if ratio >= EVIDENCE:
                scored.append((-ratio, r["h"]))
    chosen = [h for _, h in sorted(scored)[:FEATURES]]
    if not chosen:
        prior = n[1] / (n[0] + n[1])
        return Model(chars, {}, math.log(prior / (1 - prior)))
    again = {h: i for i, h in enumerate(chosen)}

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [[again[h] for h in x if h in again] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int32()))], names=["toxic", "hits"])

    data = held.mapInArrow(picked, "toxic int, hits array<int>").collect()  # the bounded sample
    w, bias = _fit([(r["toxic"], r["hits"]) for r in data], len(chosen), (1 / share[0], 1 / share[1]))
    names = sorted(candidates)
    return Model(chars, {names[h]: float(w[i]) for h, i in again.items()}, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text).

    Null text: as an empty one, which gets the model's base rate. Null doc_id:
    null, not held out. Empty table: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in pieces(batches):
            s = pa.array([of(t or "") for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s], names=["doc_id", "score"])

    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@keeping_columns("doc_id", "text")
def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold; all columns kept, texts never shuffled."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = model.scorer()
        for texts in batches:
            yield pd.Series([s(t or "") for t in texts], dtype="float64")

    return docs.where(of(F.col("text").cast("string")) < threshold)

"""Language identification by Bayesian evidence fusion.

For each row and language the log posterior adds up

* the text: byte trigrams under a smoothed model per language, tempered, since
  neighbouring trigrams are not independent;
* the declared language (markup or metadata), through how often it is right:
  a confusion table counted over the whole corpus;
* the address suffix, likewise;
* the host: a prior smoothed through a hierarchy, host -> parent -> corpus,
  whose counts are grouped aggregates of the text's own posteriors, so that no
  host's rows ever meet in one task.

Trigram models are fitted on a bounded sample of rows that declare a language;
all other statistics are over all rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact, keeping_columns, materialize, pieces

#: Rows that the trigram models are fitted on, per language (in expectation: a hash decides).
SAMPLE = 1500
#: Buckets of the hashed trigram table.
BUCKETS = 1 << 16
#: So many trigrams of a text count in full; a longer text's evidence is scaled down to that.
EVIDENCE = 300.0
#: Weight of the level above in rows, and of one more confusion count.
PRIOR_ROWS, CONFUSION = 20.0, 1.0
#: Least posterior of an accepted row.
CERTAIN = 0.5
#: A declared language is modelled if so many rows declare it or, in small tables, this share of them.
LEAST_ROWS, SHARE = 20, 0.005

#: Elements whose content is not read, and where each ends.
_UNREAD = re.compile(r"(script|style|head|nav)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "head", "nav")}
#: The language that the first html element with one declares, wherever it stands.
_MARKUP = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def page_text(markup: str) -> str:
    """What a reader of a page sees, without navigation, in one pass: an end that is missing is sought once."""
    out, at, missing = [], 0, set()

    def end_of(key: str, start: int, close: re.Pattern | str) -> int:
        if key in missing:
            return -1
        if isinstance(close, str):
            found = markup.find(close, start)
            end = found + len(close) if found >= 0 else -1
        else:
            m = close.search(markup, start)
            end = m.end() if m else -1
        if end < 0:
            missing.add(key)
        return end

    while (i := markup.find("<", at)) >= 0:
        m = _UNREAD.match(markup, i + 1)
        end = end_of(m.group(1).lower(), m.end(), _CLOSE[m.group(1).lower()]) if m else -1
        if end < 0 and markup.startswith("<!--", i):
            end = end_of("<!--", i + 4, "-->")
        if end < 0:
            end = end_of(">", i + 1, ">")
        if end < 0:
            break
        out += [markup[at:i], " "]
        at = end
    return html.unescape("".join([*out, markup[at:]]))


def _buckets(text: str) -> np.ndarray:
    """Hashed byte trigrams around and inside words; other characters count as one blank."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    x = np.where(letter, raw, 32).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]
    x = x[keep]
    if len(x) < 3 or not letter.any():
        return np.empty(0, np.int64)
    h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (BUCKETS, languages)

    def evidence(self, text: str) -> list[float] | None:
        """Tempered log likelihoods, the greatest being 0; null for a text without letters."""
        b = _buckets(text)
        if not len(b) or not self.languages:
            return None
        total = np.zeros(len(self.languages))
        for i in range(0, len(b), 1 << 16):
            total += self.logp[b[i : i + (1 << 16)]].sum(0, dtype=np.float64)
        total *= min(1.0, EVIDENCE / len(b))
        return (total - total.max()).tolist()


def _read(content: str | None, markup: bool) -> str:
    return (page_text(content) if markup else content) if content else ""


def fit(rows: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> Model:
    """A model from (content, is_markup, declared) rows; declared languages are told apart as they are spelt."""
    named = rows.where("declared is not null and content is not null")
    least = min(LEAST_ROWS, share * named.count())
    counts = {r["declared"]: r["n"] for r in named.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    place = (F.pmod(F.xxhash64("content"), F.lit(1 << 20)) / (1 << 20)).cast("double")
    odds = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / counts[k]))])
    taken = named.where(F.col("declared").isin(languages)).where(place < F.try_element_at(odds, F.col("declared"))).select("declared", "content", "is_markup")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(BUCKETS, np.int64) for k in languages}
        for b in pieces(batches):
            for k, content, markup in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[k] += np.bincount(_buckets(_read(content, markup)), minlength=BUCKETS)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["declared", "bucket", "n"])

    table = np.zeros((BUCKETS, len(languages)))
    counted = taken.mapInArrow(count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most BUCKETS rows for each language
    table[found["bucket"], found["declared"].map({k: i for i, k in enumerate(languages)})] = found["n"]
    table += 0.1
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def with_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Replaces ``content`` and ``is_markup`` by ``evidence`` (array<double>); other columns are kept."""
    rest = [c for c in rows.columns if c not in ("content", "is_markup")]
    schema = T.StructType([*rows.select(*rest).schema.fields, T.StructField("evidence", T.ArrayType(T.DoubleType()))])
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [model.evidence(_read(c, m)) for c, m in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.list_(pa.float64()))], names=[*rest, "evidence"])

    return rows.select(*rest, "content", "is_markup").mapInArrow(run, schema)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(n: int, column: str) -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(n)]


def _as_array(n: int) -> Column:
    return F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(n)])


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """Adds lang, posterior, text_lang and kept to rows with evidence, declared, suffix, host and parent.

    Any of these may be null, which is no evidence. Rows without letters have
    lang "und", posterior 0 and are not kept.
    """
    n = len(model.languages)
    if not n:
        return rows.withColumns({"lang": F.lit("und"), "posterior": F.lit(0.0), "text_lang": F.lit("und"), "kept": F.lit(False)}).drop("evidence")
    names = F.array(*map(F.lit, model.languages))
    rows = materialize(rows.withColumn("alone", _softmax(F.col("evidence"))), "evidence")
    told = rows.where("evidence is not null")
    corpus = told.agg(*_sums(n, "alone")).first()
    whole = [float(corpus[i] or 0.0) + 1.0 for i in range(n)]
    base = [x / sum(whole) for x in whole]

    def confusion(column: str) -> DataFrame:
        """(value, logs): log P(value | language) of every value; one that few rows have is smoothed to nothing."""
        counted = told.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(*_sums(n, "alone"))
        counted = materialize(counted.select("value", _as_array(n).alias("counts")), "values")
        sums = counted.agg(*_sums(n, "counts")).first()
        of_language = [float(sums[i] or 0.0) for i in range(n)]
        total = sum(of_language) or 1.0
        overall = (F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) + CONFUSION) / (total + CONFUSION)
        sizes = F.array(*[F.lit(x + CONFUSION) for x in of_language])
        logs = F.zip_with("counts", sizes, lambda c, size: F.log((c + CONFUSION * overall) / size))
        return counted.select(F.col("value").alias(f"{column}_value"), logs.alias(f"{column}_logs"))

    # Host priors: counts of each level, smoothed by the level above.
    parents = told.where("parent is not null").groupBy("parent").agg(*_sums(n, "alone")).select(F.col("parent").alias("p"), _as_array(n).alias("p_counts"))
    hosts = told.where("host is not null").groupBy("host", "parent").agg(*_sums(n, "alone")).select("host", "parent", _as_array(n).alias("h_counts"))
    up = F.array(*map(F.lit, base))

    def smoothed(counts: Column, above: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + PRIOR_ROWS
        return F.transform(F.arrays_zip(counts.alias("c"), above.alias("a")), lambda z: (z["c"] + PRIOR_ROWS * z["a"]) / total)

    parents = parents.withColumn("p_prior", smoothed(F.col("p_counts"), up)).select("p", "p_prior")
    hosts = hosts.join(parents, F.col("parent").eqNullSafe(F.col("p")), "left").withColumn("above", F.coalesce("p_prior", up))
    hosts = materialize(hosts.select(F.col("host").alias("h"), F.col("parent").alias("hp"), smoothed(F.col("h_counts"), F.col("above")).alias("h_prior")), "hosts")
    joined = rows.join(hosts, (F.col("host") == F.col("h")) & F.col("parent").eqNullSafe(F.col("hp")), "left")
    for column in ("declared", "suffix"):
        joined = joined.join(confusion(column), F.col(column) == F.col(f"{column}_value"), "left")
    flat = F.array(*[F.lit(0.0)] * n)
    parts = [F.col("evidence"), F.transform(F.coalesce("h_prior", up), lambda x: F.log(x)), F.coalesce("declared_logs", flat), F.coalesce("suffix_logs", flat)]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    done = joined.withColumn("fused", _softmax(total))
    best = lambda c: F.when(F.col(c).isNotNull(), F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int")))
    done = done.withColumns({"lang": F.coalesce(best("fused"), F.lit("und")), "posterior": F.coalesce(F.array_max("fused"), F.lit(0.0)), "text_lang": F.coalesce(best("alone"), F.lit("und"))})
    return done.withColumn("kept", F.col("posterior") >= CERTAIN).drop("evidence", "alone", "fused", "h", "hp", "h_prior", "declared_value", "declared_logs", "suffix_value", "suffix_logs")


def from_documents(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source") -> DataFrame:
    """Evidence rows of documents: doc_id, content, declared; the source is the host, and its name without digits the parent."""
    names = ["doc_id", text] + [c for c in (declared, host) if c]
    d = exact(docs, *dict.fromkeys(names))
    said = F.lower(F.col(declared).cast("string")) if declared else F.lit(None).cast("string")
    home = F.col(host).cast("string") if host else F.lit(None).cast("string")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col(text).cast("string").alias("content"), F.lit(False).alias("is_markup"), said.alias("declared"), F.lit(None).cast("string").alias("suffix"), home.alias("host"), F.regexp_replace(home, "[0-9]+$", "").alias("parent"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence rows of pages (page_id, url, html): declared markup language, address suffix, host and domain; the text is read later."""
    p = exact(pages, "page_id", "url", "html")
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    seen = p.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("content"))
    some = lambda c: F.nullif(c, F.lit(""))
    said = some(F.lower(F.regexp_extract("content", _MARKUP, 1)))
    return seen.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "content", F.lit(True).alias("is_markup"), said.alias("declared"), some(F.regexp_extract("host", r"\.([a-z]{2,})$", 1)).alias("suffix"), "host", some(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).alias("parent"))


def identify(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fits on ``rows`` (content, is_markup, declared, suffix, host, parent and any ids), and returns the ids with lang, posterior, text_lang, kept.

    Empty table: empty result. Null or empty text, or one without a letter:
    "und". Repeated rows are each returned. Of equally likely languages the
    first by name is taken. Texts and pages of any length are read whole, in
    time linear in it.
    """
    model = fit(rows, sample)
    return fuse(with_evidence(rows, model), model)


@keeping_columns("doc_id", "text", "lang", "source")
def identified_documents(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source") -> DataFrame:
    """The documents whose language is identified; all rows of them and all columns are kept.

    What goes is listed first, as ids and hashes of texts; texts move only as
    far as the join with that list needs.
    """
    rows = from_documents(docs, text, declared, host).withColumn("text_hash", F.xxhash64("content"))
    gone = identify(rows).where("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    gone = materialize(gone, "unidentified")
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_hash")), "left_anti")

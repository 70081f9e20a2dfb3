"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

1. *Candidates.* Three kinds of pattern are matched over whole texts. A regular
   expression marks each match, the text is split at the marks, and lengths of
   what lies between give places in code points.
2. *Ownership.* The SHA-256 of each candidate's value is aggregated over the
   corpus: how many distinct owners and repositories hold it.
3. *Verdict.* A value that many owners or many repositories hold is a widely
   copied example. One that few hold and that does not look like a placeholder
   is live-looking if something says that it is a credential: its own form (an
   access key), or a name it is assigned to, here or anywhere in the corpus.
   Hex digits alone say nothing: commit ids and checksums are such. The span of
   a live-looking value is reported once more, as kind ``live``.

Only hashes, places and counts are shuffled; texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exact, keeping_columns, materialize

#: The kinds in the order of a listing, their patterns, and the least length that counts.
KINDS = ["assign", "access", "hex", "live"]
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGN = 12
# Runs shorter than these cannot contain one that counts, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Owners, and repositories, from which on a value is a widely copied example.
COPIED_FROM, COPIED_REPOSITORIES = 3, 6
#: Words that placeholders are made of.
PLACEHOLDER = r"example|sample|dummy|changeme|placeholder|your[_-]?(?:key|token|secret|password)|x{6,}|0{8,}"


def either_case(pattern: str) -> str:
    """The pattern with each letter of the key words in either case, without a flag, for engines that fold beyond ASCII."""
    out, depth = [], 0
    for c in pattern:
        depth += (c == "[") - (c == "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not depth and out[-1:] != ["\\"] else c)
    return "".join(out)


def _patterns() -> dict[str, str]:
    # Only the key words are in either case; the rest of the pattern has no letters outside classes and \x20.
    words, rest = ASSIGN.split(")", 1)
    return {"assign": words.replace("(?:", "(?i:") + ")" + rest, "access": ACCESS, "hex": HEX}


def _marked(kind: str, pattern: str):
    """array<struct<kind, place, gap, size, value>>: the text before each match, its length and what it holds."""
    open_, close = "\u0001", "\u0002"
    parts = F.split(F.regexp_replace("clean", pattern, f"{open_}$0{close}"), open_)
    # The text before the first mark, then for each match "match, close, text up to the next".
    whole = lambda p: F.substring_index(p, close, 1)
    after = lambda p: F.length(p) - F.length(whole(p)) - 1
    value = (lambda p: F.regexp_extract(p, pattern, 1)) if kind == "assign" else whole
    rows = F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.when(i == 2, F.length(F.element_at(parts, 1))).otherwise(after(F.element_at(parts, i - 1))).alias("gap"), F.length(whole(F.element_at(parts, i))).alias("size"), value(F.element_at(parts, i)).alias("value")),
    )
    return F.when(F.size(parts) > 1, rows).otherwise(F.expr("array()").cast("array<struct<kind:string,place:int,gap:int,size:int,value:string>>"))


def _scan(docs: DataFrame, owner: str | None, repository: str | None) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (rid, doc_id) and spans (rid, doc_id, text_hash, owner, repository, kind, start, end, value, hash)."""
    names = ["doc_id", "text"] + [c for c in (owner, repository) if c]
    d = exact(docs, *dict.fromkeys(names))
    d = d.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\u0001\u0002", "\u0003\u0003").alias("clean"), (F.col(owner) if owner else F.col("doc_id")).cast("string").alias("owner"), (F.col(repository) if repository else F.lit("")).cast("string").alias("repository"))
    found = F.concat(*[_marked(k, p) for k, p in _patterns().items()])
    rows = materialize(d.select("rid", "doc_id", "text_hash", "owner", "repository", found.alias("found")), "scanned")
    own = ["rid", "doc_id", "text_hash", "owner", "repository"]
    one = rows.where(F.size("found") > 0).select(*own, F.explode("found").alias("m")).select(*own, "m.*")
    order = Window.partitionBy("rid", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    good = placed.where((F.col("kind") != "assign") | (F.length("value") >= LEAST_ASSIGN))
    return rows.select("rid", "doc_id"), materialize(good.select(*own, "kind", "start", "end", "value", F.sha2("value", 256).alias("hash")), "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_found, n_owners, n_repositories, named) over the corpus; an unknown owner counts as one.

    ``named``: whether the value is an access key or assigned to a telling name anywhere.
    """
    known = spans.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), (F.col("kind") != "hex").alias("named"))
    each = known.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"), F.max("named").alias("named"))
    return each.groupBy("hash").agg(F.sum("n").alias("n_found"), F.count_distinct("owner").alias("n_owners"), F.count_distinct("owner", "repository").alias("n_repositories"), F.max("named").alias("named"))


def _judged(spans: DataFrame, copied_from: int) -> DataFrame:
    shared = materialize(ownership(spans), "ownership")
    joined = spans.join(shared.withColumnRenamed("hash", "h"), F.col("hash") == F.col("h"))
    copied = (F.col("n_owners") >= copied_from) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    return joined.withColumn("copied", copied).withColumn("live", ~F.col("copied") & F.col("named") & ~F.lower("value").rlike(PLACEHOLDER))


def scan(docs: DataFrame, owner: str | None = "source", repository: str | None = "lang", copied_from: int = COPIED_FROM) -> DataFrame:
    """One row per row of (doc_id, text, owner, repository).

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans
    "kind:start:end", comma-joined), spans (those and the live ones), n_live,
    n_copied (base spans whose value is a widely copied example).
    Spans cover whole matches, in code points, end exclusive. Null or empty
    text: no spans. Repeated rows are judged each; empty table: empty result.
    """
    rows, spans = _scan(docs, owner, repository)
    judged = _judged(spans, copied_from)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct(F.col("start"), order.alias("kind_no"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    extra = F.when(F.col("live"), F.struct(F.col("start"), F.lit(len(KINDS)).cast("long").alias("kind_no"), F.col("end"), F.concat_ws(":", F.lit("live"), "start", "end").alias("said")))
    said = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x["said"]))
    of = judged.select("rid", "kind", "live", "copied", entry.alias("entry"), extra.alias("extra"))
    per = of.groupBy("rid").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:3]], F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"), F.collect_list("entry").alias("base"), F.collect_list("extra").alias("more"))
    per = per.select("rid", "n_assign", "n_access", "n_hex", "n_live", "n_copied", said("base").alias("base"), said(F.concat("base", "more")).alias("spans"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(per, "rid", "left").select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"))


def _replaced(text, kind: str, pattern: str, values, mark: str):
    """``text`` with every match of a kind whose value is among ``values`` replaced."""
    open_, close = "\u0001", "\u0002"
    parts = F.split(F.regexp_replace(text, pattern, f"{open_}$0{close}"), open_)

    def one(p, i):
        whole = F.substring_index(p, close, 1)
        rest = F.substring(p, F.length(whole) + 2, F.length(p))
        value = F.regexp_extract(whole, pattern, 1) if kind == "assign" else whole
        kept = F.substring(whole, F.lit(1), F.length(whole) - F.length(value))
        return F.when(i == 0, p).when(F.array_contains(values, value), F.concat(kept, F.lit(mark), rest)).otherwise(F.concat(whole, rest))

    return F.array_join(F.transform(parts, one), "")


@keeping_columns("doc_id", "text", "source", "lang")
def redact(docs: DataFrame, owner: str | None = "source", repository: str | None = "lang", copied_from: int = COPIED_FROM, mark: str = "[SECRET]") -> DataFrame:
    """The documents (doc_id, text and any others) with live-looking values replaced by ``mark``.

    All rows and columns stay; texts without such a value are returned as they
    are, and only documents with a candidate are shuffled. Where a value is
    replaced, the marks U+0001 and U+0002 of that text become U+0003.
    """
    _, spans = _scan(docs, owner, repository)
    live = _judged(spans, copied_from).where("live").groupBy("doc_id", "text_hash").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(f"_{k}") for k in _patterns()])
    live = materialize(live.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), *[f"_{k}" for k in _patterns()]), "live")
    names = docs.columns
    candidate = F.coalesce(F.col("text").rlike("|".join(_patterns().values())), F.lit(False))
    maybe = docs.where(candidate)
    found = maybe.join(live, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left")
    text = F.translate("text", "\u0001\u0002", "\u0003\u0003")
    for k, p in _patterns().items():
        text = _replaced(text, k, p, F.col(f"_{k}"), mark)
    changed = F.when(F.col("_hash").isNull(), F.col("text")).otherwise(text)
    return docs.where(~candidate).unionByName(found.select(*[changed.alias(c) if c == "text" else F.col(c) for c in names]))

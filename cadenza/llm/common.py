"""What several operators of this subpackage share.

* ``shared_dir`` / ``materialize``: tables written to the folder that the
  cluster names in ``spark.checkpoint.dir``, so that a lost executor never
  costs more than one stage and every reader sees the same rows.
* ``connected_components``: alternating large-star / small-star contraction,
  all of it aggregations and joins.
* ``sieve``: tells most rows that a table of keys does not have, without a
  shuffle of the rows.
* ``exact``: picks columns by exact name, also where a table has extra columns
  whose names clash except for case.
"""

from __future__ import annotations

import atexit
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset (a
    local session, as in tests) a folder of this process is made and used.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        import shutil
        import tempfile

        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cadenza-shared-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], True)
    return f"file://{_LOCAL_DIRS[app]}"


_CLEANED: set[str] = set()


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in this application's part of the shared folder, which is removed when the driver ends."""
    app = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_remove_quietly, spark, app)
    return f"{app}/{what}-{uuid.uuid4().hex}"


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001, S110  the session may be gone already
        pass


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders that no later step reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Written:
    """A table in the shared folder: ``df`` reads it, ``drop`` removes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, what: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, what)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    The result has no lineage but the files, and real sizes, which adaptive
    execution uses to choose joins and to split skewed partitions.
    """
    return Written(df, what).df


#: Rows of an Arrow batch: texts can be long, and a batch is in memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of rows with texts small, unless the session already does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def exact(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns of ``df``, found by exact spelling and, failing that, by the only spelling there is.

    Every operator on texts starts here, so this also bounds the Arrow batches.
    """
    small_batches(df.sparkSession)
    have = df.columns
    at = []
    for n in names:
        same = [i for i, c in enumerate(have) if c == n] or [i for i, c in enumerate(have) if c.lower() == n.lower()]
        if not same:
            raise ValueError(f"no column {n!r} among {have}")
        at.append(same[0])
    lower = [c.lower() for c in have]
    if len(set(lower)) == len(lower):
        return df.select(*[F.col(f"`{have[i]}`").alias(n) for i, n in zip(at, names, strict=True)])
    by_place = df.toDF(*[f"c{i}" for i in range(len(have))])
    return by_place.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def keeping_columns(*needed: str) -> Callable:
    """For functions of documents that return the same columns: inside only the needed ones keep their names.

    Whatever else a table has, names that clash included, is renamed by
    position on the way in and gets its name back on the way out.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **how) -> DataFrame:
            small_batches(docs.sparkSession)
            names = docs.columns
            inner = [n if n in needed and names.index(n) == i else f"_extra{i}" for i, n in enumerate(names)]
            return f(docs.toDF(*inner), *args, **how).toDF(*names)

        return run

    return wrap


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that few texts at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: Bits of a sieve for each key, how many of them a key sets, and the most bits there are (a million words of 64).
SIEVE_EACH, SIEVE_SET, SIEVE_MOST = 16, 4, 1 << 26


def sieve(keys: DataFrame, most: int = SIEVE_MOST) -> Callable[..., DataFrame]:
    """A function (rows, h, passing=True) -> the rows whose 64-bit hash h passes, or those whose hash does not.

    The hashes of ``keys`` (one long column, a written table) all pass, and few
    others (some 2 %): a Bloom filter in which a key sets bits of one word, sent
    to every task. It is for rows that are too long to be shuffled for the sake
    of a few; what passes still has to be joined. Its size is bounded; of more
    than ``most`` / 16 keys, more of the others pass.
    """
    n = keys.count()
    if not n:
        return lambda rows, h, passing=True: rows.where(F.lit(not passing))
    words = min(most // 64, max(16, 1 << (SIEVE_EACH * n // 64).bit_length()))

    def place(h: Column) -> Column:
        return F.shiftrightunsigned(h, 6 * SIEVE_SET).bitwiseAND(words - 1)

    def bits(h: Column) -> Column:
        each = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(SIEVE_SET)]
        return functools.reduce(Column.bitwiseOR, each)

    h = F.col("key")
    table = keys.toDF("key").groupBy(place(h).alias("_word")).agg(F.bit_or(bits(h)).alias("_bits"))
    table = materialize(table, "sieve")

    def told(rows: DataFrame, h: Column, passing: bool = True) -> DataFrame:
        met = rows.join(F.broadcast(table), place(h) == F.col("_word"), "inner" if passing else "left")
        has = F.coalesce(F.col("_bits").bitwiseAND(bits(h)) == bits(h), F.lit(False))
        return met.where(has if passing else ~has).select(*rows.columns)

    return told


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component being the least node reachable.

    Alternating large-star and small-star steps: each is one pre-aggregated
    minimum and one join, whose skewed keys adaptive execution splits, and every
    round at least halves the depth of what is left. It ends once every node
    either has one lesser neighbour or is one.
    No edges: an empty table. Self links and repeated links change nothing.
    """
    first = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    table = Written(first, "edges")
    for _ in range(max_rounds):
        e = table.df
        ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("below")), F.struct(F.col("lo").alias("node"), F.lit(None).cast("long").alias("below"))))
        seen = e.select(ends.alias("x")).groupBy("x.node").agg(F.min("x.below").alias("least"), F.max("x.below").alias("most"), F.count("x.below").alias("n"), F.count("*").alias("all"))
        if seen.where("n > 0 and (n < all or least <> most)").isEmpty():
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = Written(e.join(low, e["lo"] == low["u"]).select("hi", F.col("m").alias("lo")).distinct(), "large")
        low2 = large.df.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        joined = large.df.join(low2, F.col("hi") == F.col("u"))
        moved = F.when(F.col("lo") != F.col("m"), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))).otherwise(F.struct("hi", "lo"))
        small = joined.select(moved.alias("x")).select("x.hi", "x.lo").distinct()
        used, table = [table, large], Written(small, "edges")
        for t in used:
            t.drop()
    else:
        raise RuntimeError("the components did not settle")
    e = table.df
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)

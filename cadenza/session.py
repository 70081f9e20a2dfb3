"""The Spark session and what it ships to its workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests, benchmarks and small data."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cadenza")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def retained(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes a table once to the shared folder and reads it back.

    What reads it afterwards has a short plan, real sizes, and no lineage that
    a lost executor could make run again.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, so that grouped functions can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cadenza-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


_FOLDERS: dict[str, str] = {}
_USED: set[str] = set()


def _removed(spark: SparkSession, folder: str) -> None:
    """Deletes what this application has written to the shared folder, if the session still lives."""
    try:
        if spark.sparkContext._jsc is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110  the session may be gone already
        pass


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share, as a URI.

    It lies in ``spark.checkpoint.dir`` of the session; only a local session
    without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        folder = f"{told.rstrip('/')}/{sc.applicationId}"
        if folder not in _USED:
            _USED.add(folder)
            atexit.register(_removed, spark, folder)
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="cadenza-shared-")
        atexit.register(shutil.rmtree, _FOLDERS[sc.applicationId], True)
    return f"file://{_FOLDERS[sc.applicationId]}"

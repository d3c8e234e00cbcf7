"""Shared storage for intermediate tables, and table access."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests on a local master) a temporary folder is
    made and set. On a cluster its absence is an error, since a machine's own
    disk can't be read by the other machines.
    """
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sessionloom-")
        _made.append(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@atexit.register
def _remove() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; local ones are removed when Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    plain = path.removeprefix("file://")
    if os.path.isabs(plain):
        _made.append(plain)
    if name != "package":
        _scratch.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of all results so far, wherever they lie; returns how many.

    For long sessions, once the results that were built on them are written.
    """
    n, (jvm, conf) = len(_scratch), (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is needed several times or a lineage has to be cut. The
    files outlive the executors that wrote them, so nothing is recomputed when
    one is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table lies at ``path``, whole."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def shared_table(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made once per session from the file or folder ``source`` as it is now, and read by all later queries."""
    path = shared_path(spark, name, source)
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str, source: str) -> str:
    """Where this session keeps what it made of ``source``; another state of the source has another path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    changed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    return session_path(spark, f"{name}-{hashlib.sha256(f'{source}|{changed}'.encode()).hexdigest()[:16]}")


def session_path(spark: SparkSession, name: str) -> str:
    """The one path of that name that all queries of a session share."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}"
    plain = path.removeprefix("file://")
    if os.path.isabs(plain) and plain not in _made:
        _made.append(plain)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once per application, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    path = f"{scratch_path(spark, 'package')}/{here.name}.zip"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def require_columns(df: DataFrame, *names: str) -> None:
    """Every operator's first call: its input must have the columns, and its workers this package."""
    ship(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")

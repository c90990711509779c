"""Session settings and materialisation points shared by all operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Spark then deletes what a job shuffled as soon as the job is done; otherwise files stay until the driver collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_CUTS: list[str] = []
_SHIPPED: set[str] = set()


def build(master: str, app: str = "framelane", partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = dict(CONF)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; also for a session that someone else made."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(root)
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "framelane_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names in spark.checkpoint.dir.

    Unset, a temporary folder serves on one machine only; on a cluster that is
    an error, as each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs in here whose plan is not run again leave no shuffle files behind. A Spark without the setting goes on as ever."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def cut(df: DataFrame, compression: str | None = None, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where a result feeds several branches: the branches then read the
    columns they need instead of repeating the shuffles before this point, and
    a lost executor costs a re-read, not the whole lineage. What the job shuffled is deleted with its end, and so
    are the ``spent`` cuts: tables that nothing reads from here on.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/framelane-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path, compression=compression)
    _CUTS.append(path)
    for old in spent:
        _delete(df.sparkSession, _CUTS.pop(_CUTS.index(old.cut_path)))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_cuts(spark: SparkSession) -> int:
    """Delete the tables written by :func:`cut` in this session; results read from them end here."""
    done = 0
    while _CUTS:
        done += bool(_delete(spark, _CUTS.pop()))
    return done

"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def get_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    return _own[app]


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a folder another name, on any file system that Spark reads."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not make(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(make(old), make(new)):
        raise OSError(f"can't rename {old} to {new}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

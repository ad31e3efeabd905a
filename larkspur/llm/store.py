"""Intermediate tables in the folder that all executors and the driver share.

What materialize() writes goes when nothing reads it any more (discard, Scratch), at the latest when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir if the session has it. A session of one machine (master local) gets a folder of its own; on a
    cluster no folder can be guessed that all machines share, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        _delete_at_exit(spark, found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


_live: dict[str, DataFrame] = {}  # what is written and not discarded, by path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, outlives executors.

    The path is kept on the result as `stored_at`, for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _live[path] = out
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, where nothing reads it any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path and _live.pop(path, None) is not None:
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


class Scratch:
    """with Scratch() as s: s.keep(df) writes a result; what else was written inside goes at the end."""

    def __enter__(self) -> Scratch:
        self.before, self.kept = set(_live), []
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(materialize(df, name))
        return self.kept[-1]

    def __exit__(self, *_) -> None:
        mine = {df.stored_at for df in self.kept}
        discard(*[df for path, df in list(_live.items()) if path not in self.before and path not in mine])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

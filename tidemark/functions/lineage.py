"""Cutting the lineage of iterative plans by tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.shipping import ship


#: Temporary folders by application.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a temporary folder in local mode, where driver and executors
    are one process; an error on a cluster, whose executors would each write to a disk of their own."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _made.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _made[spark.sparkContext.applicationId] = found
    return found


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. The package goes to the workers first.

    A result may read these tables for as long as it is used, so they stay: :func:`cleared` deletes them for a caller who is
    done with a session's results; on a cluster the folder's own retention rule is the other way. Loops :func:`discard` the table of
    a round once the next one is written.
    """
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/settled-{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def discard(settled: DataFrame | None) -> None:
    """Deletes the table behind a frame that :func:`settle` gave, if it is one. Nothing that is still to be computed may read it."""
    if path := getattr(settled, "_settled_at", None):
        _delete(settled.sparkSession, path)


def cleared(spark: SparkSession) -> bool:
    """Deletes all tables that this application has settled; whether there were any. Results that read them are void."""
    return _delete(spark, f"{shared_dir(spark)}/settled-{spark.sparkContext.applicationId}")

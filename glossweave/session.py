"""Session construction and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "glossweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    Shuffle partition counts are left to AQE (``coalescePartitions``) and to the
    cluster's own defaults unless the caller passes them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local folder would be lost together with its executor.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def reliable_cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` (to the shared folder unless told otherwise) and read it back.

    As fixed as a checkpoint, and later joins know how large the table is.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark) + '/written-' + uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored_table(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table built once per application and read back from Parquet by every later query.

    Queries then start from real columns with known sizes: scans are pruned to the
    columns in use and joins are chosen by table size.
    """
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}/{name}"
        frame = build()
        frame.write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])

"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local session, where every executor sees the same disk, gets a folder
    of its own when none is named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="facetframe-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_in_place(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of a repartitioned table that later joins by the same key and count do not shuffle again.

    A checkpoint keeps the partitioning only of a plan that is fixed beforehand, so adaptive planning is off meanwhile.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once."""
    context = spark.sparkContext
    if getattr(context, "_facetframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="facetframe-")) / "facetframe.zip"   # driver only; Spark serves it
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._facetframe_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables written between two steps."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

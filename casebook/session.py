"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for.  AQE splits skewed join partitions, picks
# broadcast joins from measured sizes and merges small shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state on disk, checkpointed as changes: its size is not bound by the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark.sparkContext)
    return spark


def ship_package(context: SparkContext) -> None:
    """Send this package's code to the executors, once per application.

    The archive is built on the driver and served by it; executors read no
    driver path.
    """
    if getattr(context, "_casebook_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "casebook.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    context._casebook_shipped = True


def _configured_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for local runs."""
    folder = _configured_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage and drop the lineage (survives lost executors)."""
    ensure_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shelved(df: DataFrame, name: str) -> DataFrame:
    """`cut` for wide or long tables read several times: stored by columns, compressed, in the shared folder."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

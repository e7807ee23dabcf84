"""Tables written to the shared checkpoint folder: lineage cuts that survive lost executors.

``spark.checkpoint.dir`` names a folder that the driver and all executors share. A table written
there is read back with its schema, so a later stage neither recomputes its inputs nor depends on
blocks held by one executor. Where the setting is absent, a session whose executors are this machine
(a local test session) gets a temporary folder, recorded in the session; on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Bound of one Arrow batch on its way to a Python worker, in bytes.
ARROW_BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a local session without one, a temporary folder that is then kept."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docforge-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/docforge/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, written once as Parquet in the shared folder and read back from there."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docforge_path = path  # noqa: SLF001 - only release() reads it
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that no later result reads."""
    for df in tables:
        path = getattr(df, "_docforge_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key before costly expressions: a small file, or one with few row groups, is read by few tasks, whatever is made of its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="docforge-")) / "docforge.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def bounded_arrow(spark: SparkSession, size: int = ARROW_BATCH_BYTES) -> None:
    """Before Python on the executors: bound Arrow batches by bytes as well as by rows, and ship the package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > size:
            spark.conf.set(key, str(size))
    except Exception:  # a Spark without this setting keeps its row bound
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

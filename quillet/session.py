"""Session, table loading and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", app: str = "quillet", **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench.py use; on a cluster pass your own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLET_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader untouched, so any store Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    context = spark.sparkContext
    if getattr(context, "_quillet_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillet_")) / "quillet_pkg.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"quillet/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._quillet_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one process (tests, bench.py) is a temporary folder
    set; a cluster without the setting is an error, since its machines would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(context, "_quillet_shared", None) or "file://" + tempfile.mkdtemp(prefix="quillet_shared_")
        context._quillet_shared = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: the lineage ends there.

    A lost executor then costs a re-read, not a recomputation. The tables stay until the
    folder's owner clears it, since the returned DataFrame is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillet/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

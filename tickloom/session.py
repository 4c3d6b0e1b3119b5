"""Session helpers: builder, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tickloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with their frames
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither their path nor their folder offers it."""
    root = Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in paths or Path.cwd() == root or getattr(sc, "_tickloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tickloom")  # the driver serves the archive from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tickloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "tickloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(archive)
    sc._tickloom_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory. Instants are read as UTC whatever the cluster's zone is."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; fall back to a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = os.path.join("/tmp", "tickloom-checkpoints")
        Path(folder).mkdir(parents=True, exist_ok=True)
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

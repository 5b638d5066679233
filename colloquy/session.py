"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "colloquy", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, whatever folder the driver runs in.

    Local workers get its folder on their path; other clusters get it as an archive, once per context.
    """
    sc = spark.sparkContext
    if getattr(sc, "_colloquy_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if sc.master.startswith("local"):
        known = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root.parent) not in known:
            sc.environment["PYTHONPATH"] = os.pathsep.join([*known, str(root.parent)])
    else:
        archive = Path(tempfile.mkdtemp(prefix="colloquy-")) / "colloquy.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
    sc._colloquy_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise *df* in the checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; where that is unset a local session
    (tests, a laptop) takes a temporary folder, any other is an error: its nodes share no such folder.
    """
    spark = df.sparkSession
    ship(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-checkpoint-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

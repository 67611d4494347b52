"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    own = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g"} | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=own).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per context, unless their path has it already."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False) or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run

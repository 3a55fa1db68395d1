"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "schemaweave", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, ANSI, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's cluster, once for each application."""
    sc = spark.sparkContext
    mark = "SCHEMAWEAVE_SHIPPED"
    if os.environ.get(mark) == sc.applicationId:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "schemaweave_src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, f"{here.name}/{path.relative_to(here)}")
    sc.addPyFile(str(archive))
    os.environ[mark] = sc.applicationId

"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to Python workers, once per application.

    Nothing is sent where workers find it anyway: on PYTHONPATH or in their working folder.
    """
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == ROOT for p in known):
        return
    at = Path(tempfile.mkdtemp()) / "pagewise.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "pagewise").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``; a local one only where master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if at is None and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (at or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")

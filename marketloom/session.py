"""Session settings, and shipping of the package to executors that don't share the driver's path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Set when absent; a session that the caller made keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def session(app: str = "marketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` overrides them (keys with ``__`` for dots)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers, once in each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="marketloom-")) / "marketloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
    return spark

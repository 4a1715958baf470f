"""Making the package known to the workers of a session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_cleaned: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary one is set on a local master; elsewhere that is an error, since executors
    don't see the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.getCheckpointDir() is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        root = context.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(clean, spark, f"{root.rstrip('/')}/barloom-{app}")
    return f"{root.rstrip('/')}/barloom-{app}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession, folder: str | None = None) -> None:
    """Remove what queries of this application have written to the shared folder; results that still read it are lost.

    It is done by itself when the driver's Python ends. Until then intermediate tables stay, since results are read lazily.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) if folder is None else None
    folder = folder or f"{(root or spark.sparkContext.getCheckpointDir() or '').rstrip('/')}/barloom-{spark.sparkContext.applicationId}"
    with contextlib.suppress(Exception):  # the JVM may have gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the session's Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="barloom-code-")) / "barloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)

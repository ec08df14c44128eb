"""What a session needs of its cluster: a shared folder, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + os.environ.setdefault("TRACEMILL_SCRATCH", tempfile.mkdtemp(prefix="tracemill-"))
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/tracemill-{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="tracemill-code-")) / "tracemill-code.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at))
        _SHIPPED.add(sc.applicationId)

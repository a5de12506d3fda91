"""Sessions, and getting this package to the Python workers of executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(app: str = "conjunct", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; settings of a cluster win over them."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each SparkContext, so that functions found by name load there."""
    sc = spark.sparkContext
    if getattr(sc, "_conjunct_shipped", False):
        return
    files = sorted(p for p in ROOT.rglob("*.py"))
    mark = hashlib.sha256(b"\0".join(p.read_bytes() for p in files)).hexdigest()[:16]
    out = os.path.join(tempfile.mkdtemp(prefix="conjunct-"), f"conjunct-{mark}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in files:
            z.write(p, f"conjunct/{p.relative_to(ROOT)}")
    sc.addPyFile(out)
    sc._conjunct_shipped = True

"""Session building, the shared folder and cutting of lineage."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; settings already given (by spark-submit) win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the session has it. A local session without it gets a folder of its own, a cluster an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), f"corvane-{uuid.uuid4().hex[:12]}")
    if d and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later readers neither recompute them nor lose them with an executor.

    Sessions of build_session delete the files when no query refers to them any more (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _package() -> bytes:
    """This package as a zip file, the same bytes for the same sources."""
    home, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(home.parent))), p.read_bytes(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once for each context, by way of the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    data = _package()
    name = f"{shared_dir(spark).rstrip('/')}/corvane_{hashlib.sha256(data).hexdigest()[:16]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        f = fs.create(path, True)
        f.write(bytearray(data))
        f.close()
    sc.addPyFile(name)
    sc._corvane_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Make this package importable on executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to all Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodeseek_shipped", False):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    # read once by the driver's file server, which hands it to executors
    target = Path(tempfile.mkdtemp()) / "lodeseek.zip"
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    sc._lodeseek_shipped = True


#: Bytes of one batch of rows on its way to Python, where the session sets none. Spark's own bound of 64 MB is held several times over in each worker.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in small batches, so that a worker's memory does not grow with its partition. Results do not depend on how rows are cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodeseek-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root

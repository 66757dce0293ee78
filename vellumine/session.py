"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors through Spark, once a session, and return the session.

    Functions that run in Python workers are pickled by reference, so workers
    have to import the package even where the repository is not on their path.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="vellumine-code-")) / "vellumine_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, f"{root.name}/{path.relative_to(root)}")
        context.addPyFile(str(archive))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: later plans begin at it, lost executors do not repeat what led to it.

    The folder is that of ``spark.checkpoint.dir``; only on a local master
    that names none a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="vellumine-"))
    return df.checkpoint()

"""Bring this package to executors that do not have it installed.

Functions that run in Python workers are named, not copied, when they are sent; so the workers
must be able to import their modules.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from shopledger.plans.pinning import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the workers' path, once per application, by way of the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((top / "shopledger").rglob("*.py")):
            out.write(file, file.relative_to(top))
    target = f"{shared_folder(spark)}/shopledger-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    stream = system.create(path)
    stream.write(packed.getvalue())
    stream.close()
    system.deleteOnExit(path)  # late executors fetch it until the application ends
    context.addPyFile(system.makeQualified(path).toString())
    _shipped.add(context.applicationId)

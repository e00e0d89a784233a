"""Puts the package on the executors' path.

Functions that run in Python workers are pickled by reference, so a worker has
to be able to import this package. Where it is not installed on the executors,
its source is sent once per application as a zip file.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def package_zip() -> bytes:
    """The package's source files as a zip archive, the same bytes for the same files."""
    top = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(top)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, below, names in os.walk(top):
            below.sort()
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                entry = zipfile.ZipInfo(os.path.relpath(path, root), (1980, 1, 1, 0, 0, 0))
                with open(path, "rb") as source:
                    archive.writestr(entry, source.read())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """``addPyFile`` of the package, once for each application.

    The zip is written on the driver and served to the executors by Spark.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="counterpoise-"), "counterpoise.zip")
    with open(path, "wb") as out:
        out.write(package_zip())
    spark.sparkContext.addPyFile(path)
    _sent.add(app)

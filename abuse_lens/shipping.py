"""Send this package to the executors of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``import abuse_lens`` work on every executor, once per application.

    The driver serves a zip of the package, as ``--py-files`` would.  Where the
    package is installed on the cluster this is not needed, and does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    # the driver serves the file itself, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="abuse-lens-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root, name = os.path.split(PACKAGE)
    context.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
    _sent.add(context.applicationId)

"""The package on the executors: tasks import it, and a cluster's workers may not have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref

from pyspark.sql import SparkSession

_served: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Spark serves a copy of the package to all executors of the session, once.

    The archive is the driver's own file; executors get it from the driver and never look for its place.
    """
    context = spark.sparkContext
    if context in _served:
        return
    place = tempfile.mkdtemp(prefix="furlong-package-")
    atexit.register(shutil.rmtree, place, True)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context.addPyFile(shutil.make_archive(os.path.join(place, "furlong"), "zip", root, "furlong"))
    _served.add(context)

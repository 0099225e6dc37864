"""Lodestar: document, retrieval and catalogue analytics as PySpark DataFrame plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()
#: Rows of an Arrow batch: texts are long, and a batch is held outside the heap by the executor and again by its worker.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def ship(spark) -> None:
    """Give the executors' Python workers this package, once for each Spark application, and cut Arrow batches shorter
    where the session has Spark's own default."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestar-ship-"), "lodestar_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("lodestar", os.path.relpath(path, here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)

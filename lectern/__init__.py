"""lectern: sequence, text and ledger analytics on Apache Spark."""

from __future__ import annotations

import os
import shutil
import tempfile


def ship(spark) -> None:
    """Sends this package to the executors, once a session's context. Needed where their Python can't import it by itself."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern"), "zip", root, "lectern"))
    context._lectern_shipped = True


def spread(df):
    """df dealt over all cores, if it is read from fewer files than there are cores; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)

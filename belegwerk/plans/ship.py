"""Makes the package importable on executors that were started without it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors through Spark's own file server, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    # the file server reads it whenever an executor starts, so it stays as long as the driver
    folder = tempfile.mkdtemp(prefix=f"{root.name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{root.name}-{os.getpid()}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose function may refer to this package. A batch is a copy of its rows outside
    the heap, on either side, and rows may be whole documents: the session's limit on the rows of
    a batch is lowered to BATCH_ROWS where it is above."""
    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)

"""The package on the executors: their Python imports it from a file that Spark sends."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to and from a worker, which both sides hold.
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a Spark application; batches stay small where the session doesn't say how large they may be."""
    sc = spark.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if sc.getConf().get(name) is None:
        spark.conf.set(name, str(ARROW_BYTES))
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        held = Path(tempfile.mkdtemp(prefix="scoreloom-")) / "scoreloom_package.zip"
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(held))

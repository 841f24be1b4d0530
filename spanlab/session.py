"""Sessions, and shipping this package to their executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch.
ARROW_ROWS = 1024


def session(name: str = "spanlab", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that Python workers anywhere can import it.

    Arrow batches are made small where nobody has set their size: 10,000 long texts at once are too much for a worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if getattr(context, "_spanlab_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spanlab-")) / "spanlab.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spanlab_shipped = True
    return spark


_held: list[DataFrame] = []


def held(rows: DataFrame) -> DataFrame:
    """Kept in memory and on disk once computed, since several branches of a result use it, until `release`."""
    _held.append(rows.persist())
    return rows


def release() -> None:
    """Frees what `held` keeps. Results that haven't been computed yet compute it again."""
    while _held:
        _held.pop().unpersist()

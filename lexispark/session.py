"""Session settings, and the package itself for the executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch and rows of a scan's batch, where the application has not set its own: texts are long.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Of tables that live between two plans: what a task buffers before it writes is bounded by the row group.
WRITE = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def session(app: str = "lexispark", **conf: str) -> SparkSession:
    """A session with the settings that the engine is tuned for; ``conf`` overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors once for each application, and set its batch sizes in the session."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        for k, v in _BATCH.items():
            if not spark.sparkContext.getConf().contains(k):
                spark.conf.set(k, v)
        here = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="lexispark-")) / "lexispark_src.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset (tests), under a temporary folder set once."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, which outlives any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**WRITE).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package's code, once per application; small, served by the driver."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quillmark-code-")) / "quillmark-code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder for work tables that all machines share: spark.checkpoint.dir; on one machine, where it is unset, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return _scratch.setdefault(context.applicationId, tempfile.mkdtemp(prefix="quillmark-"))


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: made once, with no lineage, and there when executors are lost."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Without a look at the Python stack at each column made.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

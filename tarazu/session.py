"""Session defaults and the shared folder that lineage is cut into."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on for results (not for speed).
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
}

#: Settings for speed that a cluster may override.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tarazu", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings; ``extra`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **TUNING_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package where it is not installed: a zip of it goes with the session.  The driver serves the
    zip as long as it lives; it is named by its content, so that one is made for each version."""
    package = Path(__file__).resolve().parent
    files = sorted(package.rglob("*.py"))
    digest = hashlib.sha256(b"".join(str(f.relative_to(package)).encode() + f.read_bytes() for f in files)).hexdigest()[:16]
    name = Path(tempfile.gettempdir()) / f"{package.name}-{os.getuid()}-{digest}.zip"
    if not name.exists():
        made = name.with_suffix(f".{os.getpid()}")
        with zipfile.ZipFile(made, "w") as out:
            for f in files:
                out.write(f, f.relative_to(package.parent))
        made.rename(name)
    spark.sparkContext.addPyFile(str(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and its master is local (tests, a laptop) a local folder is made and set, as then driver and
    executors are one machine.  On a cluster a missing setting is an error: a machine's own folder would lose data with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tarazu-")
    spark.sparkContext.setCheckpointDir(made)
    return "file://" + made


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is the cluster's to clean
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if os.environ.get("TARAZU_KEEP_STAGED") != "1":
        atexit.register(_drop, spark, path)
    return path


def stage_table(df: DataFrame, name: str, **write_options: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: lineage is cut, the result is
    columnar and survives the loss of executors.  Removed when the driver exits."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**write_options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

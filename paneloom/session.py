"""Session helpers: a local session for tests, and fault-tolerant lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paneloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paneloom-ckpt-"))
        .getOrCreate()
    )


_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, single-machine runs) is a local temporary folder chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="paneloom-")
    return _own_dirs[app]


def new_folder(spark: SparkSession, stem: str) -> str:
    """A fresh path under the shared folder for a table that is written and read back."""
    return os.path.join(work_dir(spark), f"{stem}-{uuid.uuid4().hex}")


#: Folders written by each application and not yet dropped.
_written: dict[str, dict[str, None]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Iterative operators call this so that a lost executor costs one read of the
    written files, not a re-run of all earlier rounds. A written table also has
    a known size: small level and coefficient tables are then broadcast by
    Spark's own size rule, and tables beyond it are joined by shuffle.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    _written.setdefault(spark.sparkContext.applicationId, {})[path] = None
    df.write.parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    stage._stage_path = path
    return stage


def append_stage(df: DataFrame, stage: DataFrame | None) -> DataFrame:
    """``stage`` (from ``cut_lineage``) with the rows of ``df`` added to its folder; without one, a new stage."""
    if stage is None:
        return cut_lineage(df)
    df.write.mode("append").parquet(stage._stage_path)
    grown = df.sparkSession.read.schema(stage.schema).parquet(stage._stage_path)
    grown._stage_path = stage._stage_path
    return grown


def drop_stage(*stages: DataFrame | None) -> None:
    """Delete the folders of stages that nothing reads any more; rounds of an iteration call this for the round before."""
    for stage in stages:
        path = getattr(stage, "_stage_path", None)
        if path:
            _delete(stage.sparkSession, path)
            _written.get(stage.sparkSession.sparkContext.applicationId, {}).pop(path, None)


def stages(spark: SparkSession) -> list[str]:
    """Folders that this application has written and not dropped."""
    return list(_written.get(spark.sparkContext.applicationId, {}))


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what was written inside. Results must have been stored elsewhere, or collected, by then."""
    before = set(stages(spark))
    try:
        yield
    finally:
        close(spark, keep=before)


def close(spark: SparkSession, keep: Collection[str] = ()) -> None:
    """Delete the folders of all stages but ``keep``. Lazy results that still read one fail afterwards."""
    for path in stages(spark):
        if path not in keep:
            _delete(spark, path)
            _written[spark.sparkContext.applicationId].pop(path)

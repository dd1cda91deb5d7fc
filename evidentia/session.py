"""Session settings, the shared working folder and table loading."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings manifest chunks "
    "number_mentions gold_items item_details item_results index_vectors eval_passages subjects "
    "subject_labels common_units"
).split()


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidentia")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset, and gets its own."""
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir", None) or (jdir.get() if jdir.isDefined() else None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    if not jdir.isDefined():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again; survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of tables that nothing holds any more removed now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, sources: list[DataFrame], build: Callable[[str], None]) -> str:
    """The folder of a table that is built once for a session and then read by every query, as an index is.

    build(path) writes it below the shared folder. It is built anew where a file that it comes from has
    changed, by its path, length and time.
    """
    files = sorted(f for df in sources for f in df.inputFiles())
    fs = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    seen = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p) for p in fs]
    key = (spark.sparkContext.applicationId, name, tuple((f, x.getLen(), x.getModificationTime()) for f, x in zip(files, seen, strict=True)))
    if key not in _STORED:
        path = shared_path(spark, name)
        build(path)
        _STORED[key] = path
    return _STORED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

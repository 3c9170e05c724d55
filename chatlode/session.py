"""Session helpers: checkpoint folder, size-checked broadcast, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and, roughly, bytes a side may have to be broadcast by `small`; beyond them the join is left to Spark.
SMALL_ROWS = 20_000
SMALL_BYTES = 16_000_000


def get_spark(app: str = "chatlode", cores: str | int = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def findable(spark: SparkSession) -> SparkSession:
    """`spark`, its Python workers told where this package lies; needed where only the driver's own path names it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or ""
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(df: DataFrame) -> int:
    """A number that changes with the files that `df` reads: what is kept for a session is made anew then."""
    return hash(tuple(sorted(df.inputFiles())))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``; a folder of our own is set only where
    neither that setting nor a checkpoint folder exists, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        conf = sc.getConf()
        folder = conf.get("spark.checkpoint.dir")
        if folder is None:
            if not conf.get("spark.master", "local").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chatlode-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """`df` with a broadcast hint when it is proven to have at most `limit` rows and about `size` bytes, else unhinted.

    The proof fetches up to `limit` + 1 rows; where it succeeds, those rows are used, so `df` is computed once.
    """
    rows = df.limit(limit + 1).collect()
    fits = len(rows) <= limit and sum(len(str(r)) for r in rows) <= size
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if fits else df


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's vocabulary file; the folder is a parameter or CHATLODE_TOKENIZERS."""
    return os.path.join(folder or os.environ.get("CHATLODE_TOKENIZERS", "/opt/tokenizers"), name)

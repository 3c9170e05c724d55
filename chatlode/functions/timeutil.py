"""Calendar expressions: stored instants are UTC, calendar parts are those of a display zone given as an offset in hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlode.functions.text import bound, role
from chatlode.operators.timestamps import mixtures, normalize_timestamps
from chatlode.session import table, version

_MIXTURES: dict[tuple[str, str], tuple[int, list]] = {}
_RAW = ("source", "timestamp_source", "timestamp")


def local(ts: Column, hours: float = 8) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(round((hours % 1) * 60))))


def roles(df: DataFrame) -> DataFrame:
    """Messages with rl, the role through its aliases."""
    return df.withColumn("rl", role(F.col("role")))


def messages(spark: SparkSession, sf_dir: str, where: Column | str | None = None, hours: float = 8) -> DataFrame:
    """Messages with rl (role through its aliases), ts (the instant that the time text denotes, UTC) and lt (display zone), all
    formats read. `where` is put before the times are read. The sources' mixtures of formats, a few rows from all values,
    are found once per session and set of files."""
    m = table(spark, sf_dir, "messages")
    key, now = (spark.sparkContext.applicationId, sf_dir), version(m)
    schema = "source string, timestamp_source string, home_zone string, weights map<string,double>"
    sources = table(spark, sf_dir, "export_sources")
    if _MIXTURES.get(key, (None,))[0] != now:
        _MIXTURES[key] = (now, mixtures(m, sources).collect())  # one row per source
    sides = spark.createDataFrame(_MIXTURES[key][1], schema)
    m = m if where is None else m.where(where)
    kept = [c for c in m.columns if c != "id" and c not in _RAW]
    m = m.select("id", *kept, *_RAW, *[F.col(c).alias(f"_{c}") for c in _RAW])
    n = normalize_timestamps(m, sources, table(spark, sf_dir, "zone_abbrevs"), keep=(*kept, *[f"_{c}" for c in _RAW]), sides=sides)
    n = n.select("id", *kept, *[F.col(f"_{c}").alias(c) for c in _RAW], role(F.col("role")).alias("rl"), "utc_us")
    n = bound(n, "ts", F.timestamp_micros("utc_us").cast("timestamp_ntz")).drop("utc_us")
    return n.withColumn("lt", local(F.col("ts"), hours))


def text_of(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)

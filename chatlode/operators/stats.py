"""Statistics of the archive: counts, calendar buckets, histograms, streaks and heat maps.

Most of them come from one roll-up of the messages by conversation and local hour, which is made by the first query that
needs it and kept for the session: one scan, one reading of the times, and a table without texts behind all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.registry import MESSAGES_SQL as M
from chatlode.operators.registry import ROLES_SQL as R
from chatlode.operators.registry import query
from chatlode.session import table, version


_ROLLUPS: dict[tuple[str, str], tuple[int, DataFrame]] = {}


def rollup(spark, d) -> DataFrame:
    """n, dated, chars, lo and hi (first and last instant) of the messages by source, role, timestamp_source, conversation,
    local day and hour. Rows of one group are combined before they are shuffled, so that a hot conversation is none."""
    key, now = (spark.sparkContext.applicationId, d), version(table(spark, d, "messages"))
    was, kept = _ROLLUPS.get(key, (None, None))
    if was != now:
        if kept is not None:
            kept.unpersist()
        m = timeutil.messages(spark, d)
        g = m.groupBy("source", "rl", "timestamp_source", "conversation_id", F.to_date("lt").alias("day"), F.hour("lt").alias("hour"))
        g = g.agg(_n(), F.count("ts").alias("dated"), F.sum(F.length("text")).alias("chars"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        _ROLLUPS[key] = (now, g.persist(StorageLevel.MEMORY_AND_DISK))
    return _ROLLUPS[key][1]


def _dated(spark, d) -> DataFrame:
    return rollup(spark, d).where("day is not null")


def _sum(c="n"):
    return F.coalesce(F.sum(c), F.lit(0)).alias(c)


def _n(name="n"):
    return F.count("*").alias(name)


def _convs(name="conversations"):
    return F.countDistinct("conversation_id").alias(name)


@query("a1_totals", f"SELECT count(*) AS messages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM {M}")
def totals(spark, d):
    """Messages, characters and the dated range."""
    return rollup(spark, d).agg(_sum().alias("messages"), _sum("chars"), timeutil.text_of(F.min("lo")).alias("first_at"), timeutil.text_of(F.max("hi")).alias("last_at"))


@query("a2_by_role", f"SELECT rl AS role, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM {R} GROUP BY rl")
def by_role(spark, d):
    return rollup(spark, d).groupBy(F.col("rl").alias("role")).agg(_sum(), _sum("chars"))


@query("a3_by_source", "SELECT source, count(DISTINCT conversation_id) AS conversations, count(*) AS messages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, round(count(*) * 1.0 / count(DISTINCT conversation_id), 2) AS avg_messages FROM messages GROUP BY source")
def by_source(spark, d):
    """Conversations, messages and characters per source: partial counts per conversation first, so that a source that
    holds a third of all rows is pre-aggregated before it meets in one task."""
    m = rollup(spark, d).groupBy("source", "conversation_id").agg(_sum(), _sum("chars"))
    g = m.groupBy("source").agg(F.count("conversation_id").alias("conversations"), F.sum("n").alias("messages"), _sum("chars"))
    return g.withColumn("avg_messages", F.round(F.col("messages") / F.col("conversations"), 2))


@query("a4_by_timestamp_source", "SELECT timestamp_source, count(*) AS n FROM messages GROUP BY timestamp_source")
def by_timestamp_source(spark, d):
    return rollup(spark, d).groupBy("timestamp_source").agg(_sum())


def _key(java):
    """Text of a row's bucket: `java` is a pattern of its day, an hour behind it or alone."""
    if java == "e":
        return (F.dayofweek("day") - 1).cast("string")  # 0 is Sunday
    hour = F.lpad(F.col("hour").cast("string"), 2, "0")
    day = java.removesuffix("HH").strip()
    return hour if not day else F.concat(timeutil.text_of(F.col("day"), day), F.lit(" "), hour) if java.endswith("HH") else timeutil.text_of(F.col("day"), day)


def _bucket(name, java, duck, convs=True):
    more = ", count(DISTINCT conversation_id) AS conversations" if convs else ""

    @query(name, f"SELECT strftime(lt, '{duck}') AS k, count(*) AS n{more} FROM {M} WHERE lt IS NOT NULL GROUP BY k")
    def run(spark, d):
        g = _dated(spark, d).groupBy(_key(java).alias("k"))
        return g.agg(_sum(), _convs()) if convs else g.agg(_sum())

    return run


by_month = _bucket("a5_by_month", "yyyy-MM", "%Y-%m")
by_year = _bucket("a5_by_year", "yyyy", "%Y")
by_day = _bucket("a5_by_day", "yyyy-MM-dd", "%Y-%m-%d", convs=False)
by_hour = _bucket("a5_by_hour", "HH", "%H", convs=False)
timeline_hour = _bucket("a12_timeline_hour", "yyyy-MM-dd HH", "%Y-%m-%d %H")


@query("a5_by_weekday", f"SELECT CAST(dayofweek(lt) AS BIGINT) AS weekday, count(*) AS n FROM {M} WHERE lt IS NOT NULL GROUP BY weekday")
def by_weekday(spark, d):
    """Weekday 0 is Sunday."""
    return _dated(spark, d).groupBy((F.dayofweek("day") - 1).cast("long").alias("weekday")).agg(_sum())


def _cells(spark, d):
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    n = _dated(spark, d).groupBy((F.dayofweek("day") - 1).alias("weekday"), "hour").agg(_sum())
    return grid.join(n, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


_CELLS_SQL = f"(SELECT CAST(g.i // 24 AS INTEGER) AS weekday, CAST(g.i % 24 AS INTEGER) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(168)) AS i) g LEFT JOIN (SELECT dayofweek(lt) AS w, hour(lt) AS h, count(*) AS n FROM {M} WHERE lt IS NOT NULL GROUP BY 1, 2) x ON x.w = g.i // 24 AND x.h = g.i % 24)"


@query("a6_heatmap", f"SELECT * FROM {_CELLS_SQL}")
def heatmap(spark, d):
    """Dense 7 x 24 counts."""
    return _cells(spark, d)


@query(
    "w12_heat_levels",
    f"WITH c AS (SELECT *, row_number() OVER (ORDER BY n, weekday, hour) - 1 AS r FROM {_CELLS_SQL}), q AS (SELECT max(n) FILTER (r = 33) AS q1, max(n) FILTER (r = 67) AS q2, max(n) FILTER (r = 100) AS q3, max(n) FILTER (r = 134) AS q4 FROM c) "
    "SELECT weekday, hour, n, CASE WHEN n = 0 THEN 0 WHEN n <= q1 THEN 1 WHEN n <= q2 THEN 2 WHEN n <= q3 THEN 3 ELSE 4 END AS level FROM c, q",
)
def heat_levels(spark, d):
    """Quintile level of each cell; the window runs over 168 rows whatever the input."""
    c = _cells(spark, d).withColumn("all", F.sort_array(F.collect_list("n").over(Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    q = lambda p: F.element_at("all", int(168 * p) + 1)
    level = F.when(F.col("n") == 0, 0).when(F.col("n") <= q(0.2), 1).when(F.col("n") <= q(0.4), 2).when(F.col("n") <= q(0.6), 3).otherwise(4)
    return c.select("weekday", "hour", "n", level.alias("level"))


def _dense(spark, names, counts):
    return spark.createDataFrame([(i, k) for i, k in enumerate(names)], "pos int, k string").join(counts, "k", "left").select("pos", "k", F.coalesce("n", F.lit(0)).alias("n"))


def _hist_sql(cases, names, source):
    case = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k in cases) + f" ELSE '{names[-1]}' END"
    values = ", ".join(f"({i}, '{k}')" for i, k in enumerate(names))
    return f"SELECT CAST(b.pos AS INTEGER) AS pos, b.k, coalesce(x.n, 0) AS n FROM (VALUES {values}) b(pos, k) LEFT JOIN (SELECT {case} AS k, count(*) AS n FROM {source} GROUP BY 1) x ON x.k = b.k"


# The buckets of the length histograms.
CONVERSATION_BUCKETS = [(1, "1"), (5, "2-5"), (20, "6-20"), (50, "21-50"), (200, "51-200"), (None, "200+")]
MESSAGE_BUCKETS = [(100, "0-100"), (500, "100-500"), (2000, "500-2k"), (10000, "2k-10k"), (None, "10k+")]


def _histogram(name, tbl, col, buckets):
    names = [k for _, k in buckets]

    @query(name, _hist_sql([(f"{col} <= {b}", k) for b, k in buckets if b], names, tbl))
    def run(spark, d):
        e = F.expr("CASE " + " ".join(f"WHEN {col} <= {b} THEN '{k}'" for b, k in buckets if b) + f" ELSE '{names[-1]}' END")
        return _dense(spark, names, table(spark, d, tbl).groupBy(e.alias("k")).agg(_n()))

    return run


conversation_lengths = _histogram("a7_conversation_lengths", "conversations", "message_count", CONVERSATION_BUCKETS)
message_lengths = _histogram("a8_message_lengths", "messages", "length(text)", MESSAGE_BUCKETS)


@query("a9_models", "SELECT CASE WHEN coalesce(model, '') = '' THEN CASE source WHEN 'gemini' THEN 'Gemini' WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'deepseek' THEN 'DeepSeek' ELSE source END || ' (unspecified)' ELSE model END AS k, count(*) AS n FROM messages GROUP BY k")
def models(spark, d):
    s = F.col("source")
    label = F.when(s == "gemini", "Gemini").when(s == "chatgpt", "ChatGPT").when(s == "deepseek", "DeepSeek").otherwise(s)
    k = F.when(F.coalesce("model", F.lit("")) == "", F.concat(label, F.lit(" (unspecified)"))).otherwise(F.col("model"))
    return table(spark, d, "messages").groupBy(k.alias("k")).agg(_n())


@query(
    "a10_ratios",
    f"SELECT round(sum(length(text)) * 1.0 / count(*), 3) AS avg_chars, greatest(1, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) + 1) AS span_days, count(DISTINCT CAST(lt AS DATE)) AS active_days, round(count(ts) * 1.0 / count(DISTINCT CAST(lt AS DATE)), 3) AS per_active_day, round(count(*) * 1.0 / (greatest(1, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) + 1)), 3) AS per_day, round((SELECT count(*) FROM (SELECT DISTINCT conversation_id, CAST(lt AS DATE) FROM {M} WHERE lt IS NOT NULL AND conversation_id IS NOT NULL)) * 1.0 / count(DISTINCT CAST(lt AS DATE)), 3) AS conversations_per_active_day FROM {M}",
)
def ratios(spark, d):
    g = rollup(spark, d).groupBy("day").agg(_sum(), _sum("dated"), F.sum("chars").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.countDistinct("conversation_id").alias("convs"))
    t = g.agg(F.sum(F.when(F.col("day").isNotNull(), F.col("convs"))).alias("convs"), F.sum("n").alias("n"), F.sum("dated").alias("dated"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("day").alias("active_days"))
    span = F.floor((F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / 86_400_000_000) + 1
    days = F.greatest(F.lit(1), span)
    per = lambda a, b: F.round(a / b, 3)
    return t.select(per(F.col("c"), F.col("n")).alias("avg_chars"), days.alias("span_days"), "active_days", per(F.col("dated"), F.col("active_days")).alias("per_active_day"), per(F.col("n"), days).alias("per_day"), per(F.col("convs"), F.col("active_days")).alias("conversations_per_active_day"))


_UNITS = {"day": ("yyyy-MM-dd", "%Y-%m-%d"), "month": ("yyyy-MM", "%Y-%m"), "hour": ("HH", "%H"), "weekday": ("e", "%w")}


@query(
    "a11_busiest",
    " UNION ALL ".join(f"(SELECT '{u}' AS unit, strftime(lt, '{duck}') AS k, count(*) AS n FROM {M} WHERE lt IS NOT NULL GROUP BY 2 ORDER BY n DESC, k LIMIT 1)" for u, (_, duck) in _UNITS.items()),
)
def busiest(spark, d):
    """Bucket of most messages of each unit, the first on ties; all units from one pass."""
    each = _dated(spark, d).select("n", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), _key(java).alias("k")) for u, (java, _) in _UNITS.items()])).alias("x")).select("n", "x.*")
    g = each.groupBy("unit", "k").agg(_sum())
    return g.groupBy("unit").agg(F.max_by(F.struct("k", "n"), F.struct("n", F.translate("k", "0123456789", "9876543210"))).alias("b")).select("unit", "b.k", "b.n")


@query("a13_day", f"SELECT conversation_id, count(*) AS n, strftime(min(lt), '%H:%M:%S') AS first_at, strftime(max(lt), '%H:%M:%S') AS last_at FROM {M} WHERE lt >= TIMESTAMP '2025-06-27' AND lt < TIMESTAMP '2025-06-28' GROUP BY conversation_id")
def day(spark, d, date="2025-06-27"):
    """Conversations of one local day with their hits."""
    m = rollup(spark, d).where(F.col("day") == F.lit(date).cast("date"))
    at = lambda ts: timeutil.text_of(timeutil.local(ts), "HH:mm:ss")
    return m.groupBy("conversation_id").agg(_sum(), at(F.min("lo")).alias("first_at"), at(F.max("hi")).alias("last_at"))


@query(
    "w2_streak",
    f"WITH d AS (SELECT DISTINCT CAST(lt AS DATE) AS day FROM {M} WHERE lt IS NOT NULL), i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM d), s AS (SELECT g, count(*) AS n, max(day) AS last FROM i GROUP BY g) SELECT max(n) AS longest, arg_max(n, last) AS last_streak FROM s",
)
def streak(spark, d):
    """Longest and last run of consecutive active days. The window runs over distinct days, a calendar's worth of rows."""
    days = _dated(spark, d).select("day").distinct()
    i = days.withColumn("g", F.date_sub("day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day"))))
    s = i.groupBy("g").agg(_n(), F.max("day").alias("last"))
    return s.agg(F.max("n").alias("longest"), F.max_by("n", "last").alias("last_streak"))


@query(
    "w11_filled_days",
    f"WITH d AS (SELECT CAST(lt AS DATE) AS day, count(*) AS n FROM {M} WHERE lt IS NOT NULL GROUP BY 1), r AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day) SELECT strftime(r.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM r LEFT JOIN d USING (day)",
)
def filled_days(spark, d):
    """Messages per local day, days without any filled with zero."""
    n = _dated(spark, d).groupBy("day").agg(_sum())
    r = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return r.join(n, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("f11_flags", "SELECT count(*) FILTER (len(attachments) > 0) AS with_attachments, count(*) FILTER (coalesce(thinking, '') <> '') AS with_thinking FROM messages")
def flags(spark, d):
    return table(spark, d, "messages").agg(F.count_if(F.size("attachments") > 0).alias("with_attachments"), F.count_if(F.coalesce("thinking", F.lit("")) != "").alias("with_thinking"))


@query("a21_import_summary", f"SELECT source, timestamp_source, count(*) AS n, round(count(*) FILTER (ts IS NOT NULL) * 1.0 / count(*), 4) AS dated FROM {M} GROUP BY source, timestamp_source")
def import_summary(spark, d):
    return rollup(spark, d).groupBy("source", "timestamp_source").agg(_sum(), F.round(F.sum("dated") / F.sum("n"), 4).alias("dated"))


@query("t5_longest_message", "SELECT id, CAST(length(text) AS BIGINT) AS chars, substr(text, 1, 140) AS head FROM messages WHERE text IS NOT NULL ORDER BY length(text) DESC, id LIMIT 1")
def longest_message(spark, d):
    return table(spark, d, "messages").where("text is not null").select("id", F.length("text").cast("long").alias("chars"), F.substring("text", 1, 140).alias("head")).orderBy(F.desc("chars"), "id").limit(1)


TOP_LISTS = ("n", "chars", "span_us", "last_us")


@query(
    "t4_top_conversations",
    f"WITH g AS (SELECT conversation_id, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span_us, epoch_us(max(ts)) AS last_us FROM {M} GROUP BY conversation_id) "
    + " UNION ALL ".join(f"(SELECT '{k}' AS list, conversation_id, n, chars, span_us FROM g WHERE {k} IS NOT NULL ORDER BY {k} DESC, conversation_id LIMIT 12)" for k in TOP_LISTS),
)
def top_conversations(spark, d):
    """Twelve conversations of most messages and characters, longest span and latest message; top-k per list by partial sorts."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    g = rollup(spark, d).groupBy("conversation_id").agg(_sum(), _sum("chars"), (us(F.max("hi")) - us(F.min("lo"))).alias("span_us"), us(F.max("hi")).alias("last_us"))
    lists = [g.where(F.col(k).isNotNull()).orderBy(F.desc(k), "conversation_id").limit(12).select(F.lit(k).alias("list"), "conversation_id", "n", "chars", "span_us") for k in TOP_LISTS]
    return reduce(DataFrame.union, lists)


@query("a16_conversation_chars", "SELECT conversation_id, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(length(thinking)), 0) AS BIGINT) AS thinking_chars FROM messages GROUP BY conversation_id")
def conversation_chars(spark, d):
    return table(spark, d, "messages").groupBy("conversation_id").agg(_n(), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.length("thinking")), F.lit(0)).alias("thinking_chars"))

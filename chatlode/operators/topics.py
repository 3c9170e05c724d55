"""Topic predicates, the report on a topic, and analyses in their normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.registry import ROLES_SQL as R
from chatlode.operators.registry import query
from chatlode.session import table

# Words of the preset topic, the kind that belongs to it, and words counted in the titles and reasons of its report.
TOPIC = "心理|情绪|焦虑|抑郁|自卑|内耗|社恐|社交恐惧|强迫|创伤|原生家庭|潜意识|咨询师|孤独|崩溃|躁郁|双相|精神科|自我怀疑|讨好型|安全感|想哭|难过|痛苦|委屈|沮丧|空虚|迷茫|失眠|睡不着|压力|害怕|不安"
KIND = "情绪"
TITLE_WORDS = "抑郁 分析 存在 哲学 睡不着 情绪 死 焦虑 自我 失眠 创伤 压力".split()
REASON_WORDS = "心理 深度 知识 哲学 防御 创伤 失眠 情绪宣泄 一次".split()
EMOTIONS = ("joy", "calm", "anxiety", "anger", "sadness", "fatigue")


def on_topic(conversations: DataFrame, texts: DataFrame, analysis: DataFrame, pattern: str = TOPIC) -> DataFrame:
    """conversation_id, by_word, by_kind of the conversations whose title or one of whose `texts` (conversation_id, text) matches
    `pattern`, or that an analysis gives the topic's kind. Matches are found where the texts lie; ids alone are joined."""
    ids = conversations.where("conversation_id is not null").groupBy("conversation_id").agg(F.bool_or(F.coalesce(F.col("title").rlike(pattern), F.lit(False))).alias("titled"))
    said = texts.where(F.col("text").rlike(pattern)).select("conversation_id").distinct().withColumn("said", F.lit(True))
    kind = analysis.where(F.col("kind") == KIND).select("conversation_id").distinct().withColumn("by_kind", F.lit(True))
    j = ids.join(said, "conversation_id", "left").join(kind, "conversation_id", "left")
    no = F.lit(False)
    return j.select("conversation_id", (F.col("titled") | F.coalesce("said", no)).alias("by_word"), F.coalesce("by_kind", no).alias("by_kind")).where("by_word or by_kind")


def _topic_sql(said):
    return (
        f"SELECT * FROM (SELECT conversation_id, coalesce(bool_or(regexp_matches(title, '(?i){TOPIC}')), false) OR conversation_id IN (SELECT conversation_id FROM ({said}) WHERE conversation_id IS NOT NULL AND regexp_matches(text, '(?i){TOPIC}')) AS by_word, "
        f"conversation_id IN (SELECT conversation_id FROM analysis WHERE kind = '{KIND}' AND conversation_id IS NOT NULL) AS by_kind FROM conversations WHERE conversation_id IS NOT NULL GROUP BY conversation_id) WHERE by_word OR by_kind"
    )


_SHORT = f"SELECT conversation_id, substr(arg_min(coalesce(text, ''), (coalesce(message_index, 2147483647), id)), 1, 800) AS text FROM {R} WHERE rl = 'user' GROUP BY 1"


@query("f8_topic_full", _topic_sql("SELECT conversation_id, text FROM messages"))
def topic_full(spark, d):
    """Conversations on the topic by title, any message or kind."""
    return on_topic(table(spark, d, "conversations"), table(spark, d, "messages").select("conversation_id", "text"), table(spark, d, "analysis"), "(?i)" + TOPIC)


@query("f9_topic_short", _topic_sql(_SHORT))
def topic_short(spark, d):
    """Conversations on the topic by title, the first 800 characters of their first user message, or kind."""
    m = timeutil.roles(table(spark, d, "messages")).where("rl = 'user'")
    first = m.groupBy("conversation_id").agg(F.substring(F.min_by(F.coalesce("text", F.lit("")), F.struct(F.coalesce("message_index", F.lit(2**31 - 1)), "id")), 1, 800).alias("text"))
    return on_topic(table(spark, d, "conversations"), first, table(spark, d, "analysis"), "(?i)" + TOPIC)


_RECS = f"(SELECT * FROM analysis WHERE coalesce(model, '') <> 'heuristic' AND conversation_id IN (SELECT conversation_id FROM ({_topic_sql(_SHORT)})))"


def _recs(spark, d) -> DataFrame:
    """Analyses of the conversations on the topic, but those by rules."""
    ids = topic_short(spark, d).select("conversation_id")
    return table(spark, d, "analysis").where(F.coalesce("model", F.lit("")) != "heuristic").join(ids, "conversation_id", "left_semi")


_mean = lambda c: F.round(F.round(F.avg(F.coalesce(c, F.lit(0)).cast("double")), 9), 4)
_mean_sql = lambda c: f"round(round(avg(coalesce({c}, 0)), 9), 4)"


@query(
    "a22_topic_report",
    f"SELECT count(*) AS n, {_mean_sql('value')} AS value, " + ", ".join(f"count(*) FILTER (value = {v}) AS v{v}" for v in range(6)) + f", round(count(*) FILTER (keep) * 1.0 / count(*), 4) AS kept, {_mean_sql('intensity')} AS intensity, round(max(coalesce(intensity, 0)), 4) AS intensity_max, "
    + ", ".join(f"round(round(coalesce(avg(emotions['{e}']), 0), 9), 4) AS {e}" for e in EMOTIONS)
    + f", round(round(coalesce(avg(coalesce(sentiment, 0)) FILTER (kind = '{KIND}'), 0), 9), 4) AS sentiment_kind, round(round(coalesce(avg(coalesce(sentiment, 0)) FILTER (kind IS DISTINCT FROM '{KIND}'), 0), 9), 4) AS sentiment_rest FROM {_RECS}",
)
def topic_report(spark, d):
    """Means and counts over the analyses of the topic, in one aggregation; emotions that are missing don't count."""
    a = _recs(spark, d)
    is_kind = F.coalesce(F.col("kind") == KIND, F.lit(False))
    s = F.coalesce("sentiment", F.lit(0.0))
    half = lambda c: F.round(F.round(F.coalesce(F.avg(F.when(c, s)), F.lit(0.0)), 9), 4)
    return a.agg(
        F.count("*").alias("n"), _mean(F.col("value")).alias("value"), *[F.count_if(F.col("value") == v).alias(f"v{v}") for v in range(6)], F.round(F.count_if("keep") / F.count("*"), 4).alias("kept"), _mean(F.col("intensity")).alias("intensity"),
        F.round(F.max(F.coalesce("intensity", F.lit(0.0))), 4).alias("intensity_max"), *[F.round(F.round(F.coalesce(F.avg(F.try_element_at("emotions", F.lit(e))), F.lit(0.0)), 9), 4).alias(e) for e in EMOTIONS],
        half(is_kind).alias("sentiment_kind"), half(~is_kind).alias("sentiment_rest"),
    )


@query("a22_topic_kinds", f"SELECT coalesce(kind, '其他') AS kind, count(*) AS n, {_mean_sql('value')} AS value FROM {_RECS} GROUP BY 1 ORDER BY n DESC, kind LIMIT 6")
def topic_kinds(spark, d, most=6):
    """The most frequent kinds of the topic with their mean values."""
    return _recs(spark, d).groupBy(F.coalesce("kind", F.lit("其他")).alias("kind")).agg(F.count("*").alias("n"), _mean(F.col("value")).alias("value")).orderBy(F.desc("n"), "kind").limit(most)


@query("a22_topic_words", " UNION ALL ".join(f"SELECT '{f}' AS field, '{w}' AS word, count(*) AS n FROM {_RECS} WHERE contains({c}, '{w}')" for f, c, ws in (("title", "title", TITLE_WORDS), ("reason", "value_reason", REASON_WORDS)) for w in ws))
def topic_words(spark, d):
    """Analyses of the topic whose title or reason holds each word; all words from one pass."""
    a = _recs(spark, d)
    each = [F.struct(F.lit(f).alias("field"), F.lit(w).alias("word"), F.coalesce(F.contains(F.col(c), F.lit(w)), F.lit(False)).cast("long").alias("hit")) for f, c, ws in (("title", "title", TITLE_WORDS), ("reason", "value_reason", REASON_WORDS)) for w in ws]
    n = a.select(F.explode(F.array(*each)).alias("x")).groupBy("x.field", "x.word").agg(F.sum("x.hit").alias("hits"))
    words = spark.createDataFrame([("title", w) for w in TITLE_WORDS] + [("reason", w) for w in REASON_WORDS], "field string, word string")
    return F.broadcast(words).join(n, ["field", "word"], "left").select("field", "word", F.coalesce("hits", F.lit(0)).alias("n"))


_DENSE = "SELECT strftime(conv_created_at, '%Y-%m') AS month, round(avg(coalesce(sentiment, 0)), 9) AS sentiment FROM analysis WHERE conv_created_at IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"


@query("a23_rebound", f"WITH m AS ({_DENSE}), t AS (SELECT arg_min(month, (sentiment, month)) AS trough FROM m), l AS (SELECT * FROM m, t WHERE month > trough OR NOT EXISTS (SELECT 1 FROM m, t WHERE month > trough)) SELECT any_value(trough) AS trough, arg_max(month, (sentiment, month)) AS rebound, round(max(sentiment), 4) AS sentiment FROM l")
def rebound(spark, d, least=5):
    """The month of lowest mood, and the best one after it, or of all where none comes after; months (UTC) with enough rows."""
    a = table(spark, d, "analysis").where("conv_created_at is not null")
    m = a.groupBy(F.date_format("conv_created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("sentiment", F.lit(0.0))), 9).alias("sentiment")).where(F.col("n") >= least)
    months = m.agg(F.collect_list(F.struct("sentiment", "month")).alias("all"))  # a calendar's worth of rows
    t = months.select("all", F.array_min("all").alias("low")).select("low", F.filter("all", lambda x: x["month"] > F.col("low")["month"]).alias("later"), "all")
    best = F.array_max(F.when(F.size("later") > 0, F.col("later")).otherwise(F.col("all")))
    return t.select(F.col("low")["month"].alias("trough"), best.alias("b")).select("trough", F.col("b")["month"].alias("rebound"), F.round(F.col("b")["sentiment"], 4).alias("sentiment")).where("trough is not null")


_LOW = "SELECT strftime(conv_created_at, '%Y-%m') AS month, count(*) AS n FROM analysis WHERE sentiment < -0.3 AND conv_created_at IS NOT NULL GROUP BY 1"


@query("a24_low_span", f"WITH l AS ({_LOW}), p AS (SELECT month AS peak FROM l ORDER BY n DESC, month LIMIT 1) SELECT peak, min(month) AS first_month, max(month) AS last_month, CAST(sum(n) AS BIGINT) AS n FROM l, p WHERE month[1:4] = peak[1:4] AND abs(CAST(month[6:7] AS INTEGER) - CAST(peak[6:7] AS INTEGER)) <= 2 GROUP BY peak")
def low_span(spark, d):
    """The month of most low moods, and what lies within two months of it in its year."""
    a = table(spark, d, "analysis").where("sentiment < -0.3 and conv_created_at is not null")
    m = a.groupBy(F.date_format("conv_created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    peak = m.orderBy(F.desc("n"), "month").limit(1).select(F.col("month").alias("peak"))
    part = lambda c: F.substring(c, 6, 2).cast("int")
    near = m.join(F.broadcast(peak), F.left("month", F.lit(4)) == F.left("peak", F.lit(4))).where(F.abs(part("month") - part("peak")) <= 2)
    return near.groupBy("peak").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.sum("n").alias("n"))


_WEEK_SQL = "strftime(date_trunc('week', CAST(conv_created_at AS TIMESTAMP) + INTERVAL 8 HOUR), '%Y-%m-%d')"


@query("w6_weekly_top", f"SELECT week, CAST(r AS INTEGER) AS r, conversation_id, value FROM (SELECT {_WEEK_SQL} AS week, conversation_id, CAST(value AS INTEGER) AS value, row_number() OVER (PARTITION BY {_WEEK_SQL} ORDER BY coalesce(value, 0) DESC, coalesce(sentiment, 0), conv_created_at, conversation_id, prompt_version) AS r FROM analysis WHERE conv_created_at IS NOT NULL) WHERE r <= 3")
def weekly_top(spark, d, most=3):
    """The most valuable conversations of each local week, the lower mood first on ties; the best of each part of a week first,
    so that a week of any size is spread over tasks."""
    from pyspark.sql import Window

    a = table(spark, d, "analysis").where("conv_created_at is not null")
    week = F.date_format(F.date_trunc("week", timeutil.local(F.col("conv_created_at").cast("timestamp_ntz"))), "yyyy-MM-dd")
    a = a.select(week.alias("week"), "conversation_id", F.col("value").cast("int").alias("value"), "sentiment", "conv_created_at", "prompt_version", F.pmod(F.xxhash64("conversation_id"), F.lit(64)).alias("part"))
    order = (F.desc(F.coalesce("value", F.lit(0))), F.coalesce("sentiment", F.lit(0.0)), F.col("conv_created_at"), F.col("conversation_id"), F.col("prompt_version"))
    best = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy("week", *by).orderBy(*order))).where(F.col("r") <= most)
    return best(best(a, "part").drop("r")).select("week", "r", "conversation_id", "value")


@query(
    "x44_normal_analysis",
    "SELECT conversation_id, prompt_version, CAST(CASE WHEN value IS NULL THEN 3 ELSE greatest(0, least(5, value)) END AS INTEGER) AS value, coalesce(keep, CASE WHEN value IS NULL THEN 3 ELSE greatest(0, least(5, value)) END >= 3) AS keep, substr(coalesce(value_reason, ''), 1, 200) AS value_reason, substr(coalesce(kind, ''), 1, 16) AS kind, "
    "array_to_string(list_transform(list_filter(coalesce(topics, [])[1:5], lambda t: trim(coalesce(t, ''), ' ') <> ''), lambda t: substr(t, 1, 24)), '|') AS topics, round(greatest(-1, least(1, coalesce(sentiment, 0))), 3) AS sentiment, round(greatest(0, least(1, coalesce(intensity, 0))), 3) AS intensity, "
    + ", ".join(f"round(greatest(0, least(1, coalesce(emotions['{e}'], 0))), 3) AS {e}" for e in EMOTIONS)
    + ", substr(coalesce(summary, ''), 1, 200) AS summary FROM analysis",
)
def normal_analysis(spark, d):
    """Analyses in their normal form: values clamped and defaulted, five topics of 24 characters, the six emotions."""
    a = table(spark, d, "analysis")
    value = F.when(F.col("value").isNull(), 3).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), F.col("value")))).cast("int")
    num = lambda c, lo: F.round(F.greatest(F.lit(float(lo)), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))), 3)
    topics = F.transform(F.filter(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 5), lambda t: F.trim(F.coalesce(t, F.lit(""))) != ""), lambda t: F.substring(t, 1, 24))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return a.select("conversation_id", "prompt_version", value.alias("value"), F.coalesce("keep", value >= 3).alias("keep"), text("value_reason", 200), text("kind", 16), F.array_join(topics, "|").alias("topics"), num(F.col("sentiment"), -1).alias("sentiment"), num(F.col("intensity"), 0).alias("intensity"), *[num(F.try_element_at("emotions", F.lit(e)), 0).alias(e) for e in EMOTIONS], text("summary", 200))

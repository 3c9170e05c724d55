"""Enrichment of conversations: structure flags, emotion counts, summaries, roll-ups of analyses and topic reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.registry import ROLES_SQL as M
from chatlode.operators.registry import query
from chatlode.session import table

# Emotion words. A word is counted wherever it stands, also inside a longer one.
EMOTIONS = {
    "joy": ["开心", "高兴", "喜欢", "谢谢", "感谢", "太好了", "成功", "搞定", "解决", "不错", "哈哈", "满意", "顺利", "期待", "幸福", "棒", "爽", "舒服", "加油"],
    "sadness": ["难过", "低落", "失望", "孤独", "绝望", "想哭", "伤心", "委屈", "郁闷", "沮丧", "心痛", "痛苦"],
    "anger": ["生气", "愤怒", "烦", "恶心", "讨厌", "气死", "烦躁", "恼火", "无语", "火大"],
    "anxiety": ["焦虑", "担心", "害怕", "紧张", "压力", "着急", "急", "慌", "不安", "怕", "愁"],
    "fatigue": ["累", "疲惫", "困", "熬夜", "加班", "忙", "乏力", "没精神", "疲倦"],
}
# User messages that carry nothing.
FILLER = r"(?i)^(继续|好的?|嗯+|哦+|谢谢|感谢|ok|okay|yes|no|对|对的|是的|可以|行|好|在吗|你好|嗨|hi|hello|？+|\?+)[。！!~，, \t\r\n]*$"
INDENTED = r"(?m)^( {4}|\t)[^ \t\r\n]"


def occurrences(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [((F.length(col) - F.length(F.replace(col, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words])


def _occ_sql(words):
    return " + ".join(f"CAST((length(t) - length(replace(t, '{w}', ''))) / {len(w)} AS BIGINT)" for w in words)


@query("h5_filler_ratio", f"SELECT conversation_id, round(count(*) FILTER (trim(coalesce(text, ''), ' ') = '' OR regexp_matches(trim(text, ' '), '{FILLER}')) * 1.0 / count(*), 4) AS filler FROM {M} WHERE rl = 'user' GROUP BY conversation_id")
def filler_ratio(spark, d):
    m = timeutil.roles(table(spark, d, "messages")).where("rl = 'user'")
    t = F.trim(F.coalesce("text", F.lit("")))
    return m.groupBy("conversation_id").agg(F.round(F.count_if((t == "") | t.rlike(FILLER)) / F.count("*"), 4).alias("filler"))


@query(
    "h8_emotions",
    "WITH c AS (SELECT conversation_id, " + ", ".join(f"CAST(sum({_occ_sql(ws)}) AS BIGINT) AS {k}" for k, ws in EMOTIONS.items()) + f" FROM (SELECT conversation_id, coalesce(text, '') AS t FROM {M} WHERE rl = 'user') GROUP BY conversation_id), s AS (SELECT *, joy + sadness + anger + anxiety + fatigue AS total FROM c) "
    "SELECT conversation_id, round(CASE WHEN total > 0 THEN (joy - sadness - anger - anxiety - fatigue) * 1.0 / total ELSE 0 END, 4) AS sentiment, round(least(1.0, total / 6.0), 4) AS intensity, "
    + ", ".join(f"round(least(1.0, {k} / 3.0), 4) AS {k}" for k in EMOTIONS)
    + ", round(1 - greatest(" + ", ".join(f"least(1.0, {k} / 3.0)" for k in EMOTIONS) + "), 4) AS calm FROM s",
)
def emotions(spark, d):
    m = timeutil.roles(table(spark, d, "messages")).where("rl = 'user'")
    t = F.coalesce("text", F.lit(""))
    c = m.groupBy("conversation_id").agg(*[F.sum(occurrences(t, ws)).alias(k) for k, ws in EMOTIONS.items()])
    total = reduce(lambda a, b: a + b, [F.col(k) for k in EMOTIONS])
    each = {k: F.least(F.lit(1.0), F.col(k) / 3) for k in EMOTIONS}
    sentiment = F.when(total > 0, (F.col("joy") * 2 - total) / total).otherwise(0.0)
    return c.select("conversation_id", F.round(sentiment, 4).alias("sentiment"), F.round(F.least(F.lit(1.0), total / 6), 4).alias("intensity"), *[F.round(e, 4).alias(k) for k, e in each.items()], F.round(1 - F.greatest(*each.values()), 4).alias("calm"))


@query("a17_status", "SELECT count(*) AS n, round(avg(value), 4) AS avg_value, count(*) FILTER (keep) AS kept, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, round(coalesce(sum(cost), 0), 4) AS cost, strftime(min(analyzed_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(analyzed_at), '%Y-%m-%d %H:%M:%S') AS last_at, " + ", ".join(f"count(*) FILTER (value = {v}) AS v{v}" for v in range(6)) + " FROM analysis")
def status(spark, d):
    a = table(spark, d, "analysis")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return a.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.count_if("keep").alias("kept"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), at(F.min("analyzed_at")).alias("first_at"), at(F.max("analyzed_at")).alias("last_at"), *[F.count_if(F.col("value") == v).alias(f"v{v}") for v in range(6)])


@query("a18_by_model", "SELECT model, count(*) AS n, count(*) FILTER (model = 'heuristic') AS heuristic FROM analysis GROUP BY model")
def by_model(spark, d):
    return table(spark, d, "analysis").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("model") == "heuristic").alias("heuristic"))


_EMO = ("joy", "calm", "anxiety", "anger", "sadness", "fatigue")


@query("a19_weekly", "SELECT strftime(date_trunc('week', CAST(conv_created_at AS TIMESTAMP) + INTERVAL 8 HOUR), '%Y-%m-%d') AS week, count(*) AS n, round(round(sum(coalesce(value, 0)) * 1.0 / count(*), 9), 3) AS value, round(round(sum(coalesce(sentiment, 0)) / count(*), 9), 3) AS sentiment, round(round(sum(coalesce(intensity, 0)) / count(*), 9), 3) AS intensity, round(count(*) FILTER (keep) * 1.0 / count(*), 3) AS keep, " + ", ".join(f"round(round(sum(coalesce(emotions['{e}'], 0)) / count(*), 9), 3) AS {e}" for e in _EMO) + " FROM analysis WHERE conv_created_at IS NOT NULL GROUP BY week")
def weekly(spark, d):
    """Means of each local week, Monday first; missing values count as 0."""
    a = table(spark, d, "analysis").where("conv_created_at is not null")
    week = F.date_format(F.date_trunc("week", timeutil.local(F.col("conv_created_at").cast("timestamp_ntz"))), "yyyy-MM-dd")
    mean = lambda c: F.round(F.round(F.sum(F.coalesce(c, F.lit(0))) / F.count("*"), 9), 3)  # noqa: E731  the first round takes off what the order of summing leaves
    return a.groupBy(week.alias("week")).agg(F.count("*").alias("n"), mean(F.col("value")).alias("value"), mean(F.col("sentiment")).alias("sentiment"), mean(F.col("intensity")).alias("intensity"), F.round(F.count_if("keep") / F.count("*"), 3).alias("keep"), *[mean(F.try_element_at("emotions", F.lit(e))).alias(e) for e in _EMO])


@query("a19_weekly_topics", "WITH t AS (SELECT strftime(date_trunc('week', CAST(conv_created_at AS TIMESTAMP) + INTERVAL 8 HOUR), '%Y-%m-%d') AS week, unnest(topics) AS topic FROM analysis WHERE conv_created_at IS NOT NULL), c AS (SELECT week, topic, count(*) AS n FROM t GROUP BY 1, 2) SELECT week, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, topic) AS r FROM c) WHERE r <= 6")
def weekly_topics(spark, d, top=6):
    a = table(spark, d, "analysis").where("conv_created_at is not null")
    week = F.date_format(F.date_trunc("week", timeutil.local(F.col("conv_created_at").cast("timestamp_ntz"))), "yyyy-MM-dd")
    c = a.select(week.alias("week"), F.explode("topics").alias("topic")).groupBy("week", "topic").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("n"), "topic"))).where(F.col("r") <= top).drop("r")


@query("a20_tiers", "SELECT CASE WHEN value >= 4 THEN 'high' WHEN value = 3 THEN 'mid' ELSE 'low' END AS tier, count(*) AS n, count(DISTINCT conversation_id) AS conversations FROM analysis WHERE value IS NOT NULL GROUP BY tier")
def tiers(spark, d):
    v = F.col("value")
    return table(spark, d, "analysis").where("value is not null").groupBy(F.when(v >= 4, "high").when(v == 3, "mid").otherwise("low").alias("tier")).agg(F.count("*").alias("n"), F.countDistinct("conversation_id").alias("conversations"))


@query("f10_emotional", "SELECT conversation_id, round(intensity, 4) AS intensity, round(sentiment, 4) AS sentiment FROM analysis WHERE kind = '情绪' OR intensity >= 0.3 OR abs(sentiment) >= 0.2")
def emotional(spark, d):
    a = table(spark, d, "analysis")
    return a.where((a.kind == "情绪") | (a.intensity >= 0.3) | (F.abs(a.sentiment) >= 0.2)).select("conversation_id", F.round("intensity", 4).alias("intensity"), F.round("sentiment", 4).alias("sentiment"))


@query("a22_kinds", "SELECT lower(trim(kind, ' ')) AS kind, count(*) AS n, round(avg(value), 3) AS value, round(avg(sentiment), 3) AS sentiment, round(avg(intensity), 3) AS intensity FROM analysis GROUP BY 1")
def kinds(spark, d):
    return table(spark, d, "analysis").groupBy(F.lower(F.trim("kind")).alias("kind")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("value", "sentiment", "intensity")])


_MONTH_SQL = "SELECT strftime(conv_created_at, '%Y-%m') AS month, count(*) AS n, round(avg(sentiment), 4) AS sentiment, round(avg(emotions['anxiety']), 4) AS anxiety, round(avg(emotions['fatigue']), 4) AS fatigue FROM analysis WHERE conv_created_at IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"


@query("a23_trend", _MONTH_SQL)
def trend(spark, d, least=5):
    """Monthly means (UTC) of the months with enough conversations."""
    a = table(spark, d, "analysis").where("conv_created_at is not null")
    emo = lambda e: F.round(F.avg(F.try_element_at("emotions", F.lit(e))), 4).alias(e)
    return a.groupBy(F.date_format("conv_created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("sentiment"), 4).alias("sentiment"), emo("anxiety"), emo("fatigue")).where(F.col("n") >= least)


@query("a23_extremes", f"WITH m AS ({_MONTH_SQL}) SELECT min(month) AS first_month, max(month) AS last_month, arg_max(month, (anxiety, month)) AS anxiety_peak, arg_max(month, (fatigue, month)) AS fatigue_peak, arg_min(month, (sentiment, month)) AS trough FROM m")
def extremes(spark, d):
    m = trend(spark, d)
    return m.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.max_by("month", F.struct("anxiety", "month")).alias("anxiety_peak"), F.max_by("month", F.struct("fatigue", "month")).alias("fatigue_peak"), F.min_by("month", F.struct("sentiment", "month")).alias("trough"))


@query("a24_low_mood", "SELECT strftime(conv_created_at, '%Y-%m') AS month, count(*) AS n FROM analysis WHERE sentiment < -0.3 AND conv_created_at IS NOT NULL GROUP BY 1")
def low_mood(spark, d):
    return table(spark, d, "analysis").where("sentiment < -0.3 and conv_created_at is not null").groupBy(F.date_format("conv_created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("f13_error_kinds", "SELECT CASE WHEN regexp_matches(lower(error), '429|rate.?limit|too many') THEN 'rate_limited' WHEN regexp_matches(lower(error), 'content|filter|policy|risk') THEN 'filtered' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM analysis_errors GROUP BY 1")
def error_kinds(spark, d):
    e = F.lower("error")
    kind = F.when(e.rlike("429|rate.?limit|too many"), "rate_limited").when(e.rlike("content|filter|policy|risk"), "filtered").otherwise("other")
    return table(spark, d, "analysis_errors").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))

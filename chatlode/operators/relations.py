"""Joins, window logic and set operations of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.registry import MESSAGES_SQL as M
from chatlode.operators.registry import query
from chatlode.session import table


@query("j1_messages_of_conversations", "SELECT c.source, count(*) AS n, count(DISTINCT c.conversation_id) AS conversations FROM messages m JOIN (SELECT DISTINCT conversation_id, source FROM conversations) c USING (conversation_id) GROUP BY c.source")
def messages_of_conversations(spark, d):
    m = table(spark, d, "messages").groupBy("conversation_id").agg(F.count("*").alias("n"))  # counted before the join: a conversation is one row
    c = table(spark, d, "conversations").select("conversation_id", "source").distinct()
    return m.join(c, "conversation_id").groupBy("source").agg(F.sum("n").alias("n"), F.countDistinct("conversation_id").alias("conversations"))


@query("j3_conversation_counts", "SELECT c.conversation_id, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT conversation_id FROM conversations) c LEFT JOIN (SELECT conversation_id, count(*) AS n FROM messages GROUP BY 1) m ON m.conversation_id = c.conversation_id")
def conversation_counts(spark, d):
    m = table(spark, d, "messages").groupBy("conversation_id").agg(F.count("*").alias("n"))
    return table(spark, d, "conversations").select("conversation_id").distinct().join(m, "conversation_id", "left").select("conversation_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("j4_pending", "SELECT DISTINCT conversation_id FROM messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT conversation_id FROM analysis WHERE conversation_id IS NOT NULL) AND conversation_id NOT IN (SELECT conversation_id FROM analysis_errors WHERE attempts >= 3 AND conversation_id IS NOT NULL)")
def pending(spark, d):
    """Conversations not yet analysed and not given up."""
    ids = table(spark, d, "messages").select("conversation_id").where("conversation_id is not null").distinct()
    done = table(spark, d, "analysis").select("conversation_id")
    gone = table(spark, d, "analysis_errors").where("attempts >= 3").select("conversation_id")
    return ids.join(done, "conversation_id", "left_anti").join(gone, "conversation_id", "left_anti")


@query("j5_selected", "SELECT DISTINCT conversation_id, source FROM conversations WHERE conversation_id IN (SELECT conversation_id FROM selection_log WHERE action = 'add')")
def selected(spark, d):
    log = table(spark, d, "selection_log").where("action = 'add'").select("conversation_id").distinct()
    return table(spark, d, "conversations").select("conversation_id", "source").distinct().join(log, "conversation_id", "left_semi")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """`left` with `out`: the value of the last `right` row at or before its time, per key `by`; null where there is none.

    Both sides are put on one time line and the last value is carried forward: one shuffle and one sort, and no join that
    pairs every row with all earlier ones. Times of both sides share the column name `at`.
    """
    line = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1)).unionByName(right.select(*by, at, F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(at), "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").drop("_v", "_left")


@query("j7_as_of", "SELECT e.event_id, o.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) o ON e.user_id = o.user_id AND e.ts >= o.ts")
def last_purchase(spark, d):
    """The last purchase of the same user at or before each other event."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "purchase", "purchase_id").select("event_id", "purchase_id")


def _blocks(m: DataFrame, block: int = 1000, ids: int = 65_536) -> DataFrame:
    """`m` with `_b`, its block inside its conversation in the order of (message_index, id): by indexes, by ids where there
    is no index; rows without an index come first. Windows over blocks spread a conversation of any length over tasks."""
    at = F.col("message_index")
    return m.withColumn("_b", F.struct(at.isNotNull().alias("placed"), F.coalesce(F.floor(at / block), F.floor(F.col("id") / ids)).alias("at")))


def _with_blocks_before(m: DataFrame, **before) -> DataFrame:
    """`m`, made by _blocks, with a column for each of `before`: (aggregate of a block, function of that column and the window
    of the conversation's blocks). Only blocks meet in that window."""
    g = m.groupBy("conversation_id", "_b").agg(*(one.alias(k) for k, (one, _) in before.items()))
    w = Window.partitionBy("conversation_id")
    g = g.select(F.col("conversation_id").alias("_c"), F.col("_b").alias("_d"), *(over(F.col(k), w).alias(k) for k, (_, over) in before.items()))
    return m.join(g, F.col("conversation_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_d"))).drop("_c", "_d")


def _in_block():
    return Window.partitionBy("conversation_id", "_b").orderBy("message_index", "id")


def _before(c, w):
    """Sum of the blocks before."""
    return F.coalesce(F.sum(c).over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


_JUMP = "2025-06-27 12:00:00"


@query("j7_jump", f"(SELECT 'after' AS side, id FROM {M} WHERE lt >= TIMESTAMP '{_JUMP}' ORDER BY lt, id LIMIT 1) UNION ALL (SELECT 'before' AS side, id FROM {M} WHERE lt < TIMESTAMP '{_JUMP}' ORDER BY lt DESC, id LIMIT 1)")
def jump(spark, d, at=_JUMP):
    """The messages next to a local time on either side, by one aggregation."""
    m = timeutil.messages(spark, d).where("lt is not null")
    t = F.lit(at).cast("timestamp_ntz")
    g = m.agg(F.min(F.when(F.col("lt") >= t, F.struct("lt", "id"))).alias("after"), F.min_by("id", F.when(F.col("lt") < t, F.struct((-F.unix_micros(F.col("lt").cast("timestamp"))).alias("a"), "id"))).alias("before"))
    return g.select(F.explode(F.array(F.struct(F.lit("after").alias("side"), F.col("after.id").alias("id")), F.struct(F.lit("before").alias("side"), F.col("before").alias("id")))).alias("x")).select("x.*").where("id is not null")


@query("j9_inferred_times", f"SELECT id, strftime(coalesce(ts, CASE WHEN rl = 'assistant' AND message_index IS NOT NULL THEN last_value(CASE WHEN rl = 'user' AND message_index IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY message_index NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END), '%Y-%m-%d %H:%M:%S') AS at FROM {M}")
def inferred_times(spark, d, block=1000):
    """An answer without a time inherits that of the prompt before it; rows without an index, which have no prompt before them,
    keep their own time. Conversations are cut into blocks of indexes, so that one of any length is spread over tasks, and
    the last prompt's time passes on from block to block."""
    m = _blocks(timeutil.messages(spark, d), block)
    asked = F.when((F.col("rl") == "user") & F.col("message_index").isNotNull(), F.col("ts"))
    m = _with_blocks_before(m, carry=(F.max_by("ts", F.when(asked.isNotNull(), F.struct("message_index", "id"))), lambda c, w: F.last(c, ignorenulls=True).over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))))
    prev = F.coalesce(F.last(asked, ignorenulls=True).over(_in_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)), "carry")
    return m.select("id", timeutil.text_of(F.coalesce("ts", F.when((F.col("rl") == "assistant") & F.col("message_index").isNotNull(), prev))).alias("at"))


@query("w5_created_updated", f"SELECT conversation_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM {M} GROUP BY conversation_id")
def created_updated(spark, d):
    from chatlode.operators.stats import rollup

    return rollup(spark, d).groupBy("conversation_id").agg(timeutil.text_of(F.min("lo")).alias("created"), timeutil.text_of(F.max("hi")).alias("updated"))


@query("w7_best_analysis", "SELECT conversation_id, prompt_version, CAST(value AS INTEGER) AS value FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY prompt_version DESC NULLS LAST, analyzed_at DESC NULLS LAST, value DESC NULLS LAST) AS r FROM analysis) WHERE r = 1")
def best_analysis(spark, d):
    """The latest row per conversation, by a maximum of a struct: combined before the shuffle, no window."""
    a = table(spark, d, "analysis")
    g = a.groupBy("conversation_id").agg(F.max(F.struct("prompt_version", "analyzed_at", "value")).alias("b"))
    return g.select("conversation_id", "b.prompt_version", "b.value")


@query("w8_selection", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY collection, conversation_id ORDER BY seq DESC) AS r, max(CASE WHEN action <> 'add' OR action IS NULL THEN seq ELSE -1 END) OVER (PARTITION BY collection, conversation_id) AS removed FROM selection_log) SELECT collection, conversation_id, min(CASE WHEN seq > removed THEN seq END) AS added_seq FROM l GROUP BY collection, conversation_id, removed HAVING max(CASE WHEN r = 1 THEN action END) = 'add'")
def selection(spark, d):
    """Current members of each collection by replay of the log: any action but 'add' removes; a member stands where it was
    first added since it was last removed."""
    log = table(spark, d, "selection_log")
    g = log.groupBy("collection", "conversation_id").agg(F.max_by("action", "seq").alias("last"), F.coalesce(F.max(F.when(F.col("action").isNull() | (F.col("action") != "add"), F.col("seq"))), F.lit(-1)).alias("removed"), F.array_sort(F.collect_set(F.when(F.col("action") == "add", F.col("seq")))).alias("adds"))
    return g.where("last = 'add'").select("collection", "conversation_id", F.array_min(F.filter("adds", lambda s: s > F.col("removed"))).alias("added_seq"))


_SAMPLE_SQL = "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY message_index NULLS FIRST, id) - 1 AS i, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages WHERE trim(coalesce(text, ''), ' ') <> ''), s AS (SELECT *, greatest(1, (n - 2) // 38) AS step FROM m)"


@query("w9_digest_sample", _SAMPLE_SQL + " SELECT conversation_id, id FROM s WHERE n <= 40 OR i = 0 OR i = n - 1 OR (i BETWEEN 1 AND n - 2 AND (i - 1) % step = 0 AND (i - 1) // step < 38)")
def digest_sample(spark, d, cap=40):
    """Head, evenly strided middle and tail of each conversation, of all its messages that say something: at most `cap` rows,
    the sampling being the feature. Rows without an index come first."""
    m = _blocks(table(spark, d, "messages").where(F.trim(F.coalesce("text", F.lit(""))) != ""))
    m = _with_blocks_before(m, n=(F.count("*"), lambda c, w: F.sum(c).over(w)), before=(F.count("*"), _before))
    m = m.withColumn("i", F.row_number().over(_in_block()) - 1 + F.col("before"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 2) / (cap - 2)))
    mid = F.col("i").between(1, F.col("n") - 2) & ((F.col("i") - 1) % step == 0) & (F.floor((F.col("i") - 1) / step) < cap - 2)
    return m.where((F.col("n") <= cap) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | mid).select("conversation_id", "id")


@query("w10_char_budget", "SELECT conversation_id, id FROM (SELECT conversation_id, id, sum(length(text)) OVER (PARTITION BY conversation_id ORDER BY message_index NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM messages WHERE text IS NOT NULL) WHERE run <= 1000")
def char_budget(spark, d, budget=1000):
    """Messages from the start of each conversation as long as their characters stay within a budget."""
    m = _blocks(table(spark, d, "messages").where(F.col("text").isNotNull())).select("conversation_id", "message_index", "id", "_b", F.length("text").alias("long"))
    m = _with_blocks_before(m, before=(F.sum("long"), _before)).where(F.col("before") <= budget)
    run = F.sum("long").over(_in_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    return m.withColumn("run", run).where(F.col("run") <= budget).select("conversation_id", "id")


@query("t1_list_page", "SELECT conversation_id, source, message_count FROM conversations ORDER BY updated_at DESC NULLS LAST, conversation_id LIMIT 50")
def list_page(spark, d, page=50):
    return table(spark, d, "conversations").orderBy(F.desc_nulls_last("updated_at"), "conversation_id").limit(page).select("conversation_id", "source", "message_count")


@query("u3_stale", "SELECT DISTINCT conversation_id FROM analysis INTERSECT SELECT DISTINCT conversation_id FROM selection_log")
def stale(spark, d):
    return table(spark, d, "analysis").select("conversation_id").intersect(table(spark, d, "selection_log").select("conversation_id"))


@query("u2_fresh", "SELECT conversation_id FROM conversations EXCEPT SELECT conversation_id FROM analysis")
def fresh(spark, d):
    return table(spark, d, "conversations").select("conversation_id").subtract(table(spark, d, "analysis").select("conversation_id"))


@query("u1_union_sources", "SELECT k, count(*) AS n FROM (SELECT source AS k FROM conversations UNION ALL SELECT source FROM analysis UNION ALL SELECT source FROM documents) GROUP BY k")
def union_sources(spark, d):
    parts = [table(spark, d, t).groupBy(F.col("source").alias("k")).agg(F.count("*").alias("n")) for t in ("conversations", "analysis", "documents")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("k").agg(F.sum("n").alias("n"))


@query("f6_ordered_lookup", "SELECT i.pos, c.conversation_id, c.source FROM (SELECT CAST(row_number() OVER (ORDER BY conversation_id DESC) AS INTEGER) - 1 AS pos, conversation_id FROM (SELECT DISTINCT conversation_id FROM selection_log ORDER BY conversation_id DESC LIMIT 20)) i JOIN (SELECT DISTINCT conversation_id, source FROM conversations) c USING (conversation_id)")
def ordered_lookup(spark, d):
    """Conversations of an id list in the caller's order."""
    ids = [r[0] for r in table(spark, d, "selection_log").select("conversation_id").distinct().orderBy(F.desc("conversation_id")).limit(20).collect()]
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, conversation_id string")
    return F.broadcast(wanted).join(table(spark, d, "conversations").select("conversation_id", "source").distinct(), "conversation_id").select("pos", "conversation_id", "source")

"""Lists and views of conversations: pages in every order, point lookups, cut views, links, pending sets, message search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.registry import MESSAGES_SQL as M
from chatlode.operators.registry import ROLES_SQL as R
from chatlode.operators.registry import query
from chatlode.operators.search import holds
from chatlode.session import table

#: Orders of a list of conversations: column expression, whether the greatest comes first; conversation_id settles ties.
SORTS = {"updated": ("updated_at", True), "created": ("created_at", True), "oldest": ("created_at", False), "messages": ("message_count", True), "title": ("lower(title)", False)}


def listed(conversations: DataFrame, term: str | None = None, source: str | None = None, first: str | None = None, last: str | None = None, hours: float = 8) -> DataFrame:
    """Conversations by a part of title or id, source, and local date range of updated_at, the whole last day included."""
    c = conversations
    at = timeutil.local(F.col("updated_at").cast("timestamp_ntz"), hours)
    if term:
        c = c.where(holds(F.col("title"), term) | holds(F.col("conversation_id"), term))
    if source:
        c = c.where(F.col("source") == source)
    if first:
        c = c.where(at >= F.lit(first).cast("timestamp_ntz"))
    if last:
        c = c.where(at < F.date_add(F.lit(last), 1).cast("timestamp_ntz"))
    return c


def page(conversations: DataFrame, sort: str = "updated", limit: int = 30, offset: int = 0) -> DataFrame:
    """One page of a list, with the number of all rows as `total`; the page is the feature. A sort of `offset + limit` rows per
    partition, not of the table."""
    by, down = SORTS[sort]
    e = F.expr(by)
    rows = conversations.orderBy(F.desc_nulls_last(e) if down else F.asc_nulls_first(e), "conversation_id", "source", "title").limit(offset + limit).offset(offset)
    return rows.crossJoin(F.broadcast(conversations.agg(F.count("*").alias("total"))))  # one row


def _page_query(sort):
    by, down = SORTS[sort]

    @query(f"t1_list_{sort}", f"SELECT conversation_id, source, title, message_count, (SELECT count(*) FROM conversations) AS total FROM conversations ORDER BY {by} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}, conversation_id, source NULLS FIRST, title NULLS FIRST LIMIT 30 OFFSET 30")
    def run(spark, d):
        """Second page of 30 in this order."""
        return page(table(spark, d, "conversations"), sort, 30, 30).select("conversation_id", "source", "title", "message_count", "total")

    return run


for _sort in SORTS:
    _page_query(_sort)


@query("f4_list_range", "SELECT conversation_id, source, title FROM conversations WHERE source = 'gemini' AND CAST(updated_at AS TIMESTAMP) + INTERVAL 8 HOUR >= TIMESTAMP '2025-01-01' AND CAST(updated_at AS TIMESTAMP) + INTERVAL 8 HOUR < TIMESTAMP '2025-07-01'")
def list_range(spark, d):
    return listed(table(spark, d, "conversations"), source="gemini", first="2025-01-01", last="2025-06-30").select("conversation_id", "source", "title")


@query("f7_targets", "SELECT DISTINCT conversation_id, source FROM conversations WHERE message_count >= 6 AND conversation_id IN (SELECT conversation_id FROM selection_log)")
def targets(spark, d, least=6):
    """Conversations of a list of ids with enough messages."""
    wanted = table(spark, d, "selection_log").select("conversation_id").distinct()
    return table(spark, d, "conversations").where(F.col("message_count") >= least).select("conversation_id", "source").distinct().join(wanted, "conversation_id", "left_semi")


_LOOKED_UP = "(SELECT min(conversation_id) FROM selection_log WHERE conversation_id IN (SELECT conversation_id FROM messages))"


def _looked_up(spark, d) -> DataFrame:
    """The messages of one conversation, an equality filter that reaches the scan."""
    m = table(spark, d, "messages")
    cid = m.select("conversation_id").join(table(spark, d, "selection_log").select("conversation_id").distinct(), "conversation_id", "left_semi").agg(F.min("conversation_id")).first()[0]
    return timeutil.roles(m.where(F.col("conversation_id") == cid))


@query("f14_conversation", f"SELECT CAST(row_number() OVER (ORDER BY message_index NULLS FIRST, id) - 1 AS INTEGER) AS position, id, rl AS role, text, thinking FROM {R} WHERE conversation_id = {_LOOKED_UP}")
def conversation(spark, d):
    """One conversation, its messages in order."""
    return numbered(_looked_up(spark, d)).select("position", "id", F.col("rl").alias("role"), "text", "thinking")


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with `position` in their conversation by index, then id; blocks of a conversation are numbered apart."""
    from chatlode.operators.relations import _before, _blocks, _in_block, _with_blocks_before

    m = _with_blocks_before(_blocks(messages), before=(F.count("*"), _before))
    return m.withColumn("position", (F.row_number().over(_in_block()) - 1 + F.col("before")).cast("int")).drop("_b", "before")


def clip(col: Column, width: int) -> Column:
    """Text of at most `width` characters, an ellipsis behind it where it is cut."""
    return F.concat(F.substring(col, 1, width), F.when(F.length(col) > width, "…").otherwise(""))


@query("f17_cut_view", f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY message_index NULLS FIRST, id) - 1 AS p, count(*) OVER (PARTITION BY conversation_id) AS total FROM messages WHERE conversation_id IS NOT NULL) SELECT conversation_id, id, substr(coalesce(text, ''), 1, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS text, total, least(total, 4) AS returned FROM m WHERE p < 4")
def cut_view(spark, d, most=4, width=120):
    """The first messages of each conversation, each cut, with the counts of all and of those returned; the cuts are the feature."""
    m = table(spark, d, "messages").where("conversation_id is not null")
    total = m.groupBy("conversation_id").agg(F.count("*").alias("total"))
    heads = numbered(m.select("conversation_id", "id", "message_index", "text")).where(F.col("position") < most)
    return heads.join(total, "conversation_id").select("conversation_id", "id", clip(F.coalesce("text", F.lit("")), width).alias("text"), "total", F.least("total", F.lit(most)).alias("returned"))


@query("f18_show", "SELECT id, trim(regexp_replace(substr(coalesce(text, ''), 1, 200) || CASE WHEN length(text) > 200 THEN '…' ELSE '' END, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS snippet, CAST(coalesce(length(thinking), 0) AS INTEGER) AS thinking_chars FROM messages")
def show(spark, d, width=200):
    """A line for each message, and the length of its reasoning."""
    line = F.trim(F.regexp_replace(clip(F.coalesce("text", F.lit("")), width), r"[ \t\r\n]+", " "))
    return table(spark, d, "messages").select("id", line.alias("snippet"), F.coalesce(F.length("thinking"), F.lit(0)).alias("thinking_chars"))


@query("x13_clipped_titles", "SELECT conversation_id, substr(trim(title, ' '), 1, 12) || CASE WHEN length(trim(title, ' ')) > 12 THEN '…' ELSE '' END AS title FROM conversations")
def clipped_titles(spark, d):
    return table(spark, d, "conversations").select("conversation_id", clip(F.trim("title"), 12).alias("title"))


def url_quoted(col: Column) -> Column:
    """Percent-encoding that keeps letters, digits and -_.~ only."""
    e = F.url_encode(col)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


@query("x17_links", "SELECT id, '#c=' || url_encode(conversation_id) || coalesce('&i=' || message_index, '') AS link FROM messages WHERE conversation_id IS NOT NULL")
def links(spark, d):
    """Deep link of each message."""
    m = table(spark, d, "messages").where("conversation_id is not null")
    return m.select("id", F.concat(F.lit("#c="), url_quoted(F.col("conversation_id")), F.coalesce(F.concat(F.lit("&i="), F.col("message_index").cast("string")), F.lit(""))).alias("link"))


_PENDING = "conversation_id NOT IN (SELECT conversation_id FROM analysis WHERE conversation_id IS NOT NULL) AND conversation_id NOT IN (SELECT conversation_id FROM analysis_errors WHERE attempts >= 3 AND conversation_id IS NOT NULL)"


@query("t7_pending_oldest", f"SELECT conversation_id, min(created_at) IS NULL AS undated, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS created FROM conversations WHERE conversation_id IS NOT NULL AND {_PENDING} GROUP BY conversation_id ORDER BY min(created_at) ASC NULLS FIRST, conversation_id LIMIT 50")
def pending_oldest(spark, d, most=50):
    """Conversations that wait for an analysis, oldest first; the limit is the feature."""
    c = table(spark, d, "conversations").where("conversation_id is not null").groupBy("conversation_id").agg(F.min("created_at").alias("at"))
    done = table(spark, d, "analysis").select("conversation_id").union(table(spark, d, "analysis_errors").where("attempts >= 3").select("conversation_id"))
    c = c.join(done, "conversation_id", "left_anti").orderBy(F.asc_nulls_first("at"), "conversation_id").limit(most)
    return c.select("conversation_id", F.col("at").isNull().alias("undated"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("t8_recent", "SELECT conversation_id, source FROM conversations ORDER BY created_at DESC NULLS LAST, conversation_id, source LIMIT 60")
def recent(spark, d, most=60):
    """The latest conversations; the limit is the feature."""
    return table(spark, d, "conversations").orderBy(F.desc_nulls_last("created_at"), "conversation_id", "source").limit(most).select("conversation_id", "source")


@query("t10_daily_tail", f"SELECT strftime(lt, '%Y-%m-%d') AS day, arg_max(id, (ts, id)) AS last_id, count(*) AS n FROM {M} WHERE ts IS NOT NULL GROUP BY 1")
def daily_tail(spark, d):
    """The last message of each local day."""
    m = timeutil.messages(spark, d).where("ts is not null")
    return m.groupBy(F.date_format("lt", "yyyy-MM-dd").alias("day")).agg(F.max_by("id", F.struct("ts", "id")).alias("last_id"), F.count("*").alias("n"))


# --- ranked search over messages and the titles of their conversations --------------------------------------------------
WORD = r"[\p{L}\p{N}]+"


def terms_of(terms) -> list[tuple[list[str], bool]]:
    """The words of each term, and whether the last of them may go on: the last term, if it is ASCII of two letters or more."""
    return [([w.lower() for w in t.split()], i == len(terms) - 1 and t.isascii() and len(t) >= 2) for i, t in enumerate(terms)]


def _count(words: str, term: list[str], prefix: bool) -> Column:
    """Places of the array of words where the words of a term stand in a row."""
    at = lambda i: F.try_element_at(F.col(words), i)
    here = lambda i: reduce(lambda a, b: a & b, [(at(i + k).startswith(w) if prefix and k == len(term) - 1 else at(i + k) == w) for k, w in enumerate(term)])
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.coalesce(here(i), F.lit(False))))


def message_search(messages: DataFrame, conversations: DataFrame, terms, top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of the messages that hold every term in their text or their conversation's title, by BM25 over both. A term
    of several words is a phrase, the last word of the last term a prefix. Texts and titles are cut into words once, where
    they lie; only counts are joined and added up. The best `top` are the feature."""
    parsed = terms_of(terms)

    def counted(df, key, col, name):
        w = df.select(*key, F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), 0).alias("_w"))
        return w.select(*key, F.size("_w").alias(f"{name}_len"), *[_count("_w", t, p).alias(f"{name}{i}") for i, (t, p) in enumerate(parsed)])

    text = counted(messages, ["id", "conversation_id"], F.col("text"), "m")
    title = counted(conversations.groupBy("conversation_id").agg(F.min("title").alias("title")), ["conversation_id"], F.col("title"), "t")
    j = text.join(title, "conversation_id", "left")
    tf = [F.col(f"m{i}") + F.coalesce(f"t{i}", F.lit(0)) for i in range(len(parsed))]
    j = j.select("id", (F.col("m_len") + F.coalesce("t_len", F.lit(0))).alias("len"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    total = j.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(parsed))])
    hit = j.where(reduce(lambda a, c: a & c, [F.col(f"tf{i}") > 0 for i in range(len(parsed))])).crossJoin(F.broadcast(total))  # one row
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    score = F.round(reduce(lambda x, y: x + y, map(part, range(len(parsed)))), 6)
    return hit.select("id", score.alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(top)


_TERMS = ("retry loop", "lat")
_TF = ("len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'retry' AND ws[i + 1] = 'loop'))", "len(list_filter(ws, lambda w: starts_with(w, 'lat')))")
_PART = lambda i: f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))"


@query(
    "t2_message_search",
    "WITH c AS (SELECT conversation_id, min(title) AS title FROM conversations GROUP BY 1), p AS (SELECT id, unnest([coalesce(text, ''), coalesce(title, '')]) AS t FROM messages LEFT JOIN c USING (conversation_id)), w AS (SELECT id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS ws FROM p), "
    f"k AS (SELECT id, sum(len(ws)) AS len, sum({_TF[0]}) AS tf0, sum({_TF[1]}) AS tf1 FROM w GROUP BY id), g AS (SELECT count(*) AS docs, avg(len) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM k) "
    f"SELECT id, round({_PART(0)} + {_PART(1)}, 6) AS score FROM k, g WHERE tf0 > 0 AND tf1 > 0 ORDER BY score DESC, id DESC LIMIT 20",
)
def ranked_messages(spark, d):
    return message_search(table(spark, d, "messages"), table(spark, d, "conversations"), _TERMS)

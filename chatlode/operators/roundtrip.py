"""Readers and writers over the whole archive: every message is put into each export form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.registry import MESSAGES_SQL as M
from chatlode.operators.registry import ROLES_SQL as R
from chatlode.operators.registry import query
from chatlode.session import table
from chatlode.sources import exports, sinks
from chatlode.streaming import incremental

#: What the readers take for whitespace at the ends of a text.
_SHOWS = r"[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ROLE = "coalesce(nullif(rl, ''), 'unknown')"


@query("src5_tree_messages", f"SELECT CAST(id AS VARCHAR) AS conversation_id, CAST(0 AS INTEGER) AS message_index, {_ROLE} AS role, text, 'none' AS timestamp_source FROM {R} WHERE regexp_matches(text, '{_SHOWS}')")
def tree_messages(spark, d):
    """Each message as a tree export's conversation of its own, read back; those without a text that shows are left out."""
    m = table(spark, d, "messages")
    message = F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    rec = m.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.create_map(F.lit("r"), F.struct(message.alias("message"))).alias("mapping"))).alias("rec"))
    return exports._conversations(rec, "chatgpt", exports.tree_conversation).select("conversation_id", "message_index", "role", "text", "timestamp_source")


@query("src7_fragment_messages", f"SELECT CAST(id AS VARCHAR) AS conversation_id, CASE WHEN rl = 'user' THEN 'user' ELSE 'assistant' END AS role, coalesce(text, '') AS text, nullif(thinking, '') AS thinking, model FROM {R} WHERE coalesce(text, '') <> '' OR coalesce(thinking, '') <> ''")
def fragment_messages(spark, d):
    """Each message as a fragment export's conversation of its own, its thinking as a thought, read back."""
    m = timeutil.roles(table(spark, d, "messages"))
    part = lambda kind, c: F.struct(kind.alias("type"), F.col(c).alias("content"))
    parts = F.array(part(F.lit("THINK"), "thinking"), part(F.when(F.col("rl") == "user", "REQUEST").otherwise("RESPONSE"), "text"))
    message = F.struct(F.col("model"), parts.alias("fragments"))
    rec = m.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.create_map(F.lit("r"), F.struct(message.alias("message"))).alias("mapping"))).alias("rec"))
    return exports._conversations(rec, "deepseek", exports.fragment_conversation).select("conversation_id", "role", "text", "thinking", "model")


@query("src8_line_messages", f"SELECT CAST(id AS VARCHAR) AS conversation_id, {_ROLE} AS role, coalesce(text, '') AS text, nullif(thinking, '') AS thinking, model, len(coalesce(attachments, [])) AS files FROM {R}")
def line_messages(spark, d):
    """Each message as a line of its own with one turn, read back."""
    m = table(spark, d, "messages")
    rec = m.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.array(F.struct("role", "text", "thinking", "model", "attachments")).alias("turns"))).alias("rec"))
    return exports._conversations(rec, "gemini", exports.ndjson_conversation).select("conversation_id", "role", "text", "thinking", "model", F.size("attachments").cast("long").alias("files"))


@query("src10_activity_messages", f"SELECT CAST(id AS VARCHAR) AS id, 'gemini-unknown' AS conversation_id, regexp_replace(text, '^[\\s:：]+', '') AS text FROM {R} WHERE rl = 'user' AND text IS NOT NULL AND NOT regexp_matches(text, '^\\s|\\s$|[\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}]')")
def activity_messages(spark, d):
    """Each prompt without odd blanks as an item of an activity list, read back; the answer names the message."""
    m = timeutil.roles(table(spark, d, "messages")).where("rl = 'user' and text is not null")
    m = m.where(~F.col("text").rlike(r"^\s|\s$|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]"))
    item = F.struct(F.lit("Gemini Apps").alias("header"), F.concat(F.lit("Prompted "), "text").alias("title"), F.array(F.struct(F.concat(F.lit("<p>id:"), F.col("id").cast("string"), F.lit("</p>")).alias("html"))).alias("safeHtmlItem"))
    rows = m.select(F.to_json(item).alias("rec")).mapInArrow(_pairs, "id string, conversation_id string, text string")
    return rows


def _pairs(batches):
    import json

    import pyarrow as pa

    for b in batches:
        got = [exports.activity_json(json.loads(raw)) for raw in b.column(0).to_pylist()]
        rows = [(x[2][1]["text"].removeprefix("id:"), x[0], x[2][0]["text"]) for x in got if x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["id", "conversation_id", "text"])


@query("snk1_json_lines", "SELECT id, conversation_id, message_index, role, timestamp, text, thinking FROM messages")
def json_lines(spark, d):
    """Messages as JSON lines and back."""
    m = table(spark, d, "messages").select("id", "conversation_id", "message_index", "role", "timestamp", "text", "thinking")
    return m.select(F.from_json(F.to_json(F.struct(*m.columns)), m.schema).alias("x")).select("x.*")


@query("snk6_contents", r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?m)^#{1,6} [^\r\n]*'), lambda h: repeat('  ', length(regexp_extract(h, '^#+')) - 1) || '- ' || trim(regexp_replace(h, '^#+', ''), ' ')), chr(10)) AS contents FROM documents WHERE text IS NOT NULL")
def contents(spark, d):
    """Table of contents of each Markdown document: its headings as nested list items."""
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6} [^\r\n]*"), 0)
    line = lambda h: F.concat(F.repeat(F.lit("  "), F.length(F.regexp_extract(h, "^#+", 0)) - 1), F.lit("- "), F.trim(F.regexp_replace(h, "^#+", "")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(heads, line), "\n").alias("contents"))


@query(
    "snk2_blocks",
    "SELECT id, '## ' || coalesce('[' || message_index || '] ', '') || coalesce(role, '') || CASE WHEN lt IS NULL THEN '' ELSE ' — ' || strftime(lt, '%Y-%m-%d %H:%M') || coalesce(' (' || timestamp_source || ')', '') END || chr(10) || chr(10) || CASE WHEN coalesce(model, '') <> '' THEN '*' || model || '*' || chr(10) || chr(10) ELSE '' END "
    "|| CASE WHEN coalesce(thinking, '') <> '' THEN '<details>' || chr(10) || chr(10) || thinking || chr(10) || chr(10) || '</details>' || chr(10) || chr(10) ELSE '' END || CASE WHEN len(attachments) > 0 THEN '- ' || array_to_string(attachments, chr(10) || '- ') || chr(10) || chr(10) ELSE '' END "
    f"|| regexp_replace(coalesce(text, ''), '(^|\\n)(#{{1,5}} )', '\\1#\\2', 'g') AS block FROM {M}",
)
def blocks(spark, d):
    """Each message as the block of its conversation's Markdown document."""
    return timeutil.messages(spark, d).select("id", sinks.message_block(thinking=True, demote=True).alias("block"))


@query("j12_tier_records", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY prompt_version DESC NULLS LAST, analyzed_at DESC NULLS LAST, value DESC NULLS LAST) AS r FROM analysis WHERE value IS NOT NULL) SELECT CASE WHEN value >= 4 THEN 'high' WHEN value = 3 THEN 'mid' ELSE 'low' END AS tier, conversation_id, prompt_version, CAST(value AS INTEGER) AS value FROM b WHERE r = 1")
def tier_records(spark, d):
    """The latest valued analysis of each conversation with its tier."""
    a = table(spark, d, "analysis").where("value is not null")
    b = a.groupBy("conversation_id").agg(F.max(F.struct("prompt_version", "analyzed_at", "value")).alias("b"))
    v = F.col("b.value")
    return b.select(F.when(v >= 4, "high").when(v == 3, "mid").otherwise("low").alias("tier"), "conversation_id", "b.prompt_version", v.cast("int").alias("value"))


@query("x43_json_in_text", "SELECT id, coalesce(json_valid(nullif(regexp_extract(text, '(?s)\\{.*\\}'), '')), false) AS holds_json FROM messages WHERE contains(text, '{')")
def json_in_text(spark, d):
    """Whether what stands between the outermost braces of a text, fences and talk around it aside, is JSON."""
    m = table(spark, d, "messages").where(F.contains("text", F.lit("{")))
    body = F.nullif(F.regexp_extract("text", r"(?s)\{.*\}", 0), F.lit(""))
    return m.select("id", F.try_parse_json(body).isNotNull().alias("holds_json"))


_LOGGED = "conversation_id IN (SELECT conversation_id FROM selection_log WHERE conversation_id IS NOT NULL)"


@query("st2_merge", f"SELECT id, CASE WHEN {_LOGGED} AND source <> 'gemini' THEN text || '!' ELSE text END AS text FROM messages")
def merged(spark, d):
    """The archive after a batch that holds the conversations of the selection log with other texts: those of the activity source
    are kept, as the batch has no more messages of them, the others are replaced whole."""
    m = table(spark, d, "messages")
    ids = table(spark, d, "selection_log").select("conversation_id").distinct()
    new = m.join(ids, "conversation_id", "left_semi").withColumn("text", F.concat("text", F.lit("!"))).withColumn("prompt_only", F.lit(False))
    return incremental.merge(m, new)[0].select("id", "text")


@query("st2_changes", f"SELECT source, count(*) FILTER (NOT kept) AS changed, count(*) FILTER (kept) AS kept FROM (SELECT source, conversation_id, source = 'gemini' OR count(text) = 0 AS kept FROM messages WHERE {_LOGGED} GROUP BY 1, 2) GROUP BY source")
def merge_changes(spark, d):
    """What the batch of st2_merge does, by source."""
    m = table(spark, d, "messages")
    ids = table(spark, d, "selection_log").select("conversation_id").distinct()
    new = m.join(ids, "conversation_id", "left_semi").withColumn("text", F.concat("text", F.lit("!")))
    c = incremental.merge(m, new.withColumn("prompt_only", F.lit(False)))[1]
    return c.groupBy("source").agg(F.count_if(F.col("change") == "changed").alias("changed"), F.count_if(F.col("change") == "kept").alias("kept"))


@query("s1_windowed_events", "SELECT strftime(date_trunc('day', CAST(ts AS TIMESTAMP)), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """Events by type in tumbling windows of a day, by the operator that streams use."""
    w = incremental.windowed_counts(table(spark, d, "events"), by="event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("st5_upsert", "SELECT conversation_id, prompt_version, CAST(value AS INTEGER) AS value FROM analysis WHERE prompt_version <> 'v1' UNION ALL SELECT conversation_id, prompt_version, CAST(value AS INTEGER) FROM analysis WHERE prompt_version = 'v1' AND conversation_id NOT IN (SELECT conversation_id FROM analysis WHERE prompt_version <> 'v1' AND conversation_id IS NOT NULL)")
def upserted(spark, d):
    """Analyses of the first version after those of later ones have come."""
    a = table(spark, d, "analysis").select("conversation_id", "prompt_version", F.col("value").cast("int").alias("value"))
    return incremental.upsert(a.where("prompt_version = 'v1'"), a.where("prompt_version <> 'v1'"))


@query("st5_errors", "SELECT conversation_id, CAST(sum(attempts) + count(*) AS INTEGER) AS attempts, arg_max(error, (tried_at, error)) AS error FROM analysis_errors GROUP BY conversation_id")
def errors_again(spark, d):
    """Errors after each of them has come once more."""
    e = table(spark, d, "analysis_errors").select("conversation_id", "model", "error", "attempts", "tried_at")
    return incremental.record_errors(e, e.drop("attempts")).select("conversation_id", "attempts", "error")


@query("x22_mask_words", None)
def masked(spark, d):
    """Documents with the lexicon's words, then personal data, starred out; lengths are kept."""
    from chatlode.operators.search import mask_equal_length

    words = table(spark, d, "name_words").select("word")
    return mask_equal_length(incremental.mask_words(table(spark, d, "documents").select("doc_id", "text"), words), "text")

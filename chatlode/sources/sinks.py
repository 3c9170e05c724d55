"""Writers: JSON lines, Markdown and HTML documents per conversation, manifest and tier lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def message_block(hours: float = 8, thinking: bool = False, demote: bool = False) -> Column:
    """Markdown of one message (message_index, role, lt, timestamp_source, model, attachments, thinking, text): a heading with index,
    role, local time and where that time is from, then model, reasoning, attachments and text."""
    text = F.coalesce("text", F.lit(""))
    if demote:
        text = F.regexp_replace(text, r"(^|\n)(#{1,5} )", "$1#$2")
    at = F.when(F.col("lt").isNotNull(), F.concat(F.lit(" — "), F.date_format("lt", "yyyy-MM-dd HH:mm"), F.coalesce(F.concat(F.lit(" ("), "timestamp_source", F.lit(")")), F.lit("")))).otherwise("")
    head = F.concat(F.lit("## "), F.coalesce(F.concat(F.lit("["), F.col("message_index").cast("string"), F.lit("] ")), F.lit("")), F.coalesce("role", F.lit("")), at, F.lit("\n\n"))
    model = F.when(F.coalesce("model", F.lit("")) != "", F.concat(F.lit("*"), "model", F.lit("*\n\n"))).otherwise("")
    thought = F.when(F.coalesce("thinking", F.lit("")) != "", F.concat(F.lit("<details>\n\n"), "thinking", F.lit("\n\n</details>\n\n"))).otherwise("") if thinking else F.lit("")
    files = F.when(F.size("attachments") > 0, F.concat(F.lit("- "), F.array_join("attachments", "\n- "), F.lit("\n\n"))).otherwise("")
    return F.concat(head, model, thought, files, text)


def conversation_documents(messages: DataFrame, titles: DataFrame | None = None, thinking: bool = False, demote: bool = False) -> DataFrame:
    """conversation_id, name, markdown: one document per conversation with front matter, its messages in order, and a file name
    of day, title and the end of the id. `messages` may lack model, attachments and the like; `titles` (conversation_id, title)
    may lack conversations. A document holds its conversation whole; its size is the conversation's, which the form asks for."""
    for c, kind in (("model", "string"), ("timestamp_source", "string"), ("thinking", "string"), ("attachments", "array<string>"), ("source", "string"), ("message_index", "int")):
        if c not in messages.columns:
            messages = messages.withColumn(c, F.lit(None).cast(kind))
    if "lt" not in messages.columns:
        messages = messages.withColumn("lt", F.try_to_timestamp(F.substring("timestamp", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")) + F.expr("interval 8 hours") if "timestamp" in messages.columns else F.lit(None).cast("timestamp"))
    one = F.array_sort(F.collect_list(F.struct(F.coalesce("message_index", F.lit(2**31 - 1)).alias("i"), "id", message_block(thinking=thinking, demote=demote).alias("b"))))
    g = messages.where("conversation_id is not null").groupBy("conversation_id").agg(F.array_join(F.transform(one, lambda x: x["b"]), "\n\n").alias("body"), F.min("lt").alias("first"), F.min("source").alias("source"), F.count("*").alias("n"))
    g = g.join(titles.groupBy("conversation_id").agg(F.min("title").alias("title")), "conversation_id", "left") if titles is not None else g.withColumn("title", F.lit(None).cast("string"))
    title = F.coalesce("title", F.lit("untitled"))
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), 1, 60)
    name = F.concat(F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("undated")), F.lit("_"), slug, F.lit("_"), F.right("conversation_id", F.lit(8)), F.lit(".md"))
    front = F.concat(F.lit('---\ntitle: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"\nid: '), F.col("conversation_id"), F.lit("\nsource: "), F.coalesce("source", F.lit("")), F.lit("\nmessages: "), F.col("n").cast("string"), F.lit("\n---\n\n"))
    return g.select("conversation_id", name.alias("name"), F.concat(front, "body").alias("markdown"))


def with_contents(documents: DataFrame) -> DataFrame:
    """Documents as one Markdown text: a list of their names with links, then each under its name, headings one level lower."""
    d = documents.select(F.struct("name", F.regexp_replace("markdown", r"(^|\n)(#{1,5} )", "$1#$2").alias("body")).alias("d"))
    g = d.agg(F.array_sort(F.collect_list("d")).alias("all"))  # the selection that is exported, as the form asks for
    toc = F.array_join(F.transform("all", lambda x: F.concat(F.lit("- [["), x["name"], F.lit("]]"))), "\n")
    return g.select(F.concat(toc, F.lit("\n\n"), F.array_join(F.transform("all", lambda x: F.concat(F.lit("# "), x["name"], F.lit("\n\n"), x["body"])), "\n\n")).alias("markdown"))


def export(messages: DataFrame, ids: DataFrame, form: str, path: str, titles: DataFrame | None = None, thinking: bool = False) -> None:
    """Writes the conversations of `ids` as 'md', 'html' or 'jsonl' below `path`, one row or file part per conversation."""
    chosen = messages.join(ids.select("conversation_id").distinct(), "conversation_id", "left_semi")
    forms = {
        "md": lambda: conversation_documents(chosen, titles, thinking).select(F.col("markdown").alias("value")),
        "html": lambda: html_page(conversation_documents(chosen, titles, thinking)).select(F.col("html").alias("value")),
        "jsonl": lambda: conversation_json(chosen),
    }
    if form not in forms:
        raise ValueError(f"no form {form}; there are {', '.join(forms)}")
    forms[form]().write.mode("overwrite").text(path, lineSep="\n")


def append_selection(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Appends rows (seq, ts, conversation_id, action, collection, note) to the selection log; what is there stays."""
    spark.createDataFrame(rows, "seq long, ts timestamp, conversation_id string, action string, collection string, note string").write.mode("append").parquet(path)


def conversation_json(messages: DataFrame) -> DataFrame:
    """One JSON object per conversation with its messages nested in order."""
    one = F.array_sort(F.collect_list(F.struct(F.coalesce("message_index", F.lit(2**31 - 1)).alias("message_index"), "id", "role", "timestamp", "text")))
    return messages.where("conversation_id is not null").groupBy("conversation_id").agg(one.alias("messages")).select(F.to_json(F.struct("conversation_id", "messages")).alias("value"))


def html_page(documents: DataFrame, title: str = "Export") -> DataFrame:
    """conversation_id, html: an escaped page per document."""
    e = F.col("markdown")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return documents.select("conversation_id", F.concat(F.lit(f"<!doctype html><title>{title}</title><pre>"), e, F.lit("</pre>")).alias("html"))


def changed_only(documents: DataFrame, before: DataFrame) -> DataFrame:
    """Documents that are new or differ from those of an earlier run, told by digest."""
    old = before.select("conversation_id", F.sha2("markdown", 256).alias("was"))
    return documents.join(old, "conversation_id", "left").where(F.col("was").isNull() | (F.sha2("markdown", 256) != F.col("was"))).drop("was")


def manifest(messages: DataFrame, inputs: DataFrame, unmatched: int = 500) -> DataFrame:
    """One row: inputs with their digests, rows by source and by timestamp source, the share of rows with a time, and up to
    `unmatched` ids of rows without one, the smallest; that limit is the feature."""
    by = lambda c: messages.groupBy(F.coalesce(c, F.lit("")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(c))
    ins = inputs.agg(F.map_from_entries(F.collect_list(F.struct("path", "sha256"))).alias("inputs"))
    dated = messages.agg(F.round(F.count("timestamp") / F.count("*"), 4).alias("dated"))
    lost = messages.where("timestamp is null").orderBy("id").limit(unmatched).agg(F.array_sort(F.collect_list("id")).alias("unmatched")) if "id" in messages.columns else messages.limit(0).agg(F.array().cast("array<long>").alias("unmatched"))
    return ins.crossJoin(by("source")).crossJoin(by("timestamp_source")).crossJoin(dated).crossJoin(lost)  # single rows


def write_tiers(analysis: DataFrame, path: str) -> None:
    """Conversation ids in one folder per value tier."""
    v = F.col("value")
    analysis.where("value is not null").select("conversation_id", F.when(v >= 4, "high").when(v == 3, "mid").otherwise("low").alias("tier")).write.mode("overwrite").partitionBy("tier").text(path)

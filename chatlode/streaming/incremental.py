"""Incremental merge, backfill of times, and streaming state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fingerprint(messages: DataFrame, keys=("source", "conversation_id")) -> DataFrame:
    """keys, n, print: number of messages and digest of a conversation, in any order of its rows: sums and exclusive sums of two
    digests of each message, so that a conversation of any size is combined where it lies."""
    row = F.to_json(F.struct("message_index", "role", "timestamp", "text", "thinking", "attachments"))
    g = messages.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), row)).alias("b"))
    return g.select(*keys, "n", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string")).alias("print"))


def merge(base: DataFrame, new: DataFrame, keys=("source", "conversation_id"), activity: str = "gemini") -> tuple[DataFrame, DataFrame]:
    """(merged messages, changes): whole conversations of `new` are added or put in place of those of `base`.

    An unknown conversation is added; one whose prompts only are known (prompt_only) never replaces; one of the activity
    source replaces only with more messages; any other replaces when its fingerprint differs. Only fingerprints meet in
    the comparison; the messages themselves are taken by semi and anti joins on the outcome.
    """
    keys = list(keys)
    only = new.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("prompt_only"), F.lit(False)) if "prompt_only" in new.columns else F.lit(False)).alias("only"))
    a, b = fingerprint(base, keys), fingerprint(new, keys).join(only, keys)
    j = b.join(a.select(*keys, F.col("n").alias("n0"), F.col("print").alias("p0")), keys, "left")
    act = (
        F.when(F.col("p0").isNull(), "added")
        .when(F.col("only"), "kept")
        .when((F.col("source") == activity) & (F.col("n") <= F.col("n0")), "kept")
        .when(F.col("print") == F.col("p0"), "kept")
        .otherwise("changed")
    )
    changes = j.select(*keys, act.alias("change"))
    take = changes.where("change <> 'kept'").select(*keys)
    rest = base.join(take, keys, "left_anti")
    got = new.drop("prompt_only").join(take, keys, "left_semi")
    return rest.unionByName(got, allowMissingColumns=True), changes


def upsert(base: DataFrame, new: DataFrame, keys=("conversation_id",)) -> DataFrame:
    """`base` with the rows of `new` in place of those of the same keys; a null key is never the same as another."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def record_errors(errors: DataFrame, tries: DataFrame) -> DataFrame:
    """`errors` (conversation_id, model, error, attempts, tried_at) after further failed `tries` (the same without attempts): one
    row a conversation, attempts added up, model and error those of the last try."""
    both = errors.unionByName(tries.withColumn("attempts", F.lit(1)))
    last = F.max_by(F.struct("model", "error", "tried_at"), F.struct("tried_at", "error")).alias("l")
    return both.groupBy("conversation_id").agg(last, F.sum("attempts").cast("int").alias("attempts")).select("conversation_id", "l.model", "l.error", "attempts", "l.tried_at")


def unseen(inputs: DataFrame, seen: DataFrame) -> DataFrame:
    """Inputs whose path and digest are not those of an earlier run."""
    return inputs.join(seen.select("path", "sha256"), ["path", "sha256"], "left_anti")


def backfill(messages: DataFrame, timeline: DataFrame, least: float = 0.9, band: tuple[float, float] = (0.7, 1.4)) -> DataFrame:
    """id, at, how of prompts without a time that a timeline (item, prompt, at) dates.

    Exact pass: the k-th prompt of a normalised text takes the k-th item of that text, the first one when there are fewer.
    Near pass for the rest: texts that share a block (a 4-gram of rare rank) and a length band are compared by edit
    similarity, and each prompt takes its best item of at least `least`. Unlike a sequential search the exact pass comes
    first for all prompts.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s\x{200B}\x{FEFF}]+", " ")))
    m = messages.withColumn("k", key(F.col("text"))).where("k <> ''")
    t = timeline.withColumn("k", key(F.col("prompt"))).where("k <> ''")
    # A text can be shared by a third of all rows: ranks come from counts of blocks, not from one window over the text.
    m = _rank(m, "k", "id")
    t = _rank(t, "k", "item")
    n = t.groupBy("k").agg(F.max("rank").alias("last"))
    m = m.join(n, "k", "left").withColumn("rank", F.when(F.col("rank") <= F.col("last"), F.col("rank")).otherwise(1))
    exact = m.join(t.select("k", "rank", "at"), ["k", "rank"]).select("id", "at", F.lit("exact").alias("how"))
    lone = m.join(n.select("k"), "k", "left_anti").select("id", "k")
    left = lone.select("k").distinct().withColumn("g", F.explode(_blocks(F.col("k"))))  # each text once, however many rows it has
    right = t.groupBy("k").agg(F.min("at").alias("at")).withColumnRenamed("k", "k2").withColumn("g", F.explode(_blocks(F.col("k2"))))
    near = left.join(right, "g").where((F.length("k2") >= F.length("k") * band[0]) & (F.length("k2") <= F.length("k") * band[1])).drop("g").distinct()
    near = near.withColumn("s", 1 - F.levenshtein("k", "k2") / F.greatest(F.length("k"), F.length("k2"))).where(F.col("s") >= least)
    best = near.groupBy("k").agg(F.max_by("at", F.struct("s", "k2")).alias("at"))
    best = lone.join(best, "k").select("id", "at", F.lit("near").alias("how"))
    return exact.unionByName(best)


def _rank(df: DataFrame, key: str, order: str, block: int = 65_536) -> DataFrame:
    """`df` with `rank` from 1 inside `key` in the order of the number `order`: ranks in blocks of its values, plus the rows
    of the blocks before."""
    df = df.withColumn("_s", F.floor(F.col(order) / block))
    c = df.groupBy(key, "_s").agg(F.count("*").alias("c"))
    c = c.withColumn("before", F.sum("c").over(Window.partitionBy(key).orderBy("_s")) - F.col("c")).drop("c")
    return df.join(c, [key, "_s"]).withColumn("rank", F.row_number().over(Window.partitionBy(key, "_s").orderBy(order)) + F.col("before")).drop("_s", "before")


def _blocks(col):
    """Pairs among the four smallest digests of a text's 4-grams: near-equal texts share one with high probability, and a
    pair of digests is shared by few other texts, so that no block grows large."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 3, F.lit(1))), lambda i: F.xxhash64(F.substring(col, i, F.lit(4))))
    low = F.slice(F.array_sort(F.array_distinct(grams)), 1, 4)
    return F.array_distinct(F.flatten(F.transform(low, lambda a: F.transform(low, lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b))))))


def selection_stream(events: DataFrame) -> DataFrame:
    """Members of each collection as a stream: `events` (seq, collection, conversation_id, action) update one small state per
    member; a row comes out whenever a member is added or removed. Late and repeated events change nothing."""
    out = "collection string, conversation_id string, member boolean, since long"

    def step(key, batches, state):
        seq, member, since = state.get if state.exists else (-1, False, -1)
        was = (member, since)
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                if r.seq > seq:
                    seq = int(r.seq)
                    if r.action == "add":
                        since = since if member else seq
                        member = True
                    else:
                        member, since = False, -1
        state.update((seq, member, since))
        if (member, since) != was:
            yield pd.DataFrame({"collection": [key[0]], "conversation_id": [key[1]], "member": [member], "since": [since]})

    return events.groupBy("collection", "conversation_id").applyInPandasWithState(step, out, "seq long, member boolean, since long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day", by: str = "source") -> DataFrame:
    """Events per `by` and tumbling window with a watermark for late rows; works on batches and streams."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def land(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str):
    """Stream of JSON-lines files that land in a folder into a table folder, exactly once per file."""
    return spark.readStream.schema(schema).json(folder).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mask_words(df: DataFrame, words: DataFrame, text: str = "text", limit: int = 1_000_000) -> DataFrame:
    """`df` with every lexicon word in `text` starred out by an automaton: earliest-ending matches, not overlapping, case kept
    apart. The lexicon must stay under `limit` words; it travels with the task."""
    import ahocorasick

    ws = [r[0] for r in words.select("word").where("word <> ''").distinct().limit(limit + 1).collect()]
    if len(ws) > limit:
        raise ValueError(f"the lexicon has more than {limit} words")

    @F.pandas_udf("string")
    def star(s: pd.Series) -> pd.Series:
        auto = ahocorasick.Automaton()
        for w in ws:
            auto.add_word(w, len(w))
        if not ws:
            return s
        auto.make_automaton()

        def one(t):
            if not t:
                return t
            out, free = list(t), 0
            best: dict[int, int] = {}
            for end, n in auto.iter(t):
                best[end] = min(best.get(end, 1 << 30), n)
            for end in sorted(best):
                start = end - best[end] + 1
                if start >= free:
                    out[start : end + 1] = "*" * best[end]
                    free = end + 1
            return "".join(out)

        return s.map(one)

    return df.withColumn(text, star(text))

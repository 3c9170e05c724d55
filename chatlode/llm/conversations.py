"""Rebuilding conversations from message rows.

Rows without an identifier of their own (null or blank conversation_id, or the catch-all id) are threaded first: reply links
join a row with the one before it of its source unless it opens an exchange, quote links join an answer with the nearest
earlier prompt that it quotes, and connected components of the links, found by alternating large-star and small-star
joins, are the threads. Then all rows are ordered and validated in one range-partitioned, sorted scan: a conversation,
however large, is split over as many partitions as its size needs, each partition gives one summary row per conversation
it holds a part of, and the summaries of a conversation are folded in partition order. Links and positions come from the
same kind of scan; what crosses a partition's end is carried by one row a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlode.functions.text import blank, role
from chatlode.llm.scans import arrow_schema, numbered
from chatlode.operators.timestamps import normalize_timestamps
from chatlode.session import checkpointed, table

CATCH_ALL = "gemini-unknown"
SALT = 16
#: Quotations in an answer, whatever stands around them, and the letters that one needs to tell a prompt.
QUOTED = r"[“„«「『\"]([^“”„«»「」『』\"]+)[“”»」』\"]"
QUOTE_LETTERS = 12


def once(messages: DataFrame, *carry: Column) -> DataFrame:
    """Rows of `messages` with repeated rows (equal in every column but id) taken once, under their lowest id.

    Rows are told apart by a 128-bit digest of all columns but id; `carry` are extra expressions of the row to keep.
    """
    rest = [F.col(f"`{c}`") for c in messages.columns if c != "id"]
    row = F.struct(*rest)
    a, b = F.xxhash64(row), F.xxhash64(F.lit(7), row)
    # A null and an absent value hash alike: the set of null columns is part of the key.
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in messages.columns if c != "id"])
    keys = ["conversation_id", "source", "message_index", "role", "timestamp", "timestamp_source"]
    have = messages.select(*keys, a.alias("_a"), b.alias("_b"), nulls.alias("_n"), "id", *carry)
    group = [c for c in have.columns if c != "id"]
    return have.groupBy(*group).agg(F.min("id").alias("id")).drop("_a", "_b", "_n")


def lacking(catch_all: str | None) -> Column:
    """Whether a row has no identifier of its own."""
    none = F.col("conversation_id").isNull() | blank(F.col("conversation_id"))
    return none if catch_all is None else none | (F.col("conversation_id") == catch_all)


def light_rows(messages: DataFrame, sources: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """One row per distinct message without its text: id, conversation_id, source, index, utc_us (where the index or the
    conversation's id is null), who (0 system, 1 user, 2 assistant, 3 other), is_blank, has_files."""
    r = role(F.col("role"))
    files = F.coalesce(F.size("attachments") > 0, F.lit(False)) if "attachments" in messages.columns else F.lit(False)
    rows = once(messages, r.alias("_role"), blank(F.col("text")).alias("is_blank"), files.alias("has_files"))
    rows = rows.withColumn("who", F.when(F.col("_role") == "user", 1).when(F.col("_role") == "assistant", 2).when(F.col("_role") == "system", 0).otherwise(3))
    rows = rows.withColumn("idx", F.col("message_index").cast("long"))
    keep = ("conversation_id", "who", "is_blank", "has_files", "idx")
    # Times give the order only where no index does.
    timed = F.col("idx").isNull() | lacking(None)
    indexed = rows.where(~timed).select("id", *keep, "source", F.lit(None).cast("long").alias("utc_us"))
    late = normalize_timestamps(rows.where(timed).withColumn("_source", F.col("source")), sources, abbrevs, keep=(*keep, "_source"))
    return indexed.unionByName(late.select("id", *keep, F.col("_source").alias("source"), "utc_us"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node, component (its smallest node) of every node of `edges` (u long, v long), by alternating large-star and small-star.

    Each round halves the distances to the smallest node; lineage is cut after each, and rounds go on until nothing changes.
    A graph that isn't done after `max_rounds` raises an error. Self links give a component of one.
    """
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null").distinct()
    alone = e.where("u = v").select("u", "v")
    e = checkpointed(e.where("u < v"))
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct().where("u < v")
        down = large.select(F.col("v").alias("a"), F.col("u").alias("b"))  # every b is a smaller neighbour of a
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u < v").union(low.select(F.col("m").alias("u"), F.col("a").alias("v"))).distinct()
        e = checkpointed(star)
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    found = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return found.union(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).union(alone.select(F.col("u").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


_LINK = "pid int, id long, prev long, g string, kind string, step long"


def _before(batches):
    """Links of the sorted rows of one partition (id, g, seeks, gives, step): each row that seeks to the last one of its group
    that gives. Rows of kind 'open' found none in the partition's first group; one row 'end' tells what the next
    partitions may need: g, the last giver in `prev`, its step, and in `id` whether all the partition is that group."""
    from pyspark import TaskContext

    pid, schema = TaskContext.get().partitionId(), arrow_schema(_LINK)
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    cur, giver, at, one, started = None, None, None, True, False
    for b in batches:
        out = []
        for i, g, seeks, gives, step in zip(*(b.column(c).to_pylist() for c in ("id", "g", "seeks", "gives", "step"))):
            if not started or g != cur:
                one, started, cur, giver, at = not started, True, g, None, None
            if seeks:
                if giver is not None:
                    if near(at, step):
                        out.append((pid, i, giver, g, "link", step))
                elif one:
                    out.append((pid, i, None, g, "open", step))
            if gives:
                giver, at = i, step
        if out:
            yield pack(out)
    if started:
        yield pack([(pid, int(one), giver, cur, "end", at)])


def near(at: int | None, step: int | None) -> bool:
    """Whether a row of index `step` can follow one of index `at`; rows without indexes are told by their order alone."""
    return at is None or step is None or 0 <= step - at <= 1


def preceding(rows: DataFrame, *order: str) -> DataFrame:
    """id, prev: for each of `rows` (id, g, seeks, gives, step and `order`) that seeks, the last row before it that gives in
    its group `g`, in the order of `order`; none where their steps are further apart than one. A group of any size is
    split over partitions; one row a partition reaches the driver."""
    keys = ["g", *order, "id"]
    got = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "g", "seeks", "gives", "step").mapInArrow(_before, _LINK))
    carried, last = [], None  # last: group, giver and step at the end of the partitions so far
    for r in sorted(got.where("kind = 'end'").collect(), key=lambda r: r.pid):
        if last is not None and last[1] is not None:
            carried.append((r.pid, *last))
        last = (r.g, *last[1:]) if r.prev is None and r.id and last is not None and last[0] == r.g else (r.g, r.prev, r.step)
    links = got.where("kind = 'link'").select("id", "prev")
    if not carried:
        return links
    ends = F.broadcast(rows.sparkSession.createDataFrame(carried, "pid int, g string, prev long, at long"))
    ok = F.col("at").isNull() | F.col("step").isNull() | (F.col("step") - F.col("at")).between(0, 1)
    return links.union(got.where("kind = 'open'").drop("prev").join(ends, ["pid", "g"]).where(ok).select("id", "prev"))


def _letters_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def threads(messages: DataFrame, light: DataFrame, catch_all: str | None = CATCH_ALL) -> DataFrame:
    """id, thread of the rows that lack an identifier of their own: connected components over reply and quote links.

    A reply link goes from a row that opens no exchange to the one before it: by index in the catch-all conversation, else by
    time among the rows of the same source; without a time, by an index that no other such row of the source has. A quote link goes to the nearest earlier prompt
    whose letters and digits a quotation holds, QUOTE_LETTERS at least."""
    rows = checkpointed(light.where(lacking(catch_all)).select("id", "who", "idx", "utc_us", blank(F.col("conversation_id")).alias("lost"), F.coalesce("source", F.lit("")).alias("source")))
    rows = rows.withColumn("step", F.when(~F.col("lost"), F.col("idx"))).withColumn("late", F.when(F.col("lost"), F.col("utc_us")).otherwise(F.coalesce("idx", "utc_us")))
    g = F.when(F.col("lost"), F.concat(F.lit("s"), "source")).otherwise(F.lit("c"))
    steps = rows.where("late is not null").select("id", g.alias("g"), (F.col("who") != 1).alias("seeks"), F.lit(True).alias("gives"), "step", "late", (F.col("who") == 2).alias("turn"))
    replies = preceding(steps, "late", "turn")
    sole = rows.where("lost and late is null and idx is not null").groupBy("source", "idx").agg(F.min("id").alias("id"), F.min("who").alias("who"), F.count("*").alias("n")).where("n = 1")
    replies = replies.union(sole.where("who <> 1").join(sole.select("source", (F.col("idx") + 1).alias("idx"), F.col("id").alias("prev")), ["source", "idx"]).select("id", "prev"))
    texts = messages.where(lacking(catch_all)).select("id", "text", role(F.col("role")).alias("r")).where("text is not null")
    said = texts.where("r = 'user'").select("id", _letters_key(F.col("text")).alias("k"), F.lit(True).alias("gives"))
    quoted = texts.where((F.col("r") == "assistant") & F.col("text").rlike(QUOTED)).select("id", F.explode(F.regexp_extract_all("text", F.lit(QUOTED), 1)).alias("q"))
    quoted = quoted.select("id", _letters_key(F.col("q")).alias("k"), F.lit(False).alias("gives"))
    both = said.union(quoted).where(F.length("k") >= QUOTE_LETTERS).select("id", F.hex(F.xxhash64("k")).alias("g"), "gives", (~F.col("gives")).alias("seeks"), F.lit(None).cast("long").alias("step"))
    both = both.join(rows.select("id", "late"), "id").withColumn("late", F.coalesce("late", F.when(F.col("gives"), -(1 << 62)).otherwise(1 << 62)))
    quotes = preceding(both, "late", "seeks")
    edges = replies.union(quotes).select(F.col("id").alias("u"), F.col("prev").alias("v")).union(rows.select(F.col("id").alias("u"), F.col("id").alias("v")))
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("thread"))


PART = "pid int, conversation_id string, seq int, n long, n_idx long, lo long, hi long, twice boolean, blank boolean, first_who int, last_who int, miss boolean, first_idx long, last_idx long"


class Parts:
    """Summaries of the conversation parts among the sorted rows of one partition, batch by batch."""

    names = [c.split()[0] for c in PART.split(", ")]

    def __init__(self, pid: int):
        self.pid, self.seq, self.cur = pid, 0, None

    def add(self, b: pa.RecordBatch) -> list[tuple]:
        """The parts that end before the last one of batch `b` (conversation_id, idx, who, empty)."""
        n, out = b.num_rows, []
        if not n:
            return out
        conv = b.column("conversation_id").dictionary_encode()
        codes = conv.indices.to_numpy(zero_copy_only=False)
        words = conv.dictionary.to_pylist()
        col = b.column("idx")
        idx = col.fill_null(0).to_numpy(zero_copy_only=False)
        has = col.is_valid().to_numpy(zero_copy_only=False)
        who, bl = b.column("who").to_numpy(zero_copy_only=False), b.column("empty").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        for s, t in zip(cuts.tolist(), np.r_[cuts[1:], n].tolist()):
            ix, w = idx[s:t][has[s:t]], who[s:t]
            talk = w[(w == 1) | (w == 2)]
            part = {
                "pid": self.pid, "conversation_id": words[codes[s]], "seq": self.seq, "n": t - s, "n_idx": len(ix),
                "lo": int(ix.min()) if len(ix) else None, "hi": int(ix.max()) if len(ix) else None,
                "twice": bool((ix[1:] == ix[:-1]).any()), "blank": bool(bl[s:t].all()),
                "first_who": int(talk[0]) if len(talk) else None, "last_who": int(talk[-1]) if len(talk) else None,
                "miss": bool(((talk[:-1] == 1) & (talk[1:] == 1)).any()),
                "first_idx": int(ix[0]) if len(ix) else None, "last_idx": int(ix[-1]) if len(ix) else None,
            }
            if self.cur is not None and self.cur["conversation_id"] == part["conversation_id"]:
                self.cur = fold(self.cur, part)
            else:
                out += self.close()
                self.seq += 1
                self.cur = part
        return out

    def close(self) -> list[tuple]:
        cur, self.cur = self.cur, None
        return [] if cur is None else [tuple(cur[k] for k in self.names)]


def _parts(batches):
    """One summary of each conversation part among the sorted rows of one partition."""
    from pyspark import TaskContext

    parts, schema = Parts(TaskContext.get().partitionId()), arrow_schema(PART)
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for b in batches:
        if out := parts.add(b):
            yield flush(out)
    if out := parts.close():
        yield flush(out)


def fold(a: dict, b: dict) -> dict:
    """Summary of two adjacent parts of one conversation, `a` before `b`."""
    known = lambda k: [x for x in (a[k], b[k]) if x is not None]
    return a | {
        "n": a["n"] + b["n"], "n_idx": a["n_idx"] + b["n_idx"], "lo": min(known("lo"), default=None), "hi": max(known("hi"), default=None),
        "twice": a["twice"] or b["twice"] or (a["last_idx"] is not None and a["last_idx"] == b["first_idx"]),
        "blank": a["blank"] and b["blank"],
        "miss": a["miss"] or b["miss"] or (a["last_who"] == 1 and b["first_who"] == 1),
        "first_who": a["first_who"] if a["first_who"] is not None else b["first_who"],
        "last_who": b["last_who"] if b["last_who"] is not None else a["last_who"],
        "first_idx": a["first_idx"] if a["first_idx"] is not None else b["first_idx"],
        "last_idx": b["last_idx"] if b["last_idx"] is not None else a["last_idx"],
    }


#: Order of the rows inside a conversation: the index, else the time, else role and id.
ORDER = ("conversation_id", "idx", "late", "utc_us", "turn", "id")


def ordered(light: DataFrame, unit: str = "conversation_id") -> DataFrame:
    """`light` range-partitioned and sorted by conversation and order of its rows; rows without a time come last."""
    order = (unit, *ORDER[1:])
    rows = light.withColumn("late", F.col("utc_us").isNull()).withColumn("turn", F.element_at(F.array(*map(F.lit, (0, 1, 3, 2))), F.col("who") + 1))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def validate(light: DataFrame) -> DataFrame:
    """conversation_id, defect of each conversation: empty, broken, missing_reply, or null for a whole one.

    empty: every text blank and no attachments. broken: indexes partly null, or not 0, 1, 2, … each once. missing_reply: a
    user row with no assistant row before the next user row or the end. The first that holds counts.
    """
    return verdicts(ordered(light.withColumn("empty", F.col("is_blank") & ~F.col("has_files"))).select("conversation_id", "idx", "who", "empty").mapInArrow(_parts, PART))


def verdicts(parts: DataFrame) -> DataFrame:
    """conversation_id, defect of each conversation from the summaries of its parts."""
    # Parts of a conversation: one per partition it reaches into, at most the number of partitions.
    runs = parts.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("pid", "seq", "n", "n_idx", "lo", "hi", "twice", "blank", "first_who", "last_who", "miss", "first_idx", "last_idx"))).alias("p"))
    p = F.col("p")
    total = lambda k: F.aggregate(p[k], F.lit(0).cast("long"), lambda s, x: s + x)
    later = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), later, lambda a, b: a["last_idx"] == b["first_idx"])
    talk = F.filter(p, lambda x: x["first_who"].isNotNull())
    meet = F.zip_with(F.slice(talk, 1, F.greatest(F.size(talk) - 1, F.lit(0))), F.slice(talk, 2, F.greatest(F.size(talk) - 1, F.lit(0))), lambda a, b: (a["last_who"] == 1) & (b["first_who"] == 1))
    yes = lambda arr: F.exists(arr, lambda x: F.coalesce(x, F.lit(False)))
    n, n_idx = total("n"), total("n_idx")
    lo, hi = F.array_min(p["lo"]), F.array_max(p["hi"])
    empty = ~yes(F.transform(p, lambda x: ~x["blank"]))
    broken = ((n_idx > 0) & (n_idx < n)) | ((n_idx == n) & ((lo != 0) | (hi != n - 1) | yes(p["twice"]) | yes(pairs)))
    missing = yes(p["miss"]) | yes(meet) | F.coalesce(F.try_element_at(talk["last_who"], F.lit(-1)) == 1, F.lit(False))
    return runs.select("conversation_id", F.when(empty, "empty").when(broken, "broken").when(missing, "missing_reply").alias("defect"))


def rebuild(messages: DataFrame, sources: DataFrame, abbrevs: DataFrame, catch_all: str | None = CATCH_ALL) -> DataFrame:
    """Light rows of `messages` with `thread`: the component of rows that lack an identifier, else null; without `catch_all`
    the catch-all conversation counts as one with an identifier.

    A row with a null or blank conversation_id gets 'thread:<id>' as its conversation_id, and its index, which counts in a
    conversation that isn't known, is dropped. Null or unknown roles count as other roles, null texts as blank. An empty
    table gives an empty result; extra columns only make rows distinct.
    """
    light = checkpointed(light_rows(messages, sources, abbrevs))
    if light.where(lacking(catch_all)).isEmpty():
        return light.withColumn("thread", F.lit(None).cast("long"))
    found = threads(messages, light, catch_all)
    rest = light.where(~lacking(catch_all)).withColumn("thread", F.lit(None).cast("long"))
    rows = light.where(lacking(catch_all)).join(found, "id", "left")
    lost = blank(F.col("conversation_id"))
    rows = rows.withColumn("idx", F.when(~lost, F.col("idx"))).withColumn("conversation_id", F.when(lost, F.concat(F.lit("thread:"), F.col("thread").cast("string"))).otherwise(F.col("conversation_id")))
    return rest.unionByName(rows)


def _tables(spark, sf_dir: str):
    return [table(spark, sf_dir, t) for t in ("messages", "export_sources", "zone_abbrevs")]


def p6_found(spark, sf_dir: str) -> DataFrame:
    """conversation_id, defect of the conversations to drop; the catch-all is judged by the indexes of its own."""
    return validate(rebuild(*_tables(spark, sf_dir), catch_all=None)).where("defect is not null")


def p6_conversations(spark, sf_dir: str) -> DataFrame:
    """Rows of the whole conversations in order: conversation_id, thread, position, id, role. The threads of the catch-all are
    conversations of their own: judged one by one, never as broken, and numbered inside."""
    rows = rebuild(*_tables(spark, sf_dir))
    inside = F.col("thread").isNotNull() & ~F.col("conversation_id").startswith("thread:")
    rows = rows.withColumn("unit", F.when(inside, F.concat("conversation_id", F.lit("#"), F.col("thread").cast("string"))).otherwise(F.col("conversation_id")))
    rows = checkpointed(rows.withColumn("utc_us", F.when(inside, F.coalesce("idx", "utc_us")).otherwise(F.col("utc_us"))).withColumn("idx", F.when(~inside, F.col("idx"))))
    bad = validate(rows.drop("conversation_id").withColumnRenamed("unit", "conversation_id")).where("defect is not null").select(F.col("conversation_id").alias("unit"))
    # One conversation may hold a third of all rows: the join is spread over SALT copies of the ids.
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(bad, ["unit", "salt"], "left_anti").drop("salt")
    named = F.element_at(F.array(*map(F.lit, ("system", "user", "assistant", "other"))), F.col("who") + 1)
    return numbered(ordered(rows, "unit"), "unit", ["id", "conversation_id", "thread", "who"]).select("conversation_id", "thread", "position", "id", named.alias("role"))

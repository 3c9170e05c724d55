"""Duplicates hidden by formatting: range partition, external sort, scan of adjacent runs.

Every record gets a canonical key (one case, one width, no whitespace, punctuation or invisible characters, fields of a
JSON object or of `field: value` lines in sorted order). Records are range-partitioned and sorted by (digest, kind, key,
record); the scan compares full keys of neighbours, so equal digests alone never join records. The record is part of the
sort order, hence a run of copies, however long, is split over as many partitions as its size needs. A run that
continues over a partition's end is mended with the first records of the partitions' outer runs: two rows a partition.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlode.functions.text import bound, letters_key, role, with_one_width
from chatlode.session import checkpointed, small, table


def with_record_key(df: DataFrame, text: Column) -> DataFrame:
    """`df` with `key`, the canonical key of `text`; the fields of a JSON object or of `field: value` lines are sorted."""
    df = with_one_width(df, "_wide", text)
    df = bound(df, "_wide", F.regexp_replace("_wide", r"^[\s\p{Cf}]+", ""))
    wide = F.col("_wide")
    df = df.withColumn("_entries", F.map_entries(F.when(wide.startswith("{"), F.try_variant_get(F.try_parse_json(F.regexp_replace(wide, r"[\s\p{Cf}]+$", "")), "$", "map<string,string>"))))
    listed = wide.rlike(r"^[^:\r\n]{1,60}:[^\r\n]*[\r\n]")
    df = bound(df, "_lines", F.when(listed, F.filter(F.split(wide, r"\r\n|\n|\r"), lambda x: x.rlike(r"[^\s\p{Cf}]"))))
    fields = F.when(F.col("_entries").isNotNull(), F.transform("_entries", lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("null")))))
    fields = fields.when(F.col("_lines").isNotNull() & ~F.exists("_lines", lambda x: ~x.rlike(r"^[^:]{1,60}:")), F.col("_lines"))
    df = bound(df, "_fields", fields)
    key = F.when(F.col("_fields").isNotNull(), F.array_join(F.array_sort(F.transform("_fields", letters_key)), "")).otherwise(letters_key(wide))
    return bound(df, "key", key).drop("_wide", "_entries", "_lines", "_fields")


_OUT = "pid int, first_id string, copy_id string, first_long long, copy_long long, kind string, key string, digest long, head boolean, edge boolean"


def _scan(batches, every=False):
    """Runs of equal (digest, kind, key) among the sorted rows of one partition.

    Gives a row for every record but the first of its run, and for the first records of the partition's first and last
    runs (`edge`); with `every` also for the first of each run. Rows of the first run are marked `head`: it may have begun in an earlier partition.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    last = None  # digest, kind, key, first record, whether the run is the partition's first, whether its edge row is out
    schema = pa.schema([("pid", pa.int32()), ("first_id", pa.string()), ("copy_id", pa.string()), ("first_long", pa.int64()), ("copy_long", pa.int64()), ("kind", pa.string()), ("key", pa.string()), ("digest", pa.int64()), ("head", pa.bool_()), ("edge", pa.bool_())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        dig, kind, key, rid, rlong = (b.column(c) for c in ("digest", "kind", "key", "rec", "rec_long"))
        d = dig.to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        same = np.flatnonzero(d[1:] == d[:-1]) + 1
        if len(same):
            eq = pc.and_(pc.equal(key.take(pa.array(same)), key.take(pa.array(same - 1))), pc.equal(kind.take(pa.array(same)), kind.take(pa.array(same - 1))))
            new[same[eq.to_numpy(zero_copy_only=False)]] = False
        goes_on = last is not None and last[0] == d[0] and last[1] == kind[0].as_py() and last[2] == key[0].as_py()
        new[0] = not goes_on
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: the run that goes on
        head_runs = np.zeros(len(starts) + 1, bool)
        head_runs[0] = goes_on and last[5]
        edge_first = last is None
        if edge_first:
            head_runs[1] = True
        firsts = np.concatenate([[-1], starts])[run + 1]
        emit = np.ones(n, bool) if every else ~new
        if edge_first:
            emit[0] = True
        idx = np.flatnonzero(emit)
        if len(idx):
            f = firsts[idx]
            at = pa.array(np.maximum(f, 0))
            fid, flong = rid.take(at), rlong.take(at)
            if goes_on:
                mask = pa.array(f < 0)
                fid, flong = pc.if_else(mask, pa.scalar(last[3], pa.string()), fid), pc.if_else(mask, pa.scalar(last[4], pa.int64()), flong)
            take = pa.array(idx)
            head = head_runs[run[idx] + 1]
            keep = pa.array(head)
            keys = pc.if_else(keep, key.take(take), pa.scalar(None, pa.string()))
            edge = np.zeros(len(idx), bool)
            if edge_first:
                edge[idx == 0] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), pid, np.int32)), fid, rid.take(take), flong, rlong.take(take), kind.take(take), keys, dig.take(take), pa.array(head), pa.array(edge)], schema=schema)
        if len(starts):
            s = int(starts[-1])
            last = (int(d[s]), kind[s].as_py(), key[s].as_py(), rid[s].as_py(), rlong[s].as_py(), bool(edge_first and len(starts) == 1))
    if last is not None and not last[5]:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "first_id": last[3], "copy_id": last[3], "first_long": last[4], "copy_long": last[4], "kind": last[1], "key": last[2], "digest": last[0], "head": False, "edge": True}], schema=schema)


def collapse(records: DataFrame, every: bool = False) -> DataFrame:
    """kind, first record and copy record of every copy in `records` (kind string, key string, rec string, rec_long long).

    Records with equal (kind, key) are one group; its first record is the smallest by (rec_long, rec), rec_long being
    null for all or none of a kind. Rows with a null key are no records. Repeated (kind, key, rec) rows count as copies
    of each other. An empty table gives an empty result. With `every` the first records are given too, as their own copies.
    """
    keyed = records.where(F.col("key").isNotNull()).select(F.xxhash64("kind", "key").alias("digest"), "kind", "key", "rec", "rec_long")
    order = ["digest", "kind", "key", "rec_long", "rec"]
    keyed = checkpointed(keyed)  # the range partition looks at its input twice: for its bounds and for the rows
    runs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_scan, every=every), _OUT)
    runs = checkpointed(runs)  # copies and two rows a partition; the shuffle behind it runs once
    edges = runs.where("edge").groupBy("digest", "kind", "key").agg(F.min(F.struct("first_long", "first_id")).alias("true"), F.count("*").alias("parts")).where("parts > 1").select(F.col("digest").alias("e_digest"), F.col("kind").alias("e_kind"), F.col("key").alias("e_key"), "true")
    edges = small(edges)
    inner = runs.where("not head and not edge").select("kind", F.col("first_id").alias("first_rec"), F.col("copy_id").alias("copy_rec"))
    head = runs.where("head").join(edges, (F.col("digest") == F.col("e_digest")) & F.col("kind").eqNullSafe(F.col("e_kind")) & (F.col("key") == F.col("e_key")), "left")
    head = head.withColumn("first_rec", F.coalesce("true.first_id", "first_id")).where(F.lit(every) | (F.col("first_rec") != F.col("copy_id"))).select("kind", "first_rec", F.col("copy_id").alias("copy_rec"))
    return inner.union(head)


def message_records(messages: DataFrame, least: int = 60) -> DataFrame:
    """Records of messages: kind 'message <role>', canonical key of texts with at least `least` letters or digits."""
    rows = messages.select(F.concat(F.lit("message "), F.coalesce(role(F.col("role")), F.lit(""))).alias("kind"), F.col("id").cast("string").alias("rec"), F.col("id").alias("rec_long"), "text")
    rows = with_record_key(rows.where(F.length("text") >= least), F.col("text"))
    return rows.where(F.length(F.regexp_replace("key", r"[^\p{L}\p{N}]+", "")) >= least).select("kind", "key", "rec", "rec_long")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Records of conversations: distinct ids with their canonical key; ids without letters or digits are none."""
    ids = conversations.select(F.col("conversation_id").alias("rec")).where(F.col("rec").isNotNull()).distinct()
    rows = with_one_width(ids, "wide", F.col("rec"))
    rows = bound(rows, "key", letters_key(F.col("wide"))).where(F.length("key") > 0)
    return rows.select(F.lit("conversation").alias("kind"), "key", "rec", F.lit(None).cast("long").alias("rec_long"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """record_kind, first_key, copy_key of each copy beyond the first in messages and conversations."""
    records = message_records(table(spark, sf_dir, "messages")).unionByName(conversation_records(table(spark, sf_dir, "conversations")))
    return collapse(records).select(F.element_at(F.split("kind", " "), 1).alias("record_kind"), F.col("first_rec").alias("first_key"), F.col("copy_rec").alias("copy_key"))


def every_record(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Records of all messages and all conversation rows, repeated ones too. Texts without anything that a key keeps are alone,
    ids without are told apart as they are."""
    m = messages.select(F.concat(F.lit("message "), F.coalesce(role(F.col("role")), F.lit(""))).alias("kind"), F.col("id").cast("string").alias("rec"), F.col("id").alias("rec_long"), "text")
    m = with_record_key(m, F.col("text")).select("kind", F.when(F.length("key") > 0, F.col("key")).otherwise(F.concat(F.lit("\u0000"), "rec")).alias("key"), "rec", "rec_long")
    c = with_one_width(conversations.select(F.col("conversation_id").alias("rec")), "wide", F.col("rec"))
    c = bound(c, "key", letters_key(F.col("wide")))
    c = c.select(F.lit("conversation").alias("kind"), F.when(F.length("key") > 0, F.col("key")).otherwise(F.concat(F.lit("\u0000"), F.coalesce("rec", F.lit("\u0000")))).alias("key"), "rec", F.lit(None).cast("long").alias("rec_long"))
    return m.unionByName(c)


def p5_counts(spark, sf_dir: str) -> DataFrame:
    """The collapsed messages and conversations: the first record of each group, alone or not, and the exact number of its
    copies, itself included. Every row of the two tables counts once."""
    all_ = collapse(every_record(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations")), every=True)
    return all_.groupBy(F.element_at(F.split("kind", " "), 1).alias("record_kind"), F.col("first_rec").alias("first_key")).agg(F.count("*").alias("copies"))

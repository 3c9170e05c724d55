"""Operators of the core against brute-force versions, fixtures and DuckDB."""

import datetime as dt
import glob
import json
import math
import os
import zipfile
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatlode.functions.text import INVISIBLE, blank, letters_key, role, with_one_width
from chatlode.operators import search as search_ops
from chatlode.operators.relations import as_of
from chatlode.operators import timestamps
from chatlode.operators.timestamps import normalize_timestamps
from chatlode.plans import archive
from chatlode.sources import exports, sinks
from chatlode.streaming import incremental


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(archive.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = archive.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(archive.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.fixture(scope="module")
def long_conversation(tmp_path_factory):
    """A folder with 2,600 messages in one conversation, answers alone from index 900 on; 30 rows without an index; rows without a conversation."""
    at = tmp_path_factory.mktemp("long")
    rows = [(i + 1, "long", "utc", i, "user" if i < 900 and i % 2 == 0 else "assistant", f"01/02/2024 00:{i // 60:02}:{i % 60:02} UTC" if i < 900 and i % 2 == 0 else None, "native", "x" * (i % 3)) for i in range(2600)]
    rows += [(3000 + i, "long" if i % 2 else "bare", "utc", None, "assistant", None, "native", "no index") for i in range(30)] + [(4000 + i, None, "utc", i, "user", None, None, "alone") for i in range(1200)]
    c = duckdb.connect()
    c.execute("create table m (id bigint, conversation_id varchar, source varchar, message_index int, role varchar, timestamp varchar, timestamp_source varchar, text varchar)")
    c.executemany("insert into m values (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    c.execute("create table s as select 'utc' as source, 'native' as timestamp_source, 'UTC' as home_zone, 'dmy' as date_order")
    c.execute("create table z as select 'UTC' as abbrev, 0 as offset_minutes")
    for t, name in (("m", "messages"), ("s", "export_sources"), ("z", "zone_abbrevs")):
        c.execute(f"copy {t} to '{at}/{name}.parquet' (format parquet)")
        c.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    return str(at), c


@pytest.mark.parametrize("name", ["w9_digest_sample", "w10_char_budget", "j9_inferred_times", "f17_cut_view"])
def test_long_conversations_equal_sql(spark, long_conversation, name):
    d, c = long_conversation
    df = archive.queries()[name](spark, d)
    cols = sorted(df.columns)
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)
    cur = c.execute(archive.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert got == sorted((tuple(r[names.index(x)] for x in cols) for r in cur.fetchall()), key=repr)
    if name == "j9_inferred_times":
        assert dict((i, at) for at, i in got)[2600] == "2024-02-01 00:14:58"  # from 1,700 indexes before


def test_statistics_follow_the_files(spark, sf, tmp_path):
    """What is kept for a session is made anew when the table has other files."""
    for t in ("messages", "export_sources", "zone_abbrevs"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    count = lambda: archive.queries()["a1_totals"](spark, str(tmp_path)).first().messages
    n = count()
    spark.read.parquet(f"{sf}/messages.parquet").limit(7).write.mode("append").parquet(f"{tmp_path}/messages.parquet")
    assert count() == n + 7


@pytest.mark.parametrize("name", sorted(set(archive.queries()) - set(archive.oracle_sql())))
def test_queries_without_sql_run(spark, sf, name):
    assert archive.queries()[name](spark, sf).count() > 0


def test_mixture_is_the_same_at_every_size():
    """The declared order weighs in proportion; a source without one is read by its evidence."""
    import pandas as pd

    def weights(n, declared):
        got = timestamps._mixture(pd.DataFrame({"source": "s", "timestamp_source": "t", "declared": [declared] * 2, "readings": ["dmy:1.0", "dmy:1.0|mdy:1.0"], "n": [n, n]}), 10.0, 25)
        return json.loads(got.weights[0])

    for n in (10_000, 3_000_000):
        w = weights(n, "mdy")
        assert abs(w["mdy"] / (w["mdy"] + w["dmy"]) - 20 / 21) < 1e-3
        w = weights(n, None)
        assert w["dmy"] / (w["mdy"] + w["dmy"]) > 0.99


def test_unresolved_times_are_marked(spark):
    rows = [("free", "03/04/2024 10:00:00 UTC"), ("free", "2024-01-01 10:00:00"), ("free", "1749299911726"), ("free", "1749299911"), ("free", "999")]
    got = {r["id"]: r for r in _stamp(spark, rows).collect()}
    assert [got[i]["ambiguous"] for i in range(5)] == [True, True, False, False, False]
    assert [got[i]["format"] for i in (2, 3)] == ["milliseconds", "seconds"] and got[4]["utc_us"] is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# --- timestamps --------------------------------------------------------------------------------------------------------
SOURCES = [("us", "native", "America/New_York", "mdy"), ("eu", "native", "Europe/Berlin", "dmy"), ("cn", "native", "Asia/Shanghai", "ymd"), ("utc", "native", "UTC", "mdy")]
CASES = [
    ("us", "2024-03-10 02:30:00", None),  # the clocks skip it
    ("us", "2024-11-03 01:30:00", "2024-11-03T05:30:00"),  # twice: the first occurrence
    ("eu", "2024-03-31 02:18:43", None),
    ("eu", "03/04/2024 10:00:00", "2024-04-03T08:00:00"),
    ("us", "03/04/2024 10:00:00", "2024-03-04T15:00:00"),
    ("eu", "29.08.2023 09:09:42", "2023-08-29T07:09:42"),
    ("eu", "5. März 2024, 04:41:31 Uhr", "2024-03-05T03:41:31"),
    ("cn", "2024年4月1日 下午12:45:40", "2024-04-01T04:45:40"),
    ("cn", "2024年4月1日 12:45:40 EDT", "2024-04-01T16:45:40"),
    ("cn", "2023/05/12, 10:53:25 pm", "2023-05-12T14:53:25"),
    ("us", "Apr 8, 2024, 7:54:06 AM CST", "2024-04-07T23:54:06"),
    ("us", "Thu May 30 20:53:22 2024", "2024-05-31T00:53:22"),
    ("utc", "Wed, 14 Jan 2026 15:18:36 +0800", "2026-01-14T07:18:36"),
    ("utc", "2024-09-06t13:10:55z", "2024-09-06T13:10:55"),
    ("utc", "20260114T072507Z", "2026-01-14T07:25:07"),
    ("utc", "2023-03-16 07:06:15-0330", "2023-03-16T10:36:15"),
    ("utc", "2023-09-01T01:46:59+10", "2023-08-31T15:46:59"),
    ("cn", "2026-03-19 23:35:13,544", "2026-03-19T15:35:13.544"),
    ("us", "2025-11-17 00:33:39 America/New_York", "2025-11-17T05:33:39"),
    ("us", "2024-03-31T21:37:42[Asia/Shanghai]", "2024-03-31T13:37:42"),
    ("utc", "1749299911726", "2025-06-07T12:38:31.726"),
    ("utc", "1678694466026101", "2023-03-13T08:01:06.026101"),
    ("utc", "1.744139445062E9", "2025-04-08T19:10:45.062"),
    ("utc", "  2024-01-09 15:34:10 UTC ", "2024-01-09T15:34:10"),
    ("utc", "2024-02-30 10:00:00", None), ("utc", "2024-13-01T00:55:00Z", None), ("utc", "25:61", None), ("utc", "NaN", None), ("utc", "", None), ("utc", None, None),
    ("utc", "0000-00-00 00:00:00", None), ("utc", "2024-01-01 00:00:60", None), ("utc", "yesterday", None), ("nowhere", "2024-01-01 00:00", None), ("utc", "x" * 20_000, None),
]


def _stamp(spark, rows):
    m = spark.createDataFrame([(i, s, "native", t, "extra") for i, (s, t) in enumerate(rows)], "id long, source string, timestamp_source string, timestamp string, home_zone string")
    s = spark.createDataFrame(SOURCES, "source string, timestamp_source string, home_zone string, date_order string")
    a = spark.createDataFrame([("CST", 480), ("EDT", -240), ("UTC", 0)], "abbrev string, offset_minutes int")
    return normalize_timestamps(m, s, a)


def test_timestamps(spark):
    got = {r["id"]: r for r in _stamp(spark, [c[:2] for c in CASES]).collect()}
    assert len(got) == len(CASES)
    for i, (_, text, want) in enumerate(CASES):
        us = None if want is None else round((dt.datetime.fromisoformat(want) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        assert got[i]["utc_us"] == us, text


def test_timestamps_empty_and_undeclared_order(spark):
    assert _stamp(spark, [("utc", "x")]).where("id < 0").count() == 0
    rows = [("free", f"{d}/12/2023 10:00:00 UTC") for d in range(13, 29)] + [("free", "03/04/2024 10:00:00 UTC")]
    last = {r["id"]: r for r in _stamp(spark, rows).collect()}[len(rows) - 1]
    assert last["utc_us"] == 1712138400000000 and last["posterior"] > 0.75  # the source's other values show day first


# --- text --------------------------------------------------------------------------------------------------------------
def test_text_functions(spark):
    df = spark.createDataFrame([(" Model ", "Ａｂ－ｃ １２!", ""), ("ME", "ab c12", "​ 　"), (None, "ｶﾞｯﾂ", None), ("x", "Straße", "a")], "r string, t string, b string")
    assert [r[0] for r in df.select(role(F.col("r"))).collect()] == ["assistant", "user", None, "x"]
    assert [r[0] for r in with_one_width(df, "w", F.col("t")).select(letters_key(F.col("w"))).collect()] == ["abc12", "abc12", "ガッツ", "strasse"]
    assert [r[0] for r in df.select(blank(F.col("b"))).collect()] == [True, True, True, False]
    assert INVISIBLE.startswith("[")


def test_parse_terms():
    assert search_ops.parse_terms('"a b" title:foo -bar baz* AND Baz OR "a b"') == ["a b", "foo", "bar", "baz"]


def test_mask_equal_length(spark):
    t = "mail a.b@c.org, 13812345678, 010-12345678, 10.0.0.1, 1234567890123456, AKIA1234567890ABCD."
    out = search_ops.mask_equal_length(spark.createDataFrame([(t,), (None,), ("",)], "text string"), "text").collect()
    assert len(out[0][0]) == len(t) and "@" not in out[0][0] and "138" not in out[0][0] and "10.0" not in out[0][0]
    assert out[1][0] is None and out[2][0] == ""


def test_as_of_equals_brute_force(spark):
    left = [("a", 5), ("a", 1), ("b", 7), (None, 3)]
    right = [("a", 2, "x"), ("a", 5, "y"), ("b", 9, "z")]
    got = as_of(spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, t int, v string"), ["k"], "t", "v", "w")
    want = {(k, t, max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(0, None))[1]) for k, t in left}
    assert {tuple(r) for r in got.select("k", "t", "w").collect()} == want


# --- sources and sinks -------------------------------------------------------------------------------------------------
TREE = [{"id": "c1", "title": "T", "mapping": {
    "r": {"parent": None, "message": None},
    "a": {"parent": "r", "message": {"author": {"role": "user"}, "create_time": 10.0, "content": {"parts": ["hi", {"asset_pointer": "file://1"}]}}},
    "b": {"parent": "a", "message": {"author": {"role": "tool"}, "recipient": "python", "create_time": 11.0, "content": {"parts": ["secret"]}}},
    "c": {"parent": "a", "message": {"author": {"role": "assistant"}, "create_time": None, "content": {"parts": ["late"]}, "metadata": {"model_slug": "m"}}},
    "d": {"parent": "a", "message": {"author": {"role": "assistant"}, "create_time": 12.0, "content": {"text": "answer"}}},
    "e": {"parent": "d", "message": {"author": {"role": "user"}, "create_time": 13.0, "content": {"parts": [""]}}},
    "z": {"parent": "nowhere-but-z2", "message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"parts": ["root too"]}}},
}}]


def _write(path, obj):
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_tree_export(spark, tmp_path):
    for wrap in (TREE, {"conversations": TREE}):
        rows = exports.read_tree_export(spark, _write(tmp_path / "conversations.json", wrap)).orderBy("message_index").collect()
        assert [(r.message_index, r.role, r.text) for r in rows] == [(0, "user", "root too"), (1, "user", "hi"), (2, "assistant", "answer"), (3, "assistant", "late")]
        assert rows[1].attachments == ["file://1"] and rows[1].timestamp == "1970-01-01T00:00:10+00:00" and rows[3].timestamp_source == "none"


def test_fragment_export(spark, tmp_path):
    c = [{"id": "d1", "title": None, "mapping": {"a": {"parent": None, "message": {"inserted_at": "2024-01-01T00:00:00Z", "fragments": [{"type": "REQUEST", "content": "q"}, {"type": "FILE", "files": [{"file_name": "f.txt"}, "g"]}]}},
         "b": {"parent": "a", "message": {"model": "x", "inserted_at": "2024-01-01T00:00:01Z", "fragments": [{"type": "THINK", "content": "t"}, {"type": "SEARCH", "results": [1, 2, 3]}, {"type": "TOOL_OPEN"}, {"type": "RESPONSE", "content": "r"}]}}}}]
    a, b = exports.read_fragment_export(spark, _write(tmp_path / "f.json", c)).orderBy("message_index").collect()
    assert (a.role, a.text, a.attachments) == ("user", "q", ["f.txt", "g"])
    assert (b.role, b.text, b.thinking, b.attachments, b.model) == ("assistant", "r", "t", ["search:3", "tool_open"], "x")


def test_ndjson_ids_and_numbers(spark, tmp_path):
    """Turns of a line without an id stay together; lines of one id are numbered on."""
    lines = [{"turns": [{"role": "user", "text": "a"}, {"role": "model", "text": "b"}]}, {"id": "k", "turns": ["x", "y"]}, {"id": "k", "turns": ["z"]}]
    rows = exports.read_ndjson_export(spark, _write(tmp_path / "g.ndjson", "\n".join(map(json.dumps, lines)))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.conversation_id, []).append((r.message_index, r.text))
    assert sorted(by.pop("k")) == [(0, "x"), (1, "y"), (2, "z")]
    assert [sorted(v) for v in by.values()] == [[(0, "a"), (1, "b")]]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_array_elements(size):
    items = [{"a": 'x"],[{', "b": [1, {"c": "\\"}]}, 5, "te,xt", [], {"conversations": [9]}]
    for text in (json.dumps(items), json.dumps({"name": "items", "data": items, "z": [1]}, indent=1)):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert [json.loads(x) for x in exports.array_elements(pieces)] == items
        with pytest.raises(ValueError):
            list(exports.array_elements([text[: len(text) // 2]]))
    assert list(exports.array_elements(["[ ]"])) == []


def test_timeline_and_base(spark, tmp_path):
    item = {"header": "Gemini Apps", "title": "Prompted what is it?", "time": "2024-01-02T03:04:05Z", "safeHtmlItem": [{"html": "<p>x</p>"}]}
    rows = exports.read_activity_json(spark, _write(tmp_path / "My Activity.json", json.dumps([item, item | {"time": None}])))
    assert [(r.prompt, r.at) for r in exports.timeline(rows).collect()] == [("what is it?", "2024-01-02T03:04:05+00:00")]
    sinks.write_jsonl(rows, str(tmp_path / "base"))
    assert sorted(map(str, exports.read_base(spark, str(tmp_path / "base")).collect())) == sorted(map(str, rows.collect()))


def test_dispatch_by_kind(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    tree = [{"id": "t", "mapping": {"r": {"message": {"author": {"role": "user"}, "create_time": 1, "content": {"parts": ["hi"]}}}}}]
    _write(tmp_path / "in" / "conversations.json", "\ufeff" + json.dumps(tree))
    _write(tmp_path / "in" / "sub" / "g.ndjson", json.dumps({"id": "n", "turns": ["yo"]}))
    _write(tmp_path / "in" / "notes.txt", "nothing")
    assert sorted((r.conversation_id, r.text) for r in exports.read_exports(spark, str(tmp_path / "in")).collect()) == [("n", "yo"), ("t", "hi")]


def test_ndjson_export(spark, tmp_path):
    lines = [{"chat_id": "n1", "turns": [{"author": "Human", "body": "first line\nmore", "time": 5}, {"sender": "bot", "markdown": "yes"}]}, {"title": "t", "messages": {"10": {"role": "me", "text": "b"}, "2": {"role": "ai", "text": "a"}}}]
    rows = exports.read_ndjson_export(spark, _write(tmp_path / "g.ndjson", "\n".join(map(json.dumps, lines)) + "\nno json\n")).collect()
    assert [(r.role, r.text) for r in sorted((r for r in rows if r.title == "t"), key=lambda r: r.message_index)] == [("assistant", "a"), ("user", "b")]
    assert {r.title for r in rows if r.conversation_id == "n1"} == {"first line"} and len(rows) == 4


def test_activity(spark, tmp_path):
    cell = '<div class="outer-cell x"><div class="content-cell a">Prompted what &amp; why<br>2024年1月2日 03:04:05 CST<br><p>one<br>two</p><ul><li>x</li></ul><img src="i.png"></div><a href="https://g/app/0123456789ab">l</a></div>'
    rows = exports.read_activity_html(spark, _write(tmp_path / "MyActivity.html", "<html>" + cell + cell.replace("Prompted", "Used").replace("what", "no"))).orderBy("message_index").collect()
    assert [(r.conversation_id, r.role, r.text, r.timestamp) for r in rows] == [("gemini-0123456789ab", "user", "what & why", "2024-01-01T19:04:05+00:00"), ("gemini-0123456789ab", "assistant", "one\ntwo\n- x", "2024-01-01T19:04:05+00:00")]
    assert rows[1].attachments == ["i.png"]
    items = [{"header": "Gemini Apps", "title": "Prompted hello", "time": "2024-01-01T00:00:00Z", "safeHtmlItem": [{"html": "<b>hi</b>"}]}, {"header": "Maps", "title": "Prompted x"}]
    rows = exports.read_activity_json(spark, _write(tmp_path / "a.json", {"items": items})).collect()
    assert sorted((r.role, r.text) for r in rows) == [("assistant", "hi"), ("user", "hello")]


def test_discovery_archives_lexicon(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    _write(raw / "conversations.json", TREE)
    _write(raw / "d.json", '[{"fragments": 1}]')
    _write(raw / "My Activity.html", "x")
    _write(raw / "AI-Mode.json", '"author"')
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in exports.discover(spark, str(raw)).collect()}
    assert [kinds[k] for k in ("conversations.json", "d.json", "AI-Mode.json")] == ["tree", "fragment", "skip"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/conversations.json", json.dumps(TREE))
        z.writestr("readme.txt", "no")
    assert [r.member for r in exports.archive_members(spark, str(tmp_path / "z.zip")).collect()] == ["x/conversations.json"]
    words = exports.read_lexicon(spark, _write(tmp_path / "w.txt", "# c\nab\nabcd\t3\n坏话\n坏话\n// x\n坏"))
    assert {r.word for r in words.collect()} == {"abcd", "坏话"}


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("c", 1, 2, "assistant", None, "<b>", None, "native", "s"), ("c", 0, 1, "user", "2024", "hi", None, "native", "s"), (None, 0, 3, "user", None, "x", None, None, "s")], "conversation_id string, message_index int, id long, role string, timestamp string, text string, thinking string, timestamp_source string, source string")
    m = m.withColumn("timestamp", F.when(F.col("id") == 1, "2024-01-01T20:00:00+00:00"))
    doc = sinks.conversation_documents(m, spark.createDataFrame([("c", 'A "B"')], "conversation_id string, title string"), demote=True).collect()
    assert doc[0].markdown == '---\ntitle: "A \\"B\\""\nid: c\nsource: s\nmessages: 2\n---\n\n## [0] user — 2024-01-02 04:00 (native)\n\nhi\n\n## [1] assistant\n\n<b>'
    assert doc[0].name == "2024-01-02_a-b_c.md" and sinks.with_contents(spark.createDataFrame(doc)).first().markdown.startswith(f"- [[{doc[0].name}]]\n\n# {doc[0].name}\n\n---")
    for form, head in (("md", "---"), ("html", "<!doctype"), ("jsonl", "{")):
        sinks.export(m, spark.createDataFrame([("c",)], "conversation_id string"), form, str(tmp_path / form))
        assert spark.read.text(str(tmp_path / form), wholetext=True).where(F.length("value") > 0).first().value.startswith(head)
    sinks.append_selection(spark, str(tmp_path / "log"), [(1, None, "c", "add", "x", None)])
    sinks.append_selection(spark, str(tmp_path / "log"), [(2, None, "c", "remove", "x", None)])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    docs = spark.createDataFrame(doc)
    assert "&lt;b&gt;" in sinks.html_page(docs).first().html
    assert sinks.changed_only(docs, docs).count() == 0 and sinks.changed_only(docs, docs.where("false")).count() == 1
    assert [x["id"] for x in json.loads(sinks.conversation_json(m).first().value)["messages"]] == [1, 2]
    sinks.write_jsonl(m, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 3
    row = sinks.manifest(m, spark.createDataFrame([("p", "s")], "path string, sha256 string")).first()
    assert row["inputs"] == {"p": "s"} and row["source"] == {"s": 3} and row["dated"] == 0.3333 and row["unmatched"] == [2, 3]


# --- incremental and streaming -----------------------------------------------------------------------------------------
MS = "source string, conversation_id string, message_index int, role string, timestamp string, text string, thinking string, attachments array<string>, prompt_only boolean"


def _msgs(spark, *rows):
    return spark.createDataFrame([(s, c, i, "user", None, t, None, None, p) for s, c, i, t, p in rows], MS)


def test_merge(spark):
    base = _msgs(spark, ("a", "same", 0, "x", False), ("a", "diff", 0, "x", False), ("gemini", "few", 0, "x", False), ("gemini", "few", 1, "y", False), ("a", "po", 0, "x", False)).drop("prompt_only")
    new = _msgs(spark, ("a", "same", 0, "x", False), ("a", "diff", 0, "z", False), ("gemini", "few", 0, "q", False), ("a", "po", 0, "w", True), ("a", "new", 0, "n", False))
    merged, changes = incremental.merge(base, new)
    assert {r.conversation_id: r.change for r in changes.collect()} == {"same": "kept", "diff": "changed", "few": "kept", "po": "kept", "new": "added"}
    assert sorted(r.text for r in merged.collect()) == ["n", "x", "x", "x", "y", "z"]


def test_backfill(spark):
    m = spark.createDataFrame([(1, "Hello  World"), (2, "hello world"), (3, "hello world"), (4, "how do I bake a good sourdough bread at home"), (5, "unrelated"), (6, None), (7, "")], "id long, text string")
    t = spark.createDataFrame([(1, "hello world", "t1"), (2, "HELLO WORLD", "t2"), (3, "how do I bake a good sourdough bread at hom", "t3")], "item long, prompt string, at string")
    got = {r.id: (r["at"], r.how) for r in incremental.backfill(m, t).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["t1", "t2", "t1"] and got[4] == ("t3", "near") and 5 not in got and 6 not in got


def test_mask_words(spark):
    df = spark.createDataFrame([("xabcdx AB",), (None,), ("",)], "text string")
    out = incremental.mask_words(df, spark.createDataFrame([("ab",), ("abcd",), ("bcd",)], "word string")).collect()
    assert [r[0] for r in out] == ["x**cdx AB", None, ""]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    log = [(1, "c", "k", "add"), (2, "c", "k", "remove"), (3, "c", "k", "add"), (4, "c", "j", "odd")]
    _write(src / "1.json", "\n".join(json.dumps(dict(zip(("seq", "collection", "conversation_id", "action"), r))) for r in log))
    events = spark.readStream.schema("seq long, collection string, conversation_id string, action string").json(str(src))
    q = incremental.selection_stream(events).writeStream.format("memory").queryName("members").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("members").collect()] == [("c", "k", True, 3)]
    q = incremental.land(spark, str(src), "seq long, action string", str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert incremental.unseen(spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string"), spark.createDataFrame([("p", "1")], "path string, sha256 string")).count() == 1
    w = incremental.windowed_counts(spark.createDataFrame([Row(ts=dt.datetime(2024, 1, 1, 1), source="s"), Row(ts=dt.datetime(2024, 1, 1, 2), source="s")]))
    assert w.first().n == 2

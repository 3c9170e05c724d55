"""Readers of chat exports: tree JSON, fragment JSON, NDJSON, activity HTML and activity JSON, in files or archives.

Each reader gives message rows: conversation_id, source, title, message_index, role, timestamp (UTC text or null),
timestamp_source, model, text, thinking, attachments. A record of an export (a conversation, an activity item) is one row of
the input stage, so parsing is narrow and parallel over records; nothing larger than a record is held in memory.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlode.functions.text import ASSISTANT_ALIASES, USER_ALIASES

ROWS = "conversation_id string, source string, title string, message_index int, role string, timestamp string, timestamp_source string, model string, text string, thinking string, attachments array<string>"
_FIELDS = [x.split()[0] for x in ROWS.split(", ")]
_SCHEMA = pa.schema([(n, pa.list_(pa.string()) if n == "attachments" else pa.int32() if n == "message_index" else pa.string()) for n in _FIELDS])


def iso(value) -> str | None:
    """UTC text of an epoch number, a numeric text or an ISO text (a time without zone is UTC); null for anything else."""
    if value is None or isinstance(value, bool):
        return None
    try:
        if isinstance(value, (int, float)) or re.fullmatch(r"[+-]?\d+(\.\d+)?", str(value).strip()):
            return datetime.fromtimestamp(float(value), timezone.utc).isoformat()
        t = datetime.fromisoformat(str(value).strip().replace("Z", "+00:00"))
        return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()
    except (ValueError, OverflowError, OSError):
        return None


def known_role(value) -> str:
    r = str(value or "").strip().lower()
    return "assistant" if r in ASSISTANT_ALIASES else "user" if r in USER_ALIASES else r or "unknown"


def _numbered(messages: list[dict]) -> list[dict]:
    return [m | {"message_index": i} for i, m in enumerate(messages)]


def content_parts(content) -> tuple[str, list[str]]:
    """Text and attachments of a message's content: a text, or parts that are texts, texts in objects, or pointers."""
    if content is None:
        return "", []
    if isinstance(content, str):
        return content, []
    texts, files = [], []
    parts = content.get("parts") if isinstance(content, dict) else content
    for p in parts if isinstance(parts, list) else []:
        if isinstance(p, str):
            texts.append(p)
        elif isinstance(p, dict):
            if p.get("asset_pointer"):
                files.append(str(p["asset_pointer"]))
            elif isinstance(p.get("text"), str):
                texts.append(p["text"])
            else:
                files.append(str(p.get("content_type") or "unknown"))
    if not texts and isinstance(content, dict) and isinstance(content.get("text"), str):
        texts.append(content["text"])
    return "\n".join(t for t in texts if t), files


def _walk(mapping: dict) -> list[str]:
    """Nodes breadth first from the roots; without any root every node is one, unreachable nodes are left out."""
    children: dict[str, list[str]] = {}
    for k, v in mapping.items():
        children.setdefault((v or {}).get("parent"), []).append(k)
    queue = [k for k, v in mapping.items() if not (v or {}).get("parent") or (v or {}).get("parent") not in mapping] or list(mapping)
    seen, out = set(), []
    for k in queue:
        if k not in seen:
            seen.add(k)
            out.append(k)
            queue.extend(children.get(k, []))
    return out


def tree_conversation(c: dict) -> list[dict]:
    """Messages of a tree export's conversation: tool messages to a tool and empty ones are left out; order by time, those
    without last, then breadth first."""
    rows = []
    for order, k in enumerate(_walk(c.get("mapping") or {})):
        m = (c["mapping"][k] or {}).get("message")
        if not m:
            continue
        r = known_role((m.get("author") or {}).get("role"))
        if r == "tool" and m.get("recipient") not in (None, "all"):
            continue
        text, files = content_parts(m.get("content"))
        if not text.strip() and not files:
            continue
        meta, t = m.get("metadata") or {}, m.get("create_time")
        rows.append(((t is None, t or 0, order), {"role": r, "timestamp": iso(t), "timestamp_source": "native" if t else "none", "model": meta.get("model_slug") or meta.get("model"), "text": text, "thinking": None, "attachments": files}))
    return _numbered([r for _, r in sorted(rows, key=lambda x: x[0])])


def fragment_conversation(c: dict) -> list[dict]:
    """Messages of a fragment export's conversation: requests and responses are text, thoughts thinking, searches, files and
    tools attachments; order by the raw time text."""
    rows = []
    for order, k in enumerate(_walk(c.get("mapping") or {})):
        m = (c["mapping"][k] or {}).get("message")
        if not m:
            continue
        text, thought, files, asks = [], [], [], False
        for f in m.get("fragments") or []:
            kind, body = str(f.get("type") or "").upper(), f.get("content")
            if kind in ("REQUEST", "RESPONSE"):
                asks |= kind == "REQUEST"
                text.append(body or "")
            elif kind == "THINK":
                thought.append(body or "")
            elif kind == "SEARCH":
                files.append(f"search:{len(f.get('results') or [])}")
            elif kind == "FILE":
                names = f.get("files") if isinstance(f.get("files"), list) else [f.get("files")]
                files += [x if isinstance(x, str) else str(x.get("file_name") or x.get("name") or x.get("id")) for x in names if x]
            elif kind.startswith("TOOL"):
                files.append(kind.lower())
        text, thought = "\n\n".join(x for x in text if x), "\n\n".join(x for x in thought if x)
        if text or thought or files:
            at = m.get("inserted_at")
            rows.append(((str(at or ""), order), {"role": "user" if asks else "assistant", "timestamp": iso(at), "timestamp_source": "native" if at else "none", "model": m.get("model"), "text": text, "thinking": thought or None, "attachments": files}))
    return _numbered([r for _, r in sorted(rows, key=lambda x: x[0])])


def ndjson_conversation(c: dict) -> list[dict]:
    """Messages of a tolerant one-object-per-line chat: turns under any of their names, as a list or an object by index."""
    turns = next((c[k] for k in ("turns", "messages", "conversation", "chat", "content") if isinstance(c.get(k), (list, dict))), [])
    if isinstance(turns, dict):
        turns = [turns[k] for k in sorted(turns, key=lambda k: (not k.isdigit(), int(k) if k.isdigit() else 0, k))]
    first = lambda t, *ks: next((t[k] for k in ks if t.get(k) not in (None, "")), None)
    out = []
    for t in turns:
        if isinstance(t, str):
            t = {"text": t}
        at, files = first(t, "timestamp", "time", "create_time"), first(t, "attachments", "images") or []
        text, _ = content_parts(first(t, "text", "content", "markdown", "body"))
        out.append({"role": known_role(first(t, "role", "author", "sender")), "timestamp": iso(at), "timestamp_source": "native" if iso(at) else "none", "model": t.get("model"), "text": text, "thinking": first(t, "thinking", "thoughts", "reasoning"), "attachments": [str(f) for f in (files if isinstance(files, list) else [files])]})
    return _numbered(out)


# Elements that end a block, and offsets of the zone abbreviations in hours.
_BLOCKS = "p|div|tr|table|ul|ol|h1|h2|h3|h4|h5|h6|pre|blockquote|section|article|header"
_ZONES = {"UTC": 0, "GMT": 0, "CST": 8, "JST": 9, "KST": 9, "IST": 5.5, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "AEST": 10, "AEDT": 11}
_CJK_TIME = re.compile(r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{2}):(\d{2})\s*([A-Z]{2,5})?")


def html_to_text(h: str | None) -> str:
    """Text of an HTML fragment: breaks and block ends are line ends, list items dashes, entities characters."""
    t = re.sub(r"(?i)<br\s*/?>", "\n", h or "")
    t = re.sub(r"(?i)<li[^>]*>", "- ", t)
    t = re.sub(rf"(?i)</(?:{_BLOCKS}|li)>", "\n", t)
    t = _html.unescape(re.sub(r"<[^>]*>", "", t)).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in t.split("\n"))).strip()


def activity_item(cell: str, offset: float = 8.0) -> tuple[str, str, list[dict]] | None:
    """(conversation id, time, prompt and answer) of one record of an activity page; null for events of the interface."""
    m = re.search(r"(?s)content-cell[^>]*>(.*?)</div>", cell)
    body = m[1] if m else cell
    a = re.search(r"(Prompted|Branched)[\s\xa0]+(.*?)(?=<br|\d{4}年)", body.replace("&nbsp;", " "), re.S)
    t = _CJK_TIME.search(body)
    if not a or not t:
        return None
    hours = _ZONES.get(t[7], offset) if t[7] else offset
    at = datetime(*(int(x) for x in t.groups()[:6]), tzinfo=timezone.utc).timestamp() - hours * 3600
    when = datetime.fromtimestamp(at, timezone.utc).isoformat()
    link = re.search(r"/app/([0-9a-f]{8,})", cell)
    answer = body[t.end() :]
    base = {"timestamp": when, "timestamp_source": "native", "model": None, "thinking": None}
    pair = [base | {"role": "user", "text": html_to_text(a[2]), "attachments": []}]
    if html_to_text(answer) or "<img" in answer:
        pair.append(base | {"role": "assistant", "text": html_to_text(answer), "attachments": re.findall(r"<img[^>]+src=[\"']([^\"']+)", answer)})
    return (f"gemini-{link[1]}" if link else "gemini-unknown"), when, pair


def activity_json(item: dict) -> tuple[str, str, list[dict]] | None:
    """(conversation id, time, prompt and answer) of one record of an activity list; null for other products and events."""
    m = re.match(r"(?:Prompted|Branched|已提示|提问)[\s:：]*(.*)", str(item.get("title") or ""), re.S)
    if "gemini" not in str(item.get("header") or "").lower() or not m:
        return None
    when, link = iso(item.get("time")), re.search(r"/app/([0-9a-f]{8,})", str(item.get("titleUrl") or ""))
    answer = "".join(str(x.get("html") or "") for x in item.get("safeHtmlItem") or [])
    base = {"timestamp": when, "timestamp_source": "native" if when else "none", "model": None, "thinking": None}
    pair = [base | {"role": "user", "text": m[1].strip(), "attachments": [str(d.get("url") or d.get("name")) for d in item.get("details") or [] if d.get("url")]}]
    if answer:
        pair.append(base | {"role": "assistant", "text": html_to_text(answer), "attachments": re.findall(r"<img[^>]+src=[\"']([^\"']+)", answer)})
    return (f"gemini-{link[1]}" if link else "gemini-unknown"), when or "", pair


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in _FIELDS} for r in rows], schema=_SCHEMA)


def _conversations(records: DataFrame, source: str, parse, unnamed: str | None = None) -> DataFrame:
    """Message rows of `records` (rec: one conversation as JSON text); records that are no JSON objects are left out. With
    `unnamed`, a conversation without an id gets this prefix and a digest of its record as one."""

    return records.mapInArrow(lambda batches: _parse_records(batches, source, parse, unnamed), ROWS)


def _parse_records(batches, source: str, parse, unnamed: str | None):
    for b in batches:
        rows = []
        for raw in b.column(0).to_pylist():
            try:
                c = json.loads(raw)
            except (TypeError, ValueError):
                continue
            if isinstance(c, dict):
                cid = str(c.get("conversation_id") or c.get("id") or c.get("chat_id") or "") or None
                if cid is None and unnamed is not None:
                    cid = unnamed + hashlib.sha256(raw.encode("utf-8", "replace")).hexdigest()[:16]
                ms = parse(c)
                title = c.get("title") or c.get("name") or next((m["text"].strip().split("\n")[0][:80] for m in ms if m["role"] == "user" and m["text"].strip()), None)
                rows += [m | {"conversation_id": cid, "source": source, "title": title} for m in ms]
        yield _batch(rows)


def open_input(path: str):
    """A file of any file system that Spark names, opened for reading in pieces."""
    from urllib.parse import quote

    from pyarrow import fs

    local = re.match(r"file:/+|(?=/)", path)
    if local:
        return fs.LocalFileSystem().open_input_file("/" + path[local.end() :].lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/%"))
    return system.open_input_file(name)


def chunks_of(path: str, size: int = 1 << 20):
    """Decoded pieces of a file, a mark of order skipped; bytes that are no UTF-8 become replacement characters."""
    import codecs

    decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode
    with open_input(path) as f:
        while piece := f.read(size):
            yield decode(piece)
        yield decode(b"", True)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]', re.S)
# Names under which exports put their array.
_WRAPPED = tuple(json.dumps(k) for k in ("conversations", "data", "items", "activity"))


def array_elements(chunks):
    """The elements, as JSON texts, of an array that is alone in a text or under a usual name in its object. The text comes in
    pieces, and no more than an element is held. A text without such an array, or with one that doesn't end, is an error."""
    buf, pos, depth, at, start, key = "", 0, 0, None, None, None
    chunks = iter(chunks)
    while True:
        m, quote = _TOKEN.search(buf, pos), buf.find('"', pos)
        if m is None or 0 <= quote < m.start():  # the token, or a text, goes on in the next piece
            more = next(chunks, None)
            if more is None:
                raise ValueError("no whole array of conversations or items")
            base = pos if start is None else start
            buf, pos, start = buf[base:] + more, pos - base, None if start is None else 0
            continue
        tok, pos = m.group(), m.end()
        if tok[0] == '"':
            key = tok if depth == 1 and at is None else key
        elif tok in "[{":
            depth += 1
            if at is None and tok == "[" and (depth == 1 or depth == 2 and key in _WRAPPED):
                at, start = depth, pos
        elif tok == "," and depth != at:
            continue
        elif tok == "," or depth == at:
            if x := buf[start : m.start()].strip():
                yield x
            if tok != ",":
                return
            start = pos
        else:
            depth -= 1


def _elements(spark: SparkSession, path) -> DataFrame:
    """rec: the elements, as JSON texts, of files that hold an array; each file is read in pieces by one task."""

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                rows, size = [], 0
                for x in array_elements(chunks_of(p)):
                    rows.append(x)
                    size += len(x)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["rec"])
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["rec"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "rec string")


def read_tree_export(spark, path):
    return _conversations(_elements(spark, path), "chatgpt", tree_conversation)


def read_fragment_export(spark, path):
    return _conversations(_elements(spark, path), "deepseek", fragment_conversation)


def read_ndjson_export(spark, path):
    """One conversation per line. Lines without an id get one from their text; lines of one id are numbered on, in the order of
    the files."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    got = lines.select(F.to_json(F.struct("line", "value")).alias("rec"))

    def parse(batches):
        for b in batches:
            keyed = [json.loads(x) for x in b.column(0).to_pylist()]
            for k in keyed:
                part = pa.RecordBatch.from_arrays([pa.array([k.get("value")], pa.string())], names=["rec"])
                for out in _parse_records([part], "gemini", ndjson_conversation, "gemini-"):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([k["line"]] * out.num_rows, pa.int64())], names=[*_FIELDS, "line"])

    rows = got.mapInArrow(parse, ROWS + ", line long")
    sizes = rows.groupBy("conversation_id", "line").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conversation_id").orderBy("line")) - F.col("n")).where("before > 0").drop("n")
    rows = rows.join(before, ["conversation_id", "line"], "left")
    return rows.withColumn("message_index", (F.col("message_index") + F.coalesce("before", F.lit(0))).cast("int")).select(*_FIELDS)


def _items(records: DataFrame, parse) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                try:
                    got = parse(raw)
                except (TypeError, ValueError, AttributeError):
                    got = None
                if got:
                    rows += [m | {"conversation_id": got[0], "source": "gemini", "title": None, "message_index": None} for m in got[2]]
            yield _batch(rows)

    # Records of a conversation are numbered in the order of their times, prompt before answer.
    rows = records.mapInArrow(run, ROWS)
    from pyspark.sql import Window

    w = Window.partitionBy("conversation_id", F.when(F.col("conversation_id") == "gemini-unknown", F.pmod(F.xxhash64("timestamp", "text"), F.lit(256)))).orderBy("timestamp", F.desc("role"))
    return rows.withColumn("message_index", F.when(F.col("conversation_id") != "gemini-unknown", F.row_number().over(w) - 1).cast("int")).select(*_FIELDS)


def read_activity_html(spark, path, offset: float = 8.0):
    """Records of activity pages: the reader splits at the record's opening tag, so a page of any size is streamed."""
    cells = spark.read.text(path, lineSep='<div class="outer-cell').where(F.col("value").contains("content-cell"))
    return _items(cells.select(F.col("value").alias("rec")), lambda raw: activity_item(raw, offset))


def read_activity_json(spark, path):
    return _items(_elements(spark, path), lambda raw: activity_json(json.loads(raw)))


def timeline(activity: DataFrame) -> DataFrame:
    """item, prompt, at: the dated prompts of activity rows, as a backfill of times wants them; items are in the order of time."""
    at = F.to_timestamp("timestamp")
    return activity.where("role = 'user' and timestamp is not null").select(F.unix_micros(at).alias("item"), F.col("text").alias("prompt"), F.col("timestamp").alias("at"))


def read_base(spark, path):
    """Message rows that an earlier run wrote as JSON lines."""
    return spark.read.schema(ROWS).json(path)


def kind_of(path, head):
    """Kind of an export by its name and the first 2 MiB of its content."""
    name, body = F.lower(F.element_at(F.split(path, "/"), -1)), F.substring(head, 1, 2_097_152)
    ai_mode = name.rlike(r"ai.?mode")
    return (
        F.when(ai_mode, "skip")
        .when(name.rlike(r"(my.?activity|activity|活动记录).*\.html?$"), "activity_html")
        .when(name.rlike(r"(my.?activity|activity|活动记录).*\.json$"), "activity_json")
        .when(name.rlike(r"\.(ndjson|jsonl)$"), "ndjson")
        .when(body.contains('"fragments"'), "fragment")
        .when(body.contains('"author"'), "tree")
        .otherwise("skip")
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, size and sha256 of every file below a folder; each is read in pieces, its first 2 MiB tell the kind."""

    def run(batches):
        for b in batches:
            heads, sums = [], []
            for p in b.column(0).to_pylist():
                digest, head = hashlib.sha256(), b""
                with open_input(p) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                        head += piece if len(head) < 2_097_152 else b""
                heads.append(head[:2_097_152].decode("utf-8", "replace"))
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.string()), pa.array(sums, pa.string())], names=["path", "size", "head", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return files.mapInArrow(run, "path string, size long, head string, sha256 string").select("path", kind_of(F.col("path"), F.col("head")).alias("kind"), "size", "sha256")


def read_exports(spark: SparkSession, root: str, offset: float = 8.0) -> DataFrame:
    """Message rows of all exports below a folder, each file by the reader of its kind; files of no known kind are left out. The
    driver sees one row a file."""
    readers = {"tree": read_tree_export, "fragment": read_fragment_export, "ndjson": read_ndjson_export, "activity_html": lambda s, p: read_activity_html(s, p, offset), "activity_json": read_activity_json}
    paths: dict[str, list[str]] = {}
    for r in discover(spark, root).select("path", "kind").collect():
        paths.setdefault(r.kind, []).append(r.path)
    parts = [read(spark, sorted(paths[kind])) for kind, read in readers.items() if kind in paths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ROWS)


def archive_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """path, member, text of the members of zip and tar archives that end with `suffix`; one archive per task, opened where it
    lies and read member by member."""
    import tarfile
    import zipfile

    def members(f):
        if zipfile.is_zipfile(f):
            f.seek(0)
            with zipfile.ZipFile(f) as z:
                for n in z.namelist():
                    if n.endswith(suffix):
                        yield n, z.read(n)
        else:
            f.seek(0)
            with tarfile.open(fileobj=f) as z:
                for i in z:
                    if i.isfile() and i.name.endswith(suffix):
                        yield i.name, z.extractfile(i).read()

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                with open_input(p) as f:
                    for n, raw in members(f):
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (p, n, raw.decode("utf-8-sig", "replace"))], names=["path", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "path string, member string, text string")


def read_lexicon(spark: SparkSession, path: str, least: int = 2, least_ascii: int = 3) -> DataFrame:
    """Distinct words of word lists: comments and short words are dropped, what follows a tab is ignored."""
    w = spark.read.text(path).select(F.trim(F.element_at(F.split("value", "\t"), 1)).alias("word")).where(~F.col("word").rlike(r"^(#|//)"))
    return w.where(F.length("word") >= F.when(F.col("word").rlike(r"^[\x00-\x7f]+$"), least_ascii).otherwise(least)).distinct()

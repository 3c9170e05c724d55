"""Broken prompt and response pairs.

Each message gives small features in one narrow pass: digests of its letters, its language, the languages it asks for,
whether it stops early, and the opening of a response, codes masked. Only the features are ordered and paired, in one
sorted scan that also judges the conversations; no text is shuffled. Words of openings that no recurring shingle of five
words supports are gaps; what is left, the skeletons, is clustered by MinHash over shingles of five words with verified
similarity. A cluster that recurs across unrelated prompts is a template; where most of its responses decline by their
wording, it reveals as refusals all responses that hold nothing else. Digests tell copies, languages the responses nobody
asked for.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlode.functions.text import blank, role
from chatlode.llm.conversations import PART, Parts, _tables, arrow_schema, components, ordered, verdicts
from chatlode.llm.language import language
from chatlode.operators.timestamps import normalize_timestamps
from chatlode.session import checkpointed, small

SALT = 16
LANGS = ("en", "de", "fr", "es", "zh", "ja")

# Names of the languages, as prompts write them.
NAMES = {
    "en": r"english|englisch\w*|anglais|ingl[ée]s|英文|英语|英語",
    "de": r"german|deutsch\w*|allemand|alem[áa]n|德文|德语|ドイツ語",
    "fr": r"french|franz[öo]sisch\w*|fran[çc]ais|franc[ée]s|法文|法语|フランス語",
    "es": r"spanish|spanisch\w*|espagnol|español|castellano|西班牙文|西班牙语|スペイン語",
    "zh": r"chinese|chinesisch\w*|chinois|chino|中文|汉语|中国語",
    "ja": r"japanese|japanisch\w*|japonais|japon[ée]s|日文|日语|日本語",
}
_NAMED = {k: re.compile(v, re.I) for k, v in NAMES.items()}
#: What every language name, and every refusal, holds in lower case: most texts are told by these alone.
_NAME_HINTS = ("english", "englisch", "anglais", "ingl", "英文", "英语", "英語", "german", "deutsch", "allemand", "alem", "德文", "德语", "ドイツ語", "french", "französisch", "franzoesisch", "fran", "法文", "法语", "フランス語", "spanish", "spanisch", "espa", "castellano", "西班牙", "スペイン語", "chines", "chinois", "chino", "中文", "汉语", "中国語", "japan", "japon", "日文", "日语", "日本語")
_DECLINE_HINTS = (
    "can't", "cant ", "cannot", "can not", "won't", "will not", "unable", "not able", "must decline", "must refuse", "have to", "declin", "refus", "against my", "off limits", "not something i can", "keep me from", "not allowed", "not permitted", "where i stop", "rather not", "no comment",
    "leider", "ablehnen", "lehne", "verweiger", "auskunft", "nichts sagen", "darf ", "kann ich", "nicht ", "leid", "verzichte", "désolé", " pas", "impossible", "autorisé", "interdit", "m'abst", "décline", "lo siento", "no pued", "no podr", "no estoy", "no me ", "no debo", "rechaz", "fuera de lo",
    "抱歉", "对不起", "无法", "不能", "拒绝", "不方便", "不便", "恕", "不予", "不可以", "婉拒", "没办法", "申し訳", "できません", "できかね", "お断り", "いたしかね", "控え", "お答えできない", "応じられ", "ご遠慮",
)
_ANY_NAME = re.compile("|".join(NAMES.values()), re.I)
#: Words that ask for an answer in a language, in the sentence that names it.
_ASKS = re.compile(r"reply|answer|respond|response|write|translat|say it|antwort|schreib|übersetz|gib|répon|écri|tradui|respon|contest|escrib|traduc|traduz|回答|回复|答案|翻译|答复|写|用.{0,3}[文语]|答え|返事|訳|書い|で(?:お願い|回答|説明)|\b(?:in|auf|en)\b", re.I)
_SENT = re.compile(r"[^.!?。！？\n]+(?:(?<=\w)\.(?=\w)[^.!?。！？\n]+)*[.!?。！？\n]*")

#: Wording that declines a request.
DECLINE = re.compile(
    r"\b(?:can'?t|cannot|can not|won'?t|will not|unable|not able|must (?:decline|refuse)|have to (?:pass|decline|refuse)|declin\w+|refus\w+|against my|off limits|not something i can|keep me from|not (?:allowed|permitted)|where i stop|rather not|no comment)\b"
    r"|\b(?:leider|ablehnen|lehne|verweiger\w+|keine auskunft|nichts sagen|darf ich nicht|darf nicht|kann ich (?:\w+ ){0,2}nicht|nicht (?:helfen|beantworten|möglich)|tut mir leid|nicht dienen|verzichte)\b"
    r"|\b(?:désolé|ne (?:peux|puis|pourrai)s? pas|refus\w+|impossible|pas autorisé|interdit|m'abst\w+|décline\w*|pas en mesure)\b"
    r"|\b(?:lo siento|no (?:puedo|podré|estoy autorizad\w+|me es posible|debo|me está permitido)|rechaz\w+|declin\w+|fuera de lo que puedo)\b"
    r"|抱歉|对不起|无法|不能|拒绝|不方便|不便|恕|不予|不可以|婉拒|没办法"
    r"|申し訳|できません|できかね|お断り|いたしかねます|控え|お答えできない|応じられ|ご遠慮",
    re.I,
)
_COURTESY = re.compile(
    r"^(?:thank|thanks|please|is there anything|anything else|let me know|happy to|i looked at|sorry|danke|vielen dank|bitte|gibt es sonst|kann ich sonst|merci|y a-t-il|puis-je|gracias|hay algo|por favor|谢谢|感谢|请|还有|换|有什么|ありがとう|他に|ほかに|別の|どうぞ)",
    re.I,
)
_CODE = re.compile(r"(?<![!-~])(?:job-\w+|[!-/:-~]*\d[!-~]*(?<![.,;:!?)]))|\b\w+\.log\b|`[^`\n]*`|#\w+")
_LISTED = re.compile(r"\n[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]")
_BOLD = re.compile(r"^\*\*[^*\n]+\*\*\s*")
_WORDS = re.compile(r"[ァ-ヿ]+|[぀-ゟ㐀-鿿々]|[^\W_]+(?:'[^\W_]+)?|#")
_LIST = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])(?:[ \t]+|$)")
_EDGE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_ENDS = set(".!?。！？…؟।♪~～")
_CLOSE = set("\"'”’»）)]】」』*_`”")


_NOT_LETTER = re.compile(r"[\W_]+")
_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())


def _letters(text: str) -> str:
    """Letters and digits of a text in one case and width; of a text said several times over, those of one time."""
    if text.isascii():
        t = text.lower().encode().translate(None, _SIGNS).decode()
    else:
        t = _NOT_LETTER.sub("", text)  # signs first: what is left is mostly in normal form
        if not t.isascii() and not unicodedata.is_normalized("NFKC", t):
            t = _NOT_LETTER.sub("", unicodedata.normalize("NFKC", t))
        t = t.upper().lower()
    at = t.find(t[: min(8, len(t) // 2)], 1) if t else -1  # a text can only repeat where its start does
    period = (t + t).find(t, at) if at > 0 else 0
    return t[:period] if 0 < period < len(t) else t


def stops_early(t: str) -> tuple[bool, str | None]:
    """(whether a text without blanks at its ends stops early, its last list item where only other items can tell)."""
    if t.count("```") % 2:
        return True, None
    if t.endswith("```"):
        return False, None
    line = t[t.rfind("\n") + 1 :]
    if line.lstrip().startswith("|"):
        if not line.rstrip().endswith("|") or len(line.strip()) < 2:
            return True, None
        rows = []
        for x in reversed(t.split("\n")):
            if not x.lstrip().startswith("|"):
                break
            rows.append(x.strip())
        rows.reverse()
        wide = rows[0].count("|")
        return len(rows) < 3 or line.strip().count("|") < wide, None
    m = _LIST.match(line)
    last = t[-1]
    core = t
    while core and core[-1] in _CLOSE:
        core = core[:-1]
    if m:
        item = line[m.end() :].strip()
        if not item or item[-1] in ",，、;；:：":
            return True, None
        return False, (None if core and core[-1] in _ENDS else item.lower())
    if core and core[-1] in _ENDS:
        if core[-1] == "…" or core.endswith("..."):
            return len(core.rstrip("….").rstrip()) > 0 and core.rstrip("….").rstrip()[-1:].isalnum() and len(core) > 40, None
        return bool(re.search(r"(?:about|etwa|environ|unos|circa) \d+\.$", core)), None
    if unicodedata.category(last)[0] == "S" or unicodedata.category(last) in ("Cf", "Mn"):
        return False, None  # an emoji or a sign
    if last in ",，、;；:：-–—(（“「":
        return True, None
    if "\n" not in t and not re.search(r"[.!?。！？,，、;:：；]\s?", re.sub(r"\d[.,]\d", "", t)):
        wide = sum(1 for c in t if ord(c) > 0x2E7F)
        if (wide and len(t) <= 10) or (not wide and len(t.split()) <= 3 and len(t) <= 24):
            return False, None  # a short answer: a number, a word
    return True, None


#: Letters that a statement may hold beside its opening.
BESIDE = 24


_FAR = re.compile(r"[\u2e80-\U0010ffff]")


def _weight(x: str) -> int:
    return len(_NOT_LETTER.sub("", x)) * (1 if x.isascii() or not _FAR.search(x) else 2)


def opening(t: str, hinted: bool = True) -> tuple[str | None, bool, bool]:
    """(opening, declines, alone) of a response. The opening is its first sentence that is no mere courtesy, and where that one
    doesn't decline, what follows up to one that does; it is given as its words, codes masked, a Han or Hiragana character
    being a word. `declines`: it declines in every sentence. `alone`: the response holds no more than its opening; neither
    holds with a list, a table or code. `hinted`: some hint of a wording that declines is there at all."""
    t = t.replace("’", "'")
    framed = "```" in t or "\n" in t and ("\n|" in t or _LISTED.search(t) is not None)
    head, beside, plain, declines = "", 0, 0, False
    for m in _SENT.finditer(_BOLD.sub("", t) if t.startswith("**") else t):
        x = m.group(0).strip()
        if not x or _COURTESY.match(x):
            continue
        d = hinted and DECLINE.search(x) is not None
        n = 0 if d else _weight(x)
        if not head:
            head = x
        elif d and not declines and plain <= BESIDE:
            head += " " + x
        else:
            beside += n
        plain, declines = plain + n, declines or d
        if beside > BESIDE:
            break
    words = " ".join(_WORDS.findall(_CODE.sub("#", head).lower()))
    return words or None, declines and plain <= BESIDE and not framed, beside <= BESIDE and not framed


def asked(t: str) -> int:
    """Bit set of the languages that a prompt asks an answer in."""
    got = 0
    low = t.lower()
    if any(n in low for n in _NAME_HINTS):
        for s in _SENT.findall(t):
            if _ANY_NAME.search(s) and _ASKS.search(s):
                for i, k in enumerate(LANGS):
                    if _NAMED[k].search(s):
                        got |= 1 << i
    return got


#: Bits of `marks`: the language in the lowest four (0: not told), the languages asked for in the next six, then flags.
ASKS, EARLY, EMPTY, DECLINES, ALONE = 4, 1 << 10, 1 << 11, 1 << 12, 1 << 13
_FEATURES = "id long, text_key long, letters int, marks int, last_item string, opening string"
FEATURES = ("text_key", "letters", "marks", "last_item", "opening")
#: One expression over a batch tells the texts that can hold what `asked` and DECLINE look for.
_NAMED_AT, _HINTED_AT = ("(?i)" + "|".join(re.escape(x.strip()) for x in h) for h in (_NAME_HINTS, _DECLINE_HINTS))


def _features(batches):
    """Features of the rows of a batch: columns 0 to 3 are id, role, text and is_blank; the columns behind pass through."""
    for b in batches:
        cols = [[] for _ in range(5)]
        plain = pc.replace_substring(b.column(2), "’", "'")
        named = pc.match_substring_regex(plain, _NAMED_AT).to_pylist()
        hinted = pc.match_substring_regex(plain, _HINTED_AT).to_pylist()
        for r, t, bl, nm, ht in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), named, hinted):
            key, letters, marks, item, opens = 0, 0, EMPTY, None, None
            if not bl and r in ("user", "assistant"):
                s = t.strip(_EDGE)
                key = _letters(s)
                letters, marks = min(len(key), 2**31 - 1), 0
                lang, margin = language(s)
                if lang in LANGS and (margin >= 1.5 or lang in ("zh", "ja") and margin >= 1):
                    marks = LANGS.index(lang) + 1
                if r == "user":
                    marks |= (asked(s) if nm else 0) << ASKS
                else:
                    if not key and (re.fullmatch(r"[`~\s​]+\w*[`~\s​]*", s) or re.fullmatch(r"(`{3,}|~{3,})[^\n`]*\s*\1\s*", s)):
                        marks |= EMPTY
                    early, item = stops_early(s)
                    if early:
                        marks |= EARLY
                    else:
                        opens, declines, alone = opening(s, ht)
                        marks |= (DECLINES if declines else 0) | (ALONE if alone else 0)
                key = xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace")) - (1 << 63)
            for c, v in zip(cols, (key, letters, marks, item, opens)):
                c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), *(b.column(i) for i in range(4, b.num_columns))], names=["id", *FEATURES, *b.schema.names[4:]])


def featured(messages: DataFrame, sources: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """Light rows of the distinct messages (repeated rows once, lowest id) with their features."""
    rest = [F.col(f"`{c}`") for c in messages.columns if c != "id"]
    row = F.struct(*rest)
    nulls = F.concat(*[x.isNull().cast("int").cast("string") for x in rest])
    files = F.coalesce(F.size("attachments") > 0, F.lit(False)) if "attachments" in messages.columns else F.lit(False)
    r = role(F.col("role"))
    who = F.when(r == "user", 1).when(r == "assistant", 2).when(r == "system", 0).otherwise(3)
    timed = F.col("message_index").isNull()  # times give the order only where no index does
    times = [F.when(timed, F.col(c)).alias(c) for c in ("source", "timestamp", "timestamp_source")]
    is_blank = blank(F.col("text"))
    have = messages.where(F.col("conversation_id").isNotNull()).select("id", r.alias("_role"), "text", is_blank.alias("_blank"), is_blank.alias("is_blank"), files.alias("has_files"), who.alias("who"), "conversation_id", F.col("message_index").cast("long").alias("idx"), *times, F.xxhash64(row).alias("_a"), F.xxhash64(F.lit(7), row).alias("_b"), nulls.alias("_n"))
    passed = "is_blank boolean, has_files boolean, who int, conversation_id string, idx long, source string, timestamp string, timestamp_source string, _a long, _b long, _n string"
    got = have.mapInArrow(_features, f"{_FEATURES}, {passed}")
    rows = checkpointed(got.groupBy(*[c for c in got.columns if c != "id"]).agg(F.min("id").alias("id")).drop("_a", "_b", "_n"))
    keep = ("conversation_id", "who", "is_blank", "has_files", *FEATURES)
    indexed = rows.where("idx is not null").select("id", *keep, "idx", F.lit(None).cast("long").alias("utc_us"))
    late = normalize_timestamps(rows.where("idx is null"), sources, abbrevs, keep=keep)
    return indexed.unionByName(late.select("id", *keep, F.lit(None).cast("long").alias("idx"), "utc_us"))


_PAIR = "response_id long, u_key long, u_letters int, u_marks int, r_key long, r_letters int, r_marks int, has_files boolean, last_item string, opening string, conversation_id string"
_SIDE = _PAIR + ", edge string, pid int"
_SCAN = _SIDE + ", " + PART.replace("conversation_id string, ", "").replace("pid int, ", "")


def _scan(batches):
    """Exchanges among the sorted rows of one partition. Rows with an `edge` are halves at the partition's ends: the first
    response of its first conversation where no prompt stands before it, and the prompt of its last that waits for one.
    Rows with the edge 'part' are the summaries of the conversations' parts, from the same scan."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    schema = arrow_schema(_SCAN)
    side = [x.split()[0] for x in _SIDE.split(", ")]
    parts, conv, prompt, first, talked, started = Parts(pid), None, None, True, False, False

    def rows_of(out, names):
        cols = dict(zip(names, zip(*out)))
        return pa.RecordBatch.from_arrays([pa.array(list(cols.get(f.name, (None,) * len(out))), f.type) for f in schema], schema=schema)

    def summaries(out):
        return rows_of([(*r, "part") for r in out], [*parts.names, "edge"])

    for b in batches:
        if done := parts.add(b):
            yield summaries(done)
        out = []
        cols = [b.column(c).to_pylist() for c in ("conversation_id", "who", "id", "text_key", "letters", "marks", "has_files", "last_item", "opening")]
        for c, who, i, key, letters, marks, files, item, opens in zip(*cols):
            if not started or c != conv:
                first, started, conv, prompt, talked = not started, True, c, None, False
            if who == 1:
                prompt, talked = (key, letters, marks), True
            elif who == 2:
                if prompt is not None:
                    out.append((i, *prompt, key, letters, marks, files, item, opens, c, None, pid))
                elif first and not talked:
                    out.append((i, None, None, None, key, letters, marks, files, item, opens, c, "response", pid))
                prompt, talked = None, True
        if out:
            yield rows_of(out, side)
    if started and prompt is not None:
        yield rows_of([(None, *prompt, None, None, None, None, None, None, conv, "prompt", pid)], side)
    elif started and talked:
        yield rows_of([(None, None, None, None, None, None, None, None, None, None, conv, "done", pid)], side)
    if done := parts.close():
        yield summaries(done)


def _mend(pdf):
    """Exchanges whose prompt and response are in different partitions; `pdf` has the edges of one conversation."""
    prompt, out = None, []
    rank = {"response": 0, "prompt": 1, "done": 1}
    for r in sorted(pdf.to_dict("records"), key=lambda r: (r["pid"], rank[r["edge"]])):
        if r["edge"] == "response":
            if prompt is not None:
                out.append(r | {k: prompt[k] for k in ("u_key", "u_letters", "u_marks")})
            prompt = None
        else:
            prompt = r if r["edge"] == "prompt" else None
    return pdf.iloc[0:0] if not out else type(pdf)(out)[list(pdf.columns)]


def exchanges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per prompt and its first response before the next prompt, verdicts on the conversations), from one sorted scan."""
    scan = checkpointed(ordered(rows.withColumn("empty", F.col("is_blank") & ~F.col("has_files")).drop("is_blank")).mapInArrow(_scan, _SCAN))
    names = [x.split()[0] for x in _SIDE.split(", ")]
    halves = scan.where("edge is null or edge <> 'part'").select(*names)
    mended = halves.where("edge is not null").groupBy("conversation_id").applyInPandas(_mend, _SIDE)
    return halves.where("edge is null").unionByName(mended).drop("edge", "pid"), verdicts(scan.where("edge = 'part'"))


SHINGLE = 5


def _shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def skeleton(words: list[str], at: list[int]) -> str:
    """The words of an opening that its recurring shingles, which begin at the places `at`, support; the others as gaps '#'. A
    word is supported when half of the shingles over it recur, or one that is supported in all other words does."""
    n = max(1, len(words) - SHINGLE + 1)
    i = np.arange(len(words))
    low, high = np.maximum(0, i - SHINGLE + 1), np.minimum(i, n - 1) + 1
    ok = np.zeros(n, bool)
    ok[at] = True
    over = lambda x: np.r_[0, np.cumsum(x)]
    hits = over(ok)
    core = 2 * (hits[high] - hits[low]) >= high - low
    inside = over(core)
    w = np.arange(n)
    near = over(ok & (inside[np.minimum(w + SHINGLE, len(words))] - inside[w] >= min(SHINGLE, len(words)) - 1))
    keep = core | (near[high] > near[low])
    kept = [x if k else "#" for x, k in zip(words, keep)]
    return " ".join(x for k, x in enumerate(kept) if x != "#" or not k or kept[k - 1] != "#")


def _skeletons(batches):
    for b in batches:
        out = [skeleton(t.split(" "), at or []) for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["okey", "skeleton"])


def skeletons(openings: DataFrame, recurs: int) -> DataFrame:
    """okey, skeleton of distinct `openings` (okey long, opening string, prompts long): a shingle of five words recurs when
    the openings that hold it answer `recurs` prompts; words that fewer than half of their shingles' recurrences support are
    what a template is filled with, such as its topic."""
    w = F.split("opening", " ")
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, SHINGLE)))
    at = openings.select("okey", "prompts", F.posexplode(each).alias("pos", "h"))
    often = at.groupBy("h", "okey").agg(F.min("prompts").alias("prompts")).groupBy("h").agg(F.sum("prompts").alias("n")).where(F.col("n") >= recurs).select("h")
    ok = at.join(often, "h", "left_semi").groupBy("okey").agg(F.collect_set("pos").alias("at"))  # positions in one opening
    return openings.select("okey", "opening").join(ok, "okey", "left").select("okey", "opening", "at").mapInArrow(_skeletons, "okey long, skeleton string")


def _signatures(batches, bands: int = 12, rows: int = 4):
    mul = np.random.default_rng(11).integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = np.random.default_rng(13).integers(1, 1 << 62, bands * rows, dtype=np.uint64)
    for b in batches:
        ids, texts, keys = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = np.array([xxhash.xxh3_64_intdigest(g) for g in set(_shingles(t.split(" ")))], np.uint64)
            sig = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(h), 4096):
                sig = np.minimum(sig, (h[at : at + 4096, None] * mul + add).min(axis=0))
            for k in range(bands):
                ids.append(i)
                texts.append(t)
                keys.append(xxhash.xxh3_64_intdigest(sig[k * rows : k * rows + rows].tobytes(), k) - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(keys, pa.int64())], names=["o", "opening", "band"])


def templates(openings: DataFrame, least: float = 0.8) -> DataFrame:
    """o, cluster of distinct `openings` (o long, opening string): MinHash candidates over shingles of five words (a shorter
    opening is one shingle), each verified to a Jaccard similarity of `least`, joined to clusters. Buckets are met through
    their smallest member, so a hot bucket of n openings alike gives n pairs, not n squared; only a member that this centre
    does not verify meets all others."""
    bands = checkpointed(openings.mapInArrow(_signatures, "o long, opening string, band long"))

    def alike(batches):
        for b in batches:
            memo: dict[str, set[str]] = {}
            keep = []
            for x, y in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                p, q = (memo.get(t) or memo.setdefault(t, set(_shingles(t.split(" ")))) for t in (x, y))
                both = len(p & q) if min(len(p), len(q)) >= least * max(len(p), len(q)) else 0
                keep.append(both / (len(p) + len(q) - both) >= least)
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["u", "v"])

    verified = lambda near: checkpointed(near.distinct().mapInArrow(alike, "u long, v long"))
    centre = bands.groupBy("band").agg(F.min(F.struct("o", "opening")).alias("c"), F.count("*").alias("n")).where("n > 1")
    met = bands.join(centre, "band").where("o <> c.o").select("band", "o", "opening", F.col("c.o").alias("p"), F.col("c.opening").alias("other"), "n")
    links = verified(met.select("o", "opening", "p", "other"))
    lone = met.where("n > 2").join(links, (F.col("o") == F.col("u")) & (F.col("p") == F.col("v")), "left_anti").select("band", "o", "opening", F.col("p").alias("centre"))
    rest = lone.join(bands.select("band", F.col("o").alias("p"), F.col("opening").alias("other")), "band").where("p <> o and p <> centre")
    one, two = F.struct("o", "opening"), F.struct(F.col("p").alias("o"), F.col("other").alias("opening"))
    rest = rest.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).select("a.o", "a.opening", F.col("b.o").alias("p"), F.col("b.opening").alias("other"))
    links = links.union(verified(rest))
    return components(links.union(openings.select(F.col("o").alias("u"), F.col("o").alias("v")))).select(F.col("node").alias("o"), F.col("component").alias("cluster"))


def refusing(ex: DataFrame, recurs: int = 3, share: float = 0.5) -> DataFrame:
    """okey of the openings that refuse: their template (cluster of skeletons) recurs over `recurs` prompts, not all the same,
    and at least `share` of its responses decline in every sentence. A template that no response consists of alone can't."""
    has = lambda bit: (F.col("r_marks").bitwiseAND(bit) != 0).cast("long")
    said = ex.where(F.col("opening").isNotNull()).groupBy("opening", "u_key").agg(F.count("*").alias("n"), F.sum(has(DECLINES)).alias("votes"), F.sum(has(ALONE)).alias("alone"))
    said = said.groupBy("opening").agg(F.count("*").alias("prompts"), F.min("u_key").alias("low"), F.max("u_key").alias("high"), *[F.sum(c).alias(c) for c in ("n", "votes", "alone")])
    said = checkpointed(said.withColumn("okey", F.xxhash64("opening")))
    member = checkpointed(said.drop("opening").join(skeletons(said, recurs), "okey"))
    kept = member.where(F.col("skeleton") != "#").groupBy("skeleton").agg(*[F.sum(c).alias(c) for c in ("prompts", "n", "votes", "alone")], F.min("low").alias("low"), F.max("high").alias("high"))
    kept = checkpointed(kept.where("alone > 0").withColumn("o", F.xxhash64("skeleton")))
    kept = kept.join(templates(kept.select("o", F.col("skeleton").alias("opening"))), "o")
    sums = kept.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("prompts", "n", "votes")], F.min("low").alias("low"), F.max("high").alias("high"))
    sums = sums.where((F.col("prompts") >= recurs) & (F.col("low") < F.col("high")) & (F.col("votes") >= share * F.col("n")))
    return member.join(kept.join(sums.select("cluster"), "cluster", "left_semi").select("skeleton"), "skeleton", "left_semi").select("okey")


def cut_items(messages: DataFrame, ex: DataFrame) -> DataFrame:
    """last_item of the exchanges that another list item goes on with and none equals: it was cut there."""
    item = r"(?m)^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+([^\r\n]+?)[ \t]*\r?\n"
    items = messages.where((role(F.col("role")) == "assistant") & F.col("text").contains("\n")).select(F.explode(F.regexp_extract_all("text", F.lit(item), 1)).alias("known")).groupBy(F.lower("known").alias("known")).agg(F.count("*").alias("n"))
    known = items.select("known", F.lit(True).alias("whole"))
    last = checkpointed(ex.where("last_item is not null").select(F.col("last_item").alias("known")).distinct())
    lengths = last.agg(F.collect_set(F.length("known")).alias("lengths"))  # items of any length are cut at these only
    cut = items.crossJoin(F.broadcast(lengths)).select(F.explode(F.transform(F.filter("lengths", lambda i: i < F.length("known")), lambda i: F.substring(F.col("known"), F.lit(1), i))).alias("known"))
    cut = cut.join(small(last), "known", "left_semi").distinct().select("known", F.lit(True).alias("begun"))
    return last.join(known, "known", "left").join(cut, "known", "left").where("whole is null and begun").select(F.col("known").alias("last_item"), F.lit(True).alias("item_cut"))


def defects(messages: DataFrame, sources: DataFrame, abbrevs: DataFrame, recurs: int = 3) -> DataFrame:
    """response_id, defect of each defective response, at most one each, in this order: empty, copy, truncated, refusal, wrong_language.

    A refusal is a response that holds only its opening, of a template that `refusing` finds. Null and blank texts are empty
    unless there are attachments. A prompt that is blank has no language and no copy. Conversations that are broken, and rows
    without a conversation, are left out; what they hold counts for the templates. An empty table gives an empty result.
    """
    ex, verdict = exchanges(featured(messages, sources, abbrevs))
    ex = ex.withColumn("okey", F.xxhash64("opening"))
    mark = lambda bit: F.col("r_marks").bitwiseAND(bit) != 0
    u_lang, r_lang = F.col("u_marks").bitwiseAND(15), F.col("r_marks").bitwiseAND(15)
    asked_for = F.shiftright(F.col("u_marks"), ASKS).bitwiseAND(F.expr("shiftleft(1, greatest((r_marks & 15) - 1, 0))")) != 0
    wrong = (u_lang > 0) & (r_lang > 0) & (u_lang != r_lang) & ~asked_for
    copy = (F.col("u_key") == F.col("r_key")) & (F.col("u_letters") == F.col("r_letters")) & (F.col("r_letters") > 0)
    sure = F.when(mark(EMPTY), F.when(~F.col("has_files"), "empty").otherwise("none")).when(copy, "copy").when(mark(EARLY), "truncated")
    ex = ex.withColumn("sure", sure).withColumn("wrong", F.when(wrong, "wrong_language"))

    # Only responses that their own features leave open, and that have a last item or nothing but an opening, are looked up.
    open_ = F.col("sure").isNull() & (F.col("last_item").isNotNull() | mark(ALONE) & F.col("opening").isNotNull())
    asks = ex.where(open_).join(small(cut_items(messages, ex)), "last_item", "left").join(small(refusing(ex, recurs).withColumn("refuses", F.lit(True))), "okey", "left")
    looked = asks.select("response_id", "conversation_id", F.when(F.col("item_cut"), "truncated").when(F.col("refuses") & mark(ALONE), "refusal").otherwise(F.col("wrong")).alias("defect"))
    told = ex.where(~open_).select("response_id", "conversation_id", F.coalesce("sure", "wrong").alias("defect"))
    found = told.union(looked).where("defect is not null and defect <> 'none'").withColumn("salt", F.pmod(F.xxhash64("response_id"), F.lit(SALT)).cast("int"))

    # One conversation may hold a third of all rows: the join is spread over SALT copies of the broken ids.
    broken = verdict.where("defect = 'broken'").select("conversation_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return found.join(broken, ["conversation_id", "salt"], "left_anti").select("response_id", "defect")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """response_id and defect of each defective response in messages."""
    return defects(*_tables(spark, sf_dir))

"""Text search over messages: all-term substring search with scores and snippets, ranked search, co-occurrence, term counts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlode.functions import text, timeutil
from chatlode.operators.classify import STOP, STOPS_SQL
from chatlode.operators.registry import MESSAGES_SQL as M
from chatlode.operators.registry import ROLES_SQL as R
from chatlode.operators.registry import query
from chatlode.session import table

CJK_RUN = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}]"
TERMS = ("memory", "leak")
#: Candidates that the scored search ranks, newest first.
CANDIDATES = 4000


def parse_terms(q: str) -> list[str]:
    """Terms of a query: quoted phrases first, then words without field prefix, sign and trailing star; operators are
    dropped, repeats (in any case) too, the order stays."""
    found, rest = re.findall(r'"([^"]+)"', q), re.sub(r'"[^"]*"?', " ", q)
    for w in rest.split():
        w = re.sub(r"^[+\-]+", "", w)
        w = re.sub(r"^\w+:(?=\S)", "", w).rstrip("*")
        if w and w.upper() not in ("AND", "OR", "NOT", "NEAR"):
            found.append(w)
    seen, out = set(), []
    for w in (w.strip() for w in found):
        if w and w.lower() not in seen:
            seen.add(w.lower())
            out.append(w)
    return out


def holds(col: Column, term: str) -> Column:
    """Whether a text holds a term, in any case; false for null."""
    return F.coalesce(F.contains(F.lower(col), F.lit(term.lower())), F.lit(False))


def hits(col: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term in a text, in any case; 0 for null."""
    t = F.lower(F.coalesce(col, F.lit("")))
    return ((F.length(t) - F.length(F.replace(t, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("long")


def first_hit(col: Column, terms) -> Column:
    """1-based place of the earliest occurrence of any term; 0 for none."""
    at = [F.nullif(F.locate(t.lower(), F.lower(F.coalesce(col, F.lit("")))), F.lit(0)) for t in terms]
    return F.coalesce(F.array_min(F.array(*at)), F.lit(0))


def snippet(col: Column, at: Column, width: int = 180) -> Column:
    """`width` characters from a third of it before place `at` (1-based), cut sides marked, whitespace collapsed."""
    start = F.greatest(F.lit(1), at - width // 3)
    cut = F.substring(col, start, F.lit(width))
    text = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start - 1 + width < F.length(col), "…").otherwise(""))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def all_terms(terms) -> Column:
    """Whether text or thinking holds each of the terms."""
    return reduce(lambda a, b: a & b, [holds(F.col("text"), t) | holds(F.col("thinking"), t) for t in terms])


def search(messages: DataFrame, conversations: DataFrame, terms, limit: int = 30, candidates: int = CANDIDATES) -> DataFrame:
    """Messages (with their instants `ts`) that hold all terms in text or thinking: the newest `candidates`, scored by hits in text, half the hits in
    thinking and 3 for each term in the title, best first, then oldest. The two limits are the feature."""
    m = messages.where(all_terms(terms))
    top = m.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(candidates)
    titles = conversations.groupBy("conversation_id").agg(F.min("title").alias("title"))
    j = top.join(titles, "conversation_id", "left")
    score = reduce(lambda a, b: a + b, [hits(F.col("text"), t) + hits(F.col("thinking"), t) * 0.5 + F.when(holds(F.col("title"), t), 3).otherwise(0) for t in terms])
    in_text = first_hit(F.col("text"), terms)
    snip = F.when(in_text > 0, snippet(F.col("text"), in_text)).otherwise(F.concat(F.lit("💭 "), snippet(F.col("thinking"), first_hit(F.col("thinking"), terms))))
    return j.select("id", "conversation_id", score.cast("double").alias("score"), snip.alias("snippet"), "ts").orderBy(F.desc("score"), F.asc_nulls_last("ts"), "id").limit(limit).drop("ts")


def _sql_hits(c, t):
    return f"CAST((length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), '{t}', ''))) / {len(t)} AS BIGINT)"


def _sql_snip(c, at):
    s = f"greatest(1, {at} - 60)"
    return f"trim(regexp_replace(CASE WHEN {s} > 1 THEN '…' ELSE '' END || substr({c}, {s}, 180) || CASE WHEN {s} - 1 + 180 < length({c}) THEN '…' ELSE '' END, '[ \\t\\r\\n]+', ' ', 'g'))"


_at = lambda c: "coalesce(least(" + ", ".join(f"nullif(instr(lower(coalesce({c}, '')), '{t}'), 0)" for t in TERMS) + "), 0)"


@query(
    "t3_search_scored",
    f"WITH c AS (SELECT * FROM {M} WHERE "
    + " AND ".join(f"(contains(lower(coalesce(text, '')), '{t}') OR contains(lower(coalesce(thinking, '')), '{t}'))" for t in TERMS)
    + f" ORDER BY ts DESC NULLS LAST, id DESC LIMIT {CANDIDATES}), t AS (SELECT conversation_id, min(title) AS title FROM conversations GROUP BY conversation_id) SELECT id, conversation_id, CAST("
    + " + ".join(f"{_sql_hits('text', t)} + {_sql_hits('thinking', t)} * 0.5 + CASE WHEN contains(lower(coalesce(title, '')), '{t}') THEN 3 ELSE 0 END" for t in TERMS)
    + f" AS DOUBLE) AS score, CASE WHEN {_at('text')} > 0 THEN {_sql_snip('text', _at('text'))} ELSE '💭 ' || {_sql_snip('thinking', _at('thinking'))} END AS snippet FROM c LEFT JOIN t USING (conversation_id) ORDER BY score DESC, ts ASC NULLS LAST, id LIMIT 30",
)
def search_scored(spark, d):
    return search(timeutil.messages(spark, d, all_terms(TERMS)), table(spark, d, "conversations"), TERMS)


@query("f2_search_all_terms", "SELECT id FROM messages WHERE " + " AND ".join(f"(contains(lower(coalesce(text, '')), '{t}') OR contains(lower(coalesce(thinking, '')), '{t}'))" for t in TERMS))
def search_all_terms(spark, d):
    return table(spark, d, "messages").where(all_terms(TERMS)).select("id")


@query(
    "f1_filtered_search",
    f"SELECT id FROM {M} WHERE rl = 'user' AND source = 'gemini' AND lt >= TIMESTAMP '2025-01-01' AND lt < TIMESTAMP '2025-07-01' AND contains(lower(text), '数据')",
)
def filtered_search(spark, d, role="user", source="gemini", first="2025-01-01", last="2025-06-30", term="数据"):
    """Role, source and half-open local date range, then the term; the source filter reaches the scan."""
    m = timeutil.messages(spark, d, (F.col("source") == source) & (text.role(F.col("role")) == role) & holds(F.col("text"), term))
    return m.where((F.col("lt") >= F.lit(first).cast("timestamp_ntz")) & (F.col("lt") < F.date_add(F.lit(last), 1).cast("timestamp_ntz"))).select("id")


@query("f12_has_cjk", "SELECT source, count(*) FILTER (regexp_matches(coalesce(text, ''), '[\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}]')) AS cjk, count(*) AS n FROM messages GROUP BY source")
def has_cjk(spark, d):
    return table(spark, d, "messages").groupBy("source").agg(F.count_if(F.coalesce("text", F.lit("")).rlike(CJK_RUN)).alias("cjk"), F.count("*").alias("n"))


@query(
    "a14_cooccurrence",
    "SELECT count(*) AS messages, count(DISTINCT conversation_id) AS conversations FROM messages WHERE conversation_id IN (SELECT conversation_id FROM conversations) AND "
    + " AND ".join(f"(contains(lower(coalesce(text, '')), '{t}') OR contains(lower(coalesce(thinking, '')), '{t}'))" for t in ("login endpoint", "build cache")),
)
def cooccurrence(spark, d, a="login endpoint", b="build cache"):
    """Messages and conversations that hold both terms, of listed conversations."""
    m = table(spark, d, "messages")
    both = m.where((holds(m.text, a) | holds(m.thinking, a)) & (holds(m.text, b) | holds(m.thinking, b)))
    listed = table(spark, d, "conversations").select("conversation_id").distinct()
    return both.join(listed, "conversation_id", "left_semi").agg(F.count("*").alias("messages"), F.countDistinct("conversation_id").alias("conversations"))


_WORDS = r"[A-Za-z][A-Za-z0-9_+#.-]{2,}"


@query("a15_terms", f"WITH w AS (SELECT lower(unnest(regexp_extract_all(t, '{_WORDS}'))) AS term FROM (SELECT unnest([text, thinking]) AS t FROM messages)) SELECT term, count(*) AS n FROM w WHERE term NOT IN ({STOPS_SQL}) GROUP BY term HAVING count(*) >= 5 ORDER BY n DESC, term LIMIT 100")
def terms(spark, d, least=5, top=100):
    """Most frequent words of texts and reasoning; counted by partial aggregation, only the top reaches one task."""
    t = table(spark, d, "messages").select(F.explode(F.array("text", "thinking")).alias("t"))
    w = t.select(F.explode(F.regexp_extract_all("t", F.lit(_WORDS), 0)).alias("w")).select(F.lower("w").alias("term"))
    return w.where(~F.col("term").isin(*STOP)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(top)


@query(
    "a15_bigrams",
    "WITH r AS (SELECT unnest(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]{2,}')) AS run FROM messages), g AS (SELECT substr(run, CAST(i AS BIGINT), 2) AS term FROM (SELECT run, unnest(range(1, length(run))) AS i FROM r)) SELECT term, count(*) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 100",
)
def bigrams(spark, d, n=2, top=100):
    """Most frequent CJK n-grams, sliding over runs."""
    runs = table(spark, d, "messages").select(F.explode(F.regexp_extract_all("text", F.lit(rf"[\x{{4E00}}-\x{{9FFF}}]{{{n},}}"), 0)).alias("run"))
    g = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - (n - 1)), lambda i: F.substring("run", i, F.lit(n)))).alias("term"))
    return g.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def bm25(df: DataFrame, key: str, text: Column, terms, top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Texts that hold all `terms`, by BM25. Only the terms of the query are expanded; lengths and their mean come from one
    pass over all texts."""
    count = lambda t: F.size(F.filter("ws", lambda w: w == F.lit(t)))
    tf = [count(t).alias(f"tf{i}") for i, t in enumerate(terms)]

    def counted(rows):
        words = rows.select(F.col(key), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), 0).alias("ws"))
        return words.select(key, F.size("ws").alias("len"), *tf)

    total = counted(df).agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = counted(df.where(reduce(lambda a, c: a & c, [holds(text, t) for t in terms])))  # only these are cut into words again
    hit = hit.where(reduce(lambda a, c: a & c, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    j = hit.join(F.broadcast(total), F.col("docs") >= 0)  # one row
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return j.select(key, F.round(reduce(lambda a, c: a + c, [part(i) for i in range(len(terms))]), 6).alias("score")).orderBy(F.desc("score"), F.desc(key)).limit(top)


_BM_TERMS = ("retry", "loop")
_BM_PART = lambda t, i: f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))"


@query(
    "t2_ranked_search",
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents), k AS (SELECT doc_id, len(ws) AS len, "
    + ", ".join(f"len(list_filter(ws, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_BM_TERMS))
    + " FROM w), g AS (SELECT count(*) AS docs, avg(len) AS mean, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(2)) + " FROM k) SELECT doc_id, round("
    + " + ".join(_BM_PART(t, i) for i, t in enumerate(_BM_TERMS)) + ", 6) AS score FROM k, g WHERE " + " AND ".join(f"tf{i} > 0" for i in range(2)) + " ORDER BY score DESC, doc_id DESC LIMIT 20",
)
def ranked_search(spark, d):
    return bm25(table(spark, d, "documents"), "doc_id", F.col("text"), _BM_TERMS)


@query("f3_title_filter", "SELECT conversation_id, title FROM conversations WHERE contains(lower(title), 'notes') OR contains(lower(conversation_id), 'notes')")
def title_filter(spark, d, term="notes"):
    c = table(spark, d, "conversations")
    return c.where(holds(c.title, term) | holds(c.conversation_id, term)).select("conversation_id", "title")


@query("x16_preview", f"SELECT conversation_id, arg_min(trim(replace(substr(text, 1, 160), chr(10), ' '), ' '), (coalesce(message_index, 2147483647), id)) AS preview FROM {R} WHERE rl = 'user' AND text IS NOT NULL GROUP BY conversation_id")
def preview(spark, d):
    """First user message of each conversation in 160 characters: by index, those without one last, then by id."""
    m = timeutil.roles(table(spark, d, "messages")).where("rl = 'user' and text is not null")
    at = F.struct(F.coalesce("message_index", F.lit(2**31 - 1)), "id")
    return m.groupBy("conversation_id").agg(F.min_by(F.trim(F.replace(F.substring("text", 1, 160), F.lit("\n"), F.lit(" "))), at).alias("preview"))


def mark_html(col: Column, terms) -> Column:
    """Text escaped for HTML with the terms, longest first and in any case, in <mark>."""
    e = col
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    alt = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(e, f"(?iu)({alt})", "<mark>$1</mark>")


@query("x9_mark_html", "SELECT id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '(memory|leak)', '<mark>\\1</mark>', 'gi') AS html FROM messages WHERE contains(lower(text), 'memory leak')")
def marked(spark, d):
    m = table(spark, d, "messages")
    return m.where(holds(m.text, "memory leak")).select("id", mark_html(m.text, TERMS).alias("html"))


# Patterns of personal data that are masked by as many stars, in this order.
MASKS = [
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"(?<![0-9A-Za-z])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?![0-9A-Za-z])",
    r"(?<!\d)1[3-9]\d{9}(?!\d)",
    r"(?<!\d)0\d{2,3}[-\s]?\d{7,8}(?!\d)",
    r"(?<!\d)\d{16,19}(?!\d)",
    r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    r"\b(?:sk-[A-Za-z0-9_\-]{10,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{12,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{20,})\b",
]


def mask_equal_length(df: DataFrame, col: str) -> DataFrame:
    """`df` with `col` masked: every match of the patterns becomes stars of its length. Each pattern costs one split and one
    extraction; all stays in built-in expressions."""
    from chatlode.functions.text import bound

    for p in MASKS:
        found = F.regexp_extract_all(col, F.lit(p), 0)
        stars = F.transform(found, lambda m: F.repeat(F.lit("*"), F.length(m)))
        parts = F.split(F.col(col), p, -1)
        joined = F.array_join(F.zip_with(parts, stars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        df = bound(df, "_m", F.when(F.col(col).rlike(p), joined).otherwise(F.col(col))).drop(col).withColumnRenamed("_m", col)
    return df


@query("x21_mask", None)
def mask(spark, d):
    """Documents' texts with personal data starred out; the patterns look around, which the SQL engine can't."""
    return mask_equal_length(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("x21_mask_email", r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]', 'g') AS text FROM documents")
def mask_email(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", MASKS[0], "[email]").alias("text"))


@query("x1_norm_text", None)
def norm_text(spark, d):
    """Compatibility-composed, lower-case text with collapsed whitespace, by an Arrow batch function: there is no built-in
    for the normal form."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    t = F.regexp_replace(nfkc("text"), "[\\x{200B}\\x{FEFF}]", "")
    return table(spark, d, "messages").select("id", F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " "))).alias("text"))


@query("x2_slug", r"SELECT conversation_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT conversation_id, substr(trim(regexp_replace(regexp_replace(coalesce(title, ''), '[\\/:*?\"<>|]+', ' ', 'g'), '[ \t\r\n]+', '-', 'g'), '-.'), 1, 60) AS s FROM conversations)")
def slug(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), r'[\\/:*?"<>|]+', " "), r"[ \t\r\n]+", "-")
    s = F.substring(F.btrim(t, F.lit("-.")), 1, 60)
    return table(spark, d, "conversations").select("conversation_id", F.when(s == "", "untitled").otherwise(s).alias("slug"))


@query("x18_demoted_headings", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)<details>.*?</details>\s*', '', 'g'), '(^|\n)(#{1,5} )', '\1#\2', 'g') AS text FROM documents")
def demoted(spark, d):
    """Markdown without reasoning, its headings one level lower."""
    plain = F.regexp_replace("text", r"(?s)<details>.*?</details>\s*", "")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(plain, r"(^|\n)(#{1,5} )", "$1#$2").alias("text"))


def plain_of_html(col: Column) -> Column:
    """The text that `mark_html` was made from."""
    e = F.regexp_replace(col, "</?mark>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


@query("x19_plain", "SELECT id, text FROM messages WHERE contains(lower(text), 'memory leak') AND NOT regexp_matches(text, '</?mark>')")
def plain(spark, d):
    """Marked texts back in plain form."""
    m = table(spark, d, "messages")
    m = m.where(holds(m.text, "memory leak") & ~m.text.rlike("</?mark>"))
    return m.select("id", plain_of_html(mark_html(m.text, TERMS)).alias("text"))


_BOTH = ("login endpoint", "build cache")


@query("a14_samples", f"SELECT id, conversation_id FROM {M} WHERE " + " AND ".join(f"(contains(lower(coalesce(text, '')), '{t}') OR contains(lower(coalesce(thinking, '')), '{t}'))" for t in _BOTH) + " ORDER BY ts DESC NULLS LAST, id DESC LIMIT 5")
def cooccurrence_samples(spark, d, most=5):
    """The latest messages that hold both terms; the limit is the feature."""
    m = timeutil.messages(spark, d, all_terms(_BOTH))
    return m.orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(most).select("id", "conversation_id")

"""Rules over whole conversations: a value with its reasons, the kind, topics, a summary. One aggregation each, no window over
a conversation's messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlode.functions import timeutil
from chatlode.operators.enrichment import FILLER, INDENTED
from chatlode.operators.registry import ROLES_SQL as R
from chatlode.operators.registry import query
from chatlode.session import table

# Words by which a conversation is given a kind, in order of precedence on ties.
KINDS = {
    "技术": "代码|编程|程序|python|java|javascript|typescript|node|rust|golang|linux|unix|bash|shell|docker|kubernetes|git|nginx|redis|报错|错误|error|traceback|bug|编译|部署|服务器|接口|函数|脚本|正则|数据库|配置|安装|驱动|内核|终端|命令行|算法",
    "创作": "写一首|写一段|写一个|写篇|小说|故事|诗|文案|剧本|起名|取名|翻译|润色|改写|扩写|续写|生成一|标题|演讲稿|邮件|简历",
    "学习": "学习|教程|原理|解释一下|解释下|为什么|怎么理解|概念|数学|证明|物理|化学|历史|英语|单词|考试|复习|笔记|入门|区别|对比",
    "工作": "工作|项目|需求|会议|汇报|方案|排期|加班|老板|领导|同事|面试|求职|合同|工资|绩效|任务|计划|目标",
    "生活": "天气|吃饭|吃什么|推荐|买|购物|旅行|旅游|电影|音乐|游戏|健康|运动|锻炼|睡眠|失眠|菜谱|做饭|装修|手机|电脑|价格",
    "情绪": "难过|焦虑|开心|郁闷|烦|压力|情绪|睡不着|孤独|害怕|生气|愤怒|失望|崩溃|累|痛苦|心情|难受|想哭",
    "查询": "是什么|多少|什么时候|哪里|查一下|搜索|谁是|几点|怎么查|有没有",
    "闲聊": "你好|在吗|哈哈|谢谢|再见|无聊|聊天|晚安|早安|讲个笑话",
}
# Words of the first kind that count only on their own.
WHOLE = "sql|api"
OTHER = "其他"
# Words that are no topics.
STOP = (
    "什么 怎么 可以 这个 那个 现在 如果 就是 没有 但是 因为 所以 一个 我们 你们 他们 自己 这样 那样 还是 已经 应该 需要 可能 知道 问题 使用 进行 通过 以及 或者 然后 时候 一下 不是 不能 如何 哪些 为什么 请问 "
    "帮我 给我 看看 这里 那里 这些 那些 感觉 觉得 任何 the and for you are with that this have from not but can will how what when was were has its it's about would could should there their been"
).split()
STOPS_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)
# Words that tell of errors.
ERRORS = "报错|错误|失败|崩溃|异常|无法|不能|不对|Error|Traceback|Exception|failed|failure|bug"
TABLED = r"(?m)^[ \t]*\|.*\|[ \t\r]*$"
LISTED = r"(?m)^ {0,3}(#{1,6}[ \t]+[^ \t\r\n]|[-*+][ \t]+[^ \t\r\n]|[0-9]+[.)、][ \t]*[^ \t\r\n])"
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_flat = lambda c: F.regexp_replace(F.regexp_replace(c, _WS + "+", " "), "^ | $", "")
_flat_sql = lambda c: f"regexp_replace(regexp_replace({c}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"
_NO_WORD = r"[^\p{L}\p{N}_]"
_AT_SQL = "(coalesce(message_index, 2147483647), id)"


def _said() -> tuple:
    t = _flat(F.coalesce("text", F.lit("")))
    return t, (t == "") | t.rlike(FILLER)


_GATHERED_SQL = (
    f"SELECT conversation_id, count(*) AS n, count(*) FILTER (rl = 'user') AS users, count(*) FILTER (rl IS DISTINCT FROM 'user') AS others, CAST(coalesce(sum(length(text)) FILTER (rl = 'user'), 0) AS BIGINT) AS user_chars, CAST(coalesce(sum(length(text)) FILTER (rl IS DISTINCT FROM 'user'), 0) AS BIGINT) AS other_chars, "
    f"coalesce(bool_or(contains(text, '```') OR regexp_matches(text, '{INDENTED}')), false) AS has_code, coalesce(bool_or(rl IS DISTINCT FROM 'user' AND (regexp_matches(text, '{LISTED}') OR regexp_matches(text, '{TABLED}'))), false) AS structured, "
    f"coalesce(bool_or(len(attachments) > 0), false) AS has_files, coalesce(bool_or({_flat_sql('thinking')} <> ''), false) AS has_thinking, CAST(coalesce(sum(len(regexp_extract_all(text, '(?i){ERRORS}'))), 0) AS BIGINT) AS error_hits, "
    f"count(*) FILTER (rl = 'user' AND (coalesce({_flat_sql('text')}, '') = '' OR regexp_matches({_flat_sql('text')}, '{FILLER}'))) AS fillers FROM {R} WHERE conversation_id IS NOT NULL GROUP BY conversation_id"
)


def gathered(spark, d) -> DataFrame:
    """Counts and signs of each conversation: roles, characters, code, structure, attachments, reasoning, errors, fillers."""
    m = timeutil.roles(table(spark, d, "messages")).where("conversation_id is not null")
    user = F.coalesce(F.col("rl") == "user", F.lit(False))
    chars = lambda c: F.coalesce(F.sum(F.when(c, F.length("text"))), F.lit(0))
    _, filler = _said()
    return m.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count_if(user).alias("users"), F.count_if(~user).alias("others"), chars(user).alias("user_chars"), chars(~user).alias("other_chars"),
        F.coalesce(F.bool_or(F.contains("text", F.lit("```")) | F.col("text").rlike(INDENTED)), F.lit(False)).alias("has_code"),
        F.coalesce(F.bool_or(~user & (F.col("text").rlike(LISTED) | F.col("text").rlike(TABLED))), F.lit(False)).alias("structured"),
        F.coalesce(F.bool_or(F.size("attachments") > 0), F.lit(False)).alias("has_files"), F.coalesce(F.bool_or(_flat(F.col("thinking")) != ""), F.lit(False)).alias("has_thinking"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit("(?i)" + ERRORS))), F.lit(0)).alias("error_hits"), F.count_if(user & filler).alias("fillers"),
    )


@query("h2_flags", f"SELECT * EXCLUDE (n, other_chars, fillers) FROM ({_GATHERED_SQL})")
def flags(spark, d):
    return gathered(spark, d).drop("n", "other_chars", "fillers")


# What adds to the value of a conversation and takes from it, in the order of the reasons.
SCORES = [
    ("has_code AND other_chars >= 1200", 2, "含代码且产出较多+2"),
    ("user_chars >= 1500", 1, "用户输入量大+1"),
    ("structured", 1, "结构化输出+1"),
    ("has_files", 1, "带附件+1"),
    ("NOT has_files AND has_thinking", 1, "模型深度思考+1"),
    ("n >= 20 AND other_chars >= 4000", 1, "长对话+1"),
    ("n <= 2", -1, "仅1-2条-1"),
    ("users >= 3 AND fillers * 2 >= users", -1, "多为填充语-1"),
    ("user_chars < 40 AND users <= 2", -1, "用户几乎没输入-1"),
]
_POINTS = "CAST(greatest(0, least(5, 1 + " + " + ".join(f"CASE WHEN {c} THEN {k} ELSE 0 END" for c, k, _ in SCORES) + ")) AS INT)"
_REASONS = "coalesce(nullif(concat_ws('、', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in SCORES) + "), ''), '无突出信号')"
_VALUE_SQL = f"SELECT conversation_id, {_POINTS} AS value, {_POINTS} >= 3 AS keep, {_REASONS} AS reason FROM ({_GATHERED_SQL})"


@query("h6_value", _VALUE_SQL)
def value(spark, d):
    """Value from 0 to 5 of each conversation, whether it is worth keeping, and why."""
    return gathered(spark, d).select("conversation_id", F.expr(_POINTS).alias("value"), F.expr(_POINTS + " >= 3").alias("keep"), F.expr(_REASONS).alias("reason"))


# RE2 knows ASCII word edges only: letters of other scripts become one of ASCII before words on their own are counted.
_EDGED = r"regexp_replace(regexp_replace(t, '[^\p{L}\p{N}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', 'q', 'g')"
_KIND_SQL = (
    f"WITH t AS (SELECT conversation_id, text AS t FROM {R} WHERE rl = 'user' AND conversation_id IS NOT NULL UNION ALL SELECT conversation_id, title FROM (SELECT conversation_id, min(title) AS title FROM conversations WHERE conversation_id IN (SELECT conversation_id FROM messages) GROUP BY 1) UNION ALL SELECT DISTINCT conversation_id, '' FROM messages WHERE conversation_id IS NOT NULL), "
    "k AS (SELECT conversation_id, " + ", ".join(f"coalesce(sum(len(regexp_extract_all(t, '(?i){p}'))" + (rf" + len(regexp_extract_all({_EDGED}, '(?i)\b(?:{WHOLE})\b'))" if i == 0 else "") + f"), 0) AS k{i}" for i, p in enumerate(KINDS.values())) + " FROM t GROUP BY 1) "
    "SELECT conversation_id, CASE WHEN greatest(" + ", ".join(f"k{i}" for i in range(len(KINDS))) + f") = 0 THEN '{OTHER}' " + " ".join(f"WHEN k{i} = greatest(" + ", ".join(f"k{j}" for j in range(len(KINDS))) + f") THEN '{k}'" for i, k in enumerate(KINDS)) + " END AS kind FROM k"
)


def _texts(spark, d) -> DataFrame:
    """conversation_id, t, title: the user messages, and the title, of each conversation that has messages."""
    m = timeutil.roles(table(spark, d, "messages")).where("conversation_id is not null")
    said = m.select("conversation_id", F.when(F.col("rl") == "user", F.col("text")).alias("t"), F.lit(False).alias("title"))
    titles = table(spark, d, "conversations").groupBy("conversation_id").agg(F.min("title").alias("t")).join(m.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return said.union(titles.select("conversation_id", "t", F.lit(True)))


@query("h7_kind", _KIND_SQL)
def kind(spark, d):
    """Kind of each conversation: the one with most hits in its title and user messages; the first one on ties."""
    counts = [F.regexp_count("t", F.lit("(?i)" + p)) for p in KINDS.values()]
    counts[0] = counts[0] + F.regexp_count("t", F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{WHOLE})(?![\p{{L}}\p{{N}}_])"))
    k = _texts(spark, d).groupBy("conversation_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"k{i}") for i, c in enumerate(counts)])
    most = F.greatest(*[F.col(f"k{i}") for i in range(len(KINDS))])
    found = reduce(lambda w, x: w.when(F.col(f"k{x[0]}") == most, x[1]), enumerate(KINDS), F.when(most == 0, OTHER))
    return k.select("conversation_id", found.alias("kind"))


@query("a25_value_kind", f"SELECT v.value, k.kind, count(*) AS n FROM ({_VALUE_SQL}) v JOIN ({_KIND_SQL}) k USING (conversation_id) GROUP BY 1, 2")
def value_kind(spark, d):
    """Conversations of each value and kind."""
    return value(spark, d).join(kind(spark, d), "conversation_id").groupBy("value", "kind").agg(F.count("*").alias("n"))


_TOKENS = r"[\x{4E00}-\x{9FFF}]{2,6}|[A-Za-z][A-Za-z0-9_+#.-]{2,}"


@query(
    "h9_topics",
    f"WITH t AS (SELECT conversation_id, text AS t FROM {R} WHERE rl = 'user' AND conversation_id IS NOT NULL UNION ALL SELECT conversation_id, title FROM (SELECT conversation_id, min(title) AS title FROM conversations WHERE conversation_id IN (SELECT conversation_id FROM messages) GROUP BY 1)), "
    f"w AS (SELECT conversation_id, lower(unnest(regexp_extract_all(t, '{_TOKENS}'))) AS term FROM t), c AS (SELECT conversation_id, term, count(*) AS n FROM w WHERE term NOT IN ({STOPS_SQL}) GROUP BY 1, 2), "
    "s AS (SELECT c.*, n + CASE WHEN contains(lower(coalesce(title, '')), term) THEN 3 ELSE 0 END AS score FROM c LEFT JOIN (SELECT conversation_id, min(title) AS title FROM conversations GROUP BY 1) x USING (conversation_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, term DESC) AS r FROM s) "
    "SELECT conversation_id, CAST(r AS INTEGER) AS r, substr(term, 1, 24) AS term, n FROM r WHERE r <= 5 "
    f"UNION ALL SELECT conversation_id, 1, kind, 0 FROM ({_KIND_SQL}) WHERE kind <> '{OTHER}' AND conversation_id NOT IN (SELECT conversation_id FROM c)",
)
def topics(spark, d, top=5):
    """Most frequent words and CJK chunks of each conversation's title and user messages, those of the title ahead, later ones
    first on ties; its kind where it has none. Only the best of each part of a conversation's words meet in one task."""
    w = _texts(spark, d).select("conversation_id", F.explode(F.regexp_extract_all("t", F.lit(_TOKENS), 0)).alias("w")).select("conversation_id", F.lower("w").alias("term"))
    c = w.where(~F.col("term").isin(*STOP)).groupBy("conversation_id", "term").agg(F.count("*").alias("n"))
    titles = table(spark, d, "conversations").groupBy("conversation_id").agg(F.lower(F.coalesce(F.min("title"), F.lit(""))).alias("title"))
    score = F.col("n") + F.when(F.contains(F.coalesce("title", F.lit("")), F.col("term")), 3).otherwise(0)
    s = c.join(titles, "conversation_id", "left").select("conversation_id", "term", "n", score.alias("score"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("part"))
    best = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy("conversation_id", *by).orderBy(F.desc("score"), F.desc("term")))).where(F.col("r") <= top)
    found = best(best(s, "part").drop("r")).select("conversation_id", "r", F.substring("term", 1, 24).alias("term"), "n")
    none = kind(spark, d).where(F.col("kind") != OTHER).join(found.select("conversation_id"), "conversation_id", "left_anti")
    return found.union(none.select("conversation_id", F.lit(1), "kind", F.lit(0)))


@query(
    "h10_summary",
    f"WITH u AS (SELECT conversation_id, count(*) AS n, arg_min({_flat_sql('text')}, {_AT_SQL}) FILTER (rl = 'user' AND coalesce({_flat_sql('text')}, '') <> '' AND NOT regexp_matches({_flat_sql('text')}, '{FILLER}')) AS says, arg_min(coalesce({_flat_sql('text')}, ''), {_AT_SQL}) FILTER (rl = 'user') AS any_ FROM {R} WHERE conversation_id IS NOT NULL GROUP BY 1) "
    "SELECT conversation_id, substr(CASE WHEN coalesce(says, any_, '') <> '' THEN substr(coalesce(says, any_), 1, 42) || ' · ' || n || '条' ELSE n || ' 条消息' END, 1, 60) AS summary FROM u",
)
def summary(spark, d):
    """First user message that says something, else the first, in 42 characters, and the number of messages."""
    m = timeutil.roles(table(spark, d, "messages")).where("conversation_id is not null")
    t, filler = _said()
    user = F.col("rl") == "user"
    at = F.struct(F.coalesce("message_index", F.lit(2**31 - 1)), "id")
    g = m.groupBy("conversation_id").agg(F.count("*").cast("string").alias("n"), F.min_by(t, F.when(user & ~filler, at)).alias("says"), F.min_by(t, F.when(user, at)).alias("any"))
    first = F.coalesce("says", "any", F.lit(""))
    text = F.when(first != "", F.concat(F.substring(first, 1, 42), F.lit(" · "), F.col("n"), F.lit("条"))).otherwise(F.concat(F.col("n"), F.lit(" 条消息")))
    return g.select("conversation_id", F.substring(text, 1, 60).alias("summary"))

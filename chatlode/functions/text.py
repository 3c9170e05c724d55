"""Text expressions shared by the operators; all are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the roles in the exports.
ASSISTANT_ALIASES = ("assistant", "model", "ai", "bot", "gemini", "response")
USER_ALIASES = ("user", "human", "me", "prompt")

#: Whitespace and characters that show nothing: controls, formats, separators, fillers, variation selectors.
INVISIBLE = r"[\p{Z}\p{C}\s\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{034F}\x{2800}]+"


def role(col: Column) -> Column:
    """Role read through its aliases, in lower case; other roles are kept, null stays null."""
    r = F.lower(F.trim(col))
    return F.when(r.isin(*ASSISTANT_ALIASES), "assistant").when(r.isin(*USER_ALIASES), "user").otherwise(r)


def blank(col: Column) -> Column:
    """True for null and for texts of whitespace and invisible characters only."""
    return F.coalesce(~col.rlike(rf"[^{INVISIBLE[1:-2]}]"), F.lit(True))


# Half-width forms and the full-width letters they stand for.
_HALF = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ｡｢｣､･"
_WIDE = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン。「」、・"
_VOICED = dict(zip("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎｳ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"))
_POPPED = dict(zip("ﾊﾋﾌﾍﾎ", "パピプペポ"))


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with `value` computed once as column `name`: a generator of one row, so that no filter or projection above
    it copies the expression into each place that uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_one_width(df: DataFrame, name: str, col: Column) -> DataFrame:
    """`df` with column `name`: `col` with full-width Latin, digits and signs in ASCII and half-width kana in full width."""
    df = bound(df, name, col)
    t = kana = F.col(name)
    for marks, mark in ((_VOICED, "ﾞ"), (_POPPED, "ﾟ")):
        for half, wide in marks.items():
            kana = F.replace(kana, F.lit(half + mark), F.lit(wide))
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　￠￡￥￦"
    thin = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ¢£¥₩"
    wide = F.when(t.rlike("[｡-ﾟ]"), F.translate(F.translate(kana, _HALF, _WIDE), full, thin)).when(t.rlike("[　！-～￠-￦]"), F.translate(t, full, thin)).otherwise(t)
    return bound(df, name, wide)


def letters_key(wide: Column) -> Column:
    """Letters, digits and symbols of a text of one width, in one case: whitespace, punctuation and invisible signs are gone."""
    plain = F.regexp_replace(wide, r"[^\p{L}\p{N}\p{M}\p{S}]+|[`^~|\x{00B4}\x{3164}\x{115F}\x{1160}\x{FE00}-\x{FE0F}]+", "")
    return F.replace(F.lower(F.upper(plain)), F.lit("ß"), F.lit("ss"))

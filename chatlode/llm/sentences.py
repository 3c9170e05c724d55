"""Sentence boundaries across languages and scripts.

A text is cut into blocks (headings, list items, paragraphs; fenced code is left out). Inside a block the places where a
sentence may end form a lattice: runs of terminators outside quotations and brackets, closers of quotations and brackets
that hold a terminator, and, in Thai, spaces. Each place is an edge to keep or drop, decided by what stands before it
(abbreviations, ordinals, initials, final particles) and after it (case, opening words, particles that carry a sentence on).
The whole run of spaceless script before or behind a gap is read by a dictionary word lattice, so that particles count as
words only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chatlode.session import table

# Abbreviations by what may follow them.
#: A name or a noun follows, so the sentence goes on.
TITLES = set("dr mr mrs ms prof st sr sra srta dra d dña m mme mlle mm hr hrn fr frl rev gen col capt lt sgt hon ing lic dipl sen gov pres mt vgl inkl exkl zzgl sog sogen gegr geb ehem max min bzw vs cf ca approx aprox appr etwa env ej p.ej i.e e.g z.b d.h u.a o.ä s.o s.u i.d.r v.a viz incl resp".split())
#: A number follows; before anything else the sentence may end.
NUMBERED = set("no nos nr nrn fig figs abb tab kap art arts chap sec eq vol pp pg p s bd pág págs núm núms cap num n aufl jan feb mar apr jun jul aug sep sept oct nov dec okt dez janv févr avr juil déc ene abr ago dic".split())
#: Often the end of a sentence; before a capital it is.
OPEN_END = set("etc usw co inc ltd corp bros jr a.m p.m u.s u.k al dgl ff vjh uvm".split())
GERMAN_ORDINAL_BEFORE = set("am dem der den die das des im vom zum zur beim bis ab seit jeden jedes jede nach vor und oder ein eine einen einem einer ihrem seinem diesem ersten".split())
GERMAN_ORDINAL_AFTER = set("januar februar märz april mai juni juli august september oktober november dezember quartal jahrhundert jh kapitel stock etage mal tag woche monat jahr platz klasse auflage".split())
#: Final particles and endings of spaceless scripts: an ellipsis after one ends the sentence.
ZH_FINAL = set("了 吗 呢 吧 啊 呀 嘛 啦 过 矣 罢了 而已 下文".split())
JA_FINAL = ("でした", "ました", "ません", "です", "ます", "だった", "った", "した", "だ", "た", "ね", "よ", "か", "ない")
#: Words that carry a sentence on after a quotation or bracket.
ZH_ON = set("然后 就 便 随后 接着 于是 并 并且 而 而且 之后 后 的 地 是 等 和 与 及 或 也 还 都 才 又 再 说 问 道 喊".split())
JA_ON = set("と って という などと は が を に で の も へ から まで より や か だと".split())
HI_ON = set("उसने उन्होंने ने कहा बोला बोली बोले पूछा और फिर वह मैंने हमने तब".split())
AR_ON = set("ثم و قال قالت وقال فقال ف حين عندما".split())
#: Names that stand in lower case at the start of a sentence.
LOWER_OPENERS = set("npm pip git node yarn bash curl grep sudo iphone ipad ios macos ebay".split())
ZH_SPEAK = re.compile(r"\s*[一-鿿]{1,5}?(?:问|说|道|喊|答|叫|笑|想)")
#: Words of the lattice by which spaceless scripts are read around a gap.
LEXICON = ZH_FINAL | ZH_ON | JA_ON | set(JA_FINAL) | set("后来 后天 就是 是否 等到 再说 还有 都市 地图 和弦 他 她 它 我 你 们 这件事 那么 因为 所以 如果 没有 それ これ その この 何 も そして しかし".split()) | set("ครับ ค่ะ คะ นะ แล้ว และ หรือ แต่ ที่ ซึ่ง เพราะ จะ ได้ ไม่ โดย ว่า กับ ของ".split())
TH_ON = set("และ หรือ ซึ่ง โดย กับ".split())
LONGEST = max(map(len, LEXICON))

OPEN = dict(zip("“„«‹「『《〈（([【〔｢‘", "”“»›」』》〉）)]】〕｣’"))
CLOSERS = set("”“»›」』》〉）)]】〕｣’\"'")
TITLE_MARKS = set("《〈")
ROUND = set("（([【〔")
STRONG = set("。！？｡।॥؟۔‼⁇⁈⁉．")
_PLACE = re.compile(r"[.!?。！？｡।॥؟۔…‼⁇⁈⁉．]+|[“”„«»‹›「」『』《》〈〉（）()\[\]【】〔〕｢｣‘’\"']|[ \t\n\r 　]+(?=[฀-๿])|(?<=[฀-๿])[ \t\n\r 　]+")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦]|\d{1,9}[.)])[ \t]+")
_RULE = re.compile(r"[ \t]*([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_LINE = re.compile(r"[^\n\r]*(?:\r\n|\n|\r|$)")
_RUN_ON = re.compile(r"[“\"¿¡«„]?[A-ZÀ-Þ][^\W\d_]*(?:['’][^\W\d_]+)?[ ,;:]")
_GAP = set("​‌‍⁠﻿")


def _space(ch: str) -> bool:
    return ch.isspace() or ch in _GAP


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    o = ord(ch)
    if 0x0E00 <= o < 0x0E80:
        return "th"
    if 0x3040 <= o < 0x3100 or 0x31F0 <= o < 0x3200:
        return "ja"
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "han"
    if 0x0600 <= o < 0x0780 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00:
        return "ar"
    if 0x0900 <= o < 0x0980:
        return "hi"
    return {"Lu": "up", "Lt": "up", "Ll": "low", "Nd": "num"}.get(unicodedata.category(ch), "mark")


def lattice(run: str) -> list[str]:
    """Words of a run of spaceless script: the path with the fewest unknown characters, then the fewest words."""
    n = len(run)
    best = [(0, 0, 0)] + [(10**9, 0, 0)] * n
    for i in range(n):
        unknown, words, _ = best[i]
        for k in range(1, min(LONGEST, n - i) + 1):
            known = run[i : i + k] in LEXICON
            if k == 1 or known:
                step = (unknown + (0 if known else 1), words + 1, i)
                if step < best[i + k]:
                    best[i + k] = step
    out, i = [], n
    while i:
        out.append(run[best[i][2] : i])
        i = best[i][2]
    return out[::-1]


def _run_start(t: str, a: int, p: int, scripts: tuple[str, ...]) -> int:
    """Start of the run of these scripts that ends before `p`."""
    while p > a and _script(t[p - 1]) in scripts:
        p -= 1
    return p


def _run_end(t: str, k: int, b: int, scripts: tuple[str, ...]) -> int:
    """End of the run of these scripts that begins at `k`."""
    while k < b and _script(t[k]) in scripts:
        k += 1
    return k


def _pairs(t: str, a: int, b: int, marks: list[tuple[int, str]]) -> dict[int, int]:
    """Places of opening marks with those of their closers; marks without a partner in the block are left out."""
    got, stack = {}, []
    for i, c in marks:
        if c in "'’‘" and i > a and i + 1 < b and t[i - 1].isalnum() and t[i + 1].isalnum():
            continue  # an apostrophe
        if stack and any(x[1] == c for x in stack) and (c not in "'\"" or not _space(t[i - 1])):
            while stack[-1][1] != c:
                stack.pop()
            got[stack.pop()[0]] = i
        elif c in OPEN:
            stack.append((i, OPEN[c]))
        elif c in "'\"" and (i == a or not t[i - 1].isalnum()) and i + 1 < b and not _space(t[i + 1]):
            stack.append((i, c))
    return got


def _word_before(t: str, a: int, i: int) -> str:
    k = i
    while k > a and (t[k - 1].isalnum() or t[k - 1] == "." or unicodedata.category(t[k - 1])[0] == "M"):
        k -= 1
    return t[k:i].lstrip(".")


def _next_word(t: str, j: int, b: int) -> str:
    k = j
    while k < b and (t[k].isalnum() or unicodedata.category(t[k])[0] == "M"):
        k += 1
    return t[j:k]


def _opens(t: str, k: int, b: int) -> str:
    """Script of the character at `k`; a name that is written small at the start of a sentence counts as a capital."""
    after = _script(t[k])
    return "up" if after == "low" and _next_word(t, k, b).lower() in LOWER_OPENERS else after


def _period_ends(t: str, a: int, b: int, i: int, j: int, k: int) -> bool:
    """Whether the single full stop at `i` ends a sentence; `j` is behind it and its closers, `k` at the next character."""
    if k == j:  # something follows without a space: a decimal, a version, an address, or the next sentence run on
        word = _word_before(t, a, i)
        return len(word) > 2 and word.isalpha() and word[1:].islower() and word.lower() not in TITLES | NUMBERED and bool(_RUN_ON.match(t, k)) and not (i - len(word) > a and t[i - len(word) - 1] in "/@._-")
    after = _opens(t, k, b)
    word = _word_before(t, a, i)
    low = word.lower()
    if after == "low":  # only after a plain word of some length, which no abbreviation is
        return len(word) > 3 and word.isalpha() and low not in TITLES | NUMBERED | OPEN_END
    if not word:
        return True
    head = _script(word[-1])
    if head in ("hi", "ar") or unicodedata.category(word[-1])[0] == "M":
        return len(word) > 4 if "ऀ" <= word[0] < "ঀ" else len(word) > 1
    if low in TITLES:
        return False
    if low in NUMBERED:
        return after != "num"
    if low in OPEN_END:
        return True
    if len(word) == 1 and word.isalpha():
        return False
    if word.isdigit():
        if len(word) <= 2 and after == "up":
            p = i - len(word)
            while p > a and _space(t[p - 1]):
                p -= 1
            return not (_word_before(t, a, p).lower() in GERMAN_ORDINAL_BEFORE and _next_word(t, k, b).lower() not in ("in", "the", "it") or _next_word(t, k, b).lower() in GERMAN_ORDINAL_AFTER)
        return True
    if "." in word and re.fullmatch(r"(?:\w\.)+\w", word):
        return False
    return True


def _ellipsis_ends(t: str, a: int, b: int, i: int, j: int, k: int) -> bool:
    before = t[i - 1] if i > a else ""
    p = i
    while p > a and _space(t[p - 1]):
        p -= 1
    before = t[p - 1] if p > a else ""
    if before and _script(before) in ("han", "ja"):
        words = lattice(t[_run_start(t, a, p, ("han", "ja")) : p])
        return bool(words) and (words[-1] in ZH_FINAL or "".join(words).endswith(JA_FINAL) and _script(before) == "ja")
    if before and _script(before) == "th":
        return True
    after = _opens(t, k, b)
    return k > j and after != "low" and not (after == "mark" and t[k] in ",;:")


def _closer_ends(t: str, a: int, b: int, start: int, o: int, j: int, k: int, strong: bool) -> bool:
    """Whether a quotation or bracket opened at `o`, with a terminator before its closer, ends the sentence from `start`."""
    if t[o] in TITLE_MARKS:
        return False
    leads = o == start
    after = _opens(t, k, b)
    if strong and (after in ("up", "num") or t[k] in OPEN):  # 。！？ inside, then Latin letters or another opening mark
        return leads or t[o] not in ROUND
    if after in ("han", "ja"):
        if t[o] in ROUND:
            return leads
        run = t[k : _run_end(t, k, b, ("han", "ja"))]
        words = lattice(run)
        if any("぀" <= c < "㄀" for c in run) or any("぀" <= c < "㄀" for c in t[o:j]):
            return words[0] not in JA_ON
        if words[0] == "就" and k + 1 < b and t[k + 1].isascii():
            return True  # "as for X", an opening
        return not (ZH_SPEAK.match(t, k) if leads else words[0] in ZH_ON)
    if after in ("hi", "ar"):
        word = _next_word(t, k, b)
        return word not in (HI_ON if after == "hi" else AR_ON) if t[o] not in ROUND else leads
    if after == "th":
        return k > j
    return k > j and after != "low" and not (after == "mark" and t[k] in ",;:.!?—–-&/")


def _block(t: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    """Adds the sentences of the block t[a:b] to `out`."""
    while a < b and _space(t[a]):
        a += 1
    while b > a and _space(t[b - 1]):
        b -= 1
    if a >= b:
        return
    places = [(m.start(), m.end()) for m in _PLACE.finditer(t, a, b)]
    pairs = _pairs(t, a, b, [(i, t[i]) for i, _ in places if t[i] in OPEN or t[i] in CLOSERS])
    start, skip = a, a

    def cut(j: int) -> None:
        nonlocal start
        e = j
        while e > start and _space(t[e - 1]):
            e -= 1
        if e > start:
            out.append((start, e))
        start = j
        while start < b and _space(t[start]):
            start += 1

    for i, e in places:
        if i < skip or i < start:
            continue
        c = t[i]
        if c in OPEN or c in CLOSERS:
            if i not in pairs:
                continue
            j = pairs[i]
            last = j - 1
            while last > i and (_space(t[last]) or t[last] in CLOSERS):
                last -= 1
            j += 1
            while j < b and t[j] in CLOSERS and j not in pairs:
                j += 1
            skip = j
            if t[last] in ".!?…" or t[last] in STRONG:
                k = j
                while k < b and _space(t[k]):
                    k += 1
                if k < b and _closer_ends(t, a, b, start, i, j, k, t[last] in "。！？｡！？"):
                    cut(j)
            continue
        if _space(c):  # a gap beside Thai letters
            prev, nxt = t[i - 1], t[e]
            if _script(prev) == "mark" and prev not in "ฯๆ)”\"'" and unicodedata.category(prev)[0] != "M":
                continue
            if _script(nxt) == "th" and lattice(t[e : _run_end(t, e, b, ("th",))])[0] in TH_ON:
                continue
            cut(e)
            continue
        j = e
        while j < b and t[j] in CLOSERS and j not in pairs and not (t[j] in "'\"" and j + 1 < b and t[j + 1].isalnum()):
            j += 1
        k = j
        while k < b and _space(t[k]):
            k += 1
        if k >= b:
            break
        run = t[i:e]
        if any(x in STRONG for x in run):
            ends = True
        elif "…" in run or run.startswith(".."):
            ends = _ellipsis_ends(t, a, b, i, j, k)
        elif run == ".":
            ends = _period_ends(t, a, b, i, j, k)
        else:
            after = _opens(t, k, b)
            ends = after in ("han", "ja", "th") or k > j and after != "low" and not (after == "mark" and t[k] in ",;:")
        if ends:
            cut(j)
    if start < b:
        out.append((start, b))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text in code points; none for null, empty and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    fence, para = None, None
    pos, n = 0, len(text)
    while pos < n:
        m = _LINE.match(text, pos)
        end = m.end()
        stop = end
        while stop > pos and text[stop - 1] in "\r\n":
            stop -= 1
        line = text[pos:stop]
        f = _FENCE.match(line)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line[f.end() :].strip():
                fence = None
        else:
            own = f or _HEAD.match(line) or _RULE.match(line) or _ITEM.match(line)
            if (own or not line.strip()) and para is not None:
                _block(text, para, pos, out)
                para = None
            if f:
                fence = f[1]
            elif own:
                if own.re is _HEAD:
                    body = re.sub(r"[ \t]+#+[ \t]*$", "", line)
                    a, b = pos + min(own.end(), len(body)), pos + len(body)
                    while a < b and _space(text[a]):
                        a += 1
                    while b > a and _space(text[b - 1]):
                        b -= 1
                    if a < b:
                        out.append((a, b))
                elif own.re is _ITEM:
                    _block(text, pos + own.end(), stop, out)
            elif para is None and line.strip():
                para = pos
        pos = end
    if para is not None:
        _block(text, para, n, out)
    return out


def split(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start_pos, end_pos of each sentence unit of each document; documents pass through one narrow stage, no shuffle.

    Null, empty and blank texts have no units. Repeated rows each give their own units; an empty table gives an empty result.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, starts, ends = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in sentences(t):
                    keys.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, start_pos long, end_pos long")


def p9_found(spark, sf_dir: str) -> DataFrame:
    """doc_id, start_pos, end_pos of each sentence unit of documents."""
    return split(table(spark, sf_dir, "documents"))

"""Personal information in free text: a skip-chain conditional random field over candidate mentions.

High-recall patterns and the name lexicon propose mentions: the nodes of a text's field. A node's labels are O and the types
that its form allows; its potentials add up what speaks for a type: form, words before and after, whether it fills its
line, whether its words are known names. Neighbouring mentions share a chain potential (personal details come together),
and mentions that share a word or a long number, however far apart, a skip potential that favours one label for all.
Sum-product messages are passed around the loopy graph, and a mention gets the label of highest belief. The potentials
are stated constants: there are no labelled rows to fit them to.

Texts pass through one narrow Arrow stage. A linear-time expression over whole batches tells those without any trace of a
candidate. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlode.llm.language import WORDS
from chatlode.session import table

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_THIN = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20, 0x2011: 0x2D, 0x2010: 0x2D, 0x2013: 0x2D}

# Potentials: log-odds of a type against O.
BIAS, CUE, AGAINST, LINE, KNOWN, CHAIN, SKIP, ROUNDS, REACH = -2.0, 3.0, -5.0, 1.2, 2.0, 0.7, 1.5, 10, 60

# --- forms -------------------------------------------------------------------------------------------------------------
_EMAIL = re.compile(r"[a-z0-9À-ɏ_.+\-%]+(?:@| @ )(?:[a-z0-9\-]+\.)+[a-z]{2,24}(?![a-z0-9_@])", re.I)
_EMAIL_SPELT = re.compile(r"[a-z0-9À-ɏ_.+\-]+ ?(?:[\[({<] ?at ?[\])}>]| at ) ?[a-z0-9\-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[a-z0-9\-]+)*(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[a-z]{2,24}(?![a-z0-9_@])", re.I)
_DIGITS = re.compile(r"(?<![A-Za-z0-9_.])[(+]{0,2}\d(?:[ .\-/()]{0,2}\d){6,19}(?:[ \-]?[A-Za-z](?![A-Za-z0-9]))?(?![\d])")
_CODED = re.compile(r"(?<![A-Za-z0-9_@.\-#])(?:[A-Z]{1,2}\d{7,8}[A-Z]?|[A-Z]\d{2}[A-Z]\d{4,6}[A-Z]?|[A-Z]\d{7}[A-Z]|[A-Z]{2} \d{3} \d{4})(?![A-Za-z0-9_@])", re.I)

_PHONES = re.compile(
    r"\(?\+\d{1,3}\)?[ .\-/()]*\d(?:[ .\-/()]{0,2}\d){6,11}|00\d{2}[ .\-/]\d(?:[ .\-/]?\d){6,11}"
    r"|1[3-9]\d[ \-]?\d{4}[ \-]?\d{4}|\(?0\d{2,3}\)?[ \-]?\d{7,8}|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|0\d{2} \d{4} \d{4}"
    r"|0\d(?:[ .\-]?\d{2}){4}|\(?0\d{2,4}\)?[ /\-]?\d{3,8}(?:[ \-]?\d{1,4})?|[6789]\d{2}[ \-]?\d{3}[ \-]?\d{3}|0\d{1,3}-\d{3,4}-\d{4}|0\d{9,10}"
)
_IDS = re.compile(
    r"\d{6}[ \-]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \-]?\d{3}[\dXx]|\d{3}[ \-]\d{2}[ \-]\d{4}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
    r"|\d{2}[. ]?\d{3}[. ]?\d{3}[ \-]?[A-Za-z]|[A-Za-z]{1,2}\d{7,8}[A-Za-z]?|[A-Za-z]\d{2}[A-Za-z]\d{4,6}[A-Za-z]?|\d{4}[ \-]\d{4}[ \-]\d{4}"
)
_NOT = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|(?:19|20)\d{2}[\-/.]\d{1,2}[\-/.]\d{1,2}(?: \d{1,2})?|\d{1,2}[\-/.]\d{1,2}[\-/.](?:19|20)\d{2}|202\d{12,}")

# --- words before and after --------------------------------------------------------------------------------------------
_CUES = {
    "email": re.compile(r"(?:write|mail|address is|contact|reach|cc|to)\W{0,4}(?:me )?(?:at |to |:)?\W*$|schreib mir an|erreich\w+|écris-moi à|contacte|escríbeme a|correo|kontakt|邮箱\w{0,2}|发到|抄送|联系|連絡先|結果は|宛|(?:address|adresse|email|mailto)\W*(?:is|ist|est|es)?\W*$", re.I),
    "phone": re.compile(r"\b(?:call|text|tel|phone|mobile|cell|fax|ruf\w*|anruf\w*|handy|telefon\w*|appelle\w*|tél\w*|téléphone|llám\w+|teléfono|móvil|whatsapp|dial|ring)\b|电话|手机|微信|可以打|致电|電話|携帯|TEL", re.I),
    "id_number": re.compile(r"social security|passport|national (?:id|insurance)|tax (?:id|number)|identity|\bid\b ?[:#]|\bid (?:no|number)|\bssn\b|\bdni\b|\bnie\b|\bnif\b|documento|pasaporte|pièce d'identité|sécurité sociale|passeport|fiscal|ausweis\w*|reisepass\w*|steuer\w*|sozialversicherung\w*|身份证|证件|护照|社保|税号|個人番号|マイナンバー|旅券|パスポート|運転免許", re.I),
    "address": re.compile(r"\b(?:live|lives|send|delivery|deliver|address|ship|wohn\w+|anschrift|bitte an|lieferung|liefer\w+|habite|envoyer|livraison|adresse|vivo|env[íi]\w+|entrega|dirección|domicilio)\b|住在|寄到|地址|住所|送り先|届け先", re.I),
}
_COUNTER = re.compile(r"\b(?:order|pedido|commande|auftrag|bestellung|chapter|kapitel|chapitre|capítulo|hosts?|server|version|room|raum|salle|sala|invoice|rechnung|facture|factura|tracking|ticket|isbn|build|port|serial)\W{0,3}(?:no\.?|nr\.?|n°|number|answers on|hat)?\W{0,3}$|订单号?\W*$|运单\w*\W*$|主机是?$|版本$|注文\W*$|チャプター$|章\W*$|单号\W*$|期限\w*\W*$|ends on $|endet am $", re.I)

# Titles, street words and lead-ins of names.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Herrn|Frau|Hr|Fr|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señora?|Don|Doña)"
_WORD = r"[^\W\d_][^\W\d_]*(?:['’\-][^\W\d_]+)*"
_CAPW = r"(?:[A-ZÀ-Þ]['’])?[A-ZÀ-Þ][^\W\d_]+(?:['’\-][^\W\d_]+)*"
_LEAD = re.compile(r"(?:my name is|i am called|regards,|sincerely,|best wishes,|yours,|\bask|ich heiße|mein name ist|viele grüße,|gruß,|\bfrag|je m'appelle|cordialement,|demande à|me llamo|mi nombre es|saludos,|atentamente,|pregunta a)\s+$", re.I)
_LEAD_FIND = re.compile(rf"(?:my name is|i am called|regards,|sincerely,|best wishes,|yours,|\bask|ich heiße|mein name ist|viele grüße,|gruß,|\bfrag|je m'appelle|cordialement,|demande à|me llamo|mi nombre es|saludos,|atentamente,|pregunta a)\s+((?:{_TITLE}\.? +)?(?:{_WORD}\.?)(?:,? +{_WORD}\.?){{0,2}})", re.I)
_TRAIL = re.compile(r"\s+(?:has seen|already saw|about the rest|for the rest|nach dem rest|pour le reste|por lo demás|hat den entwurf|hat (?:schon|bereits)|a déjà (?:vu|lu)|ya (?:vio|ha visto)|has read|昨天)", re.I)
_TRAIL_HINT = re.compile(r"\s+(?:has seen the|hat den|hat schon|a déjà|ya (?:vio|ha))", re.I)
_LAST_WORDS = re.compile(rf"{_WORD}\.?,? +{_WORD}\.?$")
_LEAD_HINT = ("name is", "i am called", "regards,", "sincerely,", "wishes,", "yours,", "ask ", "heiße", "mein name", "grüße,", "gruß,", "frag ", "m'appelle", "cordialement,", "demande à", "me llamo", "mi nombre", "saludos,", "atentamente,", "pregunta a")
#: What a street with a number holds in lower case, by form of _STREETS: plain words, then a pattern to be sure.
_STREET_HINTS = [
    (("road", " rd", "street", " st", "avenue", " ave", "lane", " ln", "blvd", "boulevard", "drive", " dr", "court", " ct", "place", " pl", " way", "square", " sq", "terrace", "close", " hill", " row", " walk"), re.compile(r"\d[a-z]?,? [^\d\n]{2,60}\b(?:road|rd|street|st|avenue|ave|lane|ln|blvd|boulevard|drive|dr|court|ct|place|pl|way|square|sq|terrace|close|hill|row|walk)\b")),
    ((), re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|winkel|brink|ufer|damm|ring|steig|chaussee|hof|stieg) \d|\b(?:am|an der|an den|im|in der|auf dem|zum|zur) [^\W\d_]+ \d")),
    (("rue", "avenue", " av", " bd ", "boulevard", "impasse", "place", "chemin", "allée", "quai", "route", "cours", "square", "passage"), re.compile(r"\d(?: ?(?:bis|ter))?,? (?:rue|av|bd|bou|imp|pla|che|all|qua|rou|cou|squ|pas)")),
    (("calle", "c/", "avenida", "avda", "plaza", "pza", "paseo", "camino", "carrera", "travesía", "ronda", "glorieta"), re.compile(r"\d")),
    (("号",), re.compile(r"\d ?号")),
    (("通り", "町", "丁", "区", "市", "村"), re.compile(r"[り町区市村丁][一-鿿ぁ-ん]{0,4} ?\d")),
]
_TITLED = re.compile(rf"(?<![\w@.])({_TITLE})\.? +({_CAPW})(?: ({_CAPW}))?")
_PAIR = re.compile(rf"(?<![\w@.+\-/])({_CAPW}|[A-ZÀ-Þ]\.)(,?) +({_CAPW}|[A-ZÀ-Þ]\.)(?![\w@])")
_STREET_WORD = re.compile(r"^(?:road|rd|street|st|avenue|ave|lane|ln|blvd|boulevard|drive|court|ct|place|way|square|sq|terrace|close|hill|row|walk|park)\b", re.I)

_STREETS = [
    re.compile(r"(?<![\w.\-])\d{1,5}[a-z]?,? (?:[NSEW]\. )?(?:[A-Za-zÀ-ÿ'’\-]+ ){1,4}(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Blvd|Boulevard|Drive|Dr|Court|Ct|Place|Pl|Way|Square|Sq|Terrace|Close|Hill|Row|Walk)\b\.?(?:, (?:Apt|Flat|Unit|Suite) \w+)?(?:, [A-Z][A-Za-z\-]+(?: \d{4,5})?)?", re.I),
    re.compile(r"(?<![\w])(?:[^\W\d_][^\W\d_\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|winkel|brink|ufer|damm|ring|steig|chaussee|hof|stieg)|(?:Am|An der|An den|Im|In der|Auf dem|Zum|Zur) [^\W\d_]+|[^\W\d_]+ (?:Straße|Str\.|Weg|Platz|Allee|Gasse)) \d{1,4} ?[a-z]?(?![\w])(?:(?:,| in) (?:\d{4,5} )?[A-ZÄÖÜ][^\W\d_]+)?", re.I),
    re.compile(r"(?<![\w])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.?|bd|boulevard|impasse|place|chemin|allée|quai|route|cours|square|passage)\b [^\d\n.;:!?]{2,40}?(?:, \d{5} [A-ZÀ-Þ][\w\-À-ÿ]+|(?=[.\n;!?])|$)", re.I),
    re.compile(r"(?<![\w])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Carrera|Travesía|Ronda|Glorieta)[ ]?(?:[^\W\d_]+\.?[ ]?){1,5},? (?:n\.?º ?)?\d{1,4}\b(?:, \d\.?º ?\w)?(?:, \d{5} [A-ZÀ-Þ][\wÀ-ÿ]+)?", re.I),
    re.compile(r"(?:[一-鿿]{2,6}[省市])?(?:[一-鿿]{1,6}[市区县镇])?[一-鿿]{1,8}?(?:路|街|巷|大道|道|胡同|里|弄) ?\d{1,5} ?号(?:\d+(?:栋|单元|号楼|楼|幢))?(?:\d+(?:单元|室|栋)|\d{2,4})?(?:\d+室)?"),
    re.compile(r"(?:[一-鿿ヶ]{2,6}[都道府県])?(?:[一-鿿ヶ]{1,6}[市区町村])*[一-鿿ぁ-んァ-ヶ]{0,6}(?:通り|町|丁|区|市)[一-鿿ぁ-ん]{0,4}? ?\d{1,3}(?:丁目\d{1,3}(?:番地?(?:\d{1,3}号?)?|-\d+)?|-\d{1,3}(?:-\d{1,3})?)(?![\d-])"),
]

_STREET_LEAD = re.compile(r"[一-鿿]{0,6}?(?:我住在|住在|寄到|地址是?|住所は)")
_ZH_SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦许何吕施张孔曹严华金魏陶姜谢邹苏潘葛范彭鲁韦马方俞任袁柳唐罗薛雷贺倪汤罗毕郝安常于傅齐康伍余顾孟黄萧尹姚邵汪祁毛狄米贝明臧计成戴谈宋庞熊纪舒屈项祝董梁杜阮蓝闵季贾路江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万柯管卢莫房解应宗丁邓洪包左石崔吉龚程邢裴陆荣翁段侯班仇甘厉戎武符刘景龙叶司黎乔苍双闻党翟谭贡姬申扶堵冉桑桂牛寿边尚温庄晏柴瞿阎慕连茹习艾鱼容向古易慎戈廖庾终居衡步都耿满弘匡国文寇广禄东欧曾沙养鞠丰关相查后荆红游竺权盖益桓公云"
_ZH_DOUBLE = "上官|欧阳|司马|诸葛|东方|皇甫|尉迟|公孙|慕容|令狐|司徒|夏侯"
_HAN = "[一-鿿]"
_FUNCTION = {w for ws in WORDS.values() for w in ws.split() if w not in ("will", "may")}


class Field:
    """Candidate nodes of a text, their potentials and the beliefs after message passing."""

    def __init__(self, words: list[tuple[str, str, str]]):
        latin = [(w.lower(), p) for w, p, lang in words if lang not in ("zh", "ja")]
        self.given = {w for w, p in latin if p == "given"}
        self.family = {w for w, p in latin if p == "family"}
        zf = [w for w, p, lang in words if lang == "zh" and p == "family"]
        zg = [w for w, p, lang in words if lang == "zh" and p == "given"]
        jf = [w for w, p, lang in words if lang == "ja" and p == "family"]
        jg = [w for w, p, lang in words if lang == "ja" and p == "given"]
        any_of = lambda ws: "|".join(map(re.escape, sorted(ws, key=len, reverse=True))) or "(?!)"
        sur = f"(?:{_ZH_DOUBLE}|{any_of(zf)}|[{_ZH_SURNAMES}])"
        self.zh = [
            (re.compile(f"{sur}(?:{any_of(zg)})(?!{_HAN}?[先女]生)"), 3.2),
            (re.compile(f"(?:(?<=我叫)|(?<=我是)|(?<=此致,)|(?<=此致\n)|(?<=可以问)){sur}(?:{any_of(zg)}|(?:先生|女士|老师|{_HAN}{{1,2}}?(?=[。，,\\s！!]|昨天|$)))"), 4.5),
            (re.compile(f"(?:(?<=我叫)|(?<=此致,)|(?<=可以问)){_HAN}{{2,4}}(?=[。\\s]|$)"), 3.6),
            (re.compile(f"(?:(?<=我叫)|(?<=此致,)|(?<=可以问)){sur}{_HAN}{{1,2}}"), 3.0),
            (re.compile(f"(?<!{_HAN})(?:{sur}(?:{any_of(zg)}|先生|女士|{_HAN}{{1,2}}))(?=昨天已|已经看|看过)"), 4.5),
            (re.compile(f"(?:{_ZH_DOUBLE}|{any_of(zf)}|[{_ZH_SURNAMES}])(?:先生|女士)"), 2.4),
            (re.compile(f"(?m)^[ \t]*{sur}{_HAN}{{1,2}}[ \t]*$"), 2.3),
        ]
        fam, giv = any_of(jf), any_of(jg)
        k = "[一-鿿ヶ々]"
        self.ja = [
            (re.compile(f"(?:{fam}) ?(?:{giv}|{k}{{1,3}}(?=さん|様|氏|より|と申|[ \\s。、]|$))"), 3.2),
            (re.compile(f"{k}{{1,3}} ?(?:{giv})"), 2.4),
            (re.compile(f"(?:(?<=私は)|(?<=残りは)|(?<=担当は)){k}{{2,3}} ?{k}{{1,3}}(?=さん|様|氏|と申)"), 4.0),
            (re.compile(f"(?:(?:{fam})|{k}{{1,3}})(?:さん|様|氏)(?=[にがはをの、。])"), 0.5),
            (re.compile(f"{k}{{2,3}} {k}{{1,3}}(?=より)"), 3.2),
            (re.compile(f"(?:(?<=[。！？\\s])|^){k}{{2,6}}(?=より(?!も|大|小|多|少))"), 2.6),
            (re.compile(f"(?m)^[ \t]*{k}{{2,3}} {k}{{1,3}}[ \t]*$"), 2.4),
        ]
        self.has_ja = re.compile("[ぁ-んァ-ヶ]")
        self.has_han = re.compile(_HAN)
        self.lexicon_han = re.compile("|".join(filter(None, (any_of(zg), any_of(jg), any_of(jf)))) + "|先生|女士|我叫|此致|可以问|昨天已|申し|さん|より")

    # -- nodes ----------------------------------------------------------------------------------------------------------
    def nodes(self, t: str) -> list[tuple[int, int, dict[str, float]]]:
        """(start, end, log-odds of each type against O) of the candidates of `t`, overlaps resolved for the stronger."""
        got: list[tuple[int, int, dict[str, float]]] = []

        def alone(a: int, b: int) -> float:
            left = t.rfind("\n", 0, a) + 1
            right = t.find("\n", b)
            right = len(t) if right < 0 else right
            return LINE if not t[left:a].strip(" \t-*>·") and not t[b:right].strip(" \t.。") else 0.0

        def near(kind: str, a: int, b: int) -> float:
            left = max(t.rfind("\n", 0, a), a - 45, 0)
            for sep in (". ", "。", "! ", "? ", "！", "？"):  # a lead-in ends with its sentence, "Tel." and "no." don't
                cut = t.rfind(sep, left, max(left, a - 6))
                if cut >= 0 and not re.search(r"(?:tel|tél|no|nr|n|id)$", t[max(0, cut - 3) : cut], re.I):
                    left = max(left, cut + 1)
            return CUE if _CUES[kind].search(t[left:a]) or (kind == "id_number" and t[b : b + 16].lower().startswith(" is on the form")) else 0.0

        if "@" in t:
            for m in _EMAIL.finditer(t):
                got.append((m.start(), m.end(), {"email": 5.0 + BIAS}))
        if " at " in t or " AT " in t or "at)" in t or "at]" in t or "AT)" in t or "AT]" in t or " At " in t or "At]" in t or "At)" in t or " aT " in t:
            for m in _EMAIL_SPELT.finditer(t):
                s = m.group(0)
                local = re.match(r"[a-z0-9À-ɏ_.+\-]+", s, re.I)[0]
                odd = 1.5 if re.search(r"[\d_+.]", local) else 0.0
                got.append((m.start(), m.end(), {"email": BIAS + odd + (1.5 if re.search(r"[\[({]| dot ", s, re.I) else 0) + near("email", m.start(), m.end()) + alone(m.start(), m.end())}))
        for m in _DIGITS.finditer(t):
            a, b = m.span()
            s = m.group(0)
            if s[-1].isalpha() and not (_IDS.fullmatch(s)):
                s = s[:-1].rstrip(" -")
                b = a + len(s)
            while s.count("(") > s.count(")") and s[0] == "(" or s.count(")") > s.count("(") and s[-1] == ")":
                if s[0] == "(" and s.count("(") > s.count(")"):
                    s, a = s[1:], a + 1
                else:
                    s, b = s[:-1], b - 1
            n = sum(map(str.isdigit, s))
            if _NOT.fullmatch(s) or n < 7 or n > 18:
                continue
            against = AGAINST if _COUNTER.search(t[max(0, a - 26) : a]) else 0.0
            line = alone(a, b)
            types = {}
            if _PHONES.fullmatch(s) and 8 <= n <= 15 or n >= 8 and n <= 13 and near("phone", a, b):
                strong = 1.2 if s[0] in "+(" or re.search(r"\d[ .\-/()]+\d", s) or re.fullmatch(r"1[3-9]\d{9}", s) else 0.4
                types["phone"] = BIAS + (strong if _PHONES.fullmatch(s) else -0.8) + near("phone", a, b) + line + against
            if _IDS.fullmatch(s) or n >= 8 and near("id_number", a, b):
                long = n in (15, 17, 18) and not s.isdigit() or n == 18 or n == 15 and s[0] in "12"
                form = 2.4 if _IDS.fullmatch(s) and long else 1.2 if _IDS.fullmatch(s) else -0.8
                types["id_number"] = BIAS + form + near("id_number", a, b) + line + against
            if types:
                got.append((a, b, types))
        for m in _CODED.finditer(t):
            a, b = m.span()
            got.append((a, b, {"id_number": BIAS + 1.0 + near("id_number", a, b) + alone(a, b) + (AGAINST if _COUNTER.search(t[max(0, a - 26) : a]) else 0.0)}))
        if re.search(r"\d", t):
            low = t.lower()
            if len(low) == len(t):
                for k, rx in enumerate(_STREETS):
                    plain, sure = _STREET_HINTS[k]
                    if plain and not any(x in low for x in plain) or not sure.search(low):
                        continue
                    for m in rx.finditer(t):
                        a, b = m.span()
                        if lead := _STREET_LEAD.match(t, a, b):
                            a = lead.end()
                        form = 0.6 if k == 0 and re.search(r"\d[a-z]?,? (?:[NSEW]\. )?[a-z]", m.group(0)) else 2.6  # written small: a cue must help
                        got.append((a, b, {"address": BIAS + form + near("address", a, b) + alone(a, b)}))
        self.names(t, got, alone)
        got.sort(key=lambda x: (-max(x[2].values()), x[0] - x[1]))
        kept: list[tuple[int, int, dict[str, float]]] = []
        for x in got:
            if not any(x[0] < k[1] and k[0] < x[1] for k in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[0])

    def names(self, t: str, got: list, alone) -> None:
        low = t.lower()

        def known(w: str) -> tuple[bool, bool]:
            w = w.lower().strip(".,").replace("’", "'")
            return w in self.given, w in self.family

        def score(a: int, b: int, base: float) -> None:
            got.append((a, b, {"name": BIAS + base + alone(a, b)}))

        for m in _LEAD_FIND.finditer(t) if any(x in low for x in _LEAD_HINT) else ():
            a, s = m.start(1), m.group(1)
            raw = re.findall(rf"{_WORD}\.?,?", s)
            words = raw[:]
            # The name ends with its sentence or where a word can't belong to it.
            title = bool(re.fullmatch(_TITLE, words[0].strip(".,"), re.I)) and len(words) > 1
            take = 2
            if not title and words[0].endswith(".") and len(words[0]) > 2 and not len(words[0].strip(".")) == 1:
                take = 1
            words = words[:take]
            if len(words) < 2:
                continue
            first, second = words[0], words[1]
            gf = known(first), known(second)
            hits = gf[0][0] + gf[1][1] + ("," in first and gf[0][1]) + ("," in first and gf[1][0])
            caps = first[0].isupper() and second[0].isupper() or t[m.start() : a].isupper()
            ends = s.rstrip(" .").endswith(second.rstrip(".")) and (m.end() >= len(t) or t[m.end()] in "\n.")
            if not (caps or hits or ends and first.lower() not in _FUNCTION and second.lower() not in _FUNCTION and not s[: s.index(second, len(first))].isupper()):
                continue
            e = a + s.index(second, len(first)) + len(second)
            score(a, e - (1 if t[e - 1] in ".," and len(second.strip(".,")) > 1 else 0), CUE + (1.2 if caps else 0.4 if ends else 0.0) + KNOWN * min(2, hits) * 0.6 + (1.0 if title else 0))
        for h in _TRAIL_HINT.finditer(t):
            left = max(0, h.start() - 60)
            m = _LAST_WORDS.search(t[left : h.start()])
            if m:
                words = m.group(0).split()
                hits = any(any(known(w)) for w in words)
                if words[0][0].isupper() and words[1][0].isupper() or hits:
                    score(left + m.start(), h.start(), CUE + 1.2 + KNOWN * 0.6 * hits)
        for m in _TITLED.finditer(t):
            w = m.group(2)
            if _STREET_WORD.match(t[m.end() :].lstrip()):
                continue
            score(m.start(), m.end(2), (1.6 if t[m.end(1) : m.end(1) + 1] == "." or m.group(1) in ("Frau", "Herr", "Madame", "Monsieur", "Miss") else 0.2) + KNOWN * known(w)[1] * 1.2 + (CUE if _LEAD.search(t[max(0, m.start() - 30) : m.start()]) or _TRAIL.match(t, m.end()) else 0))
        pos = 0
        while m := _PAIR.search(t, pos):
            first, comma, second = m.group(1), m.group(2), m.group(3)
            a, b = m.span()
            pos = m.start(3)
            f, s = known(first), known(second)
            if _STREET_WORD.match(t[b:].lstrip(" .")) or re.search(r"\d[a-z]?,? (?:[NSEW]\. )?$", t[max(0, a - 8) : a]) or "\n" in m.group(0):
                continue
            lead = CUE if _LEAD.search(t[max(0, a - 30) : a]) or _TRAIL.match(t, b) else 0.0
            if comma:
                base = (KNOWN if f[1] else 0) + (KNOWN if s[0] else 0) - 1.2
            elif second.endswith("."):
                base = (KNOWN * 0.8 if f[0] else 0) - 1.5
            elif first.endswith("."):
                base = (KNOWN * 1.5 if s[1] else 0.2) - 0.3
            else:
                base = (KNOWN if f[0] else 0) + (KNOWN if s[1] else 0) + (0.8 if s[1] and not s[0] else 0)
            line = alone(a, b)
            if base <= 0 and not lead and not line or first.lower() in _FUNCTION and not lead:
                continue
            if first.isupper() and second.isupper() and len(first) > 2 and not lead and not (f[0] and s[1]):
                continue  # in capitals the case tells nothing
            if second.endswith(".") and len(second) > 2:
                b -= 1
            got.append((a, b, {"name": BIAS + base + lead + line}))
        if self.has_han.search(t) and (self.lexicon_han.search(t) or "\n" in t):
            for rx, base in self.ja if self.has_ja.search(t) else self.zh:
                for m in rx.finditer(t):
                    a, b = m.span()
                    while a < b and t[a] in " \t":
                        a += 1
                    while b > a and t[b - 1] in " \t":
                        b -= 1
                    got.append((a, b, {"name": BIAS + base}))

    # -- inference ------------------------------------------------------------------------------------------------------
    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of the personal information in a text."""
        t = text.translate(_THIN) if not text.isascii() else text
        nodes = self.nodes(t)
        if not nodes:
            return []
        labels = [["O", *x[2]] for x in nodes]
        unary = [[0.0, *x[2].values()] for x in nodes]
        edges: dict[tuple[int, int], float] = {}
        chain = set()
        for i in range(len(nodes) - 1):
            if nodes[i + 1][0] - nodes[i][1] <= REACH:
                edges[(i, i + 1)] = 0.0
                chain.add((i, i + 1))
        if len(nodes) > 1:
            seen: dict[str, int] = {}
            for i, (a, b, _) in enumerate(nodes):
                for w in {w for w in re.findall(r"[^\W\d_]{3,}|\d{6,}", t[a:b].lower())}:
                    if w in seen:  # each distinctive word links a mention with the one before that holds it
                        edges[(seen[w], i)] = SKIP
                    seen[w] = i
        belief = unary
        if edges:
            around: dict[int, list[tuple[int, tuple[int, int]]]] = {}
            for i, j in edges:
                around.setdefault(i, []).append((j, (i, j)))
                around.setdefault(j, []).append((i, (i, j)))
            msg = {(i, j): [0.0] * len(labels[j]) for i, js in around.items() for j, _ in js}

            def pair(e, la, lb):
                w = CHAIN if e in chain and la != "O" and lb != "O" else 0.0
                return w + (edges[e] if la == lb else -edges[e] * 0.5)

            for _ in range(ROUNDS):
                moved = 0.0
                for (i, j), old in list(msg.items()):
                    e = (i, j) if (i, j) in edges else (j, i)
                    inc = [u + sum(msg[(k, i)][x] for k, _ in around[i] if k != j) for x, u in enumerate(unary[i])]
                    new = []
                    for lb in labels[j]:
                        vals = [inc[x] + pair(e, la, lb) for x, la in enumerate(labels[i])]
                        top = max(vals)
                        new.append(top + math.log(sum(math.exp(v - top) for v in vals)))
                    low = new[0]
                    new = [v - low for v in new]
                    moved = max(moved, *(abs(p - q) for p, q in zip(new, old)))
                    msg[(i, j)] = new
                if moved < 1e-3:
                    break
            belief = [[u + sum(msg[(k, i)][x] for k, _ in around.get(i, ())) for x, u in enumerate(unary[i])] for i in range(len(nodes))]
        out = []
        for (a, b, _), ls, bs in zip(nodes, labels, belief):
            best = max(range(len(ls)), key=lambda x: bs[x])
            if best:
                out.append((a, b, ls[best]))
        return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for a, b, kind in spans:
        out += [text[pos:a], PLACEHOLDER[kind]]
        pos = b
    return "".join(out) + text[pos:]


#: A trace that every candidate leaves, for RE2; texts without one are not looked at. It is built from the forms above without
#: their surroundings, so that it is wider than each. Its \b knows ASCII letters only, which makes it wider still.
_LETTER, _KANJI = r"[\p{L}\p{Nl}\p{No}]", "[一-鿿ヶ々]"
_CAP = rf"(?-i:[A-ZÀ-Þ](?:{_LETTER}|['’\-])+)"
TRACE = "(?i)" + "|".join(
    [
        r"@",
        r"(?:[\[({<] ?at ?[\])}>]| at ) ?[a-z0-9\-]+(?: ?[\[({] ?dot ?[\])}]| dot |\.[a-z0-9\-])",
        r"\p{Nd}(?:[ .\-/()]{0,2}\p{Nd}){6}|[a-z]\p{Nd}{2}[a-z]\p{Nd}{4}",
        # leads and trails of names, titles, a name that fills its line
        r"my name is|i am called|regards,|sincerely,|wishes,|yours,|\bask\b|ich heiße|mein name ist|grüße,|gruß,|\bfrag\b|m'appelle|cordialement,|demande à|me llamo|mi nombre es|saludos,|atentamente,|pregunta a",
        r"has seen|already saw|about the rest|for the rest|nach dem rest|pour le reste|por lo demás|hat (?:den|schon|bereits)|a déjà|ya (?:vio|ha)|has read|昨天",
        rf"(?-i:\b{_TITLE}\.? +[A-ZÀ-Þ])",
        rf"(?m:^[ \t\-*>·]*(?:{_CAP}|(?-i:[A-ZÀ-Þ]\.)),? +(?:{_CAP}|(?-i:[A-ZÀ-Þ]\.))[ \t.。]*$)",
        rf"我叫|我是|此致|可以问|已经看|看过|先生|女士|さん|より|と申|[様氏][にがはをの、。]|(?:私|残り|担当)は{_KANJI}|(?m:^[ \t]*{_KANJI}{{2,}}(?: {_KANJI}{{1,3}})?[ \t]*$)",
        # streets, form by form
        rf"\p{{Nd}}[a-z]?,? (?:[NSEW]\. )?[\p{{L}}×÷'’\- ]+ (?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Blvd|Boulevard|Drive|Dr|Court|Ct|Place|Pl|Way|Square|Sq|Terrace|Close|Hill|Row|Walk)\b",
        rf"(?:straße|strasse|str\.|gasse|weg|platz|allee|winkel|brink|ufer|damm|ring|steig|chaussee|hof|stieg) \p{{Nd}}|\b(?:am|an der|an den|im|in der|auf dem|zum|zur) {_LETTER}+ \p{{Nd}}",
        r"\p{Nd}(?: ?(?:bis|ter))?,? (?:rue|avenue|av|bd|boulevard|impasse|place|chemin|allée|quai|route|cours|square|passage)\b",
        rf"(?:calle|c/|avenida|avda|av\.|plaza|pza|paseo|p\.º|camino|carrera|travesía|ronda|glorieta)(?:{_LETTER}|[., ])*\p{{Nd}}",
        r"[路街巷道里弄同] ?\p{Nd}|(?:通り|町|丁|区|市)[一-鿿ぁ-ん]{0,4} ?\p{Nd}",
    ]
)
_PLAIN = _THIN | {0x130: 0x69, 0x131: 0x69}  # re.I takes these for i, RE2 doesn't
_UNPLAIN = "[" + "".join(rf"\x{{{c:X}}}" for c in _PLAIN) + "]"


def traced(words: list[tuple[str, str, str]]):
    """A function that tells which texts of an Arrow array can hold a candidate, given the name lexicon."""
    any_of = lambda lang, part: "|".join(re.escape(w) for w, p, at in words if w and at == lang and p == part)
    parts = [TRACE]
    for w, _, lang in words:
        w = (w or "").translate(_PLAIN) if lang not in ("zh", "ja") else w
        if w and (lang not in ("zh", "ja") or len(w) > 1):
            form = re.escape(w.replace("’", "'")).replace("'", "['’]")
            parts.append(rf"\b{form}\b" if lang not in ("zh", "ja") and w[0].isascii() and w[-1].isascii() else form)
    if giv := any_of("zh", "given"):  # names of one character count next to what makes them names
        fam = any_of("zh", "family")
        parts.append(f"(?:{_ZH_DOUBLE}|[{_ZH_SURNAMES}]{'|' + fam if fam else ''})(?:{giv})")
    if giv := any_of("ja", "given"):
        parts.append(f"{_KANJI} ?(?:{giv})")
    if fam := any_of("ja", "family"):
        parts.append(rf"(?:{fam}) ?{_KANJI}{{1,3}}(?:さん|様|氏|より|と申|[\s\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}。、]|$)")
    trace = "|".join(parts)

    def hits(texts: pa.Array) -> pa.Array:
        odd = pc.fill_null(pc.match_substring_regex(texts, _UNPLAIN), False)
        if odd.true_count:
            texts = pa.array([t.translate(_PLAIN) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.string())
        return pc.fill_null(pc.match_substring_regex(texts, trace), False)

    return hits


def _words(names: DataFrame, limit: int = 200_000) -> list[tuple[str, str, str]]:
    rows = names.select("word", "name_part", "lang").where("word is not null").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the name lexicon has more than {limit} rows")
    return [(r[0], r[1], r[2]) for r in rows]


def detect(records: DataFrame, names: DataFrame, masked: bool = False) -> DataFrame:
    """field, record_key, pii_type of each type found in `records` (field, record_key, text), once per row; with `masked`,
    field, record_key, text of every row with typed placeholders in place of the mentions.

    Null and empty texts hold nothing and are given back as they are; repeated rows each count; an empty table gives an
    empty result. `names` (word, name_part, lang) is shipped with the task and must stay under a stated number of rows.
    """
    words = _words(names)
    made: dict[int, Field] = {}

    def run(batches):
        field = made.setdefault(0, Field(words))
        hits = traced(words)
        for b in batches:
            hit = hits(b.column(2))
            if masked:
                texts = [mask(t, field.spans(t)) if h else t for t, h in zip(b.column(2).to_pylist(), hit.to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["field", "record_key", "text"])
                continue
            b = b.filter(hit)
            at, kinds = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for k in sorted({s[2] for s in field.spans(t)}):
                    at.append(i)
                    kinds.append(k)
            ix = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array(kinds, pa.string())], names=["field", "record_key", "pii_type"])

    base = records.select("field", "record_key", "text")
    return base.mapInArrow(run, "field string, record_key string, text string" if masked else "field string, record_key string, pii_type string")


def _records(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "messages").select(F.lit("messages.text").alias("field"), F.col("id").cast("string").alias("record_key"), "text")
    a = table(spark, sf_dir, "analysis").select(F.lit("analysis.summary").alias("field"), F.col("conversation_id").alias("record_key"), F.col("summary").alias("text"))
    return m, a


def p1_found(spark, sf_dir: str) -> DataFrame:
    """field, record_key and pii_type of each type of personal information in messages and analysis."""
    m, a = _records(spark, sf_dir)
    names = table(spark, sf_dir, "name_words")
    return detect(m, names).unionByName(detect(a, names).distinct())  # a conversation may have been analysed twice


def p1_masked(spark, sf_dir: str) -> DataFrame:
    """field, record_key and text of every message and summary, with typed placeholders."""
    m, a = _records(spark, sf_dir)
    return detect(m.unionByName(a), table(spark, sf_dir, "name_words"), masked=True)

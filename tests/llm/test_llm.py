"""Operators for training data against brute-force versions, round trips and held-out accuracy."""

import itertools
import json
import math
import random
import re
import unicodedata
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatlode.llm import conversations, duplicates, encoding, packing, pairs, pii, queries, sentences, subjects
from chatlode.llm.language import language
from chatlode.session import table, tokenizer_file

MESSAGE = "id long, conversation_id string, source string, message_index int, role string, timestamp string, timestamp_source string, model string, text string, thinking string, attachments array<string>"
ALIASES = {"model": "assistant", "ai": "assistant", "bot": "assistant", "gemini": "assistant", "response": "assistant", "human": "user", "me": "user", "prompt": "user"}


def messages(spark, rows):
    """Rows of (conversation, index, role, text[, timestamp[, attachments]])."""
    full = [(i + 1, c, "utc", ix, r, (x[0] if x else None), "native", None, t, None, (x[1] if len(x) > 1 else None)) for i, (c, ix, r, t, *x) in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE)


@pytest.fixture(scope="module")
def zones(spark):
    s = spark.createDataFrame([("utc", "native", "UTC", "mdy")], "source string, timestamp_source string, home_zone string, date_order string")
    return s, spark.createDataFrame([("UTC", 0)], "abbrev string, offset_minutes int")


@pytest.fixture(scope="module")
def archive(sf):
    m = pd.read_parquet(f"{sf}/messages.parquet")
    m["who"] = m.role.str.strip().str.lower().map(lambda r: ALIASES.get(r, r))
    m["att"] = m.attachments.map(lambda x: None if x is None else "|".join(x))
    return m


def once(m):
    return m.sort_values("id").drop_duplicates([c for c in m.columns if c not in ("id", "attachments")])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf, name):
    assert len(queries.queries()[name](spark, sf).columns) >= 2


# --- 1: personal information -------------------------------------------------------------------------------------------
WORDS = [("Mark", "given", "en"), ("Elsie", "given", "en"), ("Stone", "family", "en"), ("Mossby", "family", "en"), ("Key", "family", "en"), ("念安", "given", "zh"), ("沈", "family", "zh"), ("千歳", "given", "ja"), ("霧島", "family", "ja")]
PII = [
    ("Write to me at mark12@posthaus.example if anything is missing.", {"email"}),
    ("cc x07017 at mail dot fernbrook dot example on the draft", {"email"}),
    ("We pinned left-widget@2.3.0 last week. I use @cached and @route.get.", set()),
    ("Call me on +44 20 7946 0422 after lunch.", {"phone"}),
    ("下午可以打178-0000-2380找我。", {"phone"}),
    ("Order 20244957778449577784 is still open. The host answers on 10.0.37.37. Chapter 45-106-45 has no page count.", set()),
    ("My social security number is 923 17 8749.", {"id_number"}),
    ("身份证号994415197205011749，请核对。", {"id_number"}),
    ("Mi DNI es 00.001178A.", {"id_number"}),
    ("I live at 59 Old Tannery St., Fenmoor 00633.", {"address"}),
    ("Bitte an Tuchmachergasse 46, 00199 Altmoor schicken.", {"address"}),
    ("À envoyer au 64 bd Clairsource, 00377 Valmont-sur-Aire.", {"address"}),
    ("Envíalo a Calle del Olmo Gris 43, 00481 Valdelirio.", {"address"}),
    ("我住在苍梧省白鹭市归燕街108号4单元156室。", {"address"}),
    ("住所は緑ヶ原県白鷺市川上通り8-7-106です。", {"address"}),
    ("My name is Corwin Ashgrove.", {"name"}),
    ("Regards, Mrs. Mossby", {"name"}),
    ("Elsie Mossby has seen the draft already.", {"name"}),
    ("剩下的可以问沈念安。", {"name"}),
    ("私は霧島 千歳と申します。", {"name"}),
    ("电话：0086-157-0000-2082帮我", {"phone"}), ("Tel. 600 000 668 Una tabla", {"phone"}), ("Passport no. 948 34 1210 is on the form.", {"id_number"}), ("Meine Ausweisnummer lautet LZ 723 5165.", {"id_number"}), ("此致，欧阳望舒沿海公路", {"name"}), ("cc x38776 AT xinxiang.example", {"email"}),
    ("Mark the rows and hope for the best. The Key store is open. Stone Avenue is closed.", set()),
    ("", set()), (None, set()), ("x" * 50_000, set()), ("1 " * 20_000, set()),
]


def test_pii(spark):
    rec = spark.createDataFrame([("f", str(i), t, 1) for i, (t, _) in enumerate(PII)], "field string, record_key string, text string, name int")
    names = spark.createDataFrame(WORDS, "word string, name_part string, lang string")
    got = {}
    for r in pii.detect(rec, names).collect():
        got.setdefault(int(r.record_key), set()).add(r.pii_type)
    for i, (t, want) in enumerate(PII):
        assert got.get(i, set()) == want, t
    out = {int(r.record_key): r.text for r in pii.detect(rec, names, masked=True).collect()}
    assert len(out) == len(PII) and out[0] == "Write to me at [EMAIL] if anything is missing." and out[len(PII) - 3] is None
    assert pii.detect(rec.where("false"), names).count() == 0


def test_pii_skip_links_join_distant_mentions():
    """A mention too weak on its own takes the label of a strong one that shares its words, however far; others don't."""
    f = pii.Field([])
    far, weak = "A short table with dates helps. " * 40, "\nCorwin Ashgrove\n"
    named = lambda t: [t[a:b] for a, b, k in f.spans(t) if k == "name"]
    assert named(far + weak) == []
    assert named("My name is Corwin Ashgrove. " + far + weak) == ["Corwin Ashgrove"] * 2
    assert named("My name is Nadia Corbeau. " + far + weak) == ["Nadia Corbeau"]


STREETS = ["14 Orchard Close", "27 Station Way", "3 Willow Walk", "12 Elm Ct, Dayton", "88 Market Sq", "5 Birch Pl.", "18 Maple Dr, Ohio", "Auf dem Hügel 12", "An den Eichen 5", "12bis rue des Lilas", "東京都中央区銀座4-2-11", "Hauptstraße\u00a012"]
PHONES = ["Call me on +44\u00a020\u00a07946\u00a00422", "Tel. 600\u202f000\u202f668", "Call 0171\u20114458\u20111290"]


def test_pii_filter_lets_all_forms_through(spark):
    texts = [(t, "address") for t in STREETS] + [(t, "phone") for t in PHONES] + [("Nadia Corbeau already saw it.", "name")]
    rec = spark.createDataFrame([("f", str(i), t) for i, (t, _) in enumerate(texts)], "field string, record_key string, text string")
    names = spark.createDataFrame(WORDS, "word string, name_part string, lang string")
    got = {(int(r.record_key), r.pii_type) for r in pii.detect(rec, names).collect()}
    assert got == {(i, k) for i, (_, k) in enumerate(texts)}
    masked = {int(r.record_key): r.text for r in pii.detect(rec, names, masked=True).collect()}
    assert all("[" in masked[i] for i in range(len(texts)))


_FIELD, _HITS = pii.Field(WORDS), pii.traced(WORDS)
PIECES = STREETS + PHONES + [t for t, _ in PII if t and len(t) < 200] + "Mr Mx Señora Don Doña M Fr. Herrn Ashgrove Corwin Stone O’Brien D. 沈 安 念安 柳 霧島 千歳 千 様 に さん より 我是 已经看 看过 昨天已 昨天 号 路 区 丁目 at AT {at} [at] dot . , - * > · 7 12 12b 1234567 ４５ a12b3456 bis ter rue Av. av C/ P.º n.º Am Im Zum Weg str. St Way Hill already saw has read pour le reste hat bereits yours, ask frag".split() + ["\n", "  ", "\u00a0", "\u3000", "\u2011"]


@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=7), st.sampled_from(["", " ", "  ", "\n", "\u00a0"]))
@settings(max_examples=1500, deadline=None)
def test_pii_every_text_with_a_node_passes_the_filter(pieces, sep):
    t = sep.join(pieces)
    assert not _FIELD.nodes(t.translate(pii._THIN)) or _HITS(pa.array([t]))[0].as_py(), t


def test_pii_skip_links_at_any_number_of_mentions():
    """A weak mention that a strong one repeats, behind 397 and 399 others."""
    f = pii.Field([])
    got = []
    for n in (397, 399):
        t = "My name is Corwin Ashgrove. " + "x1@example.org " * n + "and so on " * 9 + "\nCorwin Ashgrove\n"
        assert len(f.nodes(t)) == n + 2
        got.append([t[a:b] for a, b, k in f.spans(t) if k == "name"])
    assert got == [["Corwin Ashgrove"] * 2] * 2


# --- 2: pairs ----------------------------------------------------------------------------------------------------------
LONG = "The answer takes the cache into account and then the index. It is best to look at both."
PAIRS = [
    ("What about the cache of the build?", "", "empty"), ("What about the cache of the build?", "```\n```", "empty"),
    ("What about the cache of the build?", "The answer takes the cache into account and then the", "truncated"),
    ("What about the cache of the build?", "Look:\n\n```\nfor row in rows:", "truncated"), ("What about the cache of the build?", "Look:\n\n| a | b |\n|---|---|\n| 1 | 2", "truncated"),
    ("What about the cache of the build?", LONG + "\n\nSteps:\n- check the cache\n- ", "truncated"),
    ("What about the index?", "I'm sorry, but I can't help with that.", "refusal"), ("And the parser, what about it?", "I'm sorry, but I can't help with that.", "refusal"), ("Is the loop the cause of it?", "I'm sorry, but I can't help with that.", "refusal"),
    ("What about the cache of the build?", "I can't open the file itself, but your description is enough. " + LONG, None),
    ("What about the cache of the build?", "**what about the cache of the build?**", "copy"),
    ("Why does the melody sound sad?", "Why does the melody sound sad?\n\nWhy does the melody sound sad?", "copy"),
    ("What about the cache of the build?", "Le cache est la cause, et il faut regarder les deux pour la suite.", "wrong_language"),
    ("What about the cache of the build? Reply in French, please.", "Le cache est la cause, et il faut regarder les deux pour la suite.", None),
    ("What about the cache of the build?", LONG, None), ("How long?", "42 minutes", None), ("Done?", "Yes", None), ("血圧の記録は終わりましたか。", "42分", None),
]


def test_pair_defects(spark, zones):
    rows = [x for i, (q, a, _) in enumerate(PAIRS) for x in ((f"c{i}", 0, "User", q), (f"c{i}", 1, "bot", a))]
    rows += [("gap", 0, "user", "q?"), ("gap", 2, "model", ""), ("files", 0, "user", "draw it"), ("files", 1, "model", None, None, ["a.png"]), (None, 0, "user", "lost?"), (None, 1, "model", "")]
    m = messages(spark, rows)
    twice = m.where("id = 2").withColumn("id", F.lit(999).cast("long"))
    got = {r.response_id: r.defect for r in pairs.defects(m.union(twice), *zones).collect()}
    assert got == {2 * i + 2: d for i, (_, _, d) in enumerate(PAIRS) if d}
    assert pairs.defects(m.where("false"), *zones).count() == 0


def test_pair_templates_with_a_topic(spark, zones):
    """A template is found whatever fills it, and reveals what declines in other words; one that answers reveals nothing."""
    topics = ["fever curve", "python skeleton", "hip operation", "parser", "gravity model", "bread knife"]
    rows = [x for i, t in enumerate(topics) for x in ((f"c{i}", 0, "user", f"question {i} of the day?"), (f"c{i}", 1, "ai", f"My rules keep me from discussing the {t}."))]
    rows += [x for i, t in enumerate(topics) for x in ((f"d{i}", 0, "user", f"demand {i} of the day?"), (f"d{i}", 1, "ai", f"Take the second road after the {t}."))]
    rows += [("e", 0, "user", "a lone demand?"), ("e", 1, "ai", "The bridge cannot carry more than one car.")]
    got = {r.response_id: r.defect for r in pairs.defects(messages(spark, rows), *zones).collect()}
    assert got == {2 * i + 2: "refusal" for i in range(len(topics))}


def test_pair_hints_are_wider_than_the_wording():
    """No text that DECLINE or a language's name matches is without a hint."""
    for rx, at in ((pairs.DECLINE, pairs._HINTED_AT), (pairs._ANY_NAME, pairs._NAMED_AT)):
        for alt in re.sub(r"\\b|\(\?:|[()]", "", rx.pattern).split("|"):
            word = re.sub(r"\\w[*+]|\w?\?", "", re.sub(r"\[(.)[^\]]*\]", r"\1", alt)).replace("{0,2}", "")
            if rx.search(word):
                assert re.search(at.replace("(?i)", ""), word.lower()), word


def test_pair_refusals_and_cut_items_of_any_length(spark, zones):
    no = "I can't help with the request about the cache, since it is against my rules to speak of it here"
    longer = " ".join([no + "."] * 5)
    item = "the step takes the cache and then the index of the build " * 9 + "to the end"
    rows = [x for i, q in enumerate(["What about the index?", "And the parser, what about it?", "Is the loop the cause of it?"]) for x in ((f"c{i}", 0, "user", q), (f"c{i}", 1, "model", longer))]
    rows += [("d", 0, "user", "Which steps does the build take?"), ("d", 1, "model", f"Steps:\n- {item}\n- the second is the last."), ("e", 0, "user", "And which of them are first?"), ("e", 1, "model", f"Steps:\n- the first is short\n- {item[:470].strip()}")]
    assert len(longer) > 320 and len(item) > 480
    got = {r.response_id: r.defect for r in pairs.defects(messages(spark, rows), *zones).collect()}
    assert got == {2: "refusal", 4: "refusal", 6: "refusal", 10: "truncated"}


def test_templates_compare_all_members_of_a_bucket(spark):
    """Among these openings are two alike that meet only under a centre that is like neither."""
    rng = random.Random(9)
    base = sorted({"for # i have to pass: giving advice on the " + "".join(rng.choices("abcd ", k=rng.randrange(6, 26))) + " is not something i can do here." for _ in range(12)})
    texts = [x for t in base for x in (t, t + " sorry")]
    rng.shuffle(texts)
    buckets = {}
    for r in next(pairs._signatures([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["o", "opening"])])).to_pylist():
        buckets.setdefault(r["band"], set()).add(r["o"])
    grams = [set(pairs._shingles(t.split(" "))) for t in texts]
    want = list(range(len(texts)))
    for b in buckets.values():
        for x, y in itertools.combinations(b, 2):
            if len(grams[x] & grams[y]) / len(grams[x] | grams[y]) >= 0.8:
                want = [min(want[x], want[y]) if w in (want[x], want[y]) else w for w in want]
    got = {r.o: r.cluster for r in pairs.templates(spark.createDataFrame(list(enumerate(texts)), "o long, opening string")).collect()}
    same = lambda c: {(x, y) for x in range(len(texts)) for y in range(x) if c[x] == c[y]}
    assert same(got) == same(want)


def test_languages():
    assert [language(t)[0] for t in ("The cat is on the table.", "Die Katze ist auf dem Tisch.", "Le chat est sur la table.", "El gato está en la mesa.", "猫在桌子上面，它不想下来。", "猫はテーブルの上にいます。", "```\nx\n```")] == ["en", "de", "fr", "es", "zh", "ja", None]


# --- 3: subjects -------------------------------------------------------------------------------------------------------
def test_subjects_held_out():
    rng = random.Random(3)
    words = {0: "parser branch cache index module".split(), 1: "goalkeeper marathon racket referee pitch".split(), 2: "oven dough broth glaze knife".split()}
    frames = ["why does the {} go wrong in my note?", "please compare the {} with the {} for the draft.", "is the {} finished, yes or no?"]
    say = lambda s: [rng.choice(frames).format(rng.choice(words[s]), rng.choice(words[s])) for _ in range(2)]
    data = []
    for _ in range(240):
        ss = set(rng.sample(range(3), rng.choice((1, 1, 1, 2))))
        data.append(([x for s in ss for x in say(s)], ss, None))
    *model, cuts = subjects.fit(data[:180], [], 3)
    memo, hit, miss = {}, 0, 0
    for texts, ss, _ in data[180:]:
        got = {c for c in range(3) if subjects._best(*model, texts, memo)[c] >= cuts[c]}
        hit += len(got & ss)
        miss += len(got ^ ss)
    assert hit / (hit + miss / 2) > 0.95


def test_subjects_in_passing_are_learned():
    """What frames a passing remark is told from labels alone, for words that were never seen in one."""
    rng = random.Random(4)
    words = {0: "parser branch cache index module".split(), 1: "goalkeeper marathon racket referee pitch".split(), 2: "oven dough broth glaze knife".split()}
    data = []
    for _ in range(400):
        s, o = rng.sample(range(3), 2)
        data.append(([f"why does the {rng.choice(words[s])} go wrong in my note?"] + [f"by the way, the {rng.choice(words[o])} kept me busy all day."] * (rng.random() < 0.5), {s}, None))
    *model, cuts = subjects.fit(data[:300], [], 3)
    memo, wrong = {}, 0
    for texts, ss, _ in data[300:]:
        wrong += {c for c in range(3) if subjects._best(*model, texts, memo)[c] >= cuts[c]} != ss
    assert wrong <= 5


def test_subjects_units_and_empty(spark, sf):
    assert subjects.units("By the way, I was busy with the oven. Why does the parser fail in job-x12?") == ["by the way, i was busy with the oven.", "why does the parser fail in"]
    m, a, l, s = (table(spark, sf, t) for t in ("messages", "analysis", "subject_labels", "subjects"))
    assert subjects.assign(m.where("false"), a.where("false"), l.where("false"), s).count() == 0
    got = subjects.assign(m, a, l, s).toPandas()
    assert not got.duplicated().any() and set(got.subject) <= {r[0] for r in s.select("subject").collect()} and "gemini-unknown" not in set(got.conversation_id)


# --- 5: duplicates -----------------------------------------------------------------------------------------------------
def canon(t):
    t = unicodedata.normalize("NFKC", t).upper().lower()
    return "".join(c for c in t if unicodedata.category(c)[0] in "LNMS" and c not in "`^~|´")


def brute_key(t):
    t = re.sub(r"^[\s​]+|[\s​]+$", "", unicodedata.normalize("NFKC", t))
    if t.startswith("{"):
        try:
            return "".join(sorted(canon(k) + canon(str(v)) for k, v in json.loads(t).items()))
        except ValueError:
            pass
    lines = [x for x in re.split("[\r\n]+", t) if x.strip()]
    if len(lines) > 1 and all(re.match("[^:]{1,60}:", x) for x in lines):
        return "".join(sorted(map(canon, lines)))
    return canon(t)


def test_duplicates_equal_brute_force(spark, sf, archive):
    got = queries.queries()["p5_found"](spark, sf).toPandas()
    m = archive.assign(k=archive.text.fillna("").map(brute_key))
    m = m[m.k.map(lambda k: sum(unicodedata.category(c)[0] in "LN" for c in k) >= 60)]
    first = m.groupby(["who", "k"]).id.transform("min")
    assert {(a, b) for k, a, b in got.itertuples(index=False) if k == "message"} == {(str(a), str(b)) for a, b in zip(first, m.id) if a != b}
    c = pd.read_parquet(f"{sf}/conversations.parquet").conversation_id.drop_duplicates()
    low = c.groupby(c.map(canon)).transform("min")
    assert {(a, b) for k, a, b in got.itertuples(index=False) if k == "conversation"} == {(a, b) for a, b in zip(low, c) if a != b}


def test_duplicates_runs_over_partitions(spark):
    """One key holds most rows, so that its run is split over partitions."""
    rows = [("k", "same" if i % 4 else f"own{i}", str(i), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "kind string, key string, rec string, rec_long long").repartition(7)
    got = {(r.first_rec, r.copy_rec) for r in duplicates.collapse(df).collect()}
    assert got == {("1", str(i)) for i in range(2, 4000) if i % 4}
    assert duplicates.collapse(df.where("false")).count() == 0


def test_duplicate_counts_hold_every_row(spark, tmp_path):
    texts = ["Short one.", "short  ONE", "alone", None, "", "!!", None] + ["a longer text that many have"] * 3000
    messages(spark, [("c", i, "user", t) for i, t in enumerate(texts)]).repartition(5).write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([("ab-1",), ("AB 1",), ("ab-1",), ("--",), ("--",), (None,)], "conversation_id string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in duplicates.p5_counts(spark, str(tmp_path)).select("record_kind", "first_key", "copies").collect()}
    assert got == {("message", "1", 2), *(("message", str(i), 1) for i in (3, 4, 5, 6, 7)), ("message", "8", 3000), ("conversation", "AB 1", 3), ("conversation", "--", 2), ("conversation", None, 1)}


def test_duplicates_nulls(spark):
    m = spark.createDataFrame([(1, None, None, 1), (2, "user", "", 1), (3, "user", '{"a": 1, "a": 2}' + "x" * 70, 1), (4, None, "y" * 20_000, 1), (5, None, "Y" * 20_000, 1)], "id long, role string, text string, key int")
    assert [(r.first_rec, r.copy_rec) for r in duplicates.collapse(duplicates.message_records(m)).collect()] == [("4", "5")]


# --- 6: conversations --------------------------------------------------------------------------------------------------
def test_conversations_equal_brute_force(spark, sf, archive):
    m = once(archive).assign(empty=lambda d: d.text.fillna("").map(lambda t: all(c.isspace() or unicodedata.category(c)[0] in "CZ" for c in t)) & d.att.isna())
    want, unsure = {}, set()
    for c, g in m.groupby("conversation_id"):
        none = g.message_index.isna().sum()
        if g["empty"].all():
            want[c] = "empty"
        elif 0 < none < len(g) or none == 0 and sorted(g.message_index) != list(range(len(g))):
            want[c] = "broken"
        elif none == 0:
            k = [x for x in g.sort_values("message_index").who if x in ("user", "assistant")]
            if any(a == b == "user" for a, b in itertools.pairwise([*k, "user"])):
                want[c] = "missing_reply"
        else:
            unsure.add(c)
    got = {r.conversation_id: r.defect for r in queries.queries()["p6_found"](spark, sf).collect()}
    assert {c: d for c, d in got.items() if c not in unsure} == want


def test_ordered_conversations(spark, sf):
    got = queries.queries()["p6_conversations"](spark, sf).toPandas()
    bad = {r.conversation_id for r in queries.queries()["p6_found"](spark, sf).collect()}
    assert not set(got.conversation_id) & bad and got.id.is_unique
    for _, g in got.groupby(["conversation_id", got.thread.fillna(-1)]):
        assert sorted(g.position) == list(range(len(g)))
        talk = [r for r in g.sort_values("position").role if r in ("user", "assistant")]
        assert not any(a == b == "user" for a, b in itertools.pairwise([*talk, "user"]))


def test_conversation_cases(spark, zones):
    t = "2024-01-01T00:00:%02d+00:00"
    rows = [("e", 0, "user", " ​"), ("e", 1, "ai", None), ("f", 0, "user", None, None, ["x"]), ("f", 1, "ai", "a"), ("p", 0, "user", "q"), ("p", None, "ai", "a"), ("d", 0, "user", "q"), ("d", 0, "ai", "a"), ("n", 1, "user", "q"), ("n", 2, "ai", "a"), ("m", 0, "user", "q"), ("m", 1, "tool", "x"), ("m", 2, "user", "q"), ("m", 3, "ai", "a"), ("l", 0, "user", "q"), ("l", 1, "ai", "a"), ("l", 2, "user", "q")]
    rows += [("t", None, "ai", "a", t % 9), ("t", None, "user", "q", t % 3), ("u", None, "user", "q", t % 9), ("u", None, "ai", "a", t % 3), ("ok", 0, "system", "s"), ("ok", 1, "user", "q"), ("ok", 2, "ai", "a"), (None, 0, "user", "lost?"), (None, 1, "ai", "found")]
    m = messages(spark, rows)
    m = m.union(m.where("conversation_id = 'ok'").withColumn("id", F.col("id") + 100))
    got = {r.conversation_id: r.defect for r in conversations.validate(conversations.rebuild(m, *zones)).where("defect is not null").collect()}
    assert got == {"e": "empty", "p": "broken", "d": "broken", "n": "broken", "m": "missing_reply", "l": "missing_reply", "u": "missing_reply"}
    assert conversations.validate(conversations.rebuild(m.where("false"), *zones)).count() == 0


def test_long_conversation_over_partitions(spark, zones):
    rows = [("big", i, "user" if i % 2 == 0 else "ai", f"t{i}") for i in range(3000)] + [("s", 0, "user", "q"), ("s", 1, "ai", "a")]
    light = conversations.light_rows(messages(spark, rows), *zones)
    assert conversations.validate(light).where("defect is not null").count() == 0
    assert [r.defect for r in conversations.validate(light.where("idx <> 1501")).where("defect is not null").collect()] == ["broken"]


def test_threads(spark, zones):
    rows = [("gemini-unknown", 0, "user", "What about the cache of the build here?"), ("gemini-unknown", 1, "ai", "one"), ("gemini-unknown", 2, "user", "next"), ("gemini-unknown", 3, "ai", "You asked: “What about the cache of the build here?”\n\ntwo"), ("gemini-unknown", 4, "user", "alone")]
    got = {r.id: r.thread for r in conversations.rebuild(messages(spark, rows), *zones).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_threads_of_rows_without_an_id(spark, zones):
    """Exchanges without an id are told apart by time; without a time, only an index that is there once tells anything."""
    t = "2024-01-01T%02d:%02d:%02d+00:00"
    rows = [x for i in range(50) for x in ((None, 0, "user", f"q{i}", t % (i // 60, i % 60, 1)), (" ", 1, "ai", f"a{i}", t % (i // 60, i % 60, 9)))]
    got = {r.id: r.thread for r in conversations.rebuild(messages(spark, rows), *zones).collect()}
    assert got == {i: i - (i - 1) % 2 for i in range(1, 101)}
    untimed = [r[:4] for r in rows]
    got = {r.id: r.thread for r in conversations.rebuild(messages(spark, untimed), *zones).collect()}
    assert len(set(got.values())) == 100
    got = {r.id: r.thread for r in conversations.rebuild(messages(spark, untimed[:2]), *zones).collect()}
    assert got == {1: 1, 2: 1}


def test_catch_all_threads_are_judged_one_by_one(spark, zones, tmp_path):
    c = conversations.CATCH_ALL
    rows = [(c, 0, "user", "q"), (c, 1, "ai", "a"), (c, 2, "user", "no answer"), (c, 3, "user", "q"), (c, 4, "tool", "t"), (c, 5, "ai", "a"), (c, None, "user", "q"), ("z", 1, "user", "q"), ("z", 2, "ai", "a")]
    messages(spark, rows).write.parquet(f"{tmp_path}/messages.parquet")
    for name, df in zip(("export_sources", "zone_abbrevs"), zones):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = conversations.p6_conversations(spark, str(tmp_path)).collect()
    assert sorted((r.thread, r.position, r.id, r.role) for r in got) == [(1, 0, 1, "user"), (1, 1, 2, "assistant"), (4, 0, 4, "user"), (4, 1, 5, "other"), (4, 2, 6, "assistant")]
    assert {r.conversation_id: r.defect for r in conversations.p6_found(spark, str(tmp_path)).collect()} == {c: "broken", "z": "broken"}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.booleans(), st.booleans()), max_size=30), st.integers(1, 6))
def test_preceding(spark, rows, parts):
    """Links over any number of partitions, held against a plain scan."""
    want, last = {}, {}
    for i, (g, seeks, gives) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if seeks and g in last:
            want[i] = last[g]
        if gives:
            last[g] = i
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(i, g, s, v, None, i) for i, (g, s, v) in enumerate(rows)], "id long, g string, seeks boolean, gives boolean, step long, at long")
        assert {r.id: r.prev for r in conversations.preceding(df, "at").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in conversations.components(df).collect()} == {x: find(x) for x in parent}


# --- 7: encoding -------------------------------------------------------------------------------------------------------
def _reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encoding_equals_library(spark, sf):
    got = {r.doc_id: r.ids for r in queries.queries()["p7_ids"](spark, sf).collect()}
    d = pd.read_parquet(f"{sf}/documents.parquet")
    ref = _reference().encode_batch([t or "" for t in d.text], add_special_tokens=False)
    assert got == {k: r.ids for k, r in zip(d.doc_id, ref)}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_any_text(text):
    enc = encoding.encoder(tokenizer_file("byte_bpe_50k.tiktoken"))
    ids = enc.encode([text])[0]
    assert b"".join(enc.token[i] for i in ids).decode() == text
    assert ids == _REF.encode(text, add_special_tokens=False).ids


_REF = _reference()


def test_encoding_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (4, "a" * 30_000), (4, "a" * 30_000)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted((r.doc_id, len(r.ids)) for r in encoding.encode(df).collect())
    assert got[:2] == [(1, 0), (2, 0)] and len(got) == 5 and got[3] == got[4]
    assert sorted((r.doc_id, r.n_tokens) for r in encoding.encode(df, lengths=True).collect()) == got
    assert encoding.encode(df.where("false")).count() == 0


# --- 8: packing --------------------------------------------------------------------------------------------------------
def check_packing(rows, sizes, caps):
    for w, cap in caps.items():
        mine = [r for r in rows if r.window_name == w]
        fill = Counter()
        for r in mine:
            if r.container_id is not None:
                fill[r.container_id] += r.n_tokens
        assert max(fill.values(), default=0) <= cap
        whole = Counter()
        for r in mine:
            whole[r.doc_id] += r.n_tokens
        assert whole == Counter({k: n for k, n in sizes.items()}) or all(whole[k] == n for k, n in sizes.items())
        per = Counter(r.doc_id for r in mine)
        assert all(per[k] == (1 if n <= cap else math.ceil(n / cap)) for k, n in sizes.items())
        yield w, len(fill), math.ceil(sum(sizes.values()) / cap)


def test_packing(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice((3, 3, 17, 60, 61, 99, 100, 101, 250, rng.randint(1, 180))) for i in range(3000)} | {5000: 0, 5001: 1234, 5002: 100}
    items = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(5003, None, "x")], "doc_id long, n_tokens long, rest string")
    wins = spark.createDataFrame([("a", 100), ("b", 256), (None, 0)], "window_name string, capacity_tokens int")
    rows = packing.pack(items, wins).collect()
    for _, got, bound in check_packing(rows, sizes | {5003: 0}, {"a": 100, "b": 256}):
        assert got <= bound * 1.25
    assert packing.pack(items.where("false"), wins).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 60))
def test_plan_covers_every_item_once(lengths, cap):
    rows, bins = packing.plan(lengths, cap)
    fill, seen = Counter(), Counter()
    for s, lo, hi, first, slot, per in rows:
        for r in range(lo, hi):
            seen[(s, r)] += 1
            fill[first + (slot + r - lo) // per] += s
    assert seen == Counter({(s, r): 1 for s, n in lengths.items() for r in range(n)})
    assert len(fill) == bins and max(fill.values(), default=0) <= cap


# --- 9: sentences ------------------------------------------------------------------------------------------------------
SENTENCES = [
    ("Dr. Larkfield noted approx. 7.43 units, i.e. less than planned. Is it so?! Yes.", ["Dr. Larkfield noted approx. 7.43 units, i.e. less than planned.", "Is it so?!", "Yes."]),
    ("He wrote 'No. Not now.' and left. He asked: “Ready?” A table helps.", ["He wrote 'No. Not now.' and left.", "He asked: “Ready?”", "A table helps."]),
    ("From Tallow & Co. I would go at 5 p.m. Then Wait ... there is\nmore.", ["From Tallow & Co.", "I would go at 5 p.m.", "Then Wait ... there is\nmore."]),
    ("Am 8. Mai war z. B. nichts offen. Siehe Abb. 6 bzw. Nr. 18. Heute (siehe S. 30. Dort steht mehr.) auch.", ["Am 8. Mai war z. B. nichts offen.", "Siehe Abb. 6 bzw. Nr. 18.", "Heute (siehe S. 30. Dort steht mehr.) auch."]),
    ("# 1.1 Title. Two\n\n- one. Two.\n2. item\n```\nx. Y.\n```\nEnd", ["1.1 Title. Two", "one.", "Two.", "item", "End"]),
    ("“真的吗？”她问。（没人问过。）你看过《等等！别走。》这本书吗？后来就没有下文了……如果好。这件事……说来话长。", ["“真的吗？”她问。", "（没人问过。）", "你看过《等等！别走。》这本书吗？", "后来就没有下文了……", "如果好。", "这件事……说来话长。"]),
    ("「止めて！熱すぎる。」と言いました。会議（二回あった。）で決まりました。それは……長い話です。", ["「止めて！熱すぎる。」と言いました。", "会議（二回あった。）で決まりました。", "それは……長い話です。"]),
    ("ราคา1,323บาท คำถามนี้ยังไม่มีคำตอบ", ["ราคา1,323บาท", "คำถามนี้ยังไม่มีคำตอบ"]),
    ("डॉ. मेघवर्ण ने जाँची। “रुको! यह गरम है।” उसने कहा। संस्करण 2.2 तैयार है।", ["डॉ. मेघवर्ण ने जाँची।", "“रुको! यह गरम है।” उसने कहा।", "संस्करण 2.2 तैयार है।"]),
    ("راجع د. نورالبستان الجدول. قال: «توقف! إنه ساخن.» ثم خرج. هل الأمر؟", ["راجع د. نورالبستان الجدول.", "قال: «توقف! إنه ساخن.» ثم خرج.", "هل الأمر؟"]),
    ("It is easier to judge. npm is not needed here. Then it ends.If the branch stays, see config.yaml first.", ["It is easier to judge.", "npm is not needed here.", "Then it ends.", "If the branch stays, see config.yaml first."]),
    ("他回了一句“好。知道了。”（没人问过。）No. 9 很好。牌子上写着「暂停营业。下午再来！」后来就没有下文了……", ["他回了一句“好。知道了。”", "（没人问过。）", "No. 9 很好。", "牌子上写着「暂停营业。下午再来！」", "后来就没有下文了……"]),
    ("", []), (None, []), (" \n\t ", []), ("```\nopen fence. Never closed.", []),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(SENTENCES)], "doc_id long, text string, start_pos int")
    got = {}
    for r in sentences.split(df).orderBy("doc_id", "start_pos").collect():
        got.setdefault(r.doc_id, []).append(SENTENCES[r.doc_id][0][r.start_pos : r.end_pos])
    for i, (_, want) in enumerate(SENTENCES):
        assert got.get(i, []) == want
    assert sentences.split(df.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?。！“”「」()（）'\"…\n#-`1·กा", max_size=60))
def test_sentences_never_overlap(text):
    last = 0
    for a, b in sentences.sentences(text):
        assert last <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        last = b

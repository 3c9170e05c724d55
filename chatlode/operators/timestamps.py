"""Mixed timestamp formats and time zones: one UTC instant per value that denotes one.

Every value gets all readings under which it is an existing date: one for most formats, two for all-numeric dates (the
order of day and month), up to four for plain numbers (seconds to nanoseconds). Each (source, timestamp_source) has a
mixture over the readings' formats, found by expectation-maximisation: a value contributes, to each format that can read
it, its likelihood there, which is low for an instant that no archive holds. The declared date order of a source weighs
as many observations as the source has values, times a factor, whatever the size of the data. The posterior picks the
reading; values whose best posterior stays under `min_posterior`, and those without a known zone, are marked unresolved.

Everything but the few EM rounds runs in built-in expressions. EM works on counts per (source, set of readings): a few
dozen rows per source, whatever the number of values.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlode.functions.text import bound
from chatlode.session import small

# Month names as the exports write them (English abbreviations and names, German names).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "sept": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}

#: Units of plain numbers, as powers of ten of a second, and the instants, in seconds, that any of them may denote.
UNITS = {"seconds": 0, "milliseconds": 3, "microseconds": 6, "nanoseconds": 9}
EARLIEST, LATEST = 1_000_000, 100_000_000_000
#: Instants of an archive, in seconds: 1990 to 2100. Others have the likelihood UNLIKELY.
LIKELY, UNLIKELY = (631_152_000, 4_102_444_800), 1e-4
#: A row that is already in the target form: UTC offset written out, no fraction or six digits.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?\+00:00$"

_CLOCK = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?"
_TAIL = r"(?:\s*(?<ap>am|pm|a\.m\.|p\.m\.)(?![a-z]))?(?:\s+uhr)?\s*(?<z>z|[+-]\d{1,2}(?::?\d{2})?|\[[a-z_+\-]+(?:/[a-z_+\-0-9]+){0,2}\]|[a-z_]+(?:/[a-z_+\-0-9]+){1,2}|[a-z]{2,5})?"
_PATTERNS = {
    "ymd": rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t ,]\s*)\s*{_CLOCK}{_TAIL}$",
    "compact": rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(?<h>\d{{2}})(?<mi>\d{{2}})(?<s>\d{{2}})(?:[.,](?<f>\d{{1,9}}))?{_TAIL}$",
    "cjk": rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(?<cap>上午|下午|午前|午後)?\s*{_CLOCK}{_TAIL}$",
    "num": rf"^(\d{{1,2}})[/](\d{{1,2}})[/](\d{{4}}),?\s+{_CLOCK}{_TAIL}$",
    "dot": rf"^(\d{{1,2}})[.](\d{{1,2}})[.](\d{{4}}),?\s+{_CLOCK}{_TAIL}$",
    "dmony": rf"^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})\.?\s+(\p{{L}}{{3,10}})\.?,?\s+(\d{{4}}),?\s+{_CLOCK}{_TAIL}$",
    "mondy": rf"^(\p{{L}}{{3,10}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_TAIL}$",
    "ctime": rf"^[a-z]{{3}}\s+([a-z]{{3}})\s+(\d{{1,2}})\s+{_CLOCK}\s+(?<y>\d{{4}})$",
}
_EPOCH = r"^[+-]?\d+(\.\d+)?(e[+]?\d+)?$"


def _fields(name: str, pattern: str) -> str:
    """Replacement that writes the parts of a match as date|date|date|hour|minute|second|fraction|am-pm|zone."""
    dates = "$1|$2|${y}" if name == "ctime" else "$1|$2|$3"
    rest = [("${%s}" % k if f"(?<{k}>" in pattern else "") for k in ("h", "mi", "s", "f")]
    half = "".join("${%s}" % k for k in ("ap", "cap") if f"(?<{k}>" in pattern)
    return "|".join([dates, *rest, half, "${z}" if "(?<z>" in pattern else ""])


def _clean(raw: Column) -> Column:
    """Lower case, any kind of blank as one plain space, invisible characters gone."""
    t = F.regexp_replace(raw, r"[​-‏⁠﻿]", "")
    return F.lower(F.trim(F.regexp_replace(t, r"[\s  -   　]+", " ")))


def _local_us(order: str) -> Column:
    """Microseconds of the clock written in `fields`, its date read in `order`; null if there is no such time."""
    part = lambda i: F.element_at("fields", i + 1)
    y, mo, day = (part(order.index(k)) for k in "ymd")
    sec = F.coalesce(part(5).try_cast("int"), F.lit(0))
    day_at = F.try_make_timestamp(y.try_cast("int"), mo.try_cast("int"), day.try_cast("int"), F.col("hour"), part(4).try_cast("int"), F.when(sec < 60, sec).cast("decimal(16,6)"), F.lit("UTC"))
    return F.unix_micros(day_at) + F.coalesce(F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("long"), F.lit(0))


def _epoch_us(t: Column, power: int) -> Column:
    """Microseconds of a plain number in units of 10**-power seconds; null outside of EARLIEST to LATEST, 0 denotes nothing."""
    v = t.try_cast("double")
    exact = F.coalesce(t.try_cast("decimal(38,9)"), v.cast("decimal(38,9)"))
    us = F.round(exact * 10 ** (6 - power)) if power <= 6 else F.round(exact / 10 ** (power - 6))
    return F.when(F.abs(v).between(EARLIEST * 10.0**power, LATEST * 10.0**power), us.cast("long"))


def _mixture(pdf: pd.DataFrame, prior: float, rounds: int) -> pd.DataFrame:
    """EM for one source: rows are sets of readings ('format:likelihood' joined by '|') with their counts; result, the weights."""
    declared = pdf.declared.dropna().iloc[0] if pdf.declared.notna().any() else None
    sets = [([(f, float(x)) for f, x in (r.split(":") for r in s.split("|"))], float(n)) for s, n in zip(pdf.readings, pdf.n)]
    names = sorted({f for s, _ in sets for f, _ in s})
    alpha = dict.fromkeys(names, 1.0)
    if declared in ("mdy", "dmy"):  # as many observations as there are such values, times `prior`
        alpha[declared] = alpha.get(declared, 1.0) + prior * sum(n for s, n in sets if any(f in ("mdy", "dmy") for f, _ in s))
        names = sorted(alpha)
    w = {f: 1.0 for f in names}
    for _ in range(rounds):
        got = dict(alpha)
        for s, n in sets:
            total = sum(w[f] * x for f, x in s)
            for f, x in s:
                got[f] += n * w[f] * x / total
        whole = sum(got.values())
        w = {f: v / whole for f, v in got.items()}
    return pd.DataFrame({"source": [pdf.source.iloc[0]], "timestamp_source": [pdf.timestamp_source.iloc[0]], "weights": [json.dumps(w)]})


def _read(messages: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """`key`, `keep`, source, timestamp_source and raw with the readings (name, us) of each value, its family and its zone `z`."""
    base = messages.select(F.col(key), *keep, "source", "timestamp_source", F.col("timestamp").alias("raw"))
    base = base.withColumn("canonical", F.coalesce(F.col("raw").rlike(CANONICAL), F.lit(False)))
    base = bound(base, "t", F.when(~F.coalesce(F.col("timestamp_source") == "none", F.lit(False)), _clean(F.col("raw"))))
    t = F.col("t")
    fam = F.when(F.col("canonical"), F.lit("ymd")).when(t.rlike(_EPOCH), F.lit("epoch"))
    for name, p in _PATTERNS.items():
        fam = fam.when(t.rlike(p), F.lit(name))
    base = bound(base, "family", fam)
    parts = F.lit(None).cast("string")
    for name, p in _PATTERNS.items():
        parts = F.when(F.col("family") == name, F.regexp_replace(t, p, _fields(name, p))).otherwise(parts)
    base = bound(base, "fields", F.split(parts, r"\|"))
    # Month names become numbers, am/pm the hour of 24.
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    number = lambda i: F.coalesce(F.try_element_at(months, F.element_at("fields", i)).cast("string"), F.element_at("fields", i))
    named = F.col("family").isin("dmony", "mondy", "ctime")
    base = bound(base, "fields", F.when(named, F.concat(F.array(number(1), number(2)), F.slice("fields", 3, 9))).otherwise(F.col("fields")))
    hour, half = F.element_at("fields", 4).try_cast("int"), F.element_at("fields", 8)
    pm, am = half.isin("pm", "p.m.", "下午", "午後"), half.isin("am", "a.m.", "上午", "午前")
    hour = F.when((pm | am) & ((hour > 12) | (hour < 1)), None).when(pm & (hour < 12), hour + 12).when(am & (hour == 12), 0).otherwise(hour)
    base = base.withColumn("hour", F.when(hour < 24, hour))
    family = F.col("family")
    reading = lambda name, us: F.struct(F.lit(name).alias("name"), us.alias("us"))
    valid = F.filter(
        F.when(family.isin("ymd", "compact", "cjk"), F.array(F.struct(family.alias("name"), _local_us("ymd").alias("us"))))
        .when(family.isin("mondy", "ctime"), F.array(F.struct(family.alias("name"), _local_us("mdy").alias("us"))))
        .when(family.isin("dmony", "dot"), F.array(F.struct(family.alias("name"), _local_us("dmy").alias("us"))))
        .when(family == "num", F.array(reading("mdy", _local_us("mdy")), reading("dmy", _local_us("dmy"))))
        .when(family == "epoch", F.array(*[reading(k, _epoch_us(t, p)) for k, p in UNITS.items()])),
        lambda x: x["us"].isNotNull(),
    )
    base = bound(base.withColumn("z", F.coalesce(F.element_at("fields", 9), F.lit(""))), "readings", valid).drop("fields", "hour")

    return base


def _likely(x: Column) -> Column:
    """Likelihood of a reading."""
    return F.when((F.col("family") != "epoch") | (x["us"] / 1_000_000).between(*LIKELY), F.lit(1.0)).otherwise(F.lit(UNLIKELY))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"]) & a["timestamp_source"].eqNullSafe(b["timestamp_source"])


def mixtures(messages: DataFrame, sources: DataFrame, prior: float = 10.0, rounds: int = 25) -> DataFrame:
    """source, timestamp_source, home_zone, weights: each source's mixture over the formats, from all its values: those that
    only one format can read are the evidence."""
    return _mixtures(_read(messages, "timestamp", ()), sources, prior, rounds)


def _mixtures(base: DataFrame, sources: DataFrame, prior: float, rounds: int) -> DataFrame:
    sides = sources.groupBy("source", "timestamp_source").agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("declared"))
    read = F.array_join(F.transform("readings", lambda x: F.concat(x["name"], F.lit(":"), _likely(x).cast("string"))), "|")
    several = F.col("family").isin("num", "epoch")  # no other value has a choice, or tells anything of one
    counts = base.where(several & (F.size("readings") > 0)).groupBy("source", "timestamp_source", read.alias("readings")).agg(F.count("*").alias("n"))
    counts = counts.join(sides, _same(counts, sides), "left").select(counts["source"], counts["timestamp_source"], "readings", "n", "declared")
    mixture = counts.groupBy("source", "timestamp_source").applyInPandas(lambda pdf: _mixture(pdf, prior, rounds), "source string, timestamp_source string, weights string")
    mixture = mixture.withColumn("weights", F.from_json("weights", "map<string,double>"))
    return sides.join(mixture, _same(sides, mixture), "full").select(F.coalesce(sides["source"], mixture["source"]).alias("source"), F.coalesce(sides["timestamp_source"], mixture["timestamp_source"]).alias("timestamp_source"), "home_zone", "weights")


def normalize_timestamps(messages: DataFrame, sources: DataFrame, abbrevs: DataFrame, key: str = "id", keep: tuple[str, ...] = (), min_posterior: float = 0.75, prior: float = 10.0, rounds: int = 25, sides: DataFrame | None = None) -> DataFrame:
    """`key`, utc_us, format, posterior and ambiguous of every row of `messages`, any table with `key`, source,
    timestamp_source and timestamp; extra columns are ignored but for those in `keep`.

    utc_us is null where the text denotes no instant: null, blank or filler text, an impossible date, a plain number that is
    under EARLIEST seconds in every unit, a local time that a change of clocks skipped, a zone that is not known, or
    timestamp_source 'none'. A local time that occurs twice is its first occurrence. A time without zone is read in the
    home zone of its (source, timestamp_source), and denotes nothing when `sources` lists none. `ambiguous` marks values
    whose best posterior is under `min_posterior`, which keep the likelier reading, and those that lack a home zone.
    Repeated rows each get their own result; an empty table gives an empty one. `prior` is the weight of the declared
    date_order against all values of its source together, so that it is the same at every size. `sides`: what `mixtures` gave for these rows, where it is known already.
    """
    base = _read(messages, key, keep)
    sides = small(sides if sides is not None else _mixtures(base, sources, prior, rounds))
    named = small(abbrevs.groupBy(F.lower("abbrev").alias("abbrev")).agg(F.min("offset_minutes").alias("named_minutes")))
    j = base.join(sides, _same(base, sides), "left").select(base["*"], "home_zone", "weights")
    j = j.join(named, F.col("z") == F.col("abbrev"), "left").drop("abbrev")

    # Readings that give the same instant count together; of equal ones the first holds.
    weigh = F.transform("readings", lambda x: F.struct((F.coalesce(F.try_element_at("weights", x["name"]), F.lit(1.0)) * _likely(x)).alias("p"), x["us"].alias("us"), x["name"].alias("name")))
    first, second = F.try_element_at("readings", F.lit(1)), F.try_element_at("readings", F.lit(2))
    one = (F.size("readings") == 1) | (F.size("readings") == 2) & (first["us"] == second["us"])
    j = bound(j, "weighed", F.when(~one, weigh))
    best = F.reduce("weighed", F.try_element_at("weighed", F.lit(1)), lambda a, x: F.when(x["p"] > a["p"], x).otherwise(a))
    j = bound(j, "best", F.when(one, F.struct(F.lit(1.0).alias("p"), first["us"].alias("us"), first["name"].alias("name"))).otherwise(best))
    total = F.when(one, 1.0).otherwise(F.reduce("weighed", F.lit(0.0), lambda s, x: s + x["p"]))
    j = bound(j.withColumn("posterior", F.col("best.p") / total), "local_us", F.col("best.us")).drop("weighed", "readings")
    t, z = F.col("t"), F.col("z")
    digits = F.regexp_replace(F.substring(z, 2, 6), ":", "")
    digits = F.when(F.length(digits) <= 2, F.rpad(F.lpad(digits, 2, "0"), 4, "0")).otherwise(F.lpad(digits, 4, "0"))
    offset = F.when(z == "z", 0).when(z.rlike(r"^[+-]\d"), F.when(z.startswith("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))).otherwise(F.col("named_minutes"))
    region = F.when(z == "", F.col("home_zone")).when(offset.isNull(), F.regexp_extract("raw", r"\[?([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]?\s*$", 1))
    region = F.when(region.isin(*_zones()), region)
    local = F.timestamp_micros("local_us")
    there = F.to_utc_timestamp(local, region)
    utc = F.when(F.col("family") == "epoch", F.col("local_us")).when(offset.isNotNull(), F.col("local_us") - offset.cast("long") * 60_000_000).when(F.from_utc_timestamp(there, region) == local, F.unix_micros(there))
    j = bound(j, "utc_us", utc)
    homeless = F.col("local_us").isNotNull() & F.col("utc_us").isNull() & (z == "") & F.col("home_zone").isNull()
    unsure = F.coalesce(F.col("posterior") < min_posterior, F.lit(False)) | homeless
    return j.select(F.col(key), *keep, "utc_us", F.coalesce("best.name", "family", F.lit("none")).alias("format"), "posterior", unsure.alias("ambiguous"), "canonical")


def _zones() -> list[str]:
    """Names of the zones that the time-zone data of this Python knows."""
    import zoneinfo

    return sorted(z for z in zoneinfo.available_timezones() if not z.startswith(("Etc/", "SystemV/", "posix", "right")) and z not in ("localtime", "Factory"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """id and utc_us of each row of messages that denotes an instant and isn't yet in the target form."""
    from chatlode.session import table

    r = normalize_timestamps(table(spark, sf_dir, "messages"), table(spark, sf_dir, "export_sources"), table(spark, sf_dir, "zone_abbrevs"))
    return r.where(~F.col("canonical") & F.col("utc_us").isNotNull()).select("id", "utc_us")


def p4_readings(spark, sf_dir: str) -> DataFrame:
    """id, utc_us, format, posterior and ambiguous of every row of messages: the reading of its time and how sure it is."""
    from chatlode.session import table

    r = normalize_timestamps(table(spark, sf_dir, "messages"), table(spark, sf_dir, "export_sources"), table(spark, sf_dir, "zone_abbrevs"))
    return r.select("id", "utc_us", "format", "posterior", "ambiguous")


# --- the same in SQL, as a check: one statement per format, orders by their evidence -------------------------------------
_SQL_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_SQL_TAIL = r"(?:\s*<(am|pm|a\.m\.|p\.m\.)>)?(?:\s+uhr)?\s*(z|[+-]\d{1,2}(?::?\d{2})?|\[[a-z_+\-]+(?:/[a-z_+\-0-9]+){0,2}\]|[a-z_]+(?:/[a-z_+\-0-9]+){1,2}|[a-z]{2,5})?"
_SQL_FORMS = {
    "ymd": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t ,]\s*)\s*" + _SQL_CLOCK + _SQL_TAIL, "y m d h mi s f ap z"),
    "compact": (r"(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _SQL_TAIL, "y m d h mi s f ap z"),
    "cjk": (r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*(上午|下午|午前|午後)?\s*" + _SQL_CLOCK + _SQL_TAIL.replace("<(am|", "<(?:am|"), "y m d cap h mi s f z"),
    "num": (r"(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + _SQL_CLOCK + _SQL_TAIL, "m d y h mi s f ap z"),
    "dot": (r"(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _SQL_CLOCK + _SQL_TAIL, "d m y h mi s f ap z"),
    "dmony": (r"(?:[a-z]{3,9},?\s+)?(\d{1,2})\.?\s+(\p{L}{3,10})\.?,?\s+(\d{4}),?\s+" + _SQL_CLOCK + _SQL_TAIL, "d mon y h mi s f ap z"),
    "mondy": (r"(\p{L}{3,10})\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+" + _SQL_CLOCK + _SQL_TAIL, "mon d y h mi s f ap z"),
    "ctime": (r"[a-z]{3}\s+([a-z]{3})\s+(\d{1,2})\s+" + _SQL_CLOCK + r"\s+(\d{4})", "mon d h mi s f y"),
}


def normalized_sql() -> str:
    """A subquery on messages with all its columns and utc_us, the instant of `timestamp` in microseconds or null."""
    parts = ("y", "m", "d", "mon", "h", "mi", "s", "f", "ap", "cap", "z")
    cols = {k: [] for k in parts}
    family = []
    for name, (p, order) in _SQL_FORMS.items():
        order = order.split()
        family.append(f"WHEN regexp_matches(t, '^{p}$') THEN '{name}'")
        for k in parts:
            if k in order:
                cols[k].append(f"WHEN '{name}' THEN regexp_extract(t, '^{p}$', {order.index(k) + 1})")
    clean = r"lower(trim(regexp_replace(regexp_replace(timestamp, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' '))"
    clean = rf"regexp_replace({clean}, '(^|[^a-z])(am|pm|a\.m\.|p\.m\.)([^a-z]|$)', '\1<\2>\3')"  # marked: there is no look-ahead
    a = f"SELECT *, CASE WHEN coalesce(timestamp_source, '') <> 'none' THEN {clean} END AS t FROM messages"
    b = f"SELECT *, CASE WHEN regexp_matches(t, '{_EPOCH}') THEN 'epoch' {' '.join(family)} END AS fam FROM ({a})"
    c = f"SELECT *, " + ", ".join(f"CASE fam {' '.join(v)} END AS _{k}" for k, v in cols.items()) + f" FROM ({b})"
    month = "CASE " + " ".join(f"WHEN _mon = '{k}' THEN {v}" for k, v in MONTHS.items()) + " END"
    half = "coalesce(_ap, '') || coalesce(_cap, '')"
    hour = f"CASE WHEN {half} IN ('pm', 'p.m.', '下午', '午後', 'am', 'a.m.', '上午', '午前') AND (_hh > 12 OR _hh < 1) THEN NULL WHEN {half} IN ('pm', 'p.m.', '下午', '午後') AND _hh < 12 THEN _hh + 12 WHEN {half} IN ('am', 'a.m.', '上午', '午前') AND _hh = 12 THEN 0 WHEN _hh < 24 THEN _hh END"
    e = f"SELECT *, {hour} AS _hour, coalesce(TRY_CAST(_m AS INTEGER), {month}) AS _month FROM (SELECT *, TRY_CAST(_h AS INTEGER) AS _hh FROM ({c}))"
    at = lambda m, d: f"epoch_us(TRY_CAST(printf('%s-%02d-%02d %02d:%02d:%02d', _y, {m}, {d}, _hour, CAST(_mi AS INTEGER), coalesce(TRY_CAST(nullif(_s, '') AS INTEGER), 0)) AS TIMESTAMP)) + coalesce(TRY_CAST(rpad(substr(nullif(_f, ''), 1, 6), 6, '0') AS BIGINT), 0)"
    ok = "_hour IS NOT NULL AND coalesce(TRY_CAST(nullif(_s, '') AS INTEGER), 0) < 60 AND fam <> 'epoch'"
    f = f"SELECT *, CASE WHEN {ok} THEN {at('_month', 'CAST(_d AS INTEGER)')} END AS one_us, CASE WHEN {ok} AND fam = 'num' THEN {at('CAST(_d AS INTEGER)', '_month')} END AS two_us FROM ({e})"
    g = f"SELECT x.*, s.home_zone, s.date_order, count(*) FILTER (fam = 'num' AND one_us IS NOT NULL AND two_us IS NULL) OVER w AS n_mdy, count(*) FILTER (fam = 'num' AND one_us IS NULL AND two_us IS NOT NULL) OVER w AS n_dmy FROM ({f}) x LEFT JOIN (SELECT source, timestamp_source, min(home_zone) AS home_zone, min(date_order) AS date_order FROM export_sources GROUP BY 1, 2) s ON s.source IS NOT DISTINCT FROM x.source AND s.timestamp_source IS NOT DISTINCT FROM x.timestamp_source WINDOW w AS (PARTITION BY x.source, x.timestamp_source)"
    units = "CASE " + " ".join(f"WHEN abs(CAST(t AS DOUBLE)) BETWEEN {LIKELY[0]} * 1e{p} AND {LIKELY[1]} * 1e{p} THEN CAST(round(CAST(CAST(t AS DOUBLE) AS DECIMAL(38, 6)) * {10 ** max(0, 6 - p)} / {10 ** max(0, p - 6)}) AS BIGINT)" for p in UNITS.values()) + " " + " ".join(f"WHEN abs(CAST(t AS DOUBLE)) BETWEEN {EARLIEST} * 1e{p} AND {LATEST} * 1e{p} THEN CAST(round(CAST(CAST(t AS DOUBLE) AS DECIMAL(38, 6)) * {10 ** max(0, 6 - p)} / {10 ** max(0, p - 6)}) AS BIGINT)" for p in UNITS.values()) + " END"
    month_first = "CASE date_order WHEN 'mdy' THEN true WHEN 'dmy' THEN false ELSE n_mdy >= n_dmy END"
    h = f"SELECT *, CASE WHEN fam = 'epoch' THEN {units} WHEN fam <> 'num' THEN one_us WHEN {month_first} THEN coalesce(one_us, two_us) ELSE coalesce(two_us, one_us) END AS local_us FROM ({g})"
    digits = "replace(substr(_z, 2), ':', '')"
    minutes = f"CASE WHEN _z = 'z' THEN 0 WHEN regexp_matches(_z, '^[+-]') THEN (CASE WHEN _z[1] = '-' THEN -1 ELSE 1 END) * (CASE WHEN length({digits}) <= 2 THEN CAST({digits} AS INTEGER) * 60 ELSE CAST({digits} AS INTEGER) // 100 * 60 + CAST({digits} AS INTEGER) % 100 END) ELSE a.offset_minutes END"
    zone = r"CASE WHEN coalesce(_z, '') = '' THEN home_zone ELSE regexp_extract(timestamp, '\[?([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]?\s*$', 1) END"
    i = f"SELECT h.*, {minutes} AS off, {zone} AS zone FROM ({h}) h LEFT JOIN (SELECT lower(abbrev) AS abbrev, min(offset_minutes) AS offset_minutes FROM zone_abbrevs GROUP BY 1) a ON a.abbrev = h._z"
    j = f"SELECT *, CASE WHEN off IS NULL AND fam <> 'epoch' AND zone IN (SELECT name FROM pg_timezone_names()) THEN timezone(zone, make_timestamp(local_us)) END AS there FROM ({i})"
    first = "CASE WHEN timezone(zone, there) IS DISTINCT FROM make_timestamp(local_us) THEN NULL WHEN timezone(zone, there - INTERVAL 1 HOUR) = make_timestamp(local_us) THEN epoch_us(there - INTERVAL 1 HOUR) ELSE epoch_us(there) END"
    drop = "t, fam, " + ", ".join(f"_{k}" for k in parts) + ", _hh, _hour, _month, one_us, two_us, home_zone, date_order, n_mdy, n_dmy, local_us, off, zone, there"
    return f"(SELECT * EXCLUDE ({drop}), CASE WHEN fam = 'epoch' THEN local_us WHEN off IS NOT NULL THEN local_us - CAST(off AS BIGINT) * 60000000 ELSE {first} END AS utc_us FROM ({j}))"


#: p4_found in SQL.
FOUND_SQL = f"SELECT id, utc_us FROM {normalized_sql()} WHERE utc_us IS NOT NULL AND NOT regexp_matches(timestamp, '{CANONICAL}')"

"""Mixed timestamp formats and time zones to one UTC instant (problem 4).

A value contributes its likelihood under each format that parses it: full for a day
near the time of collection or before, little for one long before there were pages or
long after that moment; between two orders of day and month the source alone tells. Values of one source share a mixture of formats:
expectation-maximisation over the counts of (source, likelihoods by format) gives each
source its weights, from a prior that knows the catalogue's date order, and the posterior
picks a value's format. Values whose best posterior is not clear are marked. All parsing
is in built-in expressions; the mixture works on counts, a few rows for each source. The
session's time zone must be UTC, as the tables' is.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import sized_join, stored

ORDERS = ("ymd", "dmy", "mdy")
CLEAR = 0.9  # posterior from which a reading counts as settled
PRIOR = 20.0  # pseudo-counts behind the catalogue's date order, 1 behind each other format
UNLIKELY = 0.02  # likelihood of a day before FIRST_YEAR or more than MOST_AHEAD days after the moment of collection, against 1 for any other
FIRST_YEAR, MOST_AHEAD = 1990, 366
READINGS = ("iso", "compact", "day_name", "name_day", "dmy", "mdy", "epoch", "relative")

# Zone abbreviations with their offsets in minutes where the source's own zone has none of that name.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "CST": 480, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "AWST": 480,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Abbreviations that mean different offsets in different zones.
OF_ZONE = {
    ("CST", "Asia/Shanghai"): 480, ("CST", "Asia/Hong_Kong"): 480, ("CST", "Asia/Taipei"): 480, ("CST", "America/Chicago"): -360, ("CST", "America/Mexico_City"): -360, ("CST", "America/Winnipeg"): -360,
    ("CST", "America/New_York"): -360, ("CST", "America/Los_Angeles"): -360, ("CST", "America/Denver"): -360, ("IST", "Asia/Kolkata"): 330, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120,
    ("BST", "Europe/London"): 60, ("BST", "Asia/Dhaka"): 360, ("AST", "America/Halifax"): -240, ("AST", "Asia/Riyadh"): 180, ("EST", "Australia/Sydney"): 600, ("EDT", "Australia/Sydney"): 660,
    ("EST", "Australia/Melbourne"): 600, ("EDT", "Australia/Melbourne"): 660,
}
MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Other languages' month names by their first letters, where they differ.
MONTH_OTHER = {"mär": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12, "fév": 2, "avr": 4, "aoû": 8, "déc": 12}

FULL_WIDTH = "０１２３４５６７８９：／－．，　＋（）［］"
HALF_WIDTH = "0123456789:/-., +()[]"


def _num(c: Column) -> Column:
    return c.try_cast("int")


def _fields(v: Column) -> dict[str, Column]:
    """Pieces of a trimmed value: date numbers by order of writing, time, fraction, half of the day, and zone."""
    x = lambda p, g=1: F.nullif(F.regexp_extract(v, p, g), F.lit(""))
    return {
        "iso": x(r"^(?:北京时间|東京時間)?\s*(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?(?!\d)", 1),
        "iso_m": x(r"^(?:北京时间|東京時間)?\s*(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?(?!\d)", 2),
        "iso_d": x(r"^(?:北京时间|東京時間)?\s*(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?(?!\d)", 3),
        "cmp_y": x(r"^(\d{4})(\d{2})(\d{2})(?:[T ]?\d{4}(?:\d{2})?)?(?:[Zz]|[+-]\d{2}:?\d{2})?$", 1),
        "cmp_m": x(r"^(\d{4})(\d{2})(\d{2})(?:[T ]?\d{4}(?:\d{2})?)?(?:[Zz]|[+-]\d{2}:?\d{2})?$", 2),
        "cmp_d": x(r"^(\d{4})(\d{2})(\d{2})(?:[T ]?\d{4}(?:\d{2})?)?(?:[Zz]|[+-]\d{2}:?\d{2})?$", 3),
        "cmp_t": x(r"^\d{8}[T ]?(\d{4}(?:\d{2})?)(?:[Zz]|[+-]\d{2}:?\d{2})?$", 1),
        "num_a": x(r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?!\d)", 1),
        "num_b": x(r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?!\d)", 2),
        "num_y": x(r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?!\d)", 3),
        "dm_d": x(r"^(?:\p{L}+\.?,?\s+)?(\d{1,2})\.?(?:st|nd|rd|th)?[\s-]+(\p{L}{3,12})\.?,?[\s-]+(\d{4})(?!\d)", 1),
        "dm_m": x(r"^(?:\p{L}+\.?,?\s+)?(\d{1,2})\.?(?:st|nd|rd|th)?[\s-]+(\p{L}{3,12})\.?,?[\s-]+(\d{4})(?!\d)", 2),
        "dm_y": x(r"^(?:\p{L}+\.?,?\s+)?(\d{1,2})\.?(?:st|nd|rd|th)?[\s-]+(\p{L}{3,12})\.?,?[\s-]+(\d{4})(?!\d)", 3),
        "md_m": x(r"^(?:\p{L}+\.?,\s+)?(\p{L}{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)", 1),
        "md_d": x(r"^(?:\p{L}+\.?,\s+)?(\p{L}{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)", 2),
        "md_y": x(r"^(?:\p{L}+\.?,\s+)?(\p{L}{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)", 3),
        # the time stands behind the date, never within it
        "hh": x(r"(?:日\s*|(?:\d{4}|[-/.]\d{1,2}),?(?:T|\s+))(?:um |at )?(?:上午|下午|凌晨|早上|中午|晚上|傍晚|午前|午後)?\s*(\d{1,2})[:.时時h](\d{1,2})", 1),
        "mi": x(r"(?:日\s*|(?:\d{4}|[-/.]\d{1,2}),?(?:T|\s+))(?:um |at )?(?:上午|下午|凌晨|早上|中午|晚上|傍晚|午前|午後)?\s*(\d{1,2})[:.时時h](\d{1,2})", 2),
        "ss": x(r"\d{1,2}[:.]\d{2}:(\d{2})", 1),
        "sec2": x(r"\d{1,2}[時时]\d{1,2}分(\d{1,2})秒", 1),
        "frac": x(r"\d{1,2}:\d{2}:\d{2}[.,](\d{1,9})", 1),
        "half": F.lower(x(r"(上午|下午|凌晨|早上|中午|晚上|傍晚|午前|午後|(?i:\b[ap]\.?m\b\.?))", 1)),
        "off": x(r"(?:\d|\s|UTC|GMT|\()\s*((?:(?<=[0-9\sCT])[+-])\d{1,2}(?::?\d{2})?)\)?$", 1),
        "zone": x(r"[\[\s(]([A-Z][A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?)[\])]?$", 1),
        "abbr": x(r"(?:\d|\b[AaPp]\.?[Mm]\.?)\s*\(?([A-Z]{1,5})\)?$", 1),
        "ago_n": x(r"(?i)^(\d{1,4})\s*(秒|分钟|分鐘|分|小时|小時|時間|天|日|周|週|sec|second|min|minute|hour|hr|day|week|stunde|tag)\p{L}*\.?\s*(前|ago|zuvor)$", 1),
        "ago_u": F.lower(x(r"(?i)^(\d{1,4})\s*(秒|分钟|分鐘|分|小时|小時|時間|天|日|周|週|sec|second|min|minute|hour|hr|day|week|stunde|tag)\p{L}*\.?\s*(前|ago|zuvor)$", 2)),
        "ago_de": x(r"(?i)^vor (\d{1,4}) (sekunde|minute|stunde|tag|woche)\p{L}*$", 1),
        "ago_de_u": F.lower(x(r"(?i)^vor (\d{1,4}) (sekunde|minute|stunde|tag|woche)\p{L}*$", 2)),
        "epoch": x(r"^(\d{9,10})(?:\.\d+)?$", 1),
        "epoch_f": x(r"^\d{9,10}\.(\d{1,9})$", 1),
        "epoch_ms": x(r"^(\d{12,13})(?:\.\d+)?$", 1),
        "epoch_us": x(r"^(\d{15,16})$", 1),
    }


def _month(c: Column) -> Column:
    names = {**{n: i + 1 for i, n in enumerate(MONTH_NAMES)}, **MONTH_OTHER}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.substring(c, 1, 3)))


def _date(y: Column, m: Column, d: Column) -> Column:
    """A real calendar date, else null."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def interpretations(df: DataFrame, value: Column) -> DataFrame:
    """Adds _v, the pieces of the value, and _dates: one real date for each valid order of writing."""
    v = F.trim(F.regexp_replace(F.translate(value, FULL_WIDTH, HALF_WIDTH), r"[\s\u00A0\u200B\uFEFF]+", " "))
    df = df.withColumn("_v", v)
    f = _fields(F.col("_v"))
    df = df.withColumns({f"_{k}": c for k, c in f.items()})
    c = lambda k: F.col(f"_{k}")
    n = lambda k: _num(c(k))
    of = lambda k, y, m, d: F.when(c(k).isNotNull(), _date(y, m, d))
    days = {
        "iso": of("iso", n("iso"), n("iso_m"), n("iso_d")), "compact": of("cmp_y", n("cmp_y"), n("cmp_m"), n("cmp_d")),
        "day_name": of("dm_d", n("dm_y"), _month(c("dm_m")), n("dm_d")), "name_day": of("md_d", n("md_y"), _month(c("md_m")), n("md_d")),
        "dmy": of("num_a", n("num_y"), n("num_b"), n("num_a")), "mdy": of("num_a", n("num_y"), n("num_a"), n("num_b")),
    }
    return df.withColumns({f"_d_{k}": v for k, v in days.items()})


def em(counts: list[tuple[str, int]], order: str | None, rounds: int = 100) -> dict[str, list[float]]:
    """Posteriors by format for each likelihood code of one source.

    A code has a digit for each of READINGS: 0 where the format does not parse the value, 1 where its day is unlikely, 2
    where it is likely. counts has how many values of the source have each code.
    """
    like = {code: [(0.0, UNLIKELY, 1.0)[int(x)] for x in code] for code, _ in counts}
    prior = [PRIOR if r == order else 1.0 for r in READINGS]
    w = [p / sum(prior) for p in prior]
    for _ in range(rounds):
        got = list(prior)
        for code, n in counts:
            z = sum(a * b for a, b in zip(w, like[code]))
            if z > 0:
                for k, x in enumerate(like[code]):
                    got[k] += n * w[k] * x / z
        new = [g / sum(got) for g in got]
        if max(abs(a - b) for a, b in zip(w, new)) < 1e-12:
            break
        w = new
    out = {}
    for code, x in like.items():
        z = sum(a * b for a, b in zip(w, x))
        out[code] = [a * b / z for a, b in zip(w, x)] if z > 0 else [0.0] * len(READINGS)
    return out


def _mixture(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best format of each likelihood code of one source, and the posteriors that matter."""
    order = next((o for o in pdf["date_order"] if isinstance(o, str)), None)
    codes = list(zip(pdf["code"], pdf["n"]))
    got = em(codes, order)
    best = [max(range(len(READINGS)), key=lambda k: (got[c][k], -k)) for c, _ in codes]
    day, month = READINGS.index("dmy"), READINGS.index("mdy")
    return pd.DataFrame({
        "src": pdf["src"], "code": pdf["code"], "reading": [READINGS[k] if got[c][k] > 0 else None for (c, _), k in zip(codes, best)],
        "posterior": [got[c][k] for (c, _), k in zip(codes, best)], "numeric": [got[c][day] + got[c][month] for c, _ in codes],
    })


def _local_to_utc(ts: Column, zone: Column) -> Column:
    """Local wall time to UTC: of two instants the earlier, a skipped time with the offset before the change."""
    return F.to_utc_timestamp(ts, zone)


def normalise(df: DataFrame, value_col: str, source_col: str, catalog: DataFrame, collected_col: str, host: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds utc (timestamp), posterior and state ('stated', 'inferred', 'ambiguous', 'relative' or null) to the kept columns.

    catalog: (source, home_domain, time_zone, date_order), one row a source; joined by
    source, or where source is null by host, a leading www., m. or news. left off.
    Values that state no real date, null and empty ones give null. A value without zone
    whose source has no entry is read as UTC and marked 'ambiguous'.
    """
    keep = keep or []
    cat = catalog.select(F.col("source").alias("_s"), F.col("home_domain").alias("_h"), F.col("time_zone").alias("_tz"), F.col("date_order").alias("_order"))
    base = df.select(*keep, F.col(value_col).cast("string").alias("_value"), F.col(source_col).alias("_source"), F.col(collected_col).cast("timestamp_ntz").cast("timestamp").alias("_seen"), (host if host is not None else F.lit(None).cast("string")).alias("_host"))
    base = base.withColumn("_host", F.regexp_replace(F.lower("_host"), r"^(www|m|news)\.", ""))
    # of several rows of one source or domain the first in order counts
    one = lambda key, *cols: cat.filter(f"{key} is not null").groupBy(key).agg(F.min(F.struct("_s", "_tz", "_order")).alias("x")).select(key, *[F.col(f"x.{a}").alias(b) for a, b in cols])
    by_source, by_host = one("_s", ("_tz", "_tz1"), ("_order", "_o1")), one("_h", ("_tz", "_tz2"), ("_order", "_o2"), ("_s", "_s2"))
    base = base.join(by_source, base["_source"] == by_source["_s"], "left").join(by_host, base["_source"].isNull() & (base["_host"] == by_host["_h"]), "left")
    base = base.withColumns({"_tz": F.coalesce("_tz1", "_tz2"), "_order": F.coalesce("_o1", "_o2"), "_src": F.coalesce("_source", "_s2", F.lit(""))}).drop("_tz1", "_tz2", "_o1", "_o2", "_s", "_h", "_s2", "_host", "_source")
    x = interpretations(base, F.col("_value"))
    c = lambda k: F.col(f"_{k}")
    epoch = F.coalesce(
        F.when(c("epoch").isNotNull(), F.timestamp_millis(c("epoch").try_cast("long") * 1000 + F.coalesce(F.rpad(F.substring("_epoch_f", 1, 3), 3, "0").try_cast("long"), F.lit(0)))),
        F.when(c("epoch_ms").isNotNull(), F.timestamp_millis(c("epoch_ms").try_cast("long"))),
        F.when(c("epoch_us").isNotNull(), F.timestamp_micros(c("epoch_us").try_cast("long"))),
    )
    ago_n = F.coalesce(_num(c("ago_n")), _num(c("ago_de")))
    unit = F.coalesce(c("ago_u"), c("ago_de_u"))
    ago_s = ago_n * F.when(unit.rlike("^(秒|sec|sek)"), 1).when(unit.rlike("^(分|min)"), 60).when(unit.rlike("^(小|時|hour|hr|stunde)"), 3600).when(unit.rlike("^(天|日|day|tag)"), 86400).otherwise(604800)
    relative = F.when(ago_s.isNotNull(), F.timestamp_add("SECOND", (-ago_s).cast("int"), F.col("_seen")))
    x = x.withColumns({"_epoch_at": epoch, "_relative_at": relative})

    # the likelihood of a value under each format, as a code of one digit each
    day_of = {**{r: c(f"d_{r}") for r in READINGS[:6]}, "epoch": c("epoch_at").cast("date"), "relative": c("relative_at").cast("date")}
    early, late = F.lit(f"{FIRST_YEAR}-01-01").cast("date"), F.coalesce(F.date_add(F.col("_seen").cast("date"), MOST_AHEAD), F.lit("9999-12-31").cast("date"))
    # between two orders of day and month the source alone tells
    code = F.concat(*[F.when(day_of[r].between(early, F.lit("9999-12-31").cast("date") if r in ORDERS else late), "2").when(day_of[r].isNotNull(), "1").otherwise("0") for r in READINGS])
    hour0 = F.coalesce(_num(c("hh")), _num(F.substring("_cmp_t", 1, 2)), F.lit(0))
    half = c("half")
    pm_words = half.isin("下午", "晚上", "傍晚", "午後", "中午") | half.rlike(r"^p")
    am_words = half.isin("上午", "凌晨", "早上", "午前") | half.rlike(r"^a")
    hour = F.when(half.isNull(), hour0).when(pm_words & (hour0 < 12) & ~((half == "中午") & (hour0 > 9)), hour0 + 12).when(am_words & (hour0 == 12), 0).otherwise(hour0)
    minute = F.coalesce(_num(c("mi")), _num(F.substring("_cmp_t", 3, 2)), F.lit(0))
    second = F.coalesce(_num(c("ss")), _num(c("sec2")), _num(F.nullif(F.substring("_cmp_t", 5, 2), F.lit(""))), F.lit(0))
    ms = F.coalesce(_num(F.substring(F.rpad(F.coalesce("_frac", F.lit("0")), 3, "0"), 1, 3)), F.lit(0))
    ok = (hour < 24) & (minute < 60) & (second < 60)
    clock = F.when(ok, F.format_string("%02d:%02d:%02d.%03d", hour, minute, second, ms))

    sign = F.when(F.substring("_off", 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(F.substring("_off", 2, 9), ":", "")
    off_min = F.when(F.length(digits) <= 2, _num(digits) * 60).otherwise(_num(F.substring(digits, F.lit(1), F.length(digits) - 2)) * 60 + _num(F.substring(digits, F.length(digits) - 1, F.lit(2))))
    numeric_off = F.when(c("off").isNotNull() & (c("hh").isNotNull() | c("cmp_t").isNotNull()), sign * off_min)
    own = F.element_at(F.create_map(*[F.lit(v) for (a, z), m in OF_ZONE.items() for v in (f"{a} {z}", m)]), F.concat_ws(" ", F.upper("_abbr"), "_tz"))
    common = F.element_at(F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv]), F.upper("_abbr"))
    abbr_off = F.when(c("abbr").isNotNull() & ~c("abbr").isin("AM", "PM"), F.coalesce(own, common))
    beijing = F.when(c("v").startswith("北京时间"), F.lit(480)).when(c("v").startswith("東京時間"), F.lit(540))
    stated = F.coalesce(numeric_off, F.when(c("v").rlike(r"\d[Zz]$"), F.lit(0)), abbr_off, beijing)

    # parsed once
    x = stored(x.select(*keep, "_src", "_value", "_order", "_tz", "_zone", *[f"_d_{r}" for r in READINGS[:6]], "_epoch_at", "_relative_at", code.alias("_code"), clock.alias("_clock"), stated.cast("int").alias("_stated")))
    counts = x.filter(F.col("_code") != "0" * len(READINGS)).groupBy(F.col("_src").alias("src"), F.col("_code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("date_order"))
    chosen = stored(counts.groupBy("src").applyInPandas(_mixture, "src string, code string, reading string, posterior double, numeric double")).select(F.col("src").alias("_src"), F.col("code").alias("_code"), "reading", "posterior", "numeric")
    x = sized_join(x, chosen, ["_src", "_code"], F.col("_value"), "left")
    day = F.coalesce(*[F.when(F.col("reading") == r, day_of[r]) for r in READINGS[:6]])
    same = F.col("reading").isin("dmy", "mdy") & F.coalesce(c("d_dmy") == c("d_mdy"), F.lit(False))
    post = F.when(same, F.col("numeric")).otherwise(F.col("posterior"))

    local, stated = F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), F.col("_clock")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.col("_stated")
    zoned = F.coalesce(
        F.when(stated.isNotNull(), F.timestamp_add("MINUTE", -stated, local)),
        F.when(c("zone").isNotNull(), _local_to_utc(local, c("zone"))),
        F.when(F.col("_tz").isNotNull(), _local_to_utc(local, F.col("_tz"))),
        local,
    )
    relative, epoch = (F.when(F.col("reading") == k, c(f"{k}_at")) for k in ("relative", "epoch"))
    utc = F.coalesce(relative, epoch, zoned)
    clear = stated.isNotNull() | c("zone").isNotNull()
    state = (
        F.when(utc.isNull(), F.lit(None).cast("string")).when(relative.isNotNull(), "relative").when(epoch.isNotNull(), "stated")
        .when((post < CLEAR) | (~clear & F.col("_tz").isNull()), "ambiguous").when(clear, "stated").otherwise("inferred")
    )
    return x.select(*keep, utc.alias("utc"), post.alias("posterior"), state.alias("state"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_table(parts: list[DataFrame]) -> DataFrame:
    """(tab, row_id, utc_ts) of rows whose value states a real date."""
    one = [p.filter("utc is not null").select("tab", "row_id", iso_millis(F.col("utc")).alias("utc_ts")) for p in parts]
    return reduce(DataFrame.unionAll, one)

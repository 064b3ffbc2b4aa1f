import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from heddle.operators import instants as I

CAT = [
    ("s_cn", "cn.example", "Asia/Shanghai", "ymd"), ("s_us", "us.example", "America/New_York", "mdy"), ("s_uk", "uk.example", "Europe/London", "dmy"), ("s_in", "in.example", "Asia/Kolkata", "dmy"),
    ("s_au", "au.example", "Australia/Sydney", "dmy"),
]
SEEN = dt.datetime(2024, 5, 6, 7, 8, 9)

CASES = [
    # value, source, host, expected
    ("2024-03-05 06:07:08", "s_cn", None, "2024-03-04T22:07:08.000Z"),
    ("2024-03-05T06:07:08.0909Z", "s_cn", None, "2024-03-05T06:07:08.090Z"),
    ("2024-03-05T06:07:08+0530", "s_us", None, "2024-03-05T00:37:08.000Z"),
    ("2024-03-05 06:07:08 -05:00", "s_cn", None, "2024-03-05T11:07:08.000Z"),
    ("2024-05-30 09:38:37 UTC+5:30", "s_cn", None, "2024-05-30T04:08:37.000Z"),
    ("2024-02-24 04:59:00 UTC-5", "s_cn", None, "2024-02-24T09:59:00.000Z"),
    ("2022-12-22 04:40:49 (GMT+11)", "s_au", None, "2022-12-21T17:40:49.000Z"),
    ("2025-01-22 15:56:01 CST", "s_cn", None, "2025-01-22T07:56:01.000Z"),
    ("1 February 2026, 10:33 IST", "s_in", None, "2026-02-01T05:03:00.000Z"),
    ("Nov 5, 2023 1:23 AM EDT", "s_us", None, "2023-11-05T05:23:00.000Z"),
    ("Nov 5, 2023 1:23 AM EST", "s_us", None, "2023-11-05T06:23:00.000Z"),
    ("Sun, 30 Jul 2023 21:03:26 GMT", "s_us", None, "2023-07-30T21:03:26.000Z"),
    ("Sat, 22 Feb 2025 03:49:18 +0530", "s_us", None, "2025-02-21T22:19:18.000Z"),
    ("20230817T002654Z", "s_us", None, "2023-08-17T00:26:54.000Z"),
    ("20260503144746", "s_cn", None, "2026-05-03T06:47:46.000Z"),
    ("20251019", "s_cn", None, "2025-10-18T16:00:00.000Z"),
    ("2025-09-30", "s_us", None, "2025-09-30T04:00:00.000Z"),
    ("1760094302", "s_us", None, "2025-10-10T11:05:02.000Z"),
    ("1780501467.0", "s_us", None, "2026-06-03T15:44:27.000Z"),
    ("1777902618583", "s_cn", None, "2026-05-04T13:50:18.583Z"),
    ("２０２４-０４-０１ １２:１３:０６", "s_cn", None, "2024-04-01T04:13:06.000Z"),
    ("2025年02月21日10时28分", "s_cn", None, "2025-02-21T02:28:00.000Z"),
    ("北京时间2024年8月16日13:50", "s_us", None, "2024-08-16T05:50:00.000Z"),
    ("2025年6月30日 下午12:17", "s_cn", None, "2025-06-30T04:17:00.000Z"),
    ("2025年5月30日 凌晨5:38", "s_cn", None, "2025-05-29T21:38:00.000Z"),
    ("2022年1月23日 午後0:24", "s_cn", None, "2022-01-23T04:24:00.000Z"),
    ("2021年8月22日 下午11:22", "s_cn", None, "2021-08-22T15:22:00.000Z"),
    ("10/19/2023 1:31 PM", "s_us", None, "2023-10-19T17:31:00.000Z"),
    ("09/05/2021 12:56 AM", "s_us", None, "2021-09-05T04:56:00.000Z"),
    ("08/07/2021 23:55", "s_uk", None, "2021-07-08T22:55:00.000Z"),
    ("27.02.2026 21:30 Uhr", "s_uk", None, "2026-02-27T21:30:00.000Z"),
    ("2022.09.20 02:12", "s_cn", None, "2022-09-19T18:12:00.000Z"),
    ("2022-06-07 14.30", "s_uk", None, "2022-06-07T13:30:00.000Z"),
    ("2023-08-23 20:56:30[Asia/Tokyo]", "s_us", None, "2023-08-23T11:56:30.000Z"),
    ("2025-07-10 17:02:48 America/Los_Angeles", "s_cn", None, "2025-07-11T00:02:48.000Z"),
    ("8小时前", "s_cn", None, "2024-05-05T23:08:09.000Z"),
    ("42 min ago", "s_us", None, "2024-05-06T06:26:09.000Z"),
    ("21 分钟前", "s_cn", None, "2024-05-06T06:47:09.000Z"),
    # a wall time that occurs twice is the earlier, a skipped one keeps the old offset
    ("2023-11-05 01:30:00", "s_us", None, "2023-11-05T05:30:00.000Z"),
    ("2024-03-10 02:30:00", "s_us", None, "2024-03-10T07:30:00.000Z"),
    ("2024-03-31 01:30", "s_uk", None, "2024-03-31T01:30:00.000Z"),
    # no source: by host
    ("2024-03-05 06:07:08", None, "www.us.example", "2024-03-05T11:07:08.000Z"),
    ("08/07/2021 23:55", None, "m.uk.example", "2021-07-08T22:55:00.000Z"),
    # no real dates
    *[(v, "s_cn", None, None) for v in ("", " ", None, "N/A", "--", "unknown", "待定", "2023-13-05", "2024-02-30 10:00", "0000-00-00 00:00:00", "31/31/2024 10:00", "2024-01-01 25:00:00", "x" * 5000)],
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, v, s, h, SEEN, "clash") for i, (v, s, h, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id long, value string, src string, host string, seen timestamp_ntz, time_zone string")
    cat = spark.createDataFrame(CAT, "source string, home_domain string, time_zone string, date_order string")
    from pyspark.sql import functions as F

    out = I.normalise(df, "value", "src", cat, "seen", F.col("host"), ["row_id"])
    return {r["row_id"]: r for r in out.select("row_id", I.iso_millis(F.col("utc")).alias("ts"), "state").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(got, i):
    assert got[i]["ts"] == CASES[i][3], CASES[i]


def test_states(got):
    by = {CASES[i][0]: r["state"] for i, r in got.items()}
    assert by["8小时前"] == "relative" and by["1760094302"] == "stated" and by["2025-09-30"] == "inferred" and by["N/A"] is None


def test_zone_rules_match_the_zone_database(spark):
    """Wall times around every change of a year, against zoneinfo: fold 0, and the offset before a gap."""
    from pyspark.sql import functions as F

    zones = {"s_us": "America/New_York", "s_uk": "Europe/London", "s_au": "Australia/Sydney"}
    rows = [(s, dt.datetime(2023, m, d, h, 30)) for s in zones for m in (3, 4, 10, 11) for d in range(1, 31, 1) for h in range(0, 5)]
    df = spark.createDataFrame([(i, t.strftime("%Y-%m-%d %H:%M:%S"), s, SEEN) for i, (s, t) in enumerate(rows)], "row_id long, value string, src string, seen timestamp_ntz")
    cat = spark.createDataFrame(CAT, "source string, home_domain string, time_zone string, date_order string")
    out = {r[0]: r[1] for r in I.normalise(df, "value", "src", cat, "seen", None, ["row_id"]).select("row_id", I.iso_millis(F.col("utc"))).collect()}
    for i, (s, t) in enumerate(rows):
        want = t.replace(tzinfo=ZoneInfo(zones[s])).astimezone(dt.timezone.utc)
        assert out[i] == want.strftime("%Y-%m-%dT%H:%M:%S.000Z"), (s, t)


def test_order_from_the_mixture_where_the_catalogue_is_silent(spark):
    """Unknown source: days above 12 teach the order, and what stays open is marked."""
    from pyspark.sql import functions as F

    vals = [f"{d:02d}/03/2024 10:00" for d in range(1, 29)]
    df = spark.createDataFrame([(i, v, "x", SEEN) for i, v in enumerate(vals)] + [(99, "05/06/2024 10:00", "y", SEEN)], "row_id long, value string, src string, seen timestamp_ntz")
    cat = spark.createDataFrame([], "source string, home_domain string, time_zone string, date_order string")
    out = {r["row_id"]: r for r in I.normalise(df, "value", "src", cat, "seen", None, ["row_id"]).withColumn("ts", I.iso_millis(F.col("utc"))).collect()}
    assert all(out[i]["ts"] == f"2024-03-{i + 1:02d}T10:00:00.000Z" for i in range(28))
    assert out[99]["state"] == "ambiguous" and out[99]["posterior"] == 0.5


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, value string, src string, seen timestamp_ntz")
    cat = spark.createDataFrame(CAT, "source string, home_domain string, time_zone string, date_order string")
    assert I.normalise(df, "value", "src", cat, "seen", None, ["row_id"]).count() == 0


def test_the_mixture_chooses_between_formats():
    """A source's own values move its weights against the catalogue, and decide between a compact date and a count of milliseconds."""
    code = lambda **k: "".join(str(k.get(r, 0)) for r in I.READINGS)
    both, month_only = code(dmy=2, mdy=2), code(mdy=2)
    best = lambda x: I.READINGS[max(range(len(x)), key=lambda k: x[k])]
    assert best(I.em([(both, 5)], "dmy")[both]) == "dmy"
    assert best(I.em([(both, 5), (month_only, 200)], "dmy")[both]) == "mdy"
    twelve = code(compact=2, epoch=1)
    assert best(I.em([(twelve, 1)], None)[twelve]) == "compact"
    open_ = code(compact=2, epoch=2)
    assert best(I.em([(open_, 1), (code(epoch=2), 50)], None)[open_]) == "epoch"
    assert I.em([(code(), 3)], None)[code()] == [0.0] * len(I.READINGS)


def test_twelve_digits_are_a_compact_date(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "202403050607", "x", SEEN), (2, "1709618827123", "x", SEEN)], "row_id long, value string, src string, seen timestamp_ntz")
    cat = spark.createDataFrame([("x", "x.example", "UTC", "ymd")], "source string, home_domain string, time_zone string, date_order string")
    out = {r["row_id"]: r["ts"] for r in I.normalise(df, "value", "src", cat, "seen", None, ["row_id"]).select("row_id", I.iso_millis(F.col("utc")).alias("ts")).collect()}
    assert out == {1: "2024-03-05T06:07:00.000Z", 2: "2024-03-05T06:07:07.123Z"}

import datetime as dt
import random

from heddle.operators import bitemporal as B

P = "panel_id long, thscode string, date date, known_at timestamp_ntz, L_GPUExposure double, at string, entity string"
H = "hit_id long, thscode string, hit_time timestamp_ntz, cell string"
T0 = dt.datetime(2024, 1, 1)


def brute(hits, rows):
    out = set()
    code = lambda s: next((s[i : i + 6] for i in range(len(s) - 5) if s[i : i + 6].isdigit()), None) if s else None
    for h, firm, t, _ in hits:
        if firm is None or t is None or code(firm) is None:
            continue
        ok = [r for r in rows if r[1] and code(r[1]) == code(firm) and r[2] and r[3] and r[4] is not None and dt.datetime.combine(r[2], dt.time()) - dt.timedelta(hours=8) <= t and r[3] <= t]
        if ok:
            out.add((h, min(ok, key=lambda r: (-r[2].toordinal(), -r[3].timestamp(), r[0]))[0]))
    return out


def run(spark, hits, rows):
    got = B.exposure_at_hits(spark.createDataFrame(hits, H), spark.createDataFrame(rows, P)).collect()
    assert len(got) == len(set(got))
    return {(r["hit_id"], r["panel_id"]) for r in got}


def test_against_brute_force(spark):
    rng = random.Random(4)
    firms = ["710001.XA", "XA710001", "710001", " 710002.XB", "710002.xb", None, "none"]
    rows = [
        (i, rng.choice(firms), (T0 + dt.timedelta(days=rng.randrange(60))).date(), T0 + dt.timedelta(days=rng.randrange(-5, 70), seconds=rng.choice([0, 3600 * 16, rng.randrange(86400)])), rng.choice([None, 0.5, -1.0]), "x", "y")
        for i in range(600)
    ]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:80])]  # loaded twice
    hits = [(i, rng.choice(firms), rng.choice([None, T0 + dt.timedelta(days=rng.randrange(-3, 80), seconds=rng.choice([0, 3600 * 16, rng.randrange(86400)]))]), "c") for i in range(800)]
    assert run(spark, hits, rows) == brute(hits, rows)


def test_bounds_are_inclusive_and_ties_go_to_the_smallest_id(spark):
    d = T0.date()
    start = T0 - dt.timedelta(hours=8)
    rows = [(5, "710001", d, start, 1.0, "", ""), (3, "710001", d, start, 2.0, "", ""), (9, "710001", d, start + dt.timedelta(hours=1), 2.0, "", "")]
    hits = [(1, "710001", start, ""), (2, "710001", start - dt.timedelta(microseconds=1), ""), (3, "710001", start + dt.timedelta(hours=1), "")]
    assert run(spark, hits, rows) == {(1, 3), (3, 9)}


def test_empty_tables(spark):
    one = [(1, "710001", T0.date(), T0, 1.0, "", "")]
    assert run(spark, [], one) == set()
    assert run(spark, [(1, "710001", T0, "")], []) == set()


def test_rectangles_are_disjoint(spark):
    rows = [(i, "710001", (T0 + dt.timedelta(days=i % 7)).date(), T0 + dt.timedelta(days=(i * 3) % 11), 1.0, "", "") for i in range(30)]
    v = spark.createDataFrame(rows, P).selectExpr("panel_id version_id", "'f' entity", "date day", "unix_micros(cast(cast(date as timestamp_ntz) as timestamp)) valid_from", "unix_micros(cast(known_at as timestamp)) known_at")
    r = sorted(B.rectangles(v).collect(), key=lambda x: x["from"])
    assert all(a["until"] == b["from"] for a, b in zip(r, r[1:])) and r[-1]["until"] is None

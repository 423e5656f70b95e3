"""Measures, windows and sampling on small literal inputs."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import scalar
from attesta.operators import latest, ordered, rollups, sampling, vectors


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_mid_week_run_takes_the_last_whole_week(spark):
    start, end, week = scalar.week_window(F.lit("2026-10-07 12:00:00").cast("timestamp"))
    got = spark.range(1).select(scalar.local_day(start).cast("string"), scalar.local_day(end).cast("string"), week).first()
    assert tuple(got) == ("2026-09-27", "2026-10-04", "2026-W40")


def test_clock_change_weeks(spark):
    hours = {}
    for at in ("2026-03-31", "2026-04-07", "2026-10-27", "2026-11-03"):
        start, end, _ = scalar.week_window(F.lit(at).cast("timestamp"))
        hours[at] = spark.range(1).select(((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).cast("int")).first()[0]
    assert hours == {"2026-03-31": 168, "2026-04-07": 167, "2026-10-27": 168, "2026-11-03": 169}


def test_iso_week_of_year_end(spark):
    got = spark.range(1).select(scalar.iso_week(F.lit("2026-12-31").cast("date")), scalar.iso_week(F.lit("2027-01-03").cast("date"))).first()
    assert tuple(got) == ("2026-W53", "2026-W53")


@pytest.mark.parametrize("parts, want", [((0, 2, 4), (2.0, False)), ((2, 2, 2), (2.0, True))])
def test_framing_score(spark, parts, want):
    mean, strong = rollups.framing_score([F.lit(p) for p in parts])
    assert tuple(spark.range(1).select(mean, strong).first()) == want


def test_stratified_sample_counts_and_order_invariance(spark):
    items = [(f"{c}{t}{i}", c, t, q) for c in ("NL", "FR") for t, q in (("low", 4), ("medium", 4), ("high", 2)) for i in range(20)]
    df = spark.createDataFrame(items, "id string, country string, tier string, quota int")
    pick = lambda d: sorted(rows(sampling.stratified_hash_sample(d, ["country", "tier"], "id", F.col("quota"), 1).where("selected").select("id", "probability")))
    got = pick(df)
    assert len(got) == 20 and {p for _, p in got} == {0.2, 0.1}
    assert got == pick(df.orderBy(F.desc("id")))
    drawn = sampling.stratified_rng_sample(df.withColumn("stratum", F.concat("country", "tier")), "stratum", "id", "quota", 1)
    assert drawn.where("selected").count() == 20
    assert sorted(rows(drawn)) == sorted(rows(sampling.stratified_rng_sample(df.orderBy(F.desc("id")).withColumn("stratum", F.concat("country", "tier")), "stratum", "id", "quota", 1)))


@pytest.mark.parametrize("n, fixed, want", [(143, 30, 30), (143, None, 9), (201, None, 13), (3, None, 3), (0, None, 0)])
def test_plan_sizes(spark, n, fixed, want):
    got = sampling.hash_plan(spark.range(n), "id", "s", 0.06, 5, fixed=fixed)
    assert got.count() == want
    assert sorted(r[0] for r in got.select("place").collect()) == list(range(1, want + 1))


def test_plan_covers_both_strata(spark):
    df = spark.range(100).withColumn("rare", F.col("id") == 42)
    assert 42 in {r.id for r in sampling.hash_plan(df, "id", "s", 0.06, 5, F.col("rare")).collect()}


def test_allocation_and_weight_check(spark):
    df = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.2)], "k string, w double")
    assert sorted(rows(sampling.allocate(df, "k", "w", 10).select("k", "quota"))) == [("a", 4), ("b", 4), ("c", 2)]
    assert sorted(rows(sampling.allocate(df, "k", "w", 11).select("k", "quota"))) == [("a", 5), ("b", 4), ("c", 2)]
    with pytest.raises(Exception, match="sum to 1"):
        sampling.allocate(df.where("k <> 'c'"), "k", "w", 10).collect()


def test_complete_link_depends_on_order_not_chain(spark):
    points = [("v", 1, [1.0, 0.0]), ("v", 2, [0.8, 0.6]), ("v", 3, [0.28, 0.96])]
    df = spark.createDataFrame(points, "video string, id int, vec array<double>")
    got = {r.id: r.cluster for r in vectors.complete_link(df, "video", "id", "vec", 0.78).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_injection_share(spark):
    members = spark.createDataFrame([("v", i, [0.0, 1.0], "threat") for i in range(3)] + [("v", 3, [1.0, 0.0], "threat")], "video string, id int, vec array<double>, narrative string")
    clusters = vectors.complete_link(members, "video", "id", "vec", 0.78)
    for label, want in (("burden", 0.75), ("threat", 0.0)):
        sources = spark.createDataFrame([("v", [1.0, 0.0], [label]), ("empty", [1.0, 0.0], [label])], "video string, source_vector array<double>, source_labels array<string>")
        got = dict(rows(vectors.injection(clusters, members, sources, "video", "id", "vec", "narrative")))
        assert got == {"v": want, "empty": None}


def plain_amplification(comments, source, again):
    """(five components, clusters, largest) of one source's comments (key, text, minute, vector, narrative)."""
    n = len(comments)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    near = []
    for c in comments:
        for g in near:
            if all(cos(c[3], o[3]) >= 0.92 for o in g):
                g.append(c)
                break
        else:
            near.append([c])
    groups = {tuple(c[0] for c in g) for g in near if len(g) > 1}
    groups |= {g for t in {c[1] for c in comments} if len(g := tuple(c[0] for c in comments if c[1] == t)) > 1}
    burst = max(sum(c[2] <= o[2] <= c[2] + 10 for o in comments) for c in comments)
    hhi = sum((k / n) ** 2 for k in Counter(c[4] for c in comments).values())
    spread = (hhi - 1 / n) / (1 - 1 / n) if n > 1 else 0
    parts = (len({k for g in groups for k in g}) / n, max(0, (burst - 1) / max(1, n - 1)), sum(c[0] in again for c in comments) / n, sum(cos(source, c[3]) < 0.35 for c in comments) / n, max(0, min(1, spread)))
    return *parts, len(groups), max([len(g) for g in groups] + [0]) / n


def test_amplification_against_a_plain_version(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(120):
        v = [x + rng.gauss(0, 0.2) for x in rng.choice(base)]
        rows.append((i, rng.choice("abcd") if i != 7 else "single", f"text {rng.randint(0, 40)}", rng.randint(0, 60), v, rng.choice("xyz")))
    start = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, s, t, start + dt.timedelta(minutes=m), v, n) for i, s, t, m, v, n in rows], "id long, source string, text string, at timestamp, v array<double>, narrative string")
    sources = spark.createDataFrame([(s, base[k % 5]) for k, s in enumerate(["a", "b", "c", "d", "single", "nothing"])], "source string, source_vector array<double>")
    again = set(range(0, 120, 9))
    got = vectors.amplification(df, sources, spark.createDataFrame([(i,) for i in again], "id long"), "source", "id", F.col("text"), "at", "v", "narrative").collect()
    assert {r.source for r in got} == {"a", "b", "c", "d", "single"}
    for r in got:
        mine = [(i, t, m, v, n) for i, s, t, m, v, n in rows if s == r.source]
        want = plain_amplification(mine, base["abcd".find(r.source) if r.source != "single" else 4], again)
        assert [round(x, 9) for x in (r.duplicate, r.burst, r.recurrence, r.divergence, r.concentration, r.clusters, r.largest)] == [round(x, 9) for x in want]
        assert abs(r["index"] - sum(w * x for w, x in zip((0.25, 0.2, 0.2, 0.2, 0.15), want))) < 1e-9


def test_recurrence_groups_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    m = np.concatenate([base[i % 6] + rng.normal(size=(1, 8)) * 0.25 for i in range(60)])
    m[7] = m[3]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 12)
    want = set()
    for i in range(60):
        near = [j for j in sorted(range(60), key=lambda j: (-sim[i, j], j))[:8] if sim[i, j] >= 0.92]
        if len(near) > 1 and all(sim[a, b] >= 0.92 for a in near for b in near):
            want.add(tuple(sorted(near)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    assert {tuple(r.ids) for r in vectors.mutual_groups(df, "id", "v", 8, 0.92).collect()} == want and len(want) > 3
    both = vectors.united_groups(vectors.equal_groups(df, "id", "v"), vectors.mutual_groups(df, "id", "v", 8, 0.92))
    assert {tuple(r.ids) for r in both.collect()} == want | {(3, 7)}


def test_burst_counts_both_ends(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", base + dt.timedelta(seconds=s)) for s in (0, 600, 601)] + [("b", base)], "v string, ts timestamp")
    assert dict(rows(ordered.burst(df, "v", "ts"))) == {"a": 2, "b": 1}


def test_ranking_with_overlap(spark):
    dim = spark.createDataFrame([("FR", "France"), ("DE", "Germany"), ("GB", "United Kingdom")], "code string, name string")
    members = spark.createDataFrame([("FR", i) for i in range(10)] + [("DE", i) for i in range(4)], "code string, id int")
    got = rows(rollups.overlap_ranking(dim, "code", "name", members, "id", F.lit(10)).select("code", "n", "pct"))
    assert got == [("FR", 10, 100.0), ("DE", 4, 40.0), ("GB", 0, 0.0)]


def test_joint_is_null_with_marginals_only(spark):
    df = spark.createDataFrame([(None, 5), (3, 5), (None, 0)], "j long, total long")
    assert [r[0] for r in df.select(rollups.joint_or_null(F.col("j"), F.col("total"))).collect()] == [None, 3, 0]


def test_latest_hides_older_label(spark):
    df = spark.createDataFrame([("v", 1, True), ("v", 2, False), ("w", 1, True)], "v string, at int, ok boolean")
    assert {r.v for r in latest.latest_then_filter(df, ["v"], ["at"], F.col("ok")).collect()} == {"w"}
    assert {r.v for r in latest.filter_then_latest(df, ["v"], ["at"], F.col("ok")).collect()} == {"v", "w"}
    assert {(r.v, r.at) for r in latest.sticky_latest(df, ["v"], F.col("ok"), ["at"]).collect()} == {("v", 1), ("w", 1)}


def test_missing_stamp_loses(spark):
    df = spark.createDataFrame([("v", None, 1), ("v", "2024-01-01", 2), ("w", "rubbish", 3), ("w", "rubbish", 4)], "v string, at string, id int")
    assert {(r.v, r.id) for r in latest.latest_review(df, ["v"], "at", "id").collect()} == {("v", 2), ("w", 4)}


def test_cumulative_share_is_null_before_the_first(spark):
    df = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-03", "b")], "d string, t string")
    got = {(str(r.day), r.label): r.share for r in ordered.cumulative_share(df, "d", "t").collect()}
    assert got[("2024-01-01", "a")] == 100.0 and got[("2024-01-02", "a")] == 50.0 and round(got[("2024-01-03", "b")], 3) == 66.667


def test_prefix_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("v", 1, 5), ("v", 2, 10), ("v", 3, 1)], "v string, o int, n int")
    assert [r.o for r in ordered.prefix_budget(df, "v", "o", F.col("n"), 8).collect()] == [1]
    assert [r.o for r in ordered.prefix_budget(df, "v", "o", F.col("n"), 3, True).collect()] == [1]


def test_coverage_gaps(spark):
    regions = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 2.0)], "k string, start double, end double")
    segments = spark.createDataFrame([("a", 1.0, 3.0), ("a", 3.2, 5.0)], "k string, start double, end double")
    got = sorted((r.k, round(r.gap_start, 3), round(r.gap_end, 3)) for r in ordered.coverage_gaps(regions, segments, "k").collect())
    assert got == [("a", 0.0, 0.75), ("a", 5.25, 10.0), ("b", 0.0, 2.0)]


def test_agreement_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "a int, b int").withColumn("k", F.lit(1))
    r = rollups.agreement(df, "a", "b", ["k"]).first()
    assert (r.exact, r.mae, r.precision, r.recall) == (1.0, 0.0, None, None)
    cells = rollups.confusion(df, "a", "b", 1).collect()
    assert len(cells) == 4 and sum(c.n for c in cells) == 2


def test_jaccard_of_empty_sets_is_one(spark):
    none = F.array().cast("array<string>")
    assert spark.range(1).select(rollups.jaccard(none, none)).first()[0] == 1.0


def test_summary_survives_a_purge(spark):
    old = spark.createDataFrame([("w", 1, 2, 3)], "k string, a int, b int, c int")
    new = spark.createDataFrame([("w", 0, 0, 0), ("x", 5, 2, 3), ("y", 1, 2, 3)], "k string, a int, b int, c int")
    got = {r.k: (r.a, r.b, r.c) for r in rollups.bounded_summary(old, new, "k", ["a", "b", "c"]).collect()}
    assert got == {"w": (1, 2, 3), "y": (1, 2, 3)}


def test_age_and_ratio_nulls(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    got = spark.range(1).select(scalar.age_hours(t(None), t("2024-01-01")), scalar.age_hours(t("2024-01-02"), t("2024-01-01")), scalar.per_thousand(F.lit(1), F.lit(0)), scalar.counter(F.lit("-3")), scalar.counter(F.lit("12"))).first()
    assert tuple(got) == (None, 0.0, None, None, 12)


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_places_by_ranges_equal_one_sort(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(6)
    values = [(i, rng.choice([None, *range(12)])) for i in range(200)]
    df = spark.createDataFrame(values, "id long, v long")
    want = {i: n for n, (i, v) in enumerate(sorted(values, key=lambda r: (r[1] is None, r[1] or 0, r[0])), 1)}
    assert {r.id: r.place for r in ordered.placed(df, F.col("v"), ["id"]).collect()} == want
    assert ordered.placed(df.where("false"), F.col("v"), ["id"]).count() == 0


def test_population_hash_of_many_and_no_ids(spark):
    import hashlib
    import json

    ids = ["b", "a", "ü", 'q"', "a", None]
    for rows in (ids, [], [str(i) for i in range(25_000)]):
        want = json.dumps(sorted({i for i in rows if i is not None}), ensure_ascii=False, separators=(",", ":"))
        df = spark.createDataFrame([(i,) for i in rows], "id string")
        assert [r[0] for r in sampling.population_hash(df, "id").collect()] == [hashlib.sha256(want.encode()).hexdigest()]

"""Day partials: any range of days from the kept partials, exact parts exact, sketches within their error."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import partials, windows

T0 = datetime.datetime(2024, 3, 1)
SCHEMA = "k string, who long, ts timestamp_ntz, v double"


def rows_of(seed, n, days=10):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), float("inf"), 7.25, 7.25, round(rng.lognormvariate(3, 2), 2), round(rng.gauss(0, 50), 2)])
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), T0 + datetime.timedelta(seconds=rng.randrange(days * 86400)), value()) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def finite(rows):
    return sorted(v for *_, v in rows if v is not None and v == v and abs(v) != float("inf"))


def interpolated(values, p):
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] if low == at else values[low] * (1 - (at - low)) + values[low + 1] * (at - low)


@pytest.mark.parametrize("first,last", [(0, 9), (2, 2), (3, 7), (20, 30)])
def test_any_range_of_days(spark, tmp_path, first, last):
    rows = rows_of(1, 4000)
    path = f"{tmp_path}/days"
    partials.keep_days(partials.day_partials(table(spark, rows), "ts", ["k"], ["v"], ["who"], {"odd": F.col("who") % 2 == 1}), path)
    when = [str((T0 + datetime.timedelta(days=d)).date()) for d in (first, last)]
    got = {r.k: r for r in partials.summary(partials.kept_days(spark, path, *when), ["k"], {"p50": 0.5, "p95": 0.95}).collect()}
    mine = [r for r in rows if when[0] <= str(r[2].date()) <= when[1]]
    assert set(got) == {r[0] for r in mine}
    for k, r in got.items():
        of = [x for x in mine if x[0] == k]
        values = finite(of)
        assert (r.n, r["last"], r.odd, r.v_values, r.v_nulls) == (len(of), max(x[2] for x in of), sum(1 for x in of if x[1] is not None and x[1] % 2), len(values), len(of) - len(values))
        assert (r.v_min, r.v_max, r.who_distinct) == (values[0], values[-1], len({x[1] for x in of} - {None}))
        assert r.v_mean == pytest.approx(sum(values) / len(values))
        for found, p in ((r.v_p50, 0.5), (r.v_p95, 0.95)):
            below, upto = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
            assert below - partials.RANK_ERROR <= p <= upto + partials.RANK_ERROR


def test_rank_error_of_many_merged_days(spark):
    """300,000 values in 60 days, of which the later ones are larger: the merged sketch keeps the error of one."""
    rows = spark.range(300_000).select(F.lit("a").alias("k"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 60))").alias("ts"), (F.col("id") % 60 * 1000 + F.pmod(F.xxhash64("id"), F.lit(100_000))).cast("double").alias("v"))
    days = partials.day_partials(rows, "ts", ["k"], ["v"])
    shares = {f"p{i}": i / 20 for i in range(1, 20)}
    found = partials.summary(days, ["k"], shares).first()
    ranks = rows.agg(*[F.avg((F.col("v") <= found[f"v_{name}"]).cast("double")).alias(name) for name in shares]).first()
    assert all(abs(ranks[name] - p) <= 3 * partials.RANK_ERROR for name, p in shares.items())
    exact = partials.exact_quantiles(days, rows, ["k"], "v", shares).first()
    assert exact.asDict() == windows.quantiles(rows, ["k"], "v", shares).first().asDict()


def test_exact_quantiles_read_the_rows_once(spark):
    rows = rows_of(3, 3000)
    df = table(spark, rows)
    days = partials.day_partials(df, "ts", ["k"], ["v"])
    got = {r.k: r for r in partials.exact_quantiles(days, df, ["k"], "v", {"p": 0.5, "q": 0.9}).collect()}
    for k in ("a", "b", None):
        values = finite([r for r in rows if r[0] == k])
        assert (got[k].p, got[k].q) == (pytest.approx(interpolated(values, 0.5)), pytest.approx(interpolated(values, 0.9)))


def test_a_day_is_replaced_and_others_stay(spark, tmp_path):
    rows, path = rows_of(5, 1000), f"{tmp_path}/days"
    build = lambda part: partials.day_partials(table(spark, part), "ts", ["k"], ["v"], ["who"])
    early = [r for r in rows if r[2].minute < 50]
    partials.keep_days(build(early), path)
    late_day = T0.date() + datetime.timedelta(days=4)
    for _ in range(2):  # a rerun changes nothing
        partials.keep_days(build([r for r in rows if r[2].date() == late_day]), path)
    want = [r for r in rows if r[2].minute < 50 or r[2].date() == late_day]
    got = partials.summary(partials.kept_days(spark, path, "2024-01-01", "2025-01-01"), []).first()
    assert (got.n, got.v_values) == (len(want), len(finite(want)))


def test_other_days_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/days"
    partials.keep_days(partials.day_partials(table(spark, rows_of(6, 500)), "ts", ["k"], ["v"]), path)
    plan = partials.kept_days(spark, path, "2024-03-02", "2024-03-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_empty_and_valueless(spark):
    empty = partials.summary(partials.day_partials(table(spark, []), "ts", ["k"], ["v"], ["who"]), ["k"], {"p50": 0.5})
    assert empty.collect() == []
    nulls = table(spark, [("a", None, T0, None), ("a", None, None, float("nan"))])
    days = partials.day_partials(nulls, "ts", ["k"], ["v"], ["who"])
    r = partials.summary(days, ["k"], {"p50": 0.5}).first()
    assert (r.n, r.v_values, r.v_nulls, r.v_mean, r.v_min, r.v_p50, r.who_distinct) == (2, 0, 2, None, None, None, 0)
    assert partials.exact_quantiles(days, nulls, ["k"], "v", {"p50": 0.5}).collect() == []

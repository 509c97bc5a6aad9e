"""Properties that hold for any rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import filters as L
from tessera.operators import ranking as R
from tessera.operators import reshape as H
from tessera.operators import sets as U

ROWS = st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["a", "b", " a", "", None]), st.integers(-9, 9)), min_size=1, max_size=30)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, k int, t string, v int")


@few
@given(ROWS)
def test_dedup_is_idempotent_and_keeps_every_key(spark, rows):
    df = frame(spark, rows)
    once = R.keep_first(df, ["k", "t"], [F.col("at")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.keep_first(once, ["k", "t"], [F.col("at")]).collect()))
    assert once.count() == df.select("k", "t").distinct().count()


@few
@given(ROWS)
def test_running_totals_end_with_the_total(spark, rows):
    cells = H.cumulative_crosstab(frame(spark, rows).withColumn("t", F.trim("t")), "k", "t")
    last = {r.t: r.total for r in cells.groupBy("t").agg(F.max_by("total", "k").alias("total")).collect()}
    want = {}
    for _, t, _ in rows:
        if t is not None:
            want[t.strip()] = want.get(t.strip(), 0) + 1
    assert last == want


@few
@given(ROWS)
def test_shares_sum_to_a_hundred(spark, rows):
    total = A.percentages(frame(spark, rows), "t").agg(F.sum("percentage")).first()[0]
    assert abs(total - 100) < 1e-9


@few
@given(ROWS, ROWS)
def test_upsert_twice_is_upsert_once(spark, a, b):
    one = lambda rows: R.keep_first(frame(spark, rows), ["k"], [F.col("at")]).select("k", "t", "v")
    old, new = one(a), one(b)
    got = U.upsert(old, new, ["k"])
    key = lambda r: (r.k, r.t or "", r.v)
    assert sorted(got.collect(), key=key) == sorted(U.upsert(got, new, ["k"]).collect(), key=key)
    assert {r.k for r in got.collect()} == {r[0] for r in a} | {r[0] for r in b}


@given(st.lists(st.sampled_from(["", "All", "none", "x", " y "])))
def test_filter_values_hold_no_placeholder(values):
    kept = L.filter_value(values)
    assert kept is None or all(L.filter_text(v) == v for v in kept)

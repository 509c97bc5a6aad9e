"""Small facts about rules, regions, dedup and parsing, as tiny frames."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import regions as G
from tessera.functions import rules as D
from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import filters as L
from tessera.operators import joins as J
from tessera.operators import ranking as R
from tessera.operators import reshape as H
from tessera.operators import sets as U
from tessera.operators import statistics as T
from tessera.plans.text_to_sql import select as select_related


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def regions(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("M").alias("label")) for a, b in pairs])


def test_natural_key_dedup_keeps_the_first(spark):
    rows = [("1abc", "A", "x", 1.0, 0), ("1abc", "A", "y", 2.0, 1), ("1abc ", "A", "x", 3.0, 2), ("1abc", "A", "y", 4.0, 3), ("", None, "", 5.0, 4)]
    df = spark.createDataFrame(rows, "pdb_code string, `group` string, subgroup string, resolution double, at int")
    kept = R.keep_first_by_key(df, ["pdb_code", "group", "subgroup"], [F.col("at")])
    assert sorted(r.resolution for r in kept.collect()) == [1.0, 2.0, 5.0]


def test_group_spellings_share_a_bucket(spark):
    labels = [F.lit(x) for x in ("Bitopic", "Transmembrane proteins:alpha-helical", "alpha  helical", "transmembrane")]
    r = one(spark, D.disagreement(labels, [F.lit(1), F.lit(None).cast("int")], F.lit(None).cast("boolean")).alias("d")).d
    assert not r.group and not r["count"] and not r.any


@pytest.mark.parametrize("a, b, tolerance, far", [([(10, 30), (40, 60)], [(10, 30), (48, 70)], 5, True), ([(10, 30)], [(14, 34)], 5, False), ([(10, 30)], [(16, 36)], 5, True), ([(10, 30), (40, 60)], [(10, 30)], 5, False)])
def test_boundary_shift(spark, a, b, tolerance, far):
    assert one(spark, G.shifted(G.signature(regions(*a)), G.signature(regions(*b)), tolerance).alias("x")).x is far


def test_predictors_are_not_compared_with_each_other(spark):
    rows = [("e", "opm", [(10, 30)]), ("e", "TMbed", [(14, 34)]), ("e", "phobius", [(6, 26)]), ("f", "tmbed", [(1, 2)]), ("f", "phobius", [(50, 60)])]
    df = spark.createDataFrame([(e, s, [(a, b, "M") for a, b in r]) for e, s, r in rows], f"entity string, source string, regions array<{G.REGION}>")
    assert [(r.entity, r.boundary_disagreement) for r in G.reference_disagreement(df, "entity", "source", "regions").collect()] == [("e", False)]


def test_runs_and_membrane_filter(spark):
    r = one(spark, G.runs(F.lit("iiHHHooo")).alias("x"), G.with_label(G.runs(F.lit("iiHHHooo")), "H").alias("h"), G.runs(F.lit("")).alias("e"))
    assert [(x.label, x.start, x.end) for x in r.x] == [("i", 1, 2), ("H", 3, 5), ("o", 6, 8)]
    assert [(x.start, x.end) for x in r.h] == [(3, 5)] and r.e == []


def test_payload_regions(spark):
    many = '{"Regions": {"Region": [{"_attributes": {"Start": "1", "End": "9", "Loc": "Inside"}}, {"_attributes": {"Start": "10", "End": "30", "Loc": "Membrane"}}]}}'
    single = '{"Regions": {"Region": {"_attributes": {"Start": "3", "End": "8", "Loc": "Membrane"}}}}'
    chain = '{"chain": [{"region": [{"seq_beg": "1", "seq_end": "5", "type": "G"}, {"seq_beg": "136", "seq_end": "156", "type": "M"}]}], "sequence": "MKV"}'
    r = one(spark, G.count_membrane(G.from_payload(F.lit(many))).alias("n"), G.from_payload(F.lit(single)).alias("s"), G.from_chain_payload(F.lit(chain)).alias("c"), G.sequence_of(F.lit(chain)).alias("q"))
    assert r.n == 1 and [(x.start, x.end) for x in r.s] == [(3, 8)] and [(x.start, x.end) for x in r.c] == [(136, 156)] and r.q == "MKV"


def test_region_text(spark):
    r = one(spark, G.normalise(G.from_text(F.lit("[{'start': 30, 'end': 10, 'label': 'M'}, {'start': null, 'end': 2}]"))).alias("x"), G.from_segments(F.lit("1( 10- 30),2(40-60)")).alias("s"))
    assert [(x["index"], x.start, x.end, x.length) for x in r.x] == [(1, 10, 30, 21)]
    assert [(x.start, x.end) for x in r.s] == [(10, 30), (40, 60)]


def test_completion_needs_count_and_regions(spark):
    df = spark.createDataFrame([(1, "[..]"), (1, ""), (None, "[..]")], "n int, r string")
    assert [x.ok for x in df.select(L.completed(F.col("n"), F.col("r")).alias("ok")).collect()] == [True, False, False]


def test_agreed_values_report_conflicts(spark):
    df = spark.createDataFrame([("1abc", "aa"), ("1ABC", "AA"), ("2def", "B"), ("2def", "C")], "code string, seq string")
    good, bad = U.agreed_values(df, F.upper("code"), F.upper("seq"))
    assert [tuple(r) for r in good.collect()] == [("1ABC", "AA")] and [r.key for r in bad.collect()] == ["2DEF"]


def test_keyword_rules_and_override(spark):
    r = one(spark, D.assessment(F.lit("9xyz"), F.lit("A hemolysin in detergent"), F.lit(False)).alias("a"), D.assessment(F.lit("1pfo"), F.lit("plain"), F.lit(False)).alias("b"), D.assessment(F.lit("x"), F.lit(None).cast("string"), F.lit(True)).alias("c"))
    assert r.a.rules == ["pore_forming_toxin", "artificial_environment_context"] and r.a.confidence == "high" and not r.a.recommended
    assert r.b.rules == ["override:1PFO"] and r.b.state_dependent and not r.b.recommended
    assert r.c.rules == [] and r.c.confidence == "none" and not r.c.recommended


def test_decision_downgrade(spark):
    d = D.decision(F.lit(True), F.lit("accepted"), F.lit(False), F.lit(False), F.lit(True), F.lit(False), F.lit(True), F.lit(True))
    r = one(spark, d.alias("d"), D.status(d["include"], d["high_confidence"], F.lit(True), F.lit(False)).alias("s"))
    assert r.d.include and not r.d.high_confidence and r.s == "included_with_caution"


def test_percentages(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    assert {r.t: round(r.percentage, 2) for r in A.percentages(df, "t").collect()} == {"a": 66.67, "b": 33.33}


@pytest.mark.parametrize("given, kept", [("", None), ("All", None), ("undefined", None), (None, None), ("x", "x"), (["All", "x", ""], ["x"]), (["nan"], None)])
def test_filter_placeholders(given, kept):
    assert L.filter_value(given) == kept


def test_paging_is_clamped():
    assert R.clamped_page(30, 9, None) == (2, 25) and R.clamped_page(0, 0, 999) == (1, 200)


def test_search_needs_every_word(spark):
    df = spark.createDataFrame([("EGFR receptor", "Bitopic proteins"), ("EGFR", "other"), (None, "bitopic")], "a string, b string")
    assert df.where(L.global_search("egfr BITOPIC", ["a", "b"])).count() == 1


def test_anti_join_keeps_null_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert J.without(df, spark.createDataFrame([(1,), (None,)], "k int"), "k").count() == 2


def test_upsert_keeps_meaning(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, " ", None), (3, "c", 3.0)], "k int, t string, v double")
    new = spark.createDataFrame([(1, " ", 9.0), (2, "b", 2.0), (4, "d", 4.0)], "k int, t string, v double")
    got = sorted(tuple(r) for r in U.upsert(old, new, ["k"]).collect())
    assert got == [(1, "a", 9.0), (2, "b", 2.0), (3, "c", 3.0), (4, "d", 4.0)]
    assert sorted(tuple(r) for r in U.upsert(U.upsert(old, new, ["k"]), new, ["k"]).collect()) == got


def test_cumulative_ends_with_the_total(spark):
    df = spark.createDataFrame([(2000, "a"), (2002, "a"), (2002, "b"), (2003, "b")], "y int, g string")
    cells = H.cumulative_crosstab(df, "y", "g")
    last = {r.g: r.total for r in cells.where("y = 2003").collect()}
    assert last == {"a": 2, "b": 2} and cells.count() == 6


def test_bins_keep_empty_ones_and_text(spark):
    df = spark.createDataFrame([("0.1",), ("0.2",), ("0.9",), ("n/a",), (None,)], "v string")
    got = {r.label: r["count"] for r in H.range_bins(df, "v", 0.2).collect()}
    assert got["0.00-0.20"] == 2 and got["0.20-0.40"] == 0 and got["n/a"] == 1 and sum(got.values()) == 4


def test_scalars(spark):
    r = one(
        spark, S.count_tolerant(F.lit("about -3.9 or 4")).alias("a"), S.count_tolerant(F.lit("2.9")).alias("b"), S.bracketed_number(F.lit("[2.50]")).alias("c"),
        S.year_in_pairs(F.lit("[['year', '1999']]")).alias("d"), S.first_year(F.lit("x"), F.lit("2001-05")).alias("e"), S.strip_tags(F.lit("<b>a</b>\r\nb")).alias("f"),
        S.replacement(F.lit("1ABC"), F.lit("1ABC->2DEF"), F.lit(""), F.lit(None).cast("string")).alias("g"), S.literal_mean(F.lit("oops")).alias("h"), S.ordinal_of(F.lit("b"), ["c", "b"]).alias("i"),
        S.number_or_text(F.lit("x1")).alias("j"), S.month_number(F.lit("march")).alias("k"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.h, r.i, r.k) == (-3, 2, 2.5, 1999, 2001, "a  b", 0.0, 0, 3)
    assert tuple(r.g) == ("1ABC", "2DEF", "2DEF") and tuple(r.j) == (None, "x1")


def test_decode_entities(spark):
    assert spark.createDataFrame([("a &amp; b",), (None,)], "t string").select(S.decode_entities("t").alias("t")).collect()[0].t == "a & b"


def test_constant_columns_scale_to_null_and_are_found(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert T.varying(df, ["a", "b"]) == ["a"]
    assert {r.z for r in T.scaled(df, "b", "standard", "z").collect()} == {None}


def test_exponential_fit_recovers_its_curve():
    import math

    a, b = T.exponential_fit([(x, 120 * math.exp(0.12 * (x - 20))) for x in range(21)])
    assert abs(a - 120) < 1e-3 and abs(b - 0.12) < 1e-6


def test_selections_over_related_tables(spark):
    prot = spark.createDataFrame([("1abc", "2.5", "x"), ("2DEF", "3", "y"), ("3ghi", "none", "z")], "pdb_code string, resolution string, name string")
    fn = spark.createDataFrame([("1abc", "g1", "n1"), ("2DEF", "g2", "n2"), ("3ghi", "g3", "n3")], "pdb_code string, gene string, name string")
    out = select_related({"prot": prot, "fn": fn}, [("pdb_code", "in", ["2def", "3GHI"]), ("resolution", ">=", 2.5)], ["gene", "name"], ["pdb_code"])
    assert [tuple(r) for r in out.collect()] == [("g2", "y")]
    assert select_related({"prot": prot}).count() == 3 and select_related({"prot": prot}, [("pdb_code", "in", ["x'); DROP TABLE prot; --"])]).count() == 0
    for bad in ([("size", ">", 1)], [("name", "INSERT", 1)]):
        with pytest.raises(ValueError):
            select_related({"prot": prot}, bad)
    with pytest.raises(ValueError):
        select_related({"prot": prot}, [], ["1; DROP TABLE prot"])


def test_an_outlier_is_told_instead_of_listing_its_bins(spark):
    with pytest.raises(Exception, match="more than 100000 are not listed"):
        H.range_bins(spark.createDataFrame([("1",), ("50000000000",)], "v string"), "v", 4.0).collect()


def test_small_helpers(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (2, None, 3.0)], "k int, v string, resolution double")
    assert J.zipped(a, a.withColumn("w", F.lit(1)), "k").columns == ["k", "v", "resolution", "w"]
    assert L.complete(a).count() == 1 and L.method_columns(a, "X-ray") == ["resolution"] and L.method_columns(a, "none") == []
    assert L.cleaned(a, lambda c: F.upper(c)).first().v == "X"
    assert [r.n for r in spark.createDataFrame([("2", None), (None, [(1, 5, "M")]), ("x", None)], f"c string, r array<{G.REGION}>").select(G.stated_count(F.col("c"), F.col("r")).alias("n")).collect()] == [2, 1, None]
    assert L.short_name("rcsb_primary_citation_journal_abbrev") == "rcs_pri_citation_journal_abbrev"
    with pytest.raises(ValueError):
        L.with_short_names(spark.createDataFrame([(1, 2)], "`a-b` int, `a_b` int"))

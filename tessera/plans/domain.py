"""Registered queries of scalar functions, domain rules, regions and text-to-SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regions as G
from ..functions import rules as D
from ..functions import scalars as S
from ..operators import aggregates as A
from ..sources.readers import table
from .registry import registry
from .text_to_sql import select as select_related

query, QUERIES, ORACLE_SQL = registry()


# --- scalar functions ----------------------------------------------------------
@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE)::BIGINT AS whole FROM events")
def json_props(spark, d):
    """SCL-9, SCL-10, SCL-24."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events", ["event_id", "props"]).select("event_id", k.alias("k"), S.count_strict(k).alias("whole"))


@query("SELECT page_id, translate(regexp_replace(coalesce(html, ''), '<.*?>', '', 'g'), chr(13) || chr(10), '  ') AS plain FROM pages")
def html_strip(spark, d):
    """SCL-16."""
    return table(spark, d, "pages", ["page_id", "html"]).select("page_id", S.strip_tags(F.col("html")).alias("plain"))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 60 THEN rtrim(substr(trim(text), 1, 59)) || '...' ELSE trim(text) END AS short FROM conversations")
def excerpt(spark, d):
    """SCL-41."""
    return table(spark, d, "conversations").select("conv_id", "turn", S.excerpt(F.col("text"), 60).alias("short"))


@query("""
SELECT c_custkey, upper(trim(coalesce(c_mktsegment, ''))) AS code, CASE WHEN lower(trim(c_mktsegment)) NOT IN ('', 'nan', 'none', 'null', 'undefined') THEN trim(c_mktsegment) END AS text,
  coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' END), ''), nullif(trim(c_name), '')) AS first FROM customer
""")
def text_normalise(spark, d):
    """SCL-1, SCL-2, SCL-8, SCL-49."""
    seg = F.col("c_mktsegment")
    first = S.first_present(F.when(F.col("c_custkey") % 2 == 0, " "), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.code(seg).alias("code"), S.text(seg).alias("text"), first.alias("first"))


@query("""
SELECT o_orderkey, lower(trim(v)) IN ('replaced', 'true', '1', 'yes', 'y') AS flag, lower(trim(v)) IN ('replaced', 'obsolete', 'true', '1', 'yes', 'y') OR coalesce(TRY_CAST(trim(v) AS DOUBLE) <> 0, FALSE) AS wide
FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'obsolete' WHEN 2 THEN '2' WHEN 3 THEN ' TRUE ' WHEN 4 THEN '0' ELSE 'no' END AS v FROM orders)
""")
def replacement_flags(spark, d):
    """SCL-3..5."""
    k = F.col("o_orderkey") % 6
    v = F.when(k == 0, "Yes").when(k == 1, "obsolete").when(k == 2, "2").when(k == 3, " TRUE ").when(k == 4, "0").otherwise("no")
    return table(spark, d, "orders", ["o_orderkey"]).select("o_orderkey", S.replaced_flag(v).alias("flag"), S.replaced_flag_wide(v).alias("wide"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%b') AS month, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS readable, month(o_orderdate)::BIGINT AS number FROM orders")
def date_labels(spark, d):
    """SCL-18, SCL-19, SCL-21."""
    t = F.col("o_orderdate")
    return table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", S.year_month(t).alias("month"), S.readable_time(t).alias("readable"), S.month_number(F.date_format(t, "MMM")).cast("long").alias("number"))


@query("SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '\\d+(\\.\\d+)?', 0) AS DOUBLE) AS number, CASE WHEN c_acctbal >= 4 THEN 'high' WHEN c_acctbal >= 2 THEN 'medium' ELSE 'low' END AS band FROM customer")
def number_parsing(spark, d):
    """SCL-9, SCL-12, SCL-46."""
    return table(spark, d, "customer").select("c_custkey", S.first_number(F.col("c_name")).alias("number"), S.score_band(F.col("c_acctbal")).alias("band"))


@query("SELECT n_nationkey, CASE n_name WHEN 'UK' THEN 'GB' WHEN 'KO' THEN 'KR' WHEN 'NATION_1' THEN 'ONE' ELSE n_name END AS name, ceil(n_nationkey / 7.0::DOUBLE * 100) / 100 AS up FROM nation")
def recodes(spark, d):
    """SCL-42, SCL-44, SCL-48."""
    return table(spark, d, "nation").select("n_nationkey", S.recode(F.col("n_name"), S.COUNTRY_RECODES | {"NATION_1": "ONE"}).alias("name"), S.up_to_cents(F.col("n_nationkey") / 7.0).alias("up"))


@query("SELECT n_regionkey AS k, list_aggregate([n_nationkey, 2, 6], 'avg') AS mean, ['A' || n_nationkey, 'B'] = ['A' || n_nationkey, 'B'] AS same FROM nation")
def literal_lists(spark, d):
    """SCL-22, SCL-23, SCL-25, SCL-26."""
    numbers = F.format_string("[%d, 2, 6]", "n_nationkey")
    codes = F.format_string("['a%d', ' b ', '', 'B']", "n_nationkey")
    wanted = F.array(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")), F.lit("B"))
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), S.literal_mean(numbers).alias("mean"), (S.related_codes(codes) == wanted).alias("same"))


# --- regions -------------------------------------------------------------------
@query("""
WITH t AS (SELECT user_id, event_type, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_type, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM t GROUP BY user_id, event_type, g
""")
def rle_rows(spark, d):
    """SCL-32 over rows."""
    from ..streaming.events import runs

    return runs(table(spark, d, "events", ["event_id", "user_id", "ts", "event_type"]), "user_id", "ts", "event_id", "event_type").drop("run")


@query("""
SELECT p_partkey, label, start, "end", "end" - start + 1 AS length FROM (
  SELECT p_partkey, c AS label, min(i) AS start, max(i) AS "end" FROM (
    SELECT p_partkey, i, c, i - row_number() OVER (PARTITION BY p_partkey, c ORDER BY i) AS g FROM (SELECT p_partkey, unnest(range(1, length(p_type) + 1)) AS i, unnest(string_split(p_type, '')) AS c FROM part))
  GROUP BY p_partkey, c, g)
""")
def rle_segments(spark, d):
    """SCL-32, SCL-33."""
    out = table(spark, d, "part", ["p_partkey", "p_type"]).select("p_partkey", F.inline(G.runs(F.col("p_type"))))
    return out.select("p_partkey", "label", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "length")])


_LINES = """
WITH r AS (SELECT l_orderkey AS k, l_linenumber % 2 AS side, list_sort(list(l_quantity::BIGINT * 10 + l_linenumber)) AS s FROM lineitem GROUP BY ALL),
  p AS (SELECT a.k, a.s AS x, b.s AS y FROM r a JOIN r b ON a.k = b.k AND a.side = 1 AND b.side = 0)
"""


@query(_LINES + "SELECT k, len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda z: abs(z[1] - z[2]) > 100)) > 0 AS shifted FROM p")
def boundary_shift(spark, d):
    """RNG-1, RNG-3."""
    line = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    at = (F.col("l_quantity").cast("long") * 10 + F.col("l_linenumber")).cast("int")
    region = F.struct(at.alias("start"), (at + 20).alias("end"), F.lit("M").alias("label"))
    sides = line.groupBy(F.col("l_orderkey").alias("k")).agg(*[F.collect_list(F.when(F.col("l_linenumber") % 2 == s, region)).alias(f"r{s}") for s in (0, 1)])
    return sides.where("size(r0) > 0 and size(r1) > 0").select("k", G.shifted(G.signature(F.col("r1")), G.signature(F.col("r0")), 100).alias("shifted"))


@query("""
WITH s AS (SELECT o_custkey AS entity, CASE o_orderstatus WHEN 'F' THEN 'opm' WHEN 'O' THEN 'tmbed' ELSE 'phobius' END AS src, o_orderkey, floor(o_totalprice)::BIGINT % 40 AS a FROM orders),
  one AS (SELECT entity, src, a FROM (SELECT *, row_number() OVER (PARTITION BY entity, src ORDER BY o_orderkey) AS r FROM s) WHERE r = 1),
  ref AS (SELECT entity, a AS ra FROM one WHERE src = 'opm')
SELECT entity, coalesce(bool_or(CASE WHEN src <> 'opm' THEN abs(a - ra) > 5 END), FALSE) AS boundary_disagreement FROM one JOIN ref USING (entity) GROUP BY 1
""")
def reference_boundaries(spark, d):
    """RNG-2, RNG-4."""
    from ..operators.ranking import keep_first

    s = F.when(F.col("o_orderstatus") == "F", "OPM").when(F.col("o_orderstatus") == "O", "TMbed").otherwise("Phobius")
    a = (F.floor("o_totalprice") % 40).cast("int")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), s.alias("source"), "o_orderkey", F.array(F.struct(a.alias("start"), (a + 20).alias("end"), F.lit("M").alias("label"))).alias("regions"))
    return G.reference_disagreement(keep_first(rows, ["entity", "source"], [F.col("o_orderkey")]), "entity", "source", "regions")


@query("SELECT n_nationkey AS k, 2::BIGINT AS regions, 1::BIGINT AS membrane, (n_nationkey + 90 >= 80)::INT::BIGINT AS large FROM nation")
def region_payloads(spark, d):
    """SCL-27..29, SCL-35..38, RNG-6."""
    text = F.format_string('{"Regions": {"Region": [{"_attributes": {"Start": "1", "End": "%d", "Loc": "Membrane"}}, {"_attributes": {"Start": "120", "End": "125", "Loc": "Inside"}}]}}', F.col("n_nationkey") + 90)
    r = G.from_payload(text)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.size(G.normalise(r)).cast("long").alias("regions"), G.count_membrane(r).cast("long").alias("membrane"), F.size(G.large(r)).cast("long").alias("large"))


# --- domain rules --------------------------------------------------------------
#: Proxy labels: a part's type words become label spellings.
_SPELLINGS = ("monotopic/peripheral", " Bitopic ", "beta  barrel", "Alpha-Helical", "some BETA shaped barrel", "alpha helix bundle", "Transmembrane", "other thing", "")
_SPELLED = f"list_value({', '.join(repr(x) for x in _SPELLINGS)})[(p_partkey % {len(_SPELLINGS)} + 1)::INT]"
_STANDARD = """CASE WHEN trim(x) = '' THEN NULL WHEN l LIKE '%monotopic%' OR l LIKE '%peripheral%' THEN 'MONOTOPIC MEMBRANE PROTEINS' WHEN l LIKE '%bitopic%' THEN 'BITOPIC PROTEINS'
  WHEN l LIKE '%beta%' AND l LIKE '%barrel%' THEN 'TRANSMEMBRANE PROTEINS:BETA-BARREL' WHEN l LIKE '%alpha%' AND (l LIKE '%helical%' OR l LIKE '%helix%') THEN 'TRANSMEMBRANE PROTEINS:ALPHA-HELICAL' ELSE upper(trim(x)) END"""
_LABELS = f"WITH s AS (SELECT p_partkey, {_SPELLED} AS x, lower(trim({_SPELLED})) AS l FROM part), t AS (SELECT p_partkey, {_STANDARD} AS label FROM s)"


def _spelled(spark, d):
    at = (F.col("p_partkey") % len(_SPELLINGS)).cast("int")
    return table(spark, d, "part").withColumn("x", F.get(F.array(*[F.lit(s) for s in _SPELLINGS]), at))


@query(_LABELS + """
SELECT p_partkey, label, CASE WHEN label IN ('BITOPIC PROTEINS', 'TRANSMEMBRANE PROTEINS:ALPHA-HELICAL', 'TRANSMEMBRANE') THEN 'TRANSMEMBRANE PROTEINS:ALPHA-HELICAL / BITOPIC' ELSE label END AS bucket,
  CASE WHEN label IN ('BITOPIC PROTEINS', 'TRANSMEMBRANE PROTEINS:ALPHA-HELICAL', 'TRANSMEMBRANE', 'TRANSMEMBRANE PROTEINS:BETA-BARREL') THEN 'TRANSMEMBRANE / BITOPIC BENCHMARK' ELSE label END AS expert FROM t
""")
def label_standardise(spark, d):
    """DOM-1..3, DOM-19, SCL-52."""
    x = F.col("x")
    return _spelled(spark, d).select("p_partkey", D.standard_label(x).alias("label"), D.disagreement_bucket(x).alias("bucket"), D.expert_bucket(x).alias("expert"))


_WORDS = ("a pore-forming toxin", "the prepore oligomer", "closed state", "membrane-associated", "a fusion construct", "truncated fragment in detergent", "plain protein", "toxicology")


@query("""
WITH w AS (SELECT p_partkey, list_value('a pore-forming toxin', 'the prepore oligomer', 'closed state', 'membrane-associated', 'a fusion construct', 'truncated fragment in detergent', 'plain protein', 'toxicology')[(p_partkey % 8 + 1)::INT] AS w, p_size > 40 AS replaced FROM part),
  r AS (SELECT *, regexp_matches(w, '\\b(pore-forming|tox[in]?)\\b') AS r1, regexp_matches(w, '\\b(prepore|oligomer)\\b') AS r2, w = 'closed state' AS r3, w = 'membrane-associated' AS r4, w = 'a fusion construct' AS r5 FROM w)
SELECT p_partkey, r1 OR r2 OR r3 OR r4 AS state_dependent, CASE WHEN r1 OR r5 THEN 'high' WHEN r2 OR r3 OR r4 THEN 'medium' WHEN w = 'truncated fragment in detergent' THEN 'low' ELSE 'none' END AS confidence,
  NOT (r1 OR r2 OR r3 OR r4 OR r5) AND NOT replaced AS recommended FROM r
""")
def keyword_rules(spark, d):
    """DOM-4."""
    w = F.get(F.array(*[F.lit(x) for x in _WORDS]), (F.col("p_partkey") % len(_WORDS)).cast("int"))
    a = D.assessment(F.col("p_name"), w, F.col("p_size") > 40)
    return table(spark, d, "part").select("p_partkey", a.alias("a")).select("p_partkey", "a.state_dependent", "a.confidence", "a.recommended")


@query("""
WITH c AS (SELECT o_orderkey, o_totalprice > 200000 AS differs, CASE o_orderkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'Accepted ' WHEN 2 THEN 'open' END AS review, o_orderkey % 7 = 0 AS missing, o_orderstatus = 'P' AS flagged,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS boundary, o_orderkey % 4 <> 0 AS agrees FROM orders),
  e AS (SELECT *, lower(trim(coalesce(review, ''))) = 'rejected' AS rejected, (differs OR lower(trim(coalesce(review, ''))) IN ('accepted', 'reviewed', 'uncertain')) AND NOT missing AND lower(trim(coalesce(review, ''))) <> 'rejected' AS include FROM c),
  f AS (SELECT *, include AND NOT flagged AND NOT coalesce(boundary, FALSE) AND agrees AS high FROM e)
SELECT o_orderkey, include, high, CASE WHEN rejected THEN 'excluded' WHEN high THEN 'high_confidence' WHEN include AND NOT flagged THEN 'included_with_caution' WHEN flagged THEN 'not_recommended' ELSE 'excluded' END AS status FROM f
""")
def decision_status(spark, d):
    """DOM-7, DOM-8."""
    k = F.col("o_orderkey")
    review = F.when(k % 5 == 0, "rejected").when(k % 5 == 1, "Accepted ").when(k % 5 == 2, "open")
    flagged, boundary = F.col("o_orderstatus") == "P", F.when(k % 3 != 0, k % 3 == 1)
    c = D.decision(F.col("o_totalprice") > 200000, review, k % 7 == 0, F.lit(False), flagged, boundary, k % 4 != 0, F.lit(True))
    rows = table(spark, d, "orders").select("o_orderkey", c.alias("c"), flagged.alias("flagged"), F.coalesce(review == "rejected", F.lit(False)).alias("rejected"))
    return rows.select("o_orderkey", F.col("c.include").alias("include"), F.col("c.high_confidence").alias("high"), D.status(F.col("c.include"), F.col("c.high_confidence"), ~F.col("flagged"), F.col("rejected")).alias("status"))


@query(_LABELS + """
SELECT p_partkey, (label IS NOT NULL AND upper(p_type) IS NOT NULL) AS grp, p_size <> p_size % 10 AS cnt FROM t JOIN part USING (p_partkey)
""")
def disagreement(spark, d):
    """DOM-6, DOM-11, DOM-12."""
    rows = _spelled(spark, d)
    s = D.disagreement([F.col("x"), F.col("p_type")], [F.col("p_size"), F.col("p_size") % 10], F.lit(None).cast("boolean"))
    return rows.select("p_partkey", s.alias("s")).select("p_partkey", F.col("s.group").alias("grp"), F.col("s.count").alias("cnt"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'CANON' END, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END, upper(trim(c_mktsegment))) AS canonical,
  CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 THEN 'found' ELSE 'redirected' END AS access FROM customer
""")
def canonical_codes(spark, d):
    """DOM-17, DOM-20, SCL-6, SCL-7."""
    k, own = F.col("c_custkey"), F.col("c_mktsegment")
    to = D.canonical_code(own, F.when(k % 3 == 0, " new"), F.when(k % 4 == 0, "canon"))
    return table(spark, d, "customer").select("c_custkey", to.alias("canonical"), D.redirect(own, F.when(k % 5 != 0, to)).alias("access"))


@query("SELECT p_partkey, 'a' AS source, upper(trim(p_type)) AS label, p_size::BIGINT AS count FROM part UNION ALL SELECT p_partkey, 'b', upper(trim(p_brand)), (p_size % 7)::BIGINT FROM part")
def comparison_rows(spark, d):
    """DOM-23, DOM-24, RSH-25."""
    rows = D.comparison_rows(a=(F.col("p_type"), F.col("p_size")), b=(F.col("p_brand"), F.col("p_size") % 7))
    return table(spark, d, "part").select("p_partkey", F.inline(rows))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 'small' ELSE p_brand END AS grp, lower(p_type) <> lower(p_brand) AS differs FROM part")
def regrouping(spark, d):
    """DOM-15, DOM-16."""
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size").isin(1, 2, 3), "small").otherwise(F.col("p_brand")).alias("grp"), D.class_differs(F.col("p_type"), F.col("p_brand")).alias("differs"))


# --- text to SQL ---------------------------------------------------------------
@query("SELECT size FROM (SELECT p_partkey AS partkey, p_brand AS brand, p_size AS size FROM part) p JOIN (SELECT l_partkey AS partkey, l_quantity AS quantity FROM lineitem) l USING (partkey) WHERE size >= 10 AND upper(brand) IN ('BRAND#11', 'BRAND#12')")
def text2sql(spark, d):
    """T2S-1..6, JOIN-27, JOIN-28."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"))
    return select_related({"parts": parts, "lines": lines}, [("size", ">=", 10), ("brand", "in", ["Brand#11", "Brand#12"])], ["size"])


# --- composite records ---------------------------------------------------------
@query("""
WITH c AS (SELECT o_orderkey, o_custkey % 3 AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' END AS r FROM orders)
SELECT o_orderkey::VARCHAR AS entity, o_custkey % 3 <> o_custkey % 2 AS disagreement_count, o_orderpriority LIKE '1%' AS disagreement_group, coalesce(r, '-') AS review,
  CASE WHEN r IS NOT NULL THEN 'excluded' WHEN o_orderpriority LIKE '1%' OR o_custkey % 3 <> o_custkey % 2 THEN
    CASE WHEN o_orderpriority LIKE '1%' OR o_custkey % 3 <> o_custkey % 2 THEN 'included_with_caution' ELSE 'high_confidence' END ELSE 'excluded' END AS status
FROM orders JOIN c USING (o_orderkey)
""")
def discrepancy_candidates(spark, d):
    """E2, DOM-6..10, DOM-18."""
    from ..operators.records import candidates

    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    records = o.select(
        k.alias("entity"), F.lit("Bitopic").alias("expert"), F.when(F.col("o_orderpriority").startswith("1"), "beta barrel").otherwise("alpha helical").alias("seen"),
        (F.col("o_custkey") % 3).alias("expert_n"), (F.col("o_custkey") % 2).alias("seen_n"), F.lit("plain protein").alias("words"), F.lit(False).alias("replaced"), F.lit(None).cast("boolean").alias("boundary"),
    )
    reviews = o.where("o_orderkey % 5 = 0").select(k.alias("entity"), F.lit("rejected").alias("review_status"))
    notes = A.note_summary(table(spark, d, "conversations").withColumn("entity", F.col("conv_id").cast("string")), "entity", "turn", "turn", "text", "role")
    out = candidates(records, reviews, notes, "entity", ["expert", "seen"], ["expert_n", "seen_n"], "words", "replaced", "boundary")
    return out.select("entity", F.col("disagreement.count").alias("disagreement_count"), F.col("disagreement.group").alias("disagreement_group"), F.coalesce("review_status", F.lit("-")).alias("review"), "status")


@query("SELECT p_partkey::VARCHAR AS id, m AS method, CASE m WHEN 'upper' THEN upper(p_name) ELSE reverse(p_name) END AS topology FROM part, (VALUES ('upper'), ('reversed')) v(m)")
def predictor_fan_out(spark, d):
    """UDF-6, UDF-7."""
    from ..operators.records import predicted

    return predicted(table(spark, d, "part"), "p_partkey", "p_name", {"upper": lambda xs: [x.upper() for x in xs], "reversed": lambda xs: [x[::-1] for x in xs]})


@query("SELECT n_nationkey AS k, 2::BIGINT AS tm_count, 'inside' AS n_side, 'outside' AS c_side, 'polytopic' AS kind, (n_nationkey >= 10)::INT::BIGINT AS long_loops FROM nation")
def topology_summary(spark, d):
    """DOM-14, RNG-5, RNG-6."""
    from ..operators.records import topology_summary as summary

    region = lambda a, b, l: F.struct(F.lit(a).cast("int").alias("start"), b.cast("int").alias("end"), F.lit(l).alias("label"))
    n = F.col("n_nationkey")
    r = F.array(region(1, F.lit(9), "Inside"), region(10, F.lit(30), "Membrane"), region(31, n + 100, "loop"), region(200, F.lit(220), "TMhelix"), region(221, F.lit(230), "Outside"))
    return table(spark, d, "nation").select(n.alias("k"), summary(r).alias("s")).select("k", F.col("s.tm_count").cast("long").alias("tm_count"), "s.n_side", "s.c_side", "s.kind", F.col("s.long_loops").cast("long").alias("long_loops"))


# --- predictions and exports ---------------------------------------------------
@query("""
SELECT o_custkey AS entity, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS names FROM orders GROUP BY 1
""")
def grouped_predictions(spark, d):
    """AGG-36, AGG-37: items of an entity in order, and their names joined."""
    rows = A.grouped_items(table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderpriority"]), "o_custkey", "o_orderkey", name="o_orderpriority")
    joined = lambda f: F.array_join(F.transform("items", lambda x: x[f].cast("string")), ",")
    return rows.select(F.col("o_custkey").alias("entity"), F.size("items").cast("long").alias("n"), joined("o").alias("items"), joined("name").alias("names"))


@query("SELECT DISTINCT upper('c' || o_custkey) AS pdb_code FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'P' AND contains(o_orderpriority, 'URGENT'))")
def completed_codes(spark, d):
    """FLT-27: finished codes, and errors that will not go away."""
    from ..operators.filters import done_codes

    o = table(spark, d, "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    store = o.select(F.concat(F.lit("c"), "o_custkey").alias("pdb_code"), F.lit("p").alias("provider"), F.lit("m").alias("method"), F.when(F.col("o_orderstatus") == "P", "error").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("error"))
    return done_codes(store, "p", "m", ["F"], "URGENT")


@query("""
SELECT p_partkey AS k, m AS method, CASE m WHEN 'size' THEN p_size ELSE length(p_name) END::BIGINT AS tm_count, CASE m WHEN 'size' THEN p_brand ELSE p_type END AS tm_regions,
  CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey ELSE 'PDB:' || p_partkey END AS uniprot_id
FROM part, (VALUES ('size'), ('name')) v(m)
""")
def store_rows(spark, d):
    """RSH-24: wide predictions as rows of the store."""
    from ..operators.reshape import long_predictions

    p = table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    wide = p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("size_count"), F.col("p_brand").alias("size_regions"), F.length("p_name").cast("long").alias("name_count"), F.col("p_type").alias("name_regions"))
    known = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.concat(F.lit("A"), F.col("p_partkey")).alias("uniprot_id"))
    return long_predictions(wide, "k", ["size", "name"], known)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS props_k FROM events")
def nested_first(spark, d):
    """RSH-17, RSH-18: fields of the first object of a literal list as columns."""
    from ..operators.reshape import first_struct

    rows = table(spark, d, "events", ["event_id", "props"]).withColumn("props", F.concat(F.lit("["), "props", F.lit("]")))
    return first_struct(rows, "props", "k:int").select("event_id", "props_k")


@query("SELECT n_nationkey AS k, i AS a, chr((65 + i)::INT) AS b FROM nation, (SELECT unnest(range(3)) AS i)")
def aligned_lists(spark, d):
    """RSH-13: lists of equal length exploded in step."""
    from ..operators.reshape import aligned_rows

    rows = table(spark, d, "nation", ["n_nationkey"]).select(F.col("n_nationkey").alias("k"), F.array(*[F.lit(i).cast("long") for i in range(3)]).alias("a"), F.array(*[F.lit(chr(65 + i)) for i in range(3)]).alias("b"))
    return aligned_rows(rows, ["a", "b"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def columns_by_name(spark, d):
    """FLT-14, FLT-15, FLT-21: columns dropped by the pattern of their name."""
    from ..operators.filters import drop_by_name

    return drop_by_name(table(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), [r"key$", r"^c_mkt"], keep=["c_custkey"])


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS rating, NULL::VARCHAR AS note FROM supplier")
def evolved_schema(spark, d):
    """UPS-6: columns that a newer schema has are added as nulls."""
    from pyspark.sql import types as T

    from ..operators.sets import evolved

    wanted = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("rating", T.DoubleType()), T.StructField("note", T.StringType())])
    return evolved(table(spark, d, "supplier", ["s_suppkey", "s_name"]), wanted)


@query("SELECT n_nationkey AS k, coalesce(n, 0)::BIGINT AS count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON c_nationkey = n_nationkey")
def dimension_zeros(spark, d):
    """JOIN-12: every member of the dimension, 0 where nothing was counted."""
    from ..operators.joins import counts_with_dimension

    counts = table(spark, d, "customer", ["c_nationkey", "c_acctbal"]).where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("count"))
    return counts_with_dimension(counts, table(spark, d, "nation", ["n_nationkey"]).select(F.col("n_nationkey").alias("k")), "k").select("k", "count")

"""Registered queries of the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import reshape as H
from ..operators import sets as U
from ..sources.readers import paged, projection, table
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()


def _orders(spark, d, *columns):
    return table(spark, d, "orders", columns).withColumn("year", F.year("o_orderdate")) if "o_orderdate" in columns else table(spark, d, "orders", columns)


# --- projections and filters ---------------------------------------------------
@query("""
SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment ILIKE '%build%' AND n_name ILIKE '%a%' ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 25
""")
def star_left_join_page(spark, d):
    """FLT-1, FLT-4, JOIN-1, SORT-1, SORT-2."""
    rows = J.star(table(spark, d, "orders"), (table(spark, d, "customer"), "o_custkey", "c_custkey"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey"))
    rows = rows.where(L.substring_filters({"c_mktsegment": "build", "n_name": "a", "c_name": "All", "o_orderpriority": None}))
    order = R.ordered(rows, "o_totalprice", "desc", "o_orderkey", rows.columns)
    return R.page(rows.select("o_orderkey", "o_totalprice", "c_name", "n_name"), order, 2, 25)


@query("""
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE (p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%') AND (p_name ILIKE '%brand#1%' OR p_brand ILIKE '%brand#1%' OR p_type ILIKE '%brand#1%')
""")
def multi_token_search(spark, d):
    """FLT-5."""
    cols = ["p_name", "p_brand", "p_type"]
    return table(spark, d, "part", ["p_partkey", *cols]).where(L.global_search("a brand#1", cols))


@query("SELECT c_custkey, c_name FROM customer WHERE upper(trim(c_mktsegment)) IN ('BUILDING', 'MACHINERY')")
def in_list(spark, d):
    """FLT-7."""
    return table(spark, d, "customer").where(L.in_codes(F.col("c_mktsegment"), ["building", " Machinery "])).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_exclusion(spark, d):
    """FLT-8, JOIN-18."""
    orders = table(spark, d, "orders", ["o_custkey", "o_totalprice"]).where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.without(table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), orders, "c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_selection(spark, d):
    """JOIN-21."""
    big = table(spark, d, "orders", ["o_custkey", "o_totalprice"]).where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return J.selected(table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), big, "c_custkey")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def numeric_guard(spark, d):
    """FLT-9."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(L.numeric_guard(k, ">=", 50)).select("event_id", k.alias("k"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE upper(o_orderpriority) = '1-URGENT' OR upper(o_orderpriority) = 'NOT SPECIFIED'")
def equality_folded(spark, d):
    """FLT-6, FLT-10."""
    c = F.col("o_orderpriority")
    return table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).where(L.equals_folded(c, "1-urgent") | L.equals_folded(c, "not_specified"))


@query("SELECT p_partkey, p_brand FROM part WHERE 'BRAND#11' IN (upper(trim(coalesce(p_name, ''))), upper(trim(coalesce(p_brand, ''))), upper(trim(coalesce(p_type, ''))))")
def any_column_match(spark, d):
    """FLT-11."""
    return table(spark, d, "part").where(L.any_column_is(["p_name", "p_brand", "p_type"], "Brand#11 ")).select("p_partkey", "p_brand")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type, p_size::VARCHAR)), 'widget')")
def search_blob(spark, d):
    """FLT-22..24."""
    return table(spark, d, "part").where(L.search_blob(["p_name", "p_brand", "p_type", "p_size"], "WIDGET")).select("p_partkey")


@query("""
WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), c AS (SELECT min(y) AS cut FROM (SELECT DISTINCT y FROM y ORDER BY y DESC LIMIT 3))
SELECT y::BIGINT AS year, CASE WHEN y <= cut THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM y, c GROUP BY ALL
""")
def year_cutoff(spark, d):
    """FLT-26, ML-53."""
    early, late = L.year_split(_orders(spark, d, "o_orderkey", "o_orderdate"), "year")
    both = early.withColumn("part", F.lit("train")).unionByName(late.withColumn("part", F.lit("test")))
    return both.groupBy(F.col("year").cast("long").alias("year"), "part").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice AS price, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 10")
def paged_scan(spark, d):
    """SRC-4..6."""
    rows, _ = paged(table(spark, d, "orders"), "o_orderstatus", "F", F.col("o_orderkey"), 2, 10)
    return rows.select(*projection(["o_orderkey", "o_totalprice as price", "o_orderstatus"]))


@query("SELECT * FROM (SELECT 'doc_id' AS \"column\", count(*) - count(doc_id) AS missing, (count(*) - count(doc_id)) * 100.0::DOUBLE / count(*) AS percent FROM documents UNION ALL SELECT 'text', count(*) - count(text), (count(*) - count(text)) * 100.0::DOUBLE / count(*) FROM documents UNION ALL SELECT 'lang', count(*) - count(lang), (count(*) - count(lang)) * 100.0::DOUBLE / count(*) FROM documents)")
def missing_values(spark, d):
    """AGG-40, AGG-42, FLT-16."""
    return Q.missing_values(table(spark, d, "documents", ["doc_id", "text", "lang"]))


# --- joins ---------------------------------------------------------------------
@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, sum(c_acctbal) AS balance FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, round(coalesce(balance, 0), 2) AS balance FROM c FULL JOIN s ON c.k = s.k
""")
def outer_chain_fill(spark, d):
    """JOIN-3..5, JOIN-12."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.lit(0.0).alias("balance"))
    return J.full_chain([c, s], ["k"]).select("k", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("customers", "suppliers")], F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("""
WITH s AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1)
SELECT c_custkey, o.o_orderstatus, o.o_totalprice FROM customer LEFT JOIN s ON o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = s.first_order
""")
def left_chain_first(spark, d):
    """JOIN-6, SORT-15."""
    orders = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"]).withColumnRenamed("o_custkey", "c_custkey")
    out = J.left_chain(table(spark, d, "customer", ["c_custkey"]), [(orders, "_order")], "c_custkey", "o_orderkey")
    return out.select("c_custkey", "o_orderstatus", "o_totalprice")


@query("""
SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_mktsegment END), ''), nullif(trim(n_name), '')) AS label
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def coalesce_fill(spark, d):
    """JOIN-7..11."""
    own = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    rows = J.star(table(spark, d, "customer"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey"))
    return J.fill_from(rows.select("c_custkey", own.alias("label"), F.col("n_name").alias("label_current")), {"label": "label_current"})


@query("""
SELECT coalesce(n_name, 'Unknown') AS nation, n FROM (SELECT CASE WHEN c_nationkey >= 20 THEN 99 ELSE c_nationkey END AS k, count(*) AS n FROM customer GROUP BY 1) LEFT JOIN nation ON k = n_nationkey
""")
def labelled_counts(spark, d):
    """JOIN-13, AGG-16, AGG-17."""
    k = F.when(F.col("c_nationkey") >= 20, 99).otherwise(F.col("c_nationkey"))
    counts = table(spark, d, "customer").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    return J.labelled_counts(counts, dim, "k", "nation", "Unknown", "n").select("nation", "n")


@query("""
SELECT n_nationkey, m.seg FROM nation CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('NONE SUCH')) m(seg)
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = m.seg AND c_acctbal > 8000)
""")
def missing_methods(spark, d):
    """JOIN-19, JOIN-20, AGG-39."""
    done = table(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"))
    return J.missing_pairs(table(spark, d, "nation"), ["BUILDING", "MACHINERY", "NONE SUCH"], done, "n_nationkey", "seg")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_type, count(*) AS row_count, sum(c.n)::BIGINT AS total FROM part JOIN c USING (p_type) GROUP BY 1
""")
def joinback_fanout(spark, d):
    """JOIN-16."""
    out = J.join_back(table(spark, d, "part", ["p_brand", "p_type"]), ["p_brand", "p_type"], "p_type")
    return out.groupBy("p_type").agg(F.count("*").alias("row_count"), F.sum("n").alias("total"))


@query("SELECT l_orderkey, l_linenumber, median(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) AS typical FROM lineitem")
def group_stat_back(spark, d):
    """JOIN-15."""
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"])
    return J.with_group_stat(rows, ["l_returnflag", "l_linestatus"], F.median("l_quantity"), "typical").select("l_orderkey", "l_linenumber", "typical")


@query("""
WITH w AS (SELECT DISTINCT upper(trim(c_mktsegment)) AS a FROM customer WHERE c_custkey % 5 = 0)
SELECT a AS alias, count(*) AS n FROM w JOIN part ON upper(trim(p_type)) = a OR upper(trim(p_brand)) = a GROUP BY 1
UNION ALL SELECT upper(trim(p_brand)), count(*) FROM part WHERE upper(trim(p_brand)) IN ('BRAND#11', 'BRAND#12') GROUP BY 1
""")
def alias_join(spark, d):
    """JOIN-25, JOIN-26, JOIN-31."""
    wanted = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_mktsegment").alias("code")).unionByName(spark.createDataFrame([(" Brand#11",), ("brand#12",)], "code string"))
    part = table(spark, d, "part", ["p_partkey", "p_type", "p_brand"])
    code = wanted.select(F.upper(F.trim("code")).alias("alias")).distinct()
    return J.aliases(part, ["p_type", "p_brand"]).join(code, "alias").groupBy("alias").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'recent' WHEN b.v IS NOT NULL THEN 'all' END AS origin FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey
""")
def lookup_cascade(spark, d):
    """JOIN-33, DOM-21."""
    orders = _orders(spark, d, "o_custkey", "o_orderpriority", "o_orderdate").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("v"), "year")
    return J.lookup(table(spark, d, "customer", ["c_custkey"]), "c_custkey", [("recent", orders.where("year >= 1998")), ("all", orders)], "v")


@query("""
SELECT n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1
""")
def four_way_join(spark, d):
    """JOIN-2, JOIN-14."""
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_suppkey"]).join(table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"))


# --- aggregates ----------------------------------------------------------------
@query("SELECT o_orderstatus, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def group_count(spark, d):
    """AGG-1, AGG-4."""
    return A.group_count(table(spark, d, "orders", ["o_orderstatus"]), "o_orderstatus")


@query("SELECT year(o_orderdate)::BIGINT AS year, o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def group_count_two_keys(spark, d):
    """AGG-2, AGG-3."""
    rows = _orders(spark, d, "o_orderdate", "o_orderpriority").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return A.group_count(rows.withColumn("year", F.col("year").cast("long")), "year", "o_orderpriority")


@query("SELECT word AS item, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def item_frequency(spark, d):
    """AGG-5."""
    return A.item_count(table(spark, d, "part", ["p_name"]), F.split("p_name", " "))


@query("""
WITH b AS (SELECT ceil(l_quantity / 4.0)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1), s AS (SELECT unnest(range(1, (SELECT max(bin) FROM b) + 1)) AS bin)
SELECT printf('%.2f-%.2f', (s.bin - 1) * 4.0, s.bin * 4.0) AS label, coalesce(n, 0) AS count FROM s LEFT JOIN b USING (bin)
""")
def range_bins(spark, d):
    """AGG-6, RSH-19..22."""
    return H.range_bins(table(spark, d, "lineitem", ["l_quantity"]), "l_quantity", 4.0)


@query("SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def excluded_group_count(spark, d):
    """AGG-7."""
    return A.without_values(table(spark, d, "customer", ["c_mktsegment"]), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("SELECT year(o_orderdate)::BIGINT AS year, round(avg(o_totalprice), 3) AS mean_o_totalprice FROM orders GROUP BY 1")
def dyn_agg_year(spark, d):
    """AGG-8..10, AGG-12."""
    out = A.named_aggregates(table(spark, d, "orders", ["o_orderdate", "o_totalprice"]), F.year("o_orderdate").cast("long"), "year", ["o_totalprice"], "mean")
    return out.withColumn("mean_o_totalprice", F.round("mean_o_totalprice", 3))


@query("SELECT month(o_orderdate)::BIGINT AS month, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1")
def dyn_agg_month(spark, d):
    """AGG-11, AGG-13."""
    return A.named_aggregates(table(spark, d, "orders", ["o_orderdate", "o_totalprice"]), F.month("o_orderdate").cast("long"), "month", ["o_totalprice"], "max")


@query("""
SELECT year(o_orderdate)::BIGINT AS year, o_orderpriority, round(median(o_totalprice), 3) AS median_o_totalprice, round(avg(o_totalprice), 3) AS mean_o_totalprice,
  round(stddev_samp(o_totalprice), 3) AS std_o_totalprice, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1, 2
""")
def multi_agg(spark, d):
    """AGG-14."""
    rows = _orders(spark, d, "o_orderdate", "o_orderpriority", "o_totalprice").withColumn("year", F.col("year").cast("long"))
    out = A.many_aggregates(rows, ["year", "o_orderpriority"], "o_totalprice", ["median", "mean", "std", "sum"])
    return out.withColumns({f"{n}_o_totalprice": F.round(f"{n}_o_totalprice", 2 if n == "sum" else 3) for n in ("median", "mean", "std", "sum")})


@query("SELECT c_mktsegment, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM customer GROUP BY 1")
def pct_distribution(spark, d):
    """AGG-15, WIN-2, WIN-3."""
    return A.percentages(table(spark, d, "customer", ["c_mktsegment"]), "c_mktsegment").withColumn("percentage", F.round("percentage", 6))


@query("""
SELECT year(o_orderdate)::BIGINT AS year, 'order' AS source, count(*) AS count FROM orders GROUP BY 1 UNION ALL SELECT year(l_shipdate)::BIGINT, 'shipment', count(*) FROM lineitem GROUP BY 1
""")
def union_tagged(spark, d):
    """AGG-18, AGG-49, SET-1."""
    year = lambda t, c: table(spark, d, t, [c]).select(F.year(c).cast("long").alias("year"))
    return A.tagged_counts({"order": year("orders", "o_orderdate"), "shipment": year("lineitem", "l_shipdate")}, "year")


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT upper(o_orderpriority)) AS priorities, count(*) AS n_rows, max(o_orderdate) AS latest FROM orders")
def distinct_counts(spark, d):
    """AGG-19..21."""
    rows = table(spark, d, "orders")
    return rows.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.upper("o_orderpriority")).alias("priorities"), F.count("*").alias("n_rows"), F.max("o_orderdate").alias("latest"))


@query("SELECT 'p_brand' AS \"column\", p_brand AS value FROM part GROUP BY ALL UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part GROUP BY ALL")
def distinct_values(spark, d):
    """AGG-23, AGG-24."""
    return A.distinct_values(table(spark, d, "part"), ["p_brand", "p_size"])


@query("SELECT DISTINCT trim(x) AS option FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part) WHERE trim(x) <> ''")
def split_options(spark, d):
    """AGG-25, RSH-14."""
    return A.distinct_options(F.col("p_name"), table(spark, d, "part"), " ")


@query("""
SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1
""")
def conditional_counts(spark, d):
    """AGG-26, AGG-27."""
    return A.conditional_counts(table(spark, d, "orders"), ["o_orderstatus"], large=F.col("o_totalprice") > 200000, urgent=F.col("o_orderpriority") == "1-URGENT")


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY year(o_orderdate)) AS delta_n FROM orders GROUP BY year(o_orderdate)")
def release_delta(spark, d):
    """AGG-28."""
    counts = _orders(spark, d, "o_orderdate").groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return A.deltas(counts, "year", ["n"])


@query("""
SELECT n_regionkey, count(*) AS count, string_agg(n_name, ', ' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1
""")
def string_agg_group(spark, d):
    """AGG-29."""
    return A.listed_by(table(spark, d, "nation"), "n_regionkey", ["n_name"], "n_nationkey")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    """AGG-30."""
    return Q.duplicate_keys(table(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT l_suppkey, count(DISTINCT l_shipmode_like) AS n FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_shipmode_like) > 1")
def ambiguous_map(spark, d):
    """AGG-31."""
    rows = table(spark, d, "lineitem", ["l_suppkey", "l_returnflag", "l_linestatus"])
    return Q.ambiguous(rows.withColumn("kind", F.concat("l_returnflag", "l_linestatus")), "l_suppkey", "kind")


@query("SELECT a.n AS n_now, b.n AS n_before, abs(a.n - b.n)::DOUBLE / b.n AS change, abs(a.n - b.n)::DOUBLE / b.n > 0.1 AS drifted FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'P') b")
def row_drift(spark, d):
    """AGG-32."""
    orders = table(spark, d, "orders")
    return Q.drift(orders, orders.where("o_orderstatus <> 'P'"), 0.1)


@query("SELECT 'steel' AS word, bool_or(contains(lower(p_name || ' ' || p_type), 'steel')) AS found FROM part UNION ALL SELECT 'unobtainium', bool_or(contains(lower(p_name || ' ' || p_type), 'unobtainium')) FROM part")
def required_words(spark, d):
    """AGG-33."""
    return Q.covered(table(spark, d, "part"), ["steel", "unobtainium"], F.col("p_name"), F.col("p_type"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'P' AND (o_totalprice <= 100000)) AS unresolved, count(*) FILTER (WHERE o_orderstatus = 'P') AS flagged FROM orders")
def unresolved_flags(spark, d):
    """AGG-34."""
    target = F.when(F.col("o_totalprice") > 100000, "known").otherwise(" ")
    return Q.unresolved(table(spark, d, "orders"), F.col("o_orderstatus") == "P", target)


@query("""
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) <= 1 AND count(DISTINCT l_linestatus) <= 1 THEN max(l_returnflag) END AS l_returnflag,
  CASE WHEN count(DISTINCT l_returnflag) <= 1 AND count(DISTINCT l_linestatus) <= 1 THEN max(l_linestatus) END AS l_linestatus,
  NOT (count(DISTINCT l_returnflag) <= 1 AND count(DISTINCT l_linestatus) <= 1) AS ambiguous, count(*) AS n FROM lineitem GROUP BY 1
""")
def consensus(spark, d):
    """AGG-35."""
    return A.consensus(table(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"]), ["l_orderkey"], "l_returnflag", "l_linestatus")


@query("""
SELECT conv_id, count(*) AS notes, count(*) FILTER (WHERE role = 'user') AS open, max(turn) AS latest, arg_max(text, turn) AS latest_comment FROM conversations GROUP BY 1
""")
def note_summary(spark, d):
    """AGG-38, WIN-12."""
    rows = table(spark, d, "conversations").withColumn("role", F.when(F.col("role") == "user", "open").otherwise(F.col("role")))
    return A.note_summary(rows, "conv_id", "turn", "turn", "text", "role").drop("recent")


@query("""
SELECT source, matches, compared, matches::DOUBLE / compared AS share FROM (
  SELECT 'l_linestatus' AS source, count(*) FILTER (WHERE l_linestatus = l_returnflag) AS matches, count(*) AS compared FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(*), count(*) FROM lineitem)
""")
def concordance(spark, d):
    """AGG-46."""
    rows = table(spark, d, "lineitem", ["l_returnflag", "l_linestatus"]).withColumn("truth", F.col("l_returnflag"))
    return A.concordance(rows, "truth", ["l_linestatus", "l_returnflag"])


@query("""
SELECT predictor, count(*) AS n, count(*) FILTER (WHERE e = 0) AS exact, round(avg((e = 0)::INT), 6) AS exact_share, round(avg(e), 6) AS mae, round(stddev_samp(e), 6) AS sd FROM (
  SELECT 'toxic' AS predictor, abs(toxic - quality)::DOUBLE AS e FROM labels UNION ALL SELECT 'doc_id', abs(doc_id % 3 - quality)::DOUBLE FROM labels) GROUP BY 1
""")
def predictor_metrics(spark, d):
    """AGG-45."""
    rows = table(spark, d, "labels").withColumn("doc_id", F.col("doc_id") % 3)
    out = A.count_errors(rows, "quality", ["toxic", "doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("exact_share", "mae", "sd")})


@query("""
SELECT 'l_quantity' AS "column", count(l_quantity)::DOUBLE AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min,
  quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount)::DOUBLE, round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75), max(l_discount) FROM lineitem
""")
def column_summary(spark, d):
    """AGG-41."""
    return A.summary(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("""
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0
""")
def corr_matrix(spark, d):
    """AGG-43, AGG-44."""
    return A.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 6))


# --- reshape and windows -------------------------------------------------------
_GRID = "FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders) LEFT JOIN (SELECT year(o_orderdate) AS y, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) c USING (y, s)"


def _order_years(spark, d):
    return table(spark, d, "orders", ["o_orderdate", "o_orderstatus"]).select(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus")


@query(f"SELECT y::BIGINT AS year, s AS o_orderstatus, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY s ORDER BY y)::BIGINT AS total {_GRID}")
def crosstab_cumsum(spark, d):
    """RSH-1, RSH-3, RSH-4, WIN-1."""
    return H.cumulative_crosstab(_order_years(spark, d), "year", "o_orderstatus").select("year", "o_orderstatus", "n", "total")


@query(f"SELECT y::BIGINT AS year, s AS o_orderstatus, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN sum(coalesce(n, 0)) OVER (PARTITION BY s ORDER BY y)::BIGINT END AS total {_GRID}")
def crosstab_cumsum_null(spark, d):
    """RSH-2."""
    return H.cumulative_crosstab(_order_years(spark, d), "year", "o_orderstatus", filled=False).select("year", "o_orderstatus", "n", "total")


@query(f"SELECT y::BIGINT AS year, s AS o_orderstatus, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY y), 0.0), 6) AS percent {_GRID}")
def crosstab_share(spark, d):
    """RSH-9, WIN-2, WIN-3."""
    cells = H.crosstab(_order_years(spark, d), "year", "o_orderstatus")
    return cells.select("year", "o_orderstatus", "n", F.round(R.share(F.col("n"), ["year"]), 6).alias("percent"))


@query("""
WITH c AS (SELECT year(o_orderdate)::BIGINT AS year, o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) % 3 <> 0 GROUP BY ALL), y AS (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS year)
SELECT y.year, s.o_orderstatus, coalesce(c.n, 0) AS n FROM y CROSS JOIN (SELECT DISTINCT o_orderstatus FROM c) s LEFT JOIN c ON c.year = y.year AND c.o_orderstatus = s.o_orderstatus
""")
def gap_fill_years(spark, d):
    """RSH-10, RSH-12."""
    counts = A.group_count(_order_years(spark, d).where("year % 3 <> 0"), "year", "o_orderstatus", to="n")
    return H.years_filled(counts, "year", "o_orderstatus", "n").select("year", "o_orderstatus", "n")


@query("SELECT year, dense_rank() OVER (ORDER BY year)::BIGINT - 1 AS at, n FROM (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1)")
def year_index(spark, d):
    """RSH-11."""
    counts = A.group_count(_order_years(spark, d), "year", to="n")
    return counts.withColumn("at", H.dense_index("year").cast("long"))


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(spark, d):
    """RSH-5..7, ML-54."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return H.melt(rows, ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT p_brand, max(p_retailprice) FILTER (WHERE p_size = 1) AS size_1, max(p_retailprice) FILTER (WHERE p_size = 2) AS size_2 FROM part GROUP BY 1")
def pivot_known(spark, d):
    """RSH-8, RSH-9."""
    return H.pivoted(table(spark, d, "part"), ["p_brand"], "p_size", [1, 2], F.col("p_retailprice"), "size_{}")


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY (o_orderpriority <> '1-URGENT')::INT, o_orderkey DESC) AS r FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F_count, max(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS F_regions, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O_count,
  max(o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS O_regions FROM b WHERE r = 1 GROUP BY 1
""")
def pivot_first(spark, d):
    """RSH-23, JOIN-30, WIN-9."""
    rows = table(spark, d, "orders")
    return H.wide_predictions(rows, "o_custkey", "o_orderstatus", ["F", "O"], "o_orderpriority", "1-URGENT", "o_orderkey", "o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, trim(x) AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part) WHERE trim(x) <> ''")
def explode_split(spark, d):
    """RSH-14."""
    return H.exploded(table(spark, d, "part", ["p_partkey", "p_name"]), "p_name", " ", "word").select("p_partkey", "word")


@query("SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS w1, nullif(split_part(p_name, ' ', 2), '') AS w2, nullif(split_part(p_name, ' ', 9), '') AS w9 FROM part")
def split_columns(spark, d):
    """RSH-15, RSH-16."""
    names = [f"w{i}" for i in range(1, 10)]
    return H.split_columns(table(spark, d, "part", ["p_partkey", "p_name"]), "p_name", " ", names).select("p_partkey", "w1", "w2", "w9")


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY FROM customer")
def one_hot(spark, d):
    """RSH-26."""
    return H.one_hot(table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::BIGINT - 1 AS level FROM customer")
def label_encode(spark, d):
    """RSH-27, SCL-53."""
    return H.label_encoded(table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), "c_mktsegment", "level").select("c_custkey", "level")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def zscore_group(spark, d):
    """WIN-4."""
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", F.round(R.zscore(F.col("l_quantity"), ["l_suppkey"]), 6).alias("z"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def row_number_dedup(spark, d):
    """WIN-6, WIN-12..14, SORT-11..14."""
    rows = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    return R.keep_first(rows, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def pref_row(spark, d):
    """WIN-9..11."""
    rows = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderpriority"])
    return R.preferred(rows, ["o_custkey"], F.col("o_orderpriority"), ["2-HIGH", "1-URGENT"], [F.col("o_orderkey").asc()])


# --- order and sets ------------------------------------------------------------
@query("""
WITH p AS (SELECT *, (CASE WHEN upper(p_brand) = 'RING' THEN 120 ELSE 0 END) + (CASE WHEN upper(p_name) = 'RING' THEN 48 WHEN contains(upper(p_name), 'RING') THEN 36 ELSE 0 END)
  + (CASE WHEN upper(p_type) = 'RING' THEN 36 WHEN contains(upper(p_type), 'RING') THEN 24 ELSE 0 END) AS score FROM part)
SELECT p_partkey, score::BIGINT AS score FROM p WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25
""")
def ranked_search(spark, d):
    """SORT-5, SORT-6."""
    score, why = R.relevance("ring ", [("brand_exact", "p_brand", 120)], [("name_contains", ["p_name"], 36), ("type_contains", ["p_type"], 24)])
    rows = table(spark, d, "part").withColumns({"score": score.cast("long"), "reasons": why}).where("score > 0")
    return R.top_slice(rows, [F.desc("score"), F.asc("p_partkey")], 0, 25).select("p_partkey", "score")


@query("SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5")
def top_slice(spark, d):
    """SORT-4, SORT-7, WIN-7."""
    return R.top_slice(A.group_count(table(spark, d, "part", ["p_brand"]), "p_brand"), [F.desc("count"), F.asc("p_brand")], 5, 15)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place FROM orders ORDER BY 2, 1 LIMIT 100")
def status_rank_sort(spark, d):
    """SORT-8..10."""
    rows = table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).withColumn("place", R.by_rank(F.col("o_orderstatus"), ["P", "O"]))
    return rows.orderBy("place", "o_orderkey").limit(100).select("o_orderkey", "place")


@query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def seeded_sample(spark, d):
    """SORT-19."""
    return R.seeded_sample(table(spark, d, "orders", ["o_orderkey"]), "o_orderkey", 500, 7)


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(spark, d):
    """SORT-16, SRC-18."""
    return table(spark, d, "orders", ["o_custkey", "o_orderpriority"]).distinct()


@query("SELECT n_nationkey AS k, list_distinct(list_value(n_regionkey, n_nationkey % 5, n_regionkey))[1] IS NOT NULL AS some FROM nation")
def ordered_distinct(spark, d):
    """SORT-17."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.get(F.array_distinct(F.array("n_regionkey", F.col("n_nationkey") % 5, "n_regionkey")), F.lit(0)).isNotNull().alias("some"))


@query("SELECT count(*) FILTER (WHERE s = 3) AS both, count(*) FILTER (WHERE s = 1) AS left_only, count(*) FILTER (WHERE s = 2) AS right_only FROM (SELECT k, sum(t) AS s FROM (SELECT DISTINCT c_custkey AS k, 1 AS t FROM customer UNION ALL SELECT DISTINCT o_custkey, 2 FROM orders) GROUP BY k)")
def key_overlap(spark, d):
    """SET-4."""
    return U.overlap(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    """SET-4."""
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_keys(spark, d):
    """SET-4, SET-5."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT o_orderkey AS k, o_totalprice AS a, NULL::VARCHAR AS b FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_acctbal < 0")
def union_missing_columns(spark, d):
    """SET-2, SRC-17."""
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    return U.union_all(a, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("b")))


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def prune_missing(spark, d):
    """SET-6."""
    return U.pruned(table(spark, d, "customer", ["c_custkey", "c_name"]), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_SNAPSHOTS = """
WITH t AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
  s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE lower(o_orderpriority) END AS p, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 2 END AS v FROM orders WHERE o_orderkey % 3 <> 1)
"""


def _snapshots(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    k = F.col("o_orderkey")
    t = o.where(k % 3 != 0).select(k.alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    s = o.where(k % 3 != 1).select(k.alias("k"), F.when(k % 2 == 0, " ").otherwise(F.lower("o_orderpriority")).alias("p"), F.when(k % 5 != 0, F.col("o_totalprice") * 2).alias("v"))
    return t, s


@query(_SNAPSHOTS + """
SELECT coalesce(t.k, s.k) AS k, CASE WHEN trim(s.p) <> '' OR t.p IS NULL OR trim(t.p) = '' THEN coalesce(s.p, t.p) ELSE t.p END AS p, coalesce(s.v, t.v) AS v FROM t FULL JOIN s ON t.k = s.k
""")
def upsert_keep_meaningful(spark, d):
    """UPS-1, UPS-2, UPS-9, JOIN-24."""
    t, s = _snapshots(spark, d)
    return U.upsert(t, s, ["k"])


@query(_SNAPSHOTS + "SELECT count(*) FILTER (WHERE t.k IS NULL) AS inserted, count(*) FILTER (WHERE t.k IS NOT NULL) AS updated FROM s LEFT JOIN t ON t.k = s.k")
def upsert_counts(spark, d):
    """UPS-2."""
    t, s = _snapshots(spark, d)
    return U.upsert_counts(t, s, ["k"])


@query(_SNAPSHOTS + "SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k)")
def insert_not_exists(spark, d):
    """JOIN-22."""
    t, s = _snapshots(spark, d)
    return J.new_rows(t, s, ["k"])


@query(_SNAPSHOTS + "SELECT s.k, coalesce(CASE WHEN trim(s.p) <> '' THEN s.p END, t.p) AS p, s.v FROM s LEFT JOIN t ON t.k = s.k")
def backfill_blank(spark, d):
    """UPS-3."""
    t, s = _snapshots(spark, d)
    return U.backfilled(s, t.select("k", "p").withColumnRenamed("p", "p0").select("k", F.col("p0").alias("p")), "k", "p")


@query("SELECT o_custkey AS key, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def conflict_values(spark, d):
    """UPS-4."""
    return U.agreed_values(table(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderpriority"))[1]


@query(_SNAPSHOTS + "SELECT k, p, v FROM t WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT k, p, v FROM s")
def file_upsert(spark, d):
    """UPS-8, SORT-14."""
    t, s = _snapshots(spark, d)
    text = lambda f: f.withColumn("k", F.col("k").cast("string"))
    return U.file_upsert(text(t), text(s), "k").withColumn("k", F.col("k").cast("long"))


@query(_SNAPSHOTS + "SELECT t.* FROM t LEFT JOIN s ON t.k = s.k WHERE s.k IS NULL OR t.p IS NOT DISTINCT FROM s.p")
def delete_using(spark, d):
    """JOIN-23."""
    t, s = _snapshots(spark, d)
    return U.delete_matching(t, s.select("k", "p"), "k", ["p"])

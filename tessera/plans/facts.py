"""Registered queries of record facts, table cleaning and joins by any code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regions as G
from ..functions import rules as R
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..sources.landed import entries, flattened
from ..sources.readers import table
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE ' ' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size FROM part)
SELECT p_partkey, array_to_string(list_filter(['name', CASE WHEN p_partkey % 3 <> 0 THEN 'kind' END, CASE WHEN size IS NOT NULL THEN 'size' END], lambda x: x IS NOT NULL), ',') AS present,
  CASE WHEN p_partkey % 3 <> 0 THEN trim(kind) ELSE p_brand END AS chosen, CASE WHEN p_partkey % 3 <> 0 THEN 'kind' ELSE 'brand' END AS chosen_from,
  CASE WHEN size IS NOT NULL THEN 'survey' END AS size_from, CASE WHEN size IS NOT NULL THEN size = p_partkey % 50 + 1 END AS agreed,
  CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'first' ELSE p_brand END AS grouped, 'https://records/' || p_partkey AS link,
  CASE WHEN p_partkey % 2 = 0 THEN 'no kind is stated; seen_twice' ELSE 'seen_twice' END AS why
FROM p
""")
def record_facts(spark, d):
    """DOM-9, DOM-11..13, DOM-16, DOM-21, DOM-25: what is known of a record, and where from."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").withColumns({"kind": F.when(key % 3 != 0, F.col("p_type")).otherwise(" "), "size": F.when(key % 4 == 0, F.col("p_size"))})
    chosen = R.in_order(("kind", F.col("kind")), ("brand", F.col("p_brand")))
    present = R.sources_present(name=F.col("p_name"), kind=F.col("kind"), size=F.col("size").cast("string"))
    codes = F.when(key % 2 == 0, F.array(F.lit("no_kind"), F.lit("seen_twice"))).otherwise(F.array(F.lit("seen_twice")))
    return p.select(
        "p_partkey", F.array_join(present, ",").alias("present"), F.trim(chosen["value"]).alias("chosen"), chosen["source"].alias("chosen_from"),
        F.try_element_at(R.provenance(size=(F.col("size"), "survey")), F.lit("size")).alias("size_from"), R.consensus(F.col("size").cast("long"), F.when(F.col("size").isNotNull(), key % 50 + 1)).alias("agreed"),
        R.regroup(F.col("p_brand"), "first", ["Brand#11", "Brand#12"]).alias("grouped"), R.links(key.cast("string"), record="https://records/{code}")["record"].alias("link"),
        R.reasons(codes, {"no_kind": "no kind is stated"}).alias("why"),
    )


@query("SELECT p_partkey, p_size, p_name, 'p_partkey,p_size' AS numbers FROM part")
def cleaned_columns(spark, d):
    """FLT-16, FLT-17, FLT-18, ML-3: sparse and list-like columns go, numbers are told from the rest."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_name", F.when(key % 5 == 0, F.col("p_size")).alias("sparse"), F.concat(F.lit("["), key.cast("string"), F.lit("]")).alias("listed"))
    kept = L.drop_listed(L.drop_sparse(rows, 20.0))
    return kept.withColumn("numbers", F.lit(",".join(sorted(L.split_by_type(kept)[0]))))


@query("""
WITH p AS (SELECT p_partkey, 'P' || p_partkey AS a, CASE WHEN p_partkey % 2 = 0 THEN ' q' || (p_partkey + 1) ELSE '' END AS b FROM part),
  wanted AS (SELECT DISTINCT 'P' || l_partkey AS w FROM lineitem WHERE l_linenumber = 1 UNION SELECT DISTINCT 'Q' || l_partkey FROM lineitem WHERE l_linenumber = 2),
  alias AS (SELECT p_partkey, a, b, upper(trim(a)) AS alias FROM p UNION SELECT p_partkey, a, b, upper(trim(b)) FROM p WHERE b <> '')
SELECT p_partkey, alias.alias FROM alias JOIN wanted ON alias = w
""")
def found_by_alias(spark, d):
    """JOIN-26, JOIN-31: notes and accessions name a record by any of its codes."""
    key = F.col("p_partkey")
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), key.cast("string")).alias("a"), F.when(key % 2 == 0, F.concat(F.lit(" q"), (key + 1).cast("string"))).otherwise("").alias("b"))
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.concat(F.when(F.col("l_linenumber") == 1, "p").otherwise("q"), F.col("l_partkey").cast("string")).alias("w"))
    return J.by_alias(parts, ["a", "b"], lines, "w").select("p_partkey", "alias")


@query("SELECT o_orderkey, o_custkey, min_by(l_quantity, l_linenumber) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def first_features(spark, d):
    """JOIN-29: a record with the features of its first row; of equal line numbers the
    one that stands first in the files."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    features = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("quantity"), *place)
    features = features.where("l_linenumber is not null and quantity is not null")
    records = table(spark, d, "orders").select("o_orderkey", "o_custkey").distinct()
    return J.with_features(records, features, "o_orderkey", "l_linenumber", "file", "place").select("o_orderkey", "o_custkey", "quantity")


@query("""
WITH r AS (SELECT n_nationkey AS k, i, CASE i WHEN 1 THEN 'Inside' WHEN 2 THEN 'TMhelix' WHEN 3 THEN 'loop' WHEN 4 THEN 'TMhelix' ELSE 'Outside' END AS label FROM nation, range(1, 6) t(i))
SELECT k, label, i * 10 AS start, CASE WHEN i > 4 THEN 4 WHEN i > 2 THEN 2 END AS before, CASE WHEN i < 2 THEN 2 WHEN i < 4 THEN 4 END AS after FROM r
""")
def loop_context(spark, d):
    """RNG-5: the membrane regions on both sides of a region."""
    names = ("Inside", "TMhelix", "loop", "TMhelix", "Outside")
    regions = F.array(*[F.struct(F.lit(10 * i).cast("long").alias("start"), F.lit(10 * i + 9).cast("long").alias("end"), F.lit(n).alias("label")) for i, n in enumerate(names, 1)])
    out = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.inline(G.around(regions)))
    return out.select("k", "label", "start", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


@query("""
WITH r AS (SELECT c_custkey::VARCHAR AS id, c_name AS "entry_name", c_acctbal AS entry_account_balance, c_mktsegment AS entry_account_segment FROM customer WHERE c_custkey % 7 <> 0),
  w AS (SELECT DISTINCT o_custkey::VARCHAR AS code, o_custkey AS k FROM orders UNION SELECT c_custkey::VARCHAR, c_custkey FROM customer),
  n AS (SELECT code, CASE WHEN k % 7 = 0 AND k % 3 = 0 THEN (k + 1)::VARCHAR END AS newer FROM w)
SELECT code, CASE WHEN newer IS NULL THEN 'Not Replaced' ELSE 'Replaced' END AS is_replaced, CASE WHEN newer IS NULL THEN '' ELSE code || '->' || newer END AS code_changed, coalesce(newer, '') AS replacement_code, coalesce(newer, code) AS canonical_code, r.id IS NULL AS missing,
  r.id AS record_id, r.entry_name AS record_entry_name, r.entry_account_balance AS record_entry_account_balance, r.entry_account_segment AS record_entry_account_segment
FROM n LEFT JOIN r ON r.id = coalesce(newer, code)
""")
def landed_entries(spark, d):
    """SRC-12, SRC-13: nested JSON records by code or by the code that replaced it, flat."""
    customer = table(spark, d, "customer")
    nested = F.struct(F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("account")).alias("entry"))
    lines = customer.where("c_custkey % 7 <> 0").select(F.to_json(nested).alias("line"))
    schema = "id string, entry struct<name:string,account:struct<balance:double,segment:string>>"
    records = lines.select(F.from_json("line", schema).alias("r")).select("r.*")
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).unionByName(customer.select(F.col("c_custkey").alias("k")))
    replaced = wanted.where("k % 21 = 0").select(F.col("k").alias("old"), (F.col("k") + 1).alias("new"))
    return flattened(entries(wanted, "k", records, "id", replaced))

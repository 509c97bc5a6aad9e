"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elkan, exact_dedup, fill_middle, gru_lm, html_main, imatch, line_dedup, mixing, pii, piece_bpe, simhash, toxicity, url_filter
from .url_parts import host_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- op1: I-Match --------------------------------------------------------------
def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.fingerprint_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


# --- op2: personal data --------------------------------------------------------
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return docs.select("doc_id", *counts, F.sha2(written(of_kind(*pii.BASE_KINDS)), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


# --- op3: mixing ---------------------------------------------------------------
#: Fixed values of the production mixture: domain by the source's number, and
#: the weights of the tree's nodes.
DOMAINS = (("web", 0, 7), ("books", 8, 13), ("code", 14, 19))
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 3, "src8": 2}
MIX = {"budget_share": 0.6, "max_epochs": 2, "seed": 17}


def _choose(c: Column, of: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in of.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def mix_tree() -> tuple[Column, tuple[Column, Column, Column]]:
    """Domain column and node weights of the production mixture."""
    lang, source = F.col("lang"), F.col("source")
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,6})$", 1).try_cast("int")
    domain = F.lit("other")
    for name, low, high in DOMAINS:
        domain = F.when(number.between(low, high), name).otherwise(domain)
    return domain, (_choose(domain, DOMAIN_WEIGHTS, 1), _choose(lang, LANG_WEIGHTS, 1), _choose(source, SOURCE_WEIGHTS, 1))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domain, weights = mix_tree()
    return mixing.mix_report(docs, domain, weights, **MIX)


def _sql_choose(c: str, of: dict[str, int], other: int) -> str:
    return f"CASE {' '.join(f"WHEN {c} = '{k}' THEN {v}" for k, v in of.items())} ELSE {other} END"


def _sql_share(src: str, parents: str, budget: str, weight: str, order: str, to: str) -> str:
    by = f"PARTITION BY {parents or '0'}"
    run = f"({by} ORDER BY r ASC NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
  {to}_1 AS (SELECT *, CASE WHEN {weight} > 0 THEN cap / {weight}::DOUBLE END AS r FROM {src}),
  {to}_2 AS (SELECT *, CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE {weight}::DOUBLE END AS w FROM {to}_1),
  {to}_3 AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN cap END) OVER {run}, 0)::DOUBLE AS bef,
     sum(w) OVER ({by}) - coalesce(sum(w) OVER {run}, 0) AS lft FROM {to}_2),
  {to}_4 AS (SELECT *, CASE WHEN w > 0 AND lft > 0 THEN ({budget} - bef) / lft END AS lvl FROM {to}_3),
  {to}_5 AS (SELECT *, max(CASE WHEN lvl <= r THEN lvl END) OVER ({by}) AS cut FROM {to}_4),
  {to}_t AS (SELECT * EXCLUDE (r, w, bef, lft, lvl, cut), CASE WHEN w = 0 THEN 0.0 WHEN cut IS NULL THEN cap::DOUBLE
     ELSE least(cap::DOUBLE, greatest(cut, 0.0) * w) END AS {to} FROM {to}_5)"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, {"CASE " + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{name}'" for name, a, b in DOMAINS) + " ELSE 'other' END"} AS dom,
    coalesce(lang, '') AS lng, coalesce(source, '') AS src, tokens
  FROM (SELECT doc_id, lang, source, try_cast(regexp_extract(coalesce(source, ''), '^src(\\d{{1,6}})$', 1) AS INT) AS n,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents)),
  leaf AS (SELECT *, CASE WHEN w_src > 0 THEN tokens * {MIX["max_epochs"]} ELSE 0 END AS cap FROM (SELECT *, {_sql_choose("dom", DOMAIN_WEIGHTS, 1)} AS w_dom, {_sql_choose("lng", LANG_WEIGHTS, 1)} AS w_lng,
    {_sql_choose("src", SOURCE_WEIGHTS, 1)} AS w_src FROM (SELECT dom, lng, src, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL))),
  lng_0 AS (SELECT dom, lng, (CASE WHEN max(w_lng) > 0 THEN sum(cap) ELSE 0 END)::BIGINT AS cap, max(w_dom) AS w_dom, max(w_lng) AS w_lng, sum(tokens)::BIGINT AS tokens FROM leaf GROUP BY ALL),
  dom_0 AS (SELECT dom, sum(cap)::BIGINT AS cap, max(w_dom) AS w_dom, floor((SELECT sum(tokens)::DOUBLE FROM d) * {MIX["budget_share"]}::DOUBLE) AS b_all FROM lng_0 GROUP BY dom),
  {_sql_share("dom_0", "", "b_all", "w_dom", "dom", "b_dom")},
  lng_1 AS (SELECT l.*, b_dom FROM lng_0 l JOIN b_dom_t USING (dom)),
  {_sql_share("lng_1", "dom", "b_dom", "w_lng", "lng", "b_lng")},
  leaf_1 AS (SELECT l.*, b_lng FROM leaf l JOIN b_lng_t t USING (dom, lng)),
  {_sql_share("leaf_1", "dom, lng", "b_lng", "w_src", "src", "b_src")},
  plan AS (SELECT dom, lng, src, g - whole * tokens AS rest, whole FROM (SELECT *, floor(b_src)::BIGINT AS g,
    CASE WHEN tokens > 0 THEN floor(floor(b_src) / tokens)::BIGINT ELSE 0 END AS whole FROM b_src_t)),
  keyed AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{MIX["seed"]}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS key FROM d JOIN plan USING (dom, lng, src)),
  run AS (SELECT *, sum(tokens) OVER (PARTITION BY dom, lng, src ORDER BY key) AS upto FROM keyed)
SELECT doc_id, dom AS domain, lng AS lang, src AS source, tokens AS n_tokens,
  (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run
"""


# --- op9: line dedup -----------------------------------------------------------
MIN_LINE_DOCS = 10


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"), MIN_LINE_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
  hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_LINE_DOCS}),
  m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


# --- op10: exact dedup ---------------------------------------------------------
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


# --- op4: SentencePiece --------------------------------------------------------
def piece_model_file() -> str:
    """Where the public tokenizer's model file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_model_file())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# --- op5: main text of pages ---------------------------------------------------
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_main.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_named")


# --- op6: url filter -----------------------------------------------------------
#: The contract's rules, and host words that label a url as bad.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BAD_HOST_WORDS = ("adult", "ads", "bets", "casino", "farm", "pills", "porn", "spam", "track", "warez", "xxx")


def url_labels(pages: DataFrame) -> DataFrame:
    """Labels of the urls: 1 for hosts with a bad word as a whole part, 0 for
    other named hosts."""
    host = host_of(pages["url"])
    bad = host.rlike(rf"(^|[.-])({'|'.join(BAD_HOST_WORDS)})([.-]|$)").cast("int")
    return pages.where(host != "").select("url", bad.alias("label"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_labels(pages))


# --- op7: toxicity -------------------------------------------------------------
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- op8: SimHash --------------------------------------------------------------
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=3, radius=3, segments=2)


# --- op11: recurrent language model ---------------------------------------------
def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


# --- op12: fill in the middle ----------------------------------------------------
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform_documents(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks FROM d),
  n AS (SELECT *, len(toks)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
  f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
  p AS (SELECT *, array_to_string(toks[1:a], '') AS pre, array_to_string(toks[a + 1:b], '') AS mid, array_to_string(toks[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


# --- op13: centroid clustering ---------------------------------------------------
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = elkan.cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed=3)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql_rounds(rounds: int) -> str:
    """Plain k-means: every distance measured, in long form."""
    near = "SELECT i, c AS cluster, d AS distance FROM (SELECT k.i, m.c, sum((k.x - m.x) * (k.x - m.x))::BIGINT AS d FROM kept k JOIN {m} m USING (p) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1"
    out = []
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED ({near.format(m=f'm{r}')})")
        mean = "SELECT cluster AS c, p, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT a.cluster, k.p, sum(k.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN kept k USING (i) GROUP BY ALL)".format(r=r)
        out.append(f"m{r + 1} AS MATERIALIZED (WITH t AS ({mean}) SELECT c, p, coalesce(t.x, m.x) AS x FROM m{r} m LEFT JOIN t USING (c, p))")
    return ",\n  ".join([*out, f"a{rounds} AS MATERIALIZED ({near.format(m=f'm{rounds}')})"])


OP13_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64),
  ok AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  kept AS MATERIALIZED (SELECT i, generate_subscripts(v, 1) AS p, floor(1024 * unnest(v))::BIGINT AS x FROM ok),
  s AS (SELECT i, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS c FROM ok QUALIFY c < 8),
  m0 AS MATERIALIZED (SELECT s.c, k.p, k.x FROM s JOIN kept k USING (i)),
  {_sql_rounds(10)},
  h AS (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM m10 GROUP BY c)
SELECT ok.vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 a JOIN ok USING (i) JOIN h USING (cluster)
"""


QUERIES = {
    "op1_imatch": op1_imatch,
    "op2_personal_data": op2_personal_data,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_main_text": op5_main_text,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_recurrent_lm": op11_recurrent_lm,
    "op12_fill_middle": op12_fill_middle,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL = {"op3_mixing": OP3_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op12_fill_middle": OP12_SQL, "op13_centroids": OP13_SQL}

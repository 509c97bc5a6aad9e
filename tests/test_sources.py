"""Sources and sinks over small files."""

import pytest

from tessera.sources import readers as X
from tessera.sources import writers as W
from tessera.streaming import events as E


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_and_latest(spark, tmp_path):
    for name in ("a.csv", "a_2024-01-02.csv", "a_2024-03-01.csv"):
        write(tmp_path / name, "k,v\n1,x\n")
    assert X.latest_dated(spark, str(tmp_path), "a").endswith("a_2024-03-01.csv")
    assert X.csv(spark, f"{tmp_path}/a.csv", "k int, v string").count() == 1
    assert X.csv(spark, f"{tmp_path}/none.csv", "k int, v string").count() == 0


def test_curated_tree(spark, tmp_path):
    tree = """<root><group><name>G</name><subgroups><subgroup><name>S</name><proteins>
    <protein><pdbCode>1ABC</pdbCode><name>n</name><species>s</species><resolution>2.0</resolution>
      <memberProteins><memberProtein><pdbCode>2DEF</pdbCode><name>m</name><species>s</species><resolution>3</resolution></memberProtein></memberProteins></protein>
    <protein><pdbCode>3GHI</pdbCode><name>o</name></protein></proteins></subgroup></subgroups></group></root>"""
    got = X.curated_xml(spark, write(tmp_path / "t.xml", tree)).orderBy("pdbCode").collect()
    assert [(r.group, r.subgroup, r.pdbCode, r.is_master) for r in got] == [("G", "S", "1ABC", True), ("G", "S", "2DEF", False), ("G", "S", "3GHI", True)]


def test_sequence_files(spark, tmp_path):
    fasta = X.fasta(spark, write(tmp_path / "f.fa", ">a\nMK\nV\n>b\nAA\n")).orderBy("id").collect()
    assert [(r.id, r.sequence) for r in fasta] == [("a", "MKV"), ("b", "AA")]
    three = X.three_line(spark, write(tmp_path / "t.txt", ">a\nMAAAAAAA\niiHHHooo\n")).collect()
    assert [(r.id, r.topology) for r in three] == [("a", "iiHHHooo")]
    with pytest.raises(Exception):
        X.three_line(spark, write(tmp_path / "bad.txt", ">a\nMAA\n")).collect()


def test_gff(spark, tmp_path):
    text = "# a Number of predicted TMRs: 3\na\tTMhelix\t1\t20\nb\tTMhelix\t5\t9\nb\tinside\t10\t12\nc\tsrc\tTMhelix\t1\t4\t.\t.\t.\n"
    at = write(tmp_path / "g.gff", text)
    assert {(r.id, r.type, r.start, r.end) for r in X.gff(spark, at).collect()} == {("a", "TMhelix", 1, 20), ("b", "TMhelix", 5, 9), ("b", "inside", 10, 12), ("c", "TMhelix", 1, 4)}
    assert {r.id: r.tm_count for r in X.gff_counts(spark, at).collect()} == {"a": 3, "b": 1, "c": 1}


def test_loose_csv(spark, tmp_path):
    at = write(tmp_path / "l.csv", 'id,regions,status\n1,[{"a": 1, "b": 2}],success\n2,[],error\n')
    got = X.loose_csv(spark, at, ["id", "regions", "status"], "regions", 1).orderBy("id").collect()
    assert [(r.id, r.regions, r.status) for r in got] == [("1", '[{"a": 1, "b": 2}]', "success"), ("2", "[]", "error")]


def test_fallback_and_terms(spark):
    a, b = spark.createDataFrame([("k1", 1)], "k string, v int"), spark.createDataFrame([("k1", 9), ("k2", 2)], "k string, v int")
    assert sorted(tuple(r) for r in X.first_of((a, "k"), (b, "k")).collect()) == [("k1", 1), ("k2", 2)]
    df = spark.createDataFrame([([("F:binding",), ("C:membrane",), ("F:transport",)],)], "refs array<struct<term:string>>")
    r = X.annotation_terms(df, "refs").first()
    assert (r.molecular_function, r.cellular_component, r.biological_process) == ("binding; transport", "membrane", "")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    W.download(df, f"{tmp_path}/out", "tsv")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/out").count() == 2
    with pytest.raises(ValueError):
        W.download(df, f"{tmp_path}/x", "xlsx")
    at = W.release(df, f"{tmp_path}/rel", "v1")
    assert spark.read.parquet(at).count() == 2 and W.releases(spark, f"{tmp_path}/rel").count() == 1
    calls = []
    for _ in range(2):
        assert W.reuse(spark, f"{tmp_path}/re", "7", lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1
    assert W.prefixed({"m": df, "o": df}, "k").columns == ["k", "m_v", "o_v"]


def test_stream_counts_as_batch(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = E.table_stream(spark, f"{tmp_path}/in", rows.schema)
    got = []
    q = E.upsert_stream(stream, f"{tmp_path}/check", lambda df, n: got.append(df.count()))
    q.awaitTermination()
    assert sum(got) == rows.count() and len(got) == 3
    counted = E.over_limit(E.table_stream(spark, f"{tmp_path}/in", rows.schema, 9), "ts", ["user_id"], 3600, 0, "1 day")
    q = counted.writeStream.format("memory").queryName("limits").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("limits").count() == E.over_limit(rows, "ts", ["user_id"], 3600, 0).count()
    with pytest.raises(ValueError):
        E.run_stages({}, rows, ["none"])


def test_batches_are_reused(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert W.batched(df, "id", 3, f"{tmp_path}/b").count() == 100
    again = W.batched(df.withColumn("v", F.raise_error(F.lit("read again")).cast("long")), "id", 3, f"{tmp_path}/b")
    assert again.agg(F.sum("v")).first()[0] == 9900
    W.progress(spark, f"{tmp_path}/log", "t", "started")
    W.progress(spark, f"{tmp_path}/log", "t", "succeeded", "3 batches")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    with pytest.raises(ValueError):
        W.progress(spark, f"{tmp_path}/log", "t", "oops")

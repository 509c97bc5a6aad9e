"""Landed JSON: flat columns, replaced codes, a stopped landing that goes on."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import landed

text = T.StringType()
SCHEMA = T.StructType().add("id", text).add("cell", T.StructType().add("a", "double").add("b.c", T.StructType().add("d", text))).add("tags", T.ArrayType(text)).add("cell_a", text)


def test_nested_records_become_columns(spark):
    lines = ['{"id": "1abc", "cell": {"a": 1.5, "b.c": {"d": "x"}}, "tags": ["p", "q"], "cell_a": "own"}', '{"id": "2abc", "cell": null}']
    rows = spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_json("v", SCHEMA).alias("r")).select("r.*")
    flat = landed.flattened(rows)
    assert flat.columns == ["id", "cell_a", "cell_b.c_d", "tags", "cell_a_2"]
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [("1abc", 1.5, "x", '["p","q"]', "own"), ("2abc", None, None, None, None)]


def test_entries_follow_replacements(spark):
    wanted = spark.createDataFrame([(" 1abc",), ("1ABC",), ("2abc",), ("3abc",), ("4abc",), ("",), (None,)], "pdb string")
    records = spark.createDataFrame([("1abc", 1, "x"), ("1ABC", 0, "y"), ("9new", 9, "z"), (None, 5, "n")], "code string, record int, missing string")
    replaced = spark.createDataFrame([("1abc", "9new"), ("2abc", "9new"), ("2abc", "8new"), ("3abc", "7new"), ("4abc", "4ABC"), (None, "1abc")], "old string, new string")
    got = {r["code"]: r for r in landed.entries(wanted, "pdb", records, "code", replaced).collect()}
    assert set(got) == {"1ABC", "2ABC", "3ABC", "4ABC"}
    assert (got["1ABC"]["is_replaced"], got["1ABC"]["canonical_code"], got["1ABC"]["record"]["record"]) == ("Not Replaced", "1ABC", 1)
    assert (got["2ABC"]["is_replaced"], got["2ABC"]["code_changed"], got["2ABC"]["record"]["record"]) == ("Replaced", "2ABC->9NEW", 9)
    assert (got["3ABC"]["missing"], got["3ABC"]["replacement_code"]) == (True, "7NEW")
    assert (got["4ABC"]["missing"], got["4ABC"]["replacement_code"], got["4ABC"]["code_changed"]) == (True, "", "")
    assert landed.entries(wanted.limit(0), "pdb", records, "code", replaced).count() == 0
    assert landed.entries(wanted, "pdb", records.limit(0), "code", replaced.limit(0)).where("missing").count() == 4


def test_a_stopped_landing_goes_on(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(6):
        (folder / f"part{f}.json").write_text("".join(json.dumps({"id": f"{f}-{i}", "cell": {"a": i}}) + "\n" for i in range(5)) + ("not a record\n" if f == 2 else ""))
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/check"

    def run(name, poison):
        stream = landed.flattened(landed.record_stream(spark, str(folder), SCHEMA, 1)).withColumn("run", F.lit(name))
        if poison:
            stream = stream.withColumn("run", F.when(F.col("id") == poison, F.raise_error(F.lit("stopped"))).otherwise(F.col("run")))
        landed.land(stream, out, checkpoint).awaitTermination()
        return spark.read.parquet(out)

    # Files of one age come in any order, so the poisoned file is some batch of the six.
    with pytest.raises(PySparkException):
        run("first", "3-2")
    before = spark.read.parquet(out).count() if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")) else 0
    got = run("second", None)
    ids = [r["id"] for r in got.where("id is not null").collect()]
    assert sorted(ids) == sorted(f"{f}-{i}" for f in range(6) for i in range(5))
    assert got.where("run = 'first'").count() == before
    assert [r["_corrupt_record"] for r in got.where("_corrupt_record is not null").collect()] == ["not a record"]
    (folder / "part9.json").write_text('{"id": "9-0"}\n')
    later = run("third", None)
    assert later.count() == got.count() + 1 == 32 and later.where("run = 'third'").count() == 1

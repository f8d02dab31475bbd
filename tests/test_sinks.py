"""Tables, folders and views that are written, and those that must not be."""

import datetime

import pytest

from weft import Engine, Project, ProjectError
from weft.sources.sinks import FORMATS, statements, write


def simple(spark, target=None, table=None, unmanaged=False, **out):
    source = {"source_name": "s", "raw_attributes": ["a int"], **({"target_table": target} if target else {}), **({"refresh_type": "unmanaged"} if unmanaged else {})}
    source |= {"source_table": table} if table else {"frame": spark.createDataFrame([(1,), (2,)], "a int")}
    outs = [{"output_name": "o", "columns": ["a int"], "channels": [{"source_name": "s", "mappings": ["a a"]}], **out}] if out else []
    return Project.of([source], outputs=outs)


@pytest.fixture
def tables(spark, tmp_path):
    names = []
    yield names
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


ROWS = [(1, "a,b\n\"c", 1.5, datetime.datetime(2020, 1, 2, 3, 4, 5, 678901), [1, None], True), (2, None, None, None, None, None), (3, "", -0.0, datetime.datetime(1969, 1, 1), [], False)]
SCHEMA = "i int, s string, d double, t timestamp, l array<int>, b boolean"


@pytest.mark.parametrize("kind", [k for k in FORMATS if k not in ("avro", "text")])
def test_files_come_back_as_written(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    back = write(spark, df, "x.y", str(tmp_path), kind)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert write(spark, df.limit(1), "x.y", str(tmp_path), kind).count() == 1  # a refresh of its own folder


def test_text_and_avro(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "s string")
    assert sorted(r.s for r in write(spark, df, "t", str(tmp_path), "text").collect()) == ["x", "y"]
    with pytest.raises(ProjectError, match="one string column"):
        write(spark, spark.createDataFrame(ROWS, SCHEMA), "u", str(tmp_path), "text")
    with pytest.raises(ProjectError, match="unknown format"):
        write(spark, df, "u", str(tmp_path), "tsv")
    with pytest.raises(ProjectError, match="avro"):
        write(spark, df, "u", str(tmp_path), "avro")


def test_folders_of_others_stay(spark, tmp_path):
    theirs = str(tmp_path / "s")
    spark.createDataFrame([(7,)], "a int").write.parquet(theirs)
    with pytest.raises(ProjectError, match="not built by a project"):
        Engine(spark, simple(spark)).build(str(tmp_path))
    assert spark.read.parquet(theirs).first().a == 7


def test_tables_of_others_stay(spark, tables):
    tables += ["customer_of_others", "weft_s"]
    spark.createDataFrame([(7,)], "secret int").write.saveAsTable("customer_of_others")
    with pytest.raises(ProjectError, match="not built by a project"):
        Engine(spark, simple(spark, "weft_s", table_name="customer_of_others")).build()
    assert spark.table("customer_of_others").first().secret == 7
    engine = Engine(spark, simple(spark, "weft_s"))
    assert engine.build() == ["weft_s"] and engine.build() == ["weft_s"]  # its own table it refreshes
    assert spark.table("weft_s").count() == 2


def test_a_source_is_never_a_target(spark):
    with pytest.raises(ProjectError, match="read by the project"):
        simple(spark, "base", "base")
    with pytest.raises(ProjectError, match="read by the project"):
        simple(spark, None, "base", table_name="BASE")
    assert simple(spark, None, "S").sources["s"].target == "enriched_s"


def test_output_with_a_schema(spark, tables):
    spark.sql("CREATE SCHEMA IF NOT EXISTS weft_mart")
    tables += ["weft_mart.totals", "weft_s2"]
    assert Engine(spark, simple(spark, "weft_s2", schema_name="weft_mart", table_name="totals")).build() == ["weft_s2", "weft_mart.totals"]
    assert spark.table("weft_mart.totals").count() == 2


def test_virtual_outputs_of_two_schemas(spark, tmp_path):
    for k, schema in enumerate(("one", "two")):
        p = simple(spark, schema_name=schema, table_name="v", output_type="virtual")
        p.outputs["o"].channels[0].mappings.clear() if k else None
        Engine(spark, p).build(str(tmp_path / schema))
    assert sorted(r.a for r in spark.table("one__v").collect()) == [1, 2]
    assert [r.a for r in spark.table("two__v").collect()] == [None, None]


def test_unmanaged_source_reads_its_target(spark, tables):
    tables.append("theirs_already")
    spark.createDataFrame([(5,)], "a int").write.saveAsTable("theirs_already")
    engine = Engine(spark, simple(spark, "theirs_already", unmanaged=True, table_name="weft_o5"))
    tables.append("weft_o5")
    assert engine.source("s").first().a == 5 and engine.build() == ["weft_o5"]
    assert spark.table("weft_o5").first().a == 5 and spark.table("theirs_already").count() == 1


def test_statements_with_comments():
    assert statements("select 1 -- it's; fine\n; /* a ; b */ select '--x;' ; -- end") == ["select 1", "select '--x;'"]

"""Corpus queries with SQL, at the smallest scale, against DuckDB."""

import pytest

duckdb = pytest.importorskip("duckdb")
from weft.llm import queries as Q  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    made = db.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, made.fetchall()))


def test_certified_cutoffs_equal_sql(spark, tmp_path):
    """With enough labels cutoffs are certified; SQL finds the same ones and the same verdicts."""
    from weft.llm import oracles, quality

    prose = " ".join(f"w{k}" for k in range(20))
    rows, labels = [], []
    for i in range(5000):
        bad = i % 6 == 0
        marks = "#" * (i % 40 if bad else i % 2) + ("\\n" + "one line of words") * (i % 5 if bad else 0)
        rows.append((i, f"{prose} {i} {marks}".replace("\\n", "\n"), ["en", "de", None][i % 7 % 3]))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents"))
    known.write.parquet(str(tmp_path / "labels"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    got = quality.op5(docs, known)
    made = db.execute(oracles.quality_rules())
    columns = [d[0] for d in made.description]
    rows = sorted(map(str, map(tuple, got.select(*columns).collect())))
    assert rows == sorted(map(str, made.fetchall()))
    assert got.where("rejected_by <> ''").count() > 100

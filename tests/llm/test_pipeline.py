"""The pipeline stage by stage on the smallest test data, each against what its operator must keep."""

import corpus_pipeline
from weft.llm import quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "quality rules":
            good = quality.op5(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").count()
            assert counts[-1] == good
        if name == "near duplicates":
            assert docs.join(before.select("doc_id"), "doc_id", "left_semi").count() == counts[-1] < counts[-2]
        if name == "personal data":
            assert counts[-1] == counts[-2]
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    assert corpus_pipeline.run(spark, DATA).count() == counts[-1]


def test_stages_equal_brute_force(spark, tmp_path):
    """Every stage against a plain version of it on what its predecessor kept."""
    import re
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from test_documents import base_counts, targets
    from test_minhash import brute
    from test_surrogates import replaced
    from tokenizers import Tokenizer

    from weft.llm.vocab import default_path

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = [(10_000 + i, r.text.replace(" the ", " a ", 1) + (" mail a@b.example" if i % 2 else ""), r.lang, r.source, r.n_chars) for i, r in enumerate(docs.orderBy("doc_id").limit(30).collect())]
    docs = docs.unionByName(spark.createDataFrame([*more, (20_000, None, None, None, None), (20_001, "", "en", "src0", 0)], docs.schema))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        seen.append((before, docs.collect()))

    # quality: so few labels certify nothing, so the base rules decide
    before, after = seen[0]
    good = [r for r in before if (c := base_counts(r.text))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    assert Counter(after) == Counter(good) and len(good) < len(before)
    before, after = seen[1]
    assert sorted(str(r.doc_id) for r in after) == brute(before)[0] and set(after) <= set(before) and len(after) < len(before)
    before, after = seen[2]
    want = replaced(before, corpus_pipeline.TEST_KEY)
    assert {r.doc_id: r.text for r in after} == want and any(r.text != want[r.doc_id] for r in before)
    # mixing: whole copies of whole rows, as many as the fraction allows, words near the sources' targets
    before, after = seen[3]
    sizes, taken, copies = defaultdict(int), defaultdict(int), Counter(after)
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    goal = targets(sizes)
    assert set(after) <= set(before)
    for r in before:
        part = goal[r.source] / sizes[r.source]
        assert part - 1 < copies[r] < part + 1
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(words(r.text) for r in before if r.source == s)
    # packing: every copy's ids, once, in windows without gaps
    before, after = seen[4]
    tokenizer = Tokenizer.from_file(default_path())
    pieces = defaultdict(list)
    for r in after:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
    for doc, n in Counter(r.doc_id for r in before).items():
        ids = [*tokenizer.encode(next(r.text for r in before if r.doc_id == doc), add_special_tokens=False).ids, 1]
        assert all(ids[p.start : p.start + p.length] == p.ids and p.doc_tokens == len(ids) for p in pieces[doc])
        assert Counter(i for p in pieces[doc] for i in range(p.start, p.start + p.length)) == {i: n for i in range(len(ids))}
    windows = defaultdict(list)
    for r in after:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        ends = np.cumsum([n for _, n in sorted(w)])
        assert [o for o, _ in sorted(w)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_take_odd_and_empty_tables(spark, odd):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names, no rows."""
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, DATA)
        rows = made.collect()
        if name != "packing":
            assert made.columns == odd.columns
            given = [tuple(r) for r in odd.drop("text").collect()]
            assert all(tuple(r) in given for r in made.drop("text").collect())
        assert rows and stage(spark, odd.limit(0), DATA).count() == 0

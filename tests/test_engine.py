"""The engine on small tables: NULL keys, empty groups, fan-out, files."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weft import Engine, Project, ProjectError, load
from weft.sources.sinks import run_script, statements


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def project(spark, left, right, rules, expression="[This].k = [Related].k", cardinality="M-M", outputs=(), right_rules=()):
    made = lambda rs: [{"name": n, "expression": e} for n, e in rs]
    return Project.of(
        [
            {"source_name": "l", "frame": frame(spark, left, "id int, k int"), "raw_attributes": ["id int", "k int"], "rules": made(rules)},
            {"source_name": "r", "frame": frame(spark, right, "k int, v int"), "raw_attributes": ["k int", "v int"], "rules": made(right_rules)},
        ],
        [{"name": "[l]-k-[r]", "expression": expression, "cardinality": cardinality}],
        outputs,
    )


RULES = [("n", "count([r].v)"), ("s", "sum([r].v)"), ("vs", "size(collect_list([r].v))"), ("m", "max([r].v) - [This].id")]
rows = st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3))), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=rows, right=rows)
def test_grouped_and_condition_plans_agree_with_brute_force(spark, left, right):
    right = [(k, v) for v, k in right]
    by_key = Engine(spark, project(spark, left, right, RULES)).source("l")
    by_condition = Engine(spark, project(spark, left, right, RULES, "[This].k <= [Related].k AND [This].k >= [Related].k")).source("l")

    def expected(i, k):
        vs = [v for kk, v in right if k is not None and kk == k]
        return (i, k, max(vs) - i if vs else None, len(vs), sum(vs) if vs else None, len(vs))

    want = sorted([expected(*x) for x in left], key=str)
    for df in (by_key, by_condition):
        assert sorted([tuple(r) for r in df.select("id", "k", "m", "n", "s", "vs").collect()], key=str) == want


def test_rules_on_one_path_share_one_join(spark):
    engine = Engine(spark, project(spark, [(1, 1)], [(1, 5)], RULES))
    assert engine.explain("l").count("left join") == 1
    engine = Engine(spark, project(spark, [(1, 1)], [(1, 5)], [("a", "[r].v"), ("b", "[r].v + 1")], cardinality="M-1"))
    assert engine.explain("l").count("left join") == 1


def test_null_keys_and_fan_out(spark):
    p = project(spark, [(1, None), (2, 7), (3, 8)], [(None, 1), (7, 2), (7, 3)], [("v", "[r].v")], cardinality="M-1")
    got = sorted([tuple(r) for r in Engine(spark, p).source("l").select("id", "v").collect()], key=str)
    assert got == [(1, None), (2, 2), (2, 3), (3, None)]
    with pytest.raises(Exception, match="declared 1"):
        Engine(spark, p, check_cardinality=True).source("l").collect()


def test_types(spark):
    p = project(spark, [(1, 1)], [(1, 5)], [("d", "cast([This].id as decimal(5,1))"), ("t", "to_date('2020-01-01')"), ("arr", "array([This].id)")])
    assert Engine(spark, p).types("l") == {"id": "int", "k": "int", "arr": "array", "d": "decimal", "t": "date"}
    assert dict(Engine(spark, p).source("l").dtypes)["d"] == "decimal(38,12)"
    with pytest.raises(ProjectError, match="not offered"):
        Engine(spark, project(spark, [], [], [("x", "map([This].id, 1)")])).source("l")
    with pytest.raises(ProjectError, match="Invalid rule expression"):
        Engine(spark, project(spark, [], [], [("x", "nope([This].id)")])).source("l")


def test_aliasing_in_a_rule_is_refused(spark):
    with pytest.raises(Exception):  # noqa: B017
        Engine(spark, project(spark, [], [], [("x", "[This].id as y, 1")])).source("l").collect()


def test_filter_must_be_boolean(spark):
    out = [{"output_name": "o", "columns": ["x int"], "channels": [{"source_name": "l", "filter": "[This].id", "mappings": ["id x"]}]}]
    with pytest.raises(ProjectError, match="boolean"):
        Engine(spark, project(spark, [], [], [], outputs=out)).output("o")


def test_undeclared_columns_are_dropped_and_missing_ones_reported(spark):
    s = {"source_name": "s", "frame": frame(spark, [(1, 2)], "a int, b int"), "raw_attributes": ["a int"]}
    assert Engine(spark, Project.of([s])).source("s").columns == ["a"]
    with pytest.raises(ProjectError, match="no column z"):
        Engine(spark, Project.of([s | {"raw_attributes": ["z int"]}])).source("s")


def test_lazy_output_leaves_out_unused_joins(spark):
    out = [{"output_name": "o", "columns": ["x int"], "channels": [{"source_name": "l", "mappings": ["id x"]}]}]
    p = project(spark, [(1, 1)], [(1, 5)], RULES, outputs=out)
    assert "Join" in Engine(spark, p).output("o")._jdf.queryExecution().toString()
    plan = Engine(spark, p, trust_cardinality=True).output("o")._jdf.queryExecution().toString()
    assert "Join" not in plan


YAML = {
    "meta.yaml": 'format: "core1.0"\n',
    "relations.yaml": '- name: "[a]-k-[b]"\n  expression: "[This].k = [Related].k"\n  cardinality: M-1\n',
    "extra.yaml": "x: 1\n",
    "sources/a.yaml": "source_name: a\nsource_table: weft_a\ntarget_table: enriched_a\nraw_attributes: [id int, k int]\nrules:\n- name: v2\n  expression: '[b].v * 2'\n",
    "sources/b.yaml": "source_name: b\nsource_table: weft_b\nraw_attributes: [k int, v int]\n",
    "outputs/o.yaml": "output_name: o\ncolumns: [k int, total long]\nchannels:\n- source_name: a\n  operation_type: Aggregate\n  mappings: [k k, sum(v2) total]\n",
}


def test_project_folder_builds_files(spark, tmp_path):
    for name, text in YAML.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    frame(spark, [(1, 1), (2, 1), (3, 9)], "id int, k int").createOrReplaceTempView("weft_a")
    frame(spark, [(1, 10)], "k int, v int").createOrReplaceTempView("weft_b")
    with pytest.warns(UserWarning, match="skipped"):
        p = load(str(tmp_path))
    engine = Engine(spark, p)
    assert engine.build(str(tmp_path / "target")) == ["b", "enriched_a", "o"]
    got = sorted([tuple(r) for r in spark.read.parquet(str(tmp_path / "target/o")).collect()], key=str)
    assert got == [(1, 40), (9, None)]
    (tmp_path / "meta.yaml").write_text("format: core2.0\n")
    with pytest.raises(ProjectError, match="core1.0"):
        load(str(tmp_path))


def test_statements(spark):
    assert statements("select ';' a; ; select \"x;y\" b;") == ["select ';' a", 'select "x;y" b']
    assert run_script(spark, "select 1; select 2") == 2
    with pytest.raises(ProjectError, match="statement 2"):
        run_script(spark, "select 1; selec 2; select 3")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("expression", ["[This].k >= [Related].k AND [This].k < [Related].v", "[This].k BETWEEN [Related].k AND [Related].v", "[This].k <= [Related].v", "([Related].v > [This].k) AND [This].k + 0 <> 3", "[Related].v BETWEEN [This].id AND [This].k", "[This].k % 3 = [Related].k % 3"])
@pytest.mark.parametrize("cardinality", ["M-1", "M-M"])
def test_conditions_that_are_no_equality(spark, expression, cardinality):
    import random

    random.seed(3)
    some = lambda n: random.choice([None, *range(n)])
    left, right = [(i, some(40)) for i in range(60)], [(some(40), some(40)) for _ in range(30)]
    rules = [("v", "[r].v")] if cardinality == "M-1" else [("v", "count([r].v)")]
    p = project(spark, left, right, rules, expression, cardinality)
    sql = expression.replace("[This].", "l.").replace("[Related].", "r.")
    spark.createDataFrame(left, "id int, k int").createOrReplaceTempView("theta_l")
    spark.createDataFrame(right, "k int, v int").createOrReplaceTempView("theta_r")
    what = "r.v" if cardinality == "M-1" else "count(r.v)"
    want = spark.sql(f"SELECT l.id, {what} v FROM theta_l l LEFT JOIN theta_r r ON {sql}" + ("" if cardinality == "M-1" else " GROUP BY l.id"))
    df = Engine(spark, p).source("l").select("id", "v")
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


def test_ranges_are_joined_by_buckets(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for card, rule in (("M-1", "[r].v"), ("M-M", "max([r].v)")):
            p = project(spark, [(1, 1)], [(1, 5)], [("x", rule)], "[This].k >= [Related].k AND [This].k < [Related].v", card)
            text = plan(Engine(spark, p).source("l"))
            assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("expression", ["[This].k < [Related].k", "[This].k >= [Related].k"])
def test_ranges_with_one_end_make_no_pairs(spark, expression):
    left, right = [(i, None if i % 9 == 0 else i * 7 % 2_000) for i in range(600)], [(i * 11 % 3_000, i % 50) for i in range(2_900)] + [(None, 1), (70, None)]
    calls = ["count([r].v)", "sum([r].v)", "min([r].v)", "max([r].v)", "avg([r].v)", "count_if([r].v > 40)", "every([r].v < 49)", "sum([r].v) FILTER (WHERE [r].v > 30)"]
    df = Engine(spark, project(spark, left, right, [(f"c{i}", c) for i, c in enumerate(calls)], expression)).source("l")
    assert "Generate" not in plan(df) and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)

    def expected(k):
        vs = [v for kk, v in right if None not in (k, kk) and (k < kk if "<" in expression else k >= kk)]
        known = [v for v in vs if v is not None]
        if not vs:
            return (0, None, None, None, None, 0, None, None)
        return (len(known), sum(known), min(known), max(known), sum(known) / len(known), sum(v > 40 for v in known), all(v < 49 for v in known), sum(v for v in known if v > 30) or None)

    got = {r["id"]: tuple(r[f"c{i}"] for i in range(len(calls))) for r in df.collect()}
    assert got == {i: pytest.approx(expected(k)) for i, k in left}


def test_ranges_with_one_end_by_values_that_are_no_plain_numbers(spark):
    nan, inf = float("nan"), float("inf")
    left, right = [(i, v) for i, v in enumerate([None, 0.0, -0.0, nan, inf, -inf, 1.5])], [(v,) for v in [None, 0.0, -0.0, nan, nan, inf, -inf, 1.5, 1.5]]
    for sign in ("<", "<=", ">", ">="):
        sources = [{"source_name": "l", "frame": frame(spark, left, "id int, k double"), "raw_attributes": ["id int", "k double"], "rules": [{"name": "n", "expression": "count([r].k)"}, {"name": "different", "expression": "count(DISTINCT [r].k)"}]}, {"source_name": "r", "frame": frame(spark, right, "k double"), "raw_attributes": ["k double"]}]
        df = Engine(spark, Project.of(sources, [{"name": "[r]-k-[l]", "expression": f"[Related].k {sign} [This].k", "cardinality": "M-M"}])).source("l")
        frame(spark, left, "id int, k double").createOrReplaceTempView("one_end_l")
        frame(spark, right, "k double").createOrReplaceTempView("one_end_r")
        want = spark.sql(f"SELECT id, count(r.k) n, count(DISTINCT r.k) different FROM one_end_l l LEFT JOIN one_end_r r ON l.k {sign} r.k GROUP BY id")
        assert sorted(map(tuple, df.select("id", "n", "different").collect())) == sorted(map(tuple, want.collect()))


def test_repeated_ranges_are_not_broadcast(spark, tmp_path):
    frame(spark, [(1, 1)], "id int, k int").write.parquet(f"{tmp_path}/l")  # small files, by whose size the plan goes
    frame(spark, [(1, 5)], "k int, v int").write.parquet(f"{tmp_path}/r")
    sources = [{"source_name": n, "frame": spark.read.parquet(f"{tmp_path}/{n}"), "raw_attributes": c, "rules": x} for n, c, x in (("l", ["id int", "k int"], [{"name": "x", "expression": "median([r].v)"}]), ("r", ["k int", "v int"], []))]
    for expression in ("[This].k < [Related].k", "[This].k >= [Related].k"):
        df = Engine(spark, Project.of(sources, [{"name": "[l]-k-[r]", "expression": expression, "cardinality": "M-M"}])).source("l")
        assert any("SortMergeJoin" in line and "__bucket" in line for line in plan(df).splitlines())


def test_cardinality_check_ignores_null_keys_and_sees_ranges(spark):
    many = [(None, 1), (None, 2), (7, 3)]
    p = project(spark, [(1, None), (2, 7)], many, [("v", "[r].v")], cardinality="M-1")
    assert sorted(str(tuple(r)) for r in Engine(spark, p, check_cardinality=True).source("l").select("id", "v").collect()) == ["(1, None)", "(2, 3)"]
    for expression in ("[This].k <= [Related].k", "[This].k <= [Related].k AND [This].id = [Related].v"):
        p = project(spark, [(2, 1)], [(3, 2), (4, 2)], [("v", "[r].v")], expression, "M-1")
        with pytest.raises(Exception, match="declared 1"):
            Engine(spark, p, check_cardinality=True).source("l").collect()


def test_corr_without_spread_is_null(spark):
    p = project(spark, [(1, 1), (2, 2), (3, 3)], [(1, 5), (1, 5), (2, 1), (2, 2), (2, None)], [("c", "corr([r].v, [r].k + [r].v)")])
    assert {r.id: r.c for r in Engine(spark, p).source("l").collect()} == {1: None, 2: pytest.approx(1.0), 3: None}


def test_schema_of_json_agg(spark):
    rows = [(1, '{"a": 1, "b": [1, 2.5]}'), (1, '{"a": "x", "c": {"d": true}}'), (1, "not json"), (2, None)]
    sources = [
        {"source_name": "l", "frame": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "raw_attributes": ["id int"], "rules": [{"name": "s", "expression": "schema_of_json_agg([r].j)"}]},
        {"source_name": "r", "frame": spark.createDataFrame(rows, "k int, j string"), "raw_attributes": ["k int", "j string"]},
    ]
    p = Project.of(sources, [{"name": "[l]-k-[r]", "expression": "[This].id = [Related].k", "cardinality": "1-M"}])
    assert {r.id: r.s for r in Engine(spark, p).source("l").collect()} == {1: "STRUCT<a: STRING, b: ARRAY<DOUBLE>, c: STRUCT<d: BOOLEAN>>", 2: None, 3: None}


def test_unique_lookup_with_a_hot_null(spark):
    p = project(spark, [(1, 5), (2, 6)], [(None, 1)] * 50 + [(5, 2), (6, 3), (6, 4)], [("x", "[r].v")], "[This].k = [Related].u", "M-1", right_rules=[("u", "[This].k")])
    p.sources["r"].rules["u"].unique = True
    df = Engine(spark, p).source("l")
    assert {r.id: r.x for r in df.collect()} == {1: 2, 2: None} and "Window" not in plan(df)


def items(spark, rows, rules, nested=()):
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.DoubleType())]))
    raw = {"name": "items", "schema": kind.jsonValue(), "rules": [{"name": n, "expression": e} for n, e in nested]}
    frame = spark.createDataFrame(rows, "id int, items array<struct<x:int,y:double>>")
    return Project.of([{"source_name": "s", "frame": frame, "raw_attributes": ["id int", raw], "rules": [{"name": n, "expression": e} for n, e in rules]}])


def test_rules_and_aggregates_on_arrays(spark):
    rows = [(1, [(1, 1.5), (2, None), (2, 3.5)]), (2, []), (3, None), (4, [(None, None)])]
    rules = [("n", "count([items].y)"), ("total", "sum([items].x)"), ("both", "sum([items].z) + 1"), ("top", "max([items].x)"), ("xs", "collect_set([items].x)"), ("some_big", "any([items].x > 1)"), ("first_y", "first([items].y)"), ("late", "[This].n * 2")]
    df = Engine(spark, items(spark, rows, rules, [("z", "[This].w * 2"), ("w", "[This].x + [Parent].id")])).source("s")
    got = {r.id: (r.n, r.total, r.both, r.top, sorted(r.xs, key=str), r.some_big, r.first_y, r.late) for r in df.collect()}
    assert got[1] == (2, 5, 17, 2, [1, 2], True, 1.5, 4)
    assert got[2] == (0, None, None, None, [], None, None, 0) == got[3]
    assert got[4] == (0, None, None, None, [], None, None, 0)
    assert [tuple(e) for e in df.where("id = 1").first()["items"]][0] == (1, 1.5, 2, 4)


@pytest.mark.parametrize(
    ("rules", "nested", "code"),
    [
        ([("a", "[items].x + 1")], [], "cardinality"),
        ([("a", "sum([items].q)")], [], "unknown attribute"),
        ([], [("x", "1")], "duplicate"),
        ([], [("z", "[This].q + 1")], "unknown attribute"),
        ([], [("z", "[Parent].q + 1")], "unknown attribute"),
        ([], [("z", "sum([This].x)")], "rule"),
    ],
)
def test_errors_on_arrays(spark, rules, nested, code):
    with pytest.raises(ProjectError) as e:
        items(spark, [], rules, nested)
    assert e.value.code == code


def test_element_rules_in_a_circle(spark):
    p = items(spark, [(1, [])], [], [("a", "[This].b"), ("b", "[This].a")])
    with pytest.raises(ProjectError, match="need each other"):
        Engine(spark, p).source("s")
    p = items(spark, [(1, [])], [("m", "median([items].x)")])
    with pytest.raises(ProjectError, match="not offered"):
        Engine(spark, p).source("s")


def test_probe_warns_of_null(spark):
    p = project(spark, [], [], [("fine", "[This].id + [r].v"), ("lost", "try_to_date(concat('x', [This].id))"), ("n", "[This].fine * 2")], cardinality="M-1")
    with pytest.warns(UserWarning, match="lost is NULL"):
        assert Engine(spark, p).probe("l") == ["lost"]


def test_hubs_are_written_once(spark):
    p = project(spark, [(1, 1)], [(1, 5)], [("a", "max([r].w)"), ("b", "[This].a + 1")], right_rules=[("w", "[This].v * 2")])
    with Engine(spark, p, materialise=True) as engine:
        df = engine.source("l")
        assert df.first().b == 11 and "weft-hub" in plan(df)
        folder = engine._folders[0].removeprefix("file:")
        import os

        assert os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_unpivot_must_be_declared_whole(spark):
    for more in ({"operation_type": "Unpivot"}, {"unpivot_columns": ["id"]}):
        out = [{"output_name": "o", "columns": ["x int"], "channels": [{"source_name": "l", "mappings": ["id x"], **more}]}]
        with pytest.raises(ProjectError, match="belong together"):
            project(spark, [], [], [], outputs=out)


def test_functions_have_names(spark):
    p = project(spark, [(1, 1)], [], [("x", "twice([This].id)")])
    p.register_function("twice", lambda i: i * 2, "int")
    assert Engine(spark, p).source("l").first().x == 2
    for name in ("Sum", "sum", "a-b"):
        with pytest.raises(ProjectError, match="function name"):
            p.register_function(name, len)


def test_keys_put_together_from_numbers_are_matched_by_the_numbers(spark):
    def joined(left_rule, right_rule, kinds=("int", "int")):
        sources = [
            {"source_name": "l", "frame": frame(spark, [(1, 12), (11, 2), (None, 3)], "a int, b int"), "raw_attributes": [f"a {kinds[0]}", f"b {kinds[1]}"], "rules": [{"name": "key", "expression": left_rule}, {"name": "v", "expression": "[r].v"}]},
            {"source_name": "r", "frame": frame(spark, [(1, 12, "x"), (11, 2, "y"), (None, 3, "z")], "c int, d int, v string"), "raw_attributes": ["c int", "d int", "v string"], "rules": [{"name": "key2", "expression": right_rule}]},
        ]
        p = Project.of(sources, [{"name": "[l]-k-[r]", "expression": "[This].key = [Related].key2", "cardinality": "M-1"}])
        df = Engine(spark, p).source("l")
        return sorted(str(r.v) for r in df.collect()), "concat" in plan(df.select("a", "v"))

    both = "concat([This].{}, '|', [This].{})"
    assert joined(both.format("a", "b"), both.format("c", "d")) == (["None", "x", "y"], False)
    # a text that numbers can run into, other texts or a string keep the texts' comparison
    glued = "concat([This].{}, '', [This].{})"
    assert joined(glued.format("a", "b"), glued.format("c", "d"))[1]
    assert joined(both.format("a", "b"), "concat([This].c, '/', [This].d)") == (["None", "None", "None"], True)
    assert joined("concat([This].a, '0', [This].b)", "concat([This].c, '0', [This].d)")[1]
    assert joined(both.format("a", "b"), both.format("c", "d"), ("string", "int"))[1]

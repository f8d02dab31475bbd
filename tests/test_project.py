"""Errors and paths that need no data."""

import pytest

from weft import Project, ProjectError
from weft.plans.paths import resolve
from weft.plans.rules import build_order, levels, needs


def source(name, raw, rules=(), **more):
    return {"source_name": name, "source_table": name, "raw_attributes": raw, "rules": [r if isinstance(r, dict) else {"name": r[0], "expression": r[1], **(r[2] if len(r) > 2 else {})} for r in rules], **more}


def rel(name, expression, cardinality, **more):
    return {"name": name, "expression": expression, "cardinality": cardinality, **more}


A = ["id int", "b_id int", "c_id int"]
RELS = [rel("[a]-b-[b]", "[This].b_id = [Related].id", "M-1"), rel("[b]-c-[c]", "[This].c_id = [Related].id", "M-1")]


def project(rules=(), rels=RELS, b_rules=(), outputs=(), **more):
    return Project.of([source("a", A, rules, **more), source("b", ["id int", "c_id int"], b_rules), source("c", ["id int", "v string"])], rels, outputs)


def code(*args, **kwargs):
    with pytest.raises(ProjectError) as e:
        project(*args, **kwargs)
    return e.value.code


def test_automatic_path_takes_two_hops():
    p = project([("v", "[c].v")])
    path = needs(p, p.sources["a"])["v"].lookups
    assert [h.relation for h in next(iter(path.values()))] == ["[a]-b-[b]", "[b]-c-[c]"]


def test_ambiguous_and_explicit_path():
    more = [*RELS, rel("[a]-c-[c]", "[This].c_id = [Related].id", "M-1")]
    assert code([("v", "[c].v")], more) == "ambiguous"
    p = project([("v", "[c].v", {"parameters": [{"relations": ["[a]-c-[c]"]}]})], more)
    assert len(next(iter(needs(p, p.sources["a"])["v"].lookups.values()))) == 1
    assert code([("v", "[c].v", {"parameters": [{"relations": ["[b]-c-[c]"]}]})], more) == "path"
    assert code([("v", "[c].v", {"parameters": [{"relations": ["nope"]}]})], more) == "path"


def test_direct_relation_that_also_begins_a_longer_path_is_not_ambiguous():
    more = [*RELS, rel("[c]-back-[b]", "[This].id = [Related].c_id", "1-1")]
    p = project(rels=more)
    assert [h.relation for h in resolve(p, "a", "b", True, [], "x")] == ["[a]-b-[b]"]


def test_cardinality_errors():
    assert code(b_rules=[("v", "[a].id")]) == "cardinality"
    assert code([("v", "sum([c].id)")]) == "cardinality"
    assert code([("v", "[c].v")], rels=RELS[:1]) == "path"


@pytest.mark.parametrize(
    ("text", "expected"),
    [("count(1)", "aggregate"), ("sum([This].id)", "aggregate"), ("[x].y", "unknown source"), ("[b].y", "unknown attribute"), ("[This].y", "unknown attribute"), ("[This].v + 1", "self-reference"), ("[Related].id", "reference")],
)
def test_rule_errors(text, expected):
    assert code([("v", text)]) == expected


def test_rule_cycle_names_the_rules():
    with pytest.raises(ProjectError, match="x -> y|y -> x"):
        project([("x", "[This].y + 1"), ("y", "[This].x + 1")])


def test_source_cycle():
    assert code([("v", "[b].n")], b_rules=[("n", "count([a].id)")]) == "source cycle"


def test_levels_follow_rules_and_keys():
    p = project([("k", "[This].id + 1"), ("j", "[This].k + 1"), ("z", "[c].v"), ("w", "1")], [*RELS, rel("[a]-j-[c]", "[This].j = [Related].id", "M-1", active_flag=False)])
    assert levels(p.sources["a"], needs(p, p.sources["a"])) == [["k", "w", "z"], ["j"]]
    assert build_order(p).index("c") < build_order(p).index("a")


@pytest.mark.parametrize("raw", [["id bigint"], ["id"], ["id decimal(10,2)"], [], ["id int", "id int"], [{"name": "s", "schema": "int"}]])
def test_raw_attribute_errors(raw):
    with pytest.raises(ProjectError):
        Project.of([source("a", raw)])


@pytest.mark.parametrize(
    "rule",
    [("Bad", "1"), ("1x", "1"), ("id", "1"), ("v", "1", {"cast_datatype": "money"}), ("v", "1", {"rule_type_code": "Q"}), ("v", "rank() over (order by [This].id)", {"keep_current_flag": False})],
)
def test_rule_declaration_errors(rule):
    with pytest.raises(ProjectError):
        project([rule])


@pytest.mark.parametrize(("name", "expression", "cardinality"), [("a-b", "[This].b_id = [Related].id", "M-1"), ("[a]-b-[b]", "[This].b_id = [Related].id", "M-N"), ("[a]-b-[b]", "[This].b_id = 1", "M-1"), ("[a]-b-[b]", "[a].b_id = [Related].id", "M-1"), ("[a]-b-[q]", "[This].b_id = [Related].id", "M-1"), ("[a]-b-[b]", "[This].nope = [Related].id", "M-1")])
def test_relation_errors(name, expression, cardinality):
    with pytest.raises(ProjectError):
        project(rels=[rel(name, expression, cardinality)])


def output(channels, columns=("x int", "y")):
    return [{"output_name": "o", "columns": list(columns), "channels": channels}]


@pytest.mark.parametrize(
    "channels",
    [
        [],
        [{"source_name": "a", "mappings": ["sum(id) x"]}],
        [{"source_name": "a", "mappings": ["id nope"]}],
        [{"source_name": "a", "mappings": ["id x", "b_id x"]}],
        [{"source_name": "a", "mappings": ["nope x"]}],
        [{"source_name": "q", "mappings": ["id x"]}],
        [{"source_name": "a", "mappings": ["id + 1 x"]}],
        [{"source_name": "a", "operation_type": "Unpivot", "mappings": ["id x"]}],
        [{"source_name": "a", "filter": "[b].id > 1", "mappings": ["id x"]}],
        [{"source_name": "a", "mappings": ["id x"], "include_pass_flag": False, "include_warn_flag": False}],
    ],
)
def test_output_errors(channels):
    with pytest.raises(ProjectError):
        project(outputs=output(channels))


@pytest.mark.parametrize("rule", [("v", "rank() over (order by [This].id)"), ("v", "[This].id", {"unique_flag": True}), ("v", "count([x].id)")])
def test_streams_refuse_state(rule):
    x = source("x", ["id int"])
    with pytest.raises(ProjectError) as e:
        Project.of([source("a", A, [rule], processing_type="stream"), x], [rel("[a]-x-[x]", "[This].id = [Related].id", "1-M")])
    assert e.value.code == "stream"

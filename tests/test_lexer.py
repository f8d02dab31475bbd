import pytest

from weft import ProjectError
from weft.functions.lexer import Agg, Ref, parse


def test_references_and_text():
    e = parse("[This].a + [B].c1_x.k * [This].arr[0]")
    assert e.refs() == [Ref(None, "a"), Ref("B", "c1_x"), Ref(None, "arr")]
    assert e.render(lambda r: r.attribute) == "a + c1_x.k * arr[0]"


def test_quotes_hide_brackets_and_aggregates():
    e = parse("concat('[x].y sum(', \"it''s [\", `[q].r`, [This].a, 'it''s')")
    assert e.refs() == [Ref(None, "a")] and not e.aggs()


def test_aggregates():
    e = parse("sum( [B].x * [B].y ) / count (DISTINCT [B].z) + [This].q")
    assert [a.name for a in e.aggs()] == ["sum", "count"]
    assert e.aggs()[0].refs() == [Ref("B", "x"), Ref("B", "y")] and e.refs() == [Ref(None, "q")]
    assert e.render(lambda r: r.attribute, lambda a: f"<{a.name}>") == "<sum> / <count> + q"


@pytest.mark.parametrize("text", ["sum([This].a) over (partition by [This].b)", "percentile_cont(0.5) within group (order by [This].a) over (partition by [This].b)", "count([This].a) OVER(ORDER BY [This].b)"])
def test_windows_are_no_aggregates(text):
    e = parse(text)
    assert e.windowed and not e.aggs()


def test_names_that_only_contain_an_aggregate():
    assert not parse("my_sum([This].a) + t.count(1) + [This].sum").aggs()


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (None, "empty"),
        ("  ", "empty"),
        ("[This].a /* x */", "comment"),
        ("[[This].a]", "bracket"),
        ("[].a", "bracket"),
        ("[This]a", "bracket"),
        ("[This", "bracket"),
        ("'open", "quote"),
        ("sum(max([B].a))", "nested aggregate"),
        ("sum([B].a", "bracket"),
        ("sum([B].a) + rank() over (order by [This].b)", "window"),
        ("rank() over (order by [This].b) + sum([B].a)", "window"),
        ("[This].a -- it's", "comment"),
    ],
)
def test_errors(text, code):
    with pytest.raises(ProjectError) as e:
        parse(text, "here")
    assert e.value.code == code and "here" in str(e.value)


def test_agg_is_a_part():
    assert isinstance(parse("1 + sum([B].a)").parts[1], Agg)

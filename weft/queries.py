"""Every operator of the language as a query over the test tables, with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.engine import Engine
from weft.model import Project

COLUMNS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}
RELATIONS = [
    ("[lineitem]-orderkey-[orders]", "[This].l_orderkey = [Related].o_orderkey", "M-1"),
    ("[orders]-custkey-[customer]", "[This].o_custkey = [Related].c_custkey", "M-1"),
    ("[customer]-nationkey-[nation]", "[This].c_nationkey = [Related].n_nationkey", "M-1"),
    ("[nation]-nationkey-[supplier]", "[This].n_nationkey = [Related].s_nationkey", "1-M"),
    ("[nation]-regionkey-[region]", "[This].n_regionkey = [Related].r_regionkey", "M-1"),
]
PARTSUPP = "ps_partkey long, ps_suppkey long, ps_supplycost double"
SUPPLIER = ("[lineitem]-suppkey-[supplier]", "[This].l_suppkey = [Related].s_suppkey", "M-1")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(declared: str) -> list[str]:
    return [c.strip() for c in declared.split(", ")]


def _project(spark: SparkSession, sf_dir: str, rules=None, relations=(), outputs=(), frames=None, base=True) -> Project:
    sources = []
    tables = {t: (declared, lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t, declared in COLUMNS.items()} | (frames(spark, sf_dir) if frames else {})
    for t, (declared, frame) in tables.items():
        raw = declared if isinstance(declared, list) else _columns(declared)
        own = [r if isinstance(r, dict) else {"name": r[0], "expression": r[1], **(r[2] if len(r) > 2 else {})} for r in (rules or {}).get(t, [])]
        sources.append({"source_name": t, "frame": frame, "raw_attributes": raw, "rules": own})
    rels = [{"name": n, "expression": e, "cardinality": c} for n, e, c in [*(RELATIONS if base else []), *relations]]
    return Project.of(sources, rels, outputs)


def rule(name: str, source: str, rules: list, keep: str, sql: str | None, relations=(), others=None, frames=None, base=True, **engine) -> None:
    """A query: the columns ``keep`` (expressions) of a source with rules."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _project(spark, sf_dir, {source: rules, **(others or {})}, relations, frames=frames, base=base)
        return Engine(spark, p, **engine).source(source).selectExpr(*[k.strip() for k in keep.split(";")])

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def out(name: str, columns: str, channels: list[dict], sql: str | None, rules=None, relations=(), frames=None, finish: str | None = None, **engine) -> None:
    """A query: an output; ``finish`` rounds what the grammar of outputs can't."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = {"output_name": "result", "columns": _columns(columns), "channels": channels}
        p = _project(spark, sf_dir, rules, relations, [spec], frames)
        df = Engine(spark, p, **engine).output("result")
        return df.selectExpr(*[k.strip() for k in finish.split(";")]) if finish else df

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def channel(source: str, mappings: str, aggregate: bool = False, **more) -> dict:
    return {"source_name": source, "mappings": [m.strip() for m in mappings.split(";")], **({"operation_type": "Aggregate"} if aggregate else {}), **more}


def _partsupp(spark, sf_dir):
    query = f"SELECT l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost FROM parquet.`{sf_dir}/lineitem.parquet` GROUP BY 1, 2"
    return {"partsupp": (PARTSUPP, lambda: spark.sql(query))}


PS_SQL = "(SELECT l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost FROM lineitem GROUP BY 1, 2)"
LINE = "l_orderkey; l_linenumber; l_partkey; l_suppkey; "
L_SQL = "l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey"

# scans and sources
rule("scan_declared_columns", "nation", [], "n_nationkey; n_name; n_regionkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
rule("source_query_derived", "partsupp", [], "ps_partkey; ps_suppkey; ps_supplycost", f"SELECT * FROM {PS_SQL}", frames=_partsupp)

# row rules
rule("rule_row_expression", "lineitem", [("net", "([This].l_extendedprice - [This].l_tax - [This].l_discount) * 100")], LINE + "round(net, 2) net", f"SELECT {L_SQL}, round((l_extendedprice - l_tax - l_discount) * 100, 2) net FROM lineitem l")
rule("rule_on_rule", "lineitem", [("a", "[This].l_quantity * 2"), ("b", "[This].a + 1"), ("c", "[This].b * [This].a")], LINE + "a; b; c", f"SELECT {L_SQL}, l_quantity * 2 a, l_quantity * 2 + 1 b, (l_quantity * 2 + 1) * (l_quantity * 2) c FROM lineitem l")
rule("rule_constant", "region", [("one", "1"), ("word", "'a [b].c'")], "r_regionkey; one; word", "SELECT r_regionkey, 1::INTEGER one, 'a [b].c' word FROM region")
rule("rule_cast", "orders", [("key_text", "[This].o_orderkey", {"cast_datatype": "string"}), ("price", "[This].o_totalprice", {"cast_datatype": "long"})], "o_orderkey; key_text; price", "SELECT o_orderkey, o_orderkey::VARCHAR key_text, trunc(o_totalprice)::BIGINT price FROM orders")
rule("rule_decimal_normalised", "supplier", [("bal", "cast([This].s_acctbal as decimal(10,2))")], "s_suppkey; bal", "SELECT s_suppkey, s_acctbal::DECIMAL(10,2)::DECIMAL(38,12) bal FROM supplier")
rule("rule_case_when", "lineitem", [("band", "CASE WHEN [This].l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN [This].l_quantity IN (20, 30) THEN 'round' WHEN [This].l_returnflag LIKE 'R%' THEN 'back' ELSE 'other' END")], LINE + "band", f"SELECT {L_SQL}, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN l_quantity IN (20, 30) THEN 'round' WHEN l_returnflag LIKE 'R%' THEN 'back' ELSE 'other' END band FROM lineitem l")
rule("rule_inactive", "nation", [("gone", "1", {"active_flag": False}), ("kept", "[This].n_nationkey + 1")], "*", "SELECT n_nationkey, n_name, n_regionkey, n_nationkey + 1 kept FROM nation")


def _structs(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("kind", T.StructType([T.StructField("name", T.StringType())]))])
    items = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.LongType())]))
    raw = ["event_id long", {"name": "s", "schema": schema.jsonValue()}, {"name": "arr", "schema": T.ArrayType(T.LongType()).jsonValue()}, {"name": "items", "schema": items.jsonValue()}]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = F.expr("named_struct('k', cast(get_json_object(props, '$.k') as int), 'kind', named_struct('name', event_type))")
    parts = F.expr("transform(sequence(0, cast(event_id % 3 as int)), i -> named_struct('x', i, 'y', event_id * i))")
    return {"nested": (raw, lambda: events.select("event_id", made.alias("s"), F.array(F.col("event_id"), F.col("user_id")).alias("arr"), parts.alias("items")))}


rule("struct_field_rule", "nested", [("k2", "[This].s.k * 2"), ("kind", "upper([This].s.kind.name)")], "event_id; k2; kind", "SELECT event_id, (json_extract_string(props, '$.k')::INTEGER * 2)::INTEGER k2, upper(event_type) kind FROM events", frames=_structs)
rule("array_index_rule", "nested", [("first_item", "[This].arr[0]"), ("second_item", "[This].arr[1] + 1")], "event_id; first_item; second_item", "SELECT event_id, event_id first_item, user_id + 1 second_item FROM events", frames=_structs)
rule("array_struct_aggregate", "nested", [("total", "aggregate(transform([This].items, i -> i.x * i.y), 0L, (a, v) -> a + v)"), ("n", "size([This].items)")], "event_id; total; n", "SELECT event_id, list_sum(list_transform(range(0, event_id % 3 + 1), lambda i: i * i * event_id))::BIGINT total, (event_id % 3 + 1)::INTEGER n FROM events", frames=_structs)
rule("array_struct_rules", "nested", [("priced", "transform([This].items, i -> named_struct('x', i.x, 'y', i.y, 'sum_xy', i.x + i.y))"), ("last_sum", "element_at([This].priced, -1).sum_xy")], "event_id; size(priced) n; last_sum", "SELECT event_id, (event_id % 3 + 1)::INTEGER n, (event_id % 3) + event_id * (event_id % 3) last_sum FROM events", frames=_structs)


def _order_lines(spark, sf_dir):
    """Orders with their lines within, whose elements have rules of their own."""
    from pyspark.sql import types as T

    element = T.StructType([T.StructField("qty", T.DoubleType()), T.StructField("price", T.DoubleType()), T.StructField("flag", T.StringType())])
    lines = F.sort_array(F.collect_list(F.struct(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")))).alias("items")
    nested = [{"name": "half", "expression": "[This].price / 2"}, {"name": "tagged", "expression": "concat([This].flag, '-', [Parent].l_orderkey)"}, {"name": "quarter", "expression": "[This].half / 2"}]
    raw = ["l_orderkey long", {"name": "items", "schema": T.ArrayType(element).jsonValue(), "rules": nested}]
    return {"basket": (raw, lambda: spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(lines))}


rule("sub_source_rules", "basket", [("n", "size([This].items)"), ("last_item", "element_at([This].items, -1)")], "l_orderkey; n; round(last_item.quarter * 4, 2) price; last_item.tagged tagged", "SELECT l_orderkey, count(*)::INTEGER n, round(arg_max(l_extendedprice, struct_pack(a := l_quantity, b := l_extendedprice, c := l_returnflag)), 2) price, concat(arg_max(l_returnflag, struct_pack(a := l_quantity, b := l_extendedprice, c := l_returnflag)), '-', l_orderkey) tagged FROM lineitem GROUP BY 1", frames=_order_lines)
rule("sub_source_aggregate", "basket", [("revenue", "sum([items].half * 2)"), ("n", "count([items].qty)"), ("flags", "count(DISTINCT [items].flag)"), ("top", "max([items].qty) - min([items].qty)"), ("mean_qty", "avg([items].qty)"), ("dear", "count_if([items].price > 20000)"), ("back", "any([items].flag = 'R')")], "l_orderkey; round(revenue, 2) revenue; n; flags; top; round(mean_qty, 6) mean_qty; dear; back", "SELECT l_orderkey, round(sum(l_extendedprice), 2) revenue, count(*) n, count(DISTINCT l_returnflag) flags, max(l_quantity) - min(l_quantity) top, round(avg(l_quantity), 6) mean_qty, count(*) FILTER (l_extendedprice > 20000) dear, bool_or(l_returnflag = 'R') back FROM lineitem GROUP BY 1", frames=_order_lines)
rule("validation_rule", "orders", [("has_price", "[This].o_totalprice > 1000", {"rule_type_code": "V", "validation_action_code": "F"})], "o_orderkey; has_price", "SELECT o_orderkey, o_totalprice > 1000 has_price FROM orders")
VALID = [("dear", "[This].o_totalprice > 50000", {"rule_type_code": "V", "validation_action_code": "F"}), ("opened", "[This].o_orderstatus <> 'F'", {"rule_type_code": "V", "validation_action_code": "W"})]
STATUS_SQL = "CASE WHEN NOT coalesce(o_totalprice > 50000, false) THEN 'F' WHEN NOT coalesce(o_orderstatus <> 'F', false) THEN 'W' ELSE 'P' END"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _project(spark, sf_dir, {"orders": VALID})).with_status("orders").select("o_orderkey", "validation_status")


QUERIES["validation_status"] = _status
ORACLES["validation_status"] = f"SELECT o_orderkey, {STATUS_SQL} validation_status FROM orders"

# scalar functions
rule("scalar_string", "part", [("s", "concat(upper(substring([This].p_name, 1, 3)), '-', lower([This].p_brand), '-', length([This].p_type))"), ("words", "size(split([This].p_name, ' '))"), ("digits", "regexp_extract([This].p_brand, '([0-9]+)', 1)")], "p_partkey; s; words; digits", "SELECT p_partkey, concat(upper(substring(p_name, 1, 3)), '-', lower(p_brand), '-', length(p_type)) s, len(string_split(p_name, ' '))::INTEGER words, regexp_extract(p_brand, '([0-9]+)', 1) digits FROM part")
rule("scalar_date", "orders", [("ym", "date_format([This].o_orderdate, 'yyyyMM')"), ("y", "year([This].o_orderdate)"), ("day_count", "datediff(date'2002-01-01', cast([This].o_orderdate as date))"), ("m", "cast(date_trunc('month', [This].o_orderdate) as date)"), ("later", "add_months(cast([This].o_orderdate as date), 1)")], "o_orderkey; ym; y; day_count; m; later", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') ym, year(o_orderdate)::INTEGER y, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INTEGER day_count, date_trunc('month', o_orderdate)::DATE m, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE later FROM orders")
rule("scalar_math", "customer", [("a", "round(abs([This].c_acctbal) / 7, 3)"), ("b", "floor([This].c_acctbal)"), ("c", "round(log(abs([This].c_acctbal) + 1), 6)"), ("d", "pow([This].c_nationkey, 2)")], "c_custkey; a; b; c; d", "SELECT c_custkey, round(abs(c_acctbal) / 7, 3) a, floor(c_acctbal)::BIGINT b, round(ln(abs(c_acctbal) + 1), 6) c, pow(c_nationkey, 2)::DOUBLE d FROM customer")
rule("scalar_array", "events", [("parts", "array([This].user_id, [This].event_id, 7L)"), ("total", "aggregate([This].parts, 0L, (a, x) -> a + x)"), ("big", "size(filter([This].parts, x -> x > 7))"), ("has", "exists([This].parts, x -> x = 7)")], "event_id; total; big; has", "SELECT event_id, user_id + event_id + 7 total, ((user_id > 7)::INTEGER + (event_id > 7)::INTEGER)::INTEGER big, true has FROM events")
rule("scalar_json", "events", [("k", "cast(get_json_object([This].props, '$.k') as int)"), ("j", "from_json([This].props, 'k INT').k + 1")], "event_id; k; j", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER k, json_extract_string(props, '$.k')::INTEGER + 1 j FROM events")
rule("scalar_hash", "customer", [("m", "md5([This].c_name)"), ("s", "sha2([This].c_name, 256)")], "c_custkey; m; s", "SELECT c_custkey, md5(c_name) m, sha256(c_name) s FROM customer")
rule("scalar_conditional", "lineitem", [("x", "if([This].l_discount > 0.05, nullif([This].l_linenumber, 1), coalesce(null, [This].l_linenumber))"), ("t", "([This].l_returnflag = 'R') IS TRUE")], LINE + "x; t", f"SELECT {L_SQL}, CASE WHEN l_discount > 0.05 THEN nullif(l_linenumber, 1) ELSE l_linenumber END x, l_returnflag = 'R' t FROM lineitem l")

# lookups
rule("lookup_single_hop", "lineitem", [("status", "[orders].o_orderstatus")], LINE + "status", f"SELECT {L_SQL}, o_orderstatus status FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey")
rule("lookup_multi_hop", "lineitem", [("c_name", "[customer].c_name")], LINE + "c_name", f"SELECT {L_SQL}, c_name FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
rule("lookup_missing_rows", "documents", [("good", "[labels].quality")], "doc_id; good", "SELECT d.doc_id, quality good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", relations=[("[documents]-label-[labels]", "[This].doc_id = [Related].doc_id", "1-1")])
rule("lookup_one_to_one", "labels", [("lang", "[documents].lang")], "doc_id; lang", "SELECT l.doc_id, lang FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id", relations=[("[documents]-label-[labels]", "[This].doc_id = [Related].doc_id", "1-1")])
rule("lookup_reverse_relation", "supplier", [("nation_name", "[nation].n_name")], "s_suppkey; nation_name", "SELECT s_suppkey, n_name nation_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
EXPLICIT = {"parameters": [{"source_name": "nation", "relations": ["[lineitem]-orderkey-[orders]", "[orders]-custkey-[customer]", "[customer]-nationkey-[nation]"]}]}
EXPLICIT2 = {"parameters": [{"relations": ["[lineitem]-suppkey-[supplier]", "[nation]-nationkey-[supplier]"]}]}
CHAIN = "lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n.n_nationkey"
rule("lookup_explicit_path", "lineitem", [("c_n_name", "[nation].n_name", EXPLICIT)], LINE + "c_n_name", f"SELECT {L_SQL}, n_name c_n_name FROM {CHAIN}", relations=[SUPPLIER])
rule("lookup_role_playing", "lineitem", [("c_nation", "[nation].n_name", EXPLICIT), ("s_nation", "[nation].n_name", EXPLICIT2), ("same", "[This].c_nation = [This].s_nation")], LINE + "c_nation; s_nation; same", f"SELECT {L_SQL}, n.n_name c_nation, m.n_name s_nation, n.n_name = m.n_name same FROM {CHAIN} LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation m ON s_nationkey = m.n_nationkey", relations=[SUPPLIER])
PSKEY = [("partsupp_pkey", "CONCAT([This].l_partkey,'|',[This].l_suppkey)")]
PS_RULE = {"partsupp": [("ps_pkey", "CONCAT([This].ps_partkey,'|',[This].ps_suppkey)")]}
PS_REL = [("[lineitem]-partsupp_pkey-[partsupp]", "[This].partsupp_pkey = [Related].ps_pkey", "M-1")]
PS_JOIN = f"lineitem l LEFT JOIN {PS_SQL} ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey"
rule("lookup_on_rule_key", "lineitem", [*PSKEY, ("cost", "[partsupp].ps_supplycost")], LINE + "partsupp_pkey; cost", f"SELECT {L_SQL}, concat(l_partkey, '|', l_suppkey) partsupp_pkey, ps_supplycost AS cost FROM {PS_JOIN}", relations=PS_REL, others=PS_RULE, frames=_partsupp)
rule("lookup_composite_key", "lineitem", [("cost", "[partsupp].ps_supplycost")], LINE + "cost", f"SELECT {L_SQL}, ps_supplycost AS cost FROM {PS_JOIN}", relations=[("[lineitem]-both-[partsupp]", "[This].l_partkey = [Related].ps_partkey AND [This].l_suppkey = [Related].ps_suppkey", "M-1")], frames=_partsupp)


def _buckets(spark, sf_dir):
    rows = [(0.0, 10.0, "small"), (10.0, 25.0, "medium"), (25.0, 40.0, "large")]
    return {"bucket": ("lo double, hi double, label string", lambda: spark.createDataFrame(rows, "lo double, hi double, label string"))}


rule("lookup_theta_range", "lineitem", [("size_band", "[bucket].label")], LINE + "size_band", f"SELECT {L_SQL}, label size_band FROM lineitem l LEFT JOIN (VALUES (0.0, 10.0, 'small'), (10.0, 25.0, 'medium'), (25.0, 40.0, 'large')) b(lo, hi, label) ON l_quantity >= lo AND l_quantity < hi", relations=[("[lineitem]-band-[bucket]", "[This].l_quantity >= [Related].lo AND [This].l_quantity < [Related].hi", "M-1")], frames=_buckets)
rule("lookup_self_relation", "nation", [("prev_key", "[This].n_nationkey - 1"), ("loud", "upper([This].n_name)"), ("prev_loud", "[nation].loud")], "n_nationkey; prev_loud", "SELECT n.n_nationkey, upper(p.n_name) prev_loud FROM nation n LEFT JOIN nation p ON n.n_nationkey - 1 = p.n_nationkey", relations=[("[nation]-prev-[nation]", "[This].prev_key = [Related].n_nationkey", "M-1")])
rule("lookup_unique_only", "events", [("k", "cast(get_json_object([This].props, '$.k') as int)"), ("owner", "[customer].c_custkey")], "event_id; owner", "SELECT event_id, c_custkey AS owner FROM events LEFT JOIN (SELECT floor(c_acctbal)::BIGINT b, min(c_custkey) c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1) ON user_id = b", others={"customer": [("bal_floor", "floor([This].c_acctbal)", {"unique_flag": True})]}, relations=[("[events]-u-[customer]", "[This].user_id = [Related].bal_floor", "M-1")])
rule("lookup_of_rule", "orders", [("seg", "[customer].seg_code")], "o_orderkey; seg", "SELECT o_orderkey, lower(substring(c_mktsegment, 1, 4)) seg FROM orders LEFT JOIN customer ON o_custkey = c_custkey", others={"customer": [("seg_code", "lower(substring([This].c_mktsegment, 1, 4))")]})
# The rules of the sample project, as users know it.
SAMPLE = [
    ("net_price_int", "([This].l_extendedprice - [This].l_tax - [This].l_discount)*100"),
    ("net_price_no_returns", "CASE WHEN [This].l_returnflag = 'R' THEN [This].net_price_int ELSE 0 END"),
    ("c_name", "[customer].c_name"),
    ("c_n_name", "[nation].n_name", EXPLICIT),
    ("gross_margin_per_quantity", "([This].net_price_int - [partsupp].ps_supplycost)/[This].l_quantity"),
    *PSKEY,
    ("order_date_year_month", "date_format([orders].o_orderdate, 'yyyyMM')"),
]
rule("enriched_lineitem", "lineitem", SAMPLE, LINE + "round(net_price_int, 2) net_price_int; round(net_price_no_returns, 2) net_price_no_returns; c_name; c_n_name; round(gross_margin_per_quantity * l_quantity, 2) gross_margin; partsupp_pkey; order_date_year_month",
     f"SELECT {L_SQL}, round((l_extendedprice - l_tax - l_discount)*100, 2) net_price_int, round(CASE WHEN l_returnflag = 'R' THEN (l_extendedprice - l_tax - l_discount)*100 ELSE 0 END, 2) net_price_no_returns, c_name, n_name c_n_name, round(((l_extendedprice - l_tax - l_discount)*100 - ps_supplycost)/l_quantity * l_quantity, 2) gross_margin, concat(l_partkey, '|', l_suppkey) partsupp_pkey, strftime(o_orderdate, '%Y%m') order_date_year_month FROM {CHAIN} LEFT JOIN {PS_SQL} ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey",
     relations=PS_REL, others=PS_RULE, frames=_partsupp)

# aggregates over the many side
O_L = "orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
rule("many_join_aggregate", "orders", [("lines", "count([lineitem].l_linenumber)"), ("qty", "sum([lineitem].l_quantity)")], "o_orderkey; lines; qty", f"SELECT o_orderkey, count(l_linenumber) lines, sum(l_quantity) qty FROM {O_L} GROUP BY 1")
rule("many_join_expression", "orders", [("revenue", "sum([lineitem].l_extendedprice * (1 - [lineitem].l_discount))")], "o_orderkey; round(revenue, 6) revenue", f"SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 6) revenue FROM {O_L} GROUP BY 1")
rule("many_join_ratio", "orders", [("avg_price", "sum([lineitem].l_extendedprice) / nullif(count([lineitem].l_linenumber), 0)")], "o_orderkey; round(avg_price, 6) avg_price", f"SELECT o_orderkey, round(sum(l_extendedprice) / nullif(count(l_linenumber), 0), 6) avg_price FROM {O_L} GROUP BY 1")
rule("many_join_count_distinct", "orders", [("supps", "count(DISTINCT [lineitem].l_suppkey)")], "o_orderkey; supps", f"SELECT o_orderkey, count(DISTINCT l_suppkey) supps FROM {O_L} GROUP BY 1")
rule("many_join_conditional", "orders", [("back", "sum(CASE WHEN [lineitem].l_returnflag = 'R' THEN 1 ELSE 0 END)"), ("dear", "count_if([lineitem].l_extendedprice > 20000)")], "o_orderkey; back; dear", f"SELECT o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_orderkey IS NOT NULL THEN 0 END)::BIGINT back, count(*) FILTER (l_extendedprice > 20000) dear FROM {O_L} GROUP BY 1")
rule("many_join_mixed", "orders", [("gap", "[This].o_totalprice - sum([lineitem].l_extendedprice)")], "o_orderkey; round(gap, 2) gap", f"SELECT o_orderkey, round(any_value(o_totalprice) - sum(l_extendedprice), 2) gap FROM {O_L} GROUP BY 1")
rule("many_join_two_paths", "nation", [("both", "count([supplier].s_suppkey) + count([customer].c_custkey)")], "n_nationkey; both", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS both FROM nation")
rule("many_join_chained", "customer", [("suppliers", "count([supplier].s_suppkey)"), ("best", "max([supplier].s_acctbal)")], "c_custkey; suppliers; best", "SELECT c_custkey, count(s_suppkey) suppliers, max(s_acctbal) best FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
rule("many_join_self", "nation", [("shout", "upper([This].n_name)"), ("peers", "count([nation].n_nationkey)"), ("last_peer", "max([nation].shout)")], "n_nationkey; peers; last_peer", "SELECT n.n_nationkey, count(p.n_nationkey) peers, max(upper(p.n_name)) last_peer FROM nation n LEFT JOIN nation p ON n.n_regionkey = p.n_regionkey GROUP BY 1", relations=[("[nation]-peer-[nation]", "[This].n_regionkey = [Related].n_regionkey", "M-M")])
rule("many_join_theta", "nation", [("after", "count([nation].n_nationkey)")], "n_nationkey; after", "SELECT n.n_nationkey, count(p.n_nationkey) AS after FROM nation n LEFT JOIN nation p ON n.n_regionkey = p.n_regionkey AND n.n_nationkey < p.n_nationkey GROUP BY 1", relations=[("[nation]-after-[nation]", "[This].n_regionkey = [Related].n_regionkey AND [This].n_nationkey < [Related].n_nationkey", "M-M")])


def _price_bands(spark, sf_dir):
    """A band of prices around each part's, about as many as parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return {"band": ("band_key long, low double, high double", lambda: part.selectExpr("p_partkey band_key", "p_retailprice * 20 low", "p_retailprice * 20 + p_size high"))}


_BANDS = "(SELECT p_partkey band_key, p_retailprice * 20 AS low, p_retailprice * 20 + p_size AS high FROM part)"
rule("many_join_theta_range", "band", [("lines", "count([lineitem].l_orderkey)"), ("dearest", "max([lineitem].l_extendedprice)")], "band_key; lines; dearest", f"SELECT band_key, count(l_orderkey) AS lines, max(l_extendedprice) dearest FROM {_BANDS} LEFT JOIN lineitem ON l_extendedprice >= low AND l_extendedprice < high GROUP BY 1", relations=[("[band]-price-[lineitem]", "[Related].l_extendedprice >= [This].low AND [Related].l_extendedprice < [This].high", "M-M")], frames=_price_bands)
rule("many_join_theta_one_side", "supplier", [("richer", "count([supplier].s_suppkey)")], "s_suppkey; richer", "SELECT s.s_suppkey, count(p.s_suppkey) richer FROM supplier s LEFT JOIN supplier p ON s.s_acctbal < p.s_acctbal GROUP BY 1", relations=[("[supplier]-richer-[supplier]", "[This].s_acctbal < [Related].s_acctbal", "M-M")])


def _prices(spark, sf_dir):
    """Ranges of prices that don't overlap: from each price among the parts to the next."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    query = "SELECT low, lead(low) OVER (ORDER BY low) high FROM (SELECT DISTINCT p_retailprice * 20 low FROM {part})"
    return {"price": ("low double, high double", lambda: spark.sql(query, part=part))}


rule("lookup_theta_many_ranges", "lineitem", [("from_price", "[price].low")], LINE + "from_price", f"SELECT {L_SQL}, low from_price FROM lineitem l LEFT JOIN (SELECT low, lead(low) OVER (ORDER BY low) high FROM (SELECT DISTINCT p_retailprice * 20 low FROM part)) ON l_extendedprice >= low AND l_extendedprice < high", relations=[("[lineitem]-price-[price]", "[This].l_extendedprice >= [Related].low AND [This].l_extendedprice < [Related].high", "M-1")], frames=_prices)
rule("many_join_reused_by_rules", "orders", [("n", "count([lineitem].l_linenumber)"), ("busy", "[This].n > 4"), ("share", "[This].n / (count([lineitem].l_linenumber) + 1)")], "o_orderkey; n; busy; round(share, 6) share", f"SELECT o_orderkey, count(l_linenumber) n, count(l_linenumber) > 4 busy, round(count(l_linenumber) / (count(l_linenumber) + 1), 6) share FROM {O_L} GROUP BY 1")
STATS = {
    "avg": ("round(avg({x}), 4)", "round(avg(l_quantity), 4)"), "mean": ("round(mean({x}), 4)", "round(avg(l_quantity), 4)"), "median": ("median({x})", "median(l_quantity)::DOUBLE"),
    "percentile": ("percentile({x}, 0.25)", "quantile_cont(l_quantity, 0.25)::DOUBLE"), "std": ("round(std({x}), 4)", "round(stddev_samp(l_quantity), 4)"), "stddev": ("round(stddev({x}), 4)", "round(stddev_samp(l_quantity), 4)"),
    "stddev_samp": ("round(stddev_samp({x}), 4)", "round(stddev_samp(l_quantity), 4)"), "stddev_pop": ("round(stddev_pop({x}), 4)", "round(stddev_pop(l_quantity), 4)"), "var_pop": ("round(var_pop({x}), 7)", "round(var_pop(l_quantity), 7)"),
    "var_samp": ("round(var_samp({x}), 7)", "round(var_samp(l_quantity), 7)"), "variance": ("round(variance({x}), 7)", "round(var_samp(l_quantity), 7)"), "covar_pop": ("round(covar_pop({x}, {y}) * count({x}) * count({x}), 2)", "round(covar_pop(l_quantity, l_extendedprice) * count(l_quantity) * count(l_quantity), 2)"),
    "covar_samp": ("round(covar_samp({x}, {y}) * count({x}) * (count({x}) - 1), 2)", "round(covar_samp(l_quantity, l_extendedprice) * count(l_quantity) * (count(l_quantity) - 1), 2)"), "min": ("min({x})", "min(l_quantity)"), "max": ("max({x})", "max(l_quantity)"), "sum": ("sum({x})", "sum(l_quantity)"), "count": ("count({x})", "count(l_quantity)"),
    "any": ("any({x} > 45)", "bool_or(l_quantity > 45)"), "some": ("some({x} > 45)", "bool_or(l_quantity > 45)"), "every": ("every({x} > 5)", "bool_and(l_quantity > 5)"), "bool_and": ("bool_and({x} > 5)", "bool_and(l_quantity > 5)"), "bool_or": ("bool_or({x} > 45)", "bool_or(l_quantity > 45)"),
    "bit_or": ("bit_or({n})", "bit_or(l_linenumber)"), "bit_xor": ("bit_xor({n})", "bit_xor(l_linenumber)"), "count_if": ("count_if({x} > 45)", "count(*) FILTER (l_quantity > 45)"),
    "collect_list": ("sort_array(collect_list({n}))", "coalesce(list_sort(list(l_linenumber) FILTER (l_linenumber IS NOT NULL)), [])"), "array_agg": ("sort_array(array_agg({n}))", "coalesce(list_sort(list(l_linenumber) FILTER (l_linenumber IS NOT NULL)), [])"),
    "collect_set": ("sort_array(collect_set({n}))", "coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_linenumber IS NOT NULL)), [])"), "corr": ("round(corr({x}, {y}), 6)", "round(CASE WHEN stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) END, 6)"),
    # the order of a group's rows is not fixed, so these are asked for what all its rows have in common
    **{n: (f"{n}({{k}} * 2)", "any_value(l_orderkey * 2)") for n in ("any_value", "first", "first_value", "last", "last_value")},
    "max_by": ("max_by({n}, struct({y}, {n}))", "arg_max(l_linenumber, struct_pack(a := l_extendedprice, b := l_linenumber))"), "min_by": ("min_by({n}, struct({y}, {n}))", "arg_min(l_linenumber, struct_pack(a := l_extendedprice, b := l_linenumber))"),
    "approx_count_distinct": ("approx_count_distinct({f})", "count(DISTINCT l_returnflag)"),
}
#: Per order from all its lines: population moments, the most frequent value, and percentiles, exact in so small groups.
_MOMENT = "sum(pow(l_quantity - m, {k})) / count(*)"
_BY_MEAN = f"(SELECT l_orderkey, CASE WHEN {_MOMENT.format(k=2)} > 0 THEN {{v}} END v FROM lineitem JOIN (SELECT l_orderkey o, avg(l_quantity) m FROM lineitem GROUP BY 1) ON l_orderkey = o GROUP BY 1)"
_RANKED = "(SELECT l_orderkey, l_quantity v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) r, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem) WHERE r = ceil(n * 0.5))"
_MOST = "(SELECT l_orderkey, v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, v) r FROM (SELECT l_orderkey, l_quantity v, count(*) n FROM lineitem GROUP BY 1, 2)) WHERE r = 1)"
DERIVED = {
    "skewness": ("round(skewness({x}), 4)", _BY_MEAN.format(v=f"round({_MOMENT.format(k=3)} / pow({_MOMENT.format(k=2)}, 1.5), 4)")),
    "kurtosis": ("round(kurtosis({x}), 4)", _BY_MEAN.format(v=f"round({_MOMENT.format(k=4)} / pow({_MOMENT.format(k=2)}, 2) - 3, 4)")),
    "mode": ("mode({x}, true)", _MOST), "approx_percentile": ("approx_percentile({x}, 0.5)", _RANKED), "percentile_approx": ("percentile_approx({x}, 0.5)", _RANKED),
}
for _name, (_spark, _sql) in STATS.items():
    _refs = {"x": "[lineitem].l_quantity", "y": "[lineitem].l_extendedprice", "n": "[lineitem].l_linenumber", "f": "[lineitem].l_returnflag", "k": "[lineitem].l_orderkey"}
    _list = _name in ("collect_list", "collect_set", "array_agg")
    rule(f"agg_{_name}", "orders", [("v", _spark.format(**_refs))], "o_orderkey; concat_ws(',', cast(v as array<string>)) v" if _list else "o_orderkey; v",
         (f"SELECT o_orderkey, array_to_string({_sql}, ',') v FROM {O_L} GROUP BY 1" if _list else f"SELECT o_orderkey, {_sql} v FROM {O_L} GROUP BY 1") if _sql else None)

for _name, (_spark, _sql) in DERIVED.items():
    rule(f"agg_{_name}", "orders", [("v", _spark.format(x="[lineitem].l_quantity"))], "o_orderkey; v", f"SELECT o_orderkey, v FROM orders LEFT JOIN {_sql} ON l_orderkey = o_orderkey")
rule("agg_schema_of_json_agg", "customer", [("v", "schema_of_json_agg([events].props)")], "c_custkey; v", "SELECT c_custkey, CASE WHEN count(event_id) > 0 THEN 'STRUCT<k: BIGINT>' END v FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1", relations=[("[events]-user-[customer]", "[This].user_id = [Related].c_custkey", "M-1")])

# windows
EV = "event_id; "
rule("window_running_sum", "events", [("run", "sum([This].value) OVER (PARTITION BY [This].user_id ORDER BY [This].ts, [This].event_id ROWS UNBOUNDED PRECEDING)")], EV + "round(run, 2) run", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) run FROM events")
rule("window_agg_partition", "events", [("share", "[This].value / sum([This].value) over (partition by [This].event_type)"), ("n", "count(*) over (partition by [This].user_id)")], EV + "round(share, 8) share; n", "SELECT event_id, round(value / sum(value) OVER (PARTITION BY event_type), 8) share, count(*) OVER (PARTITION BY user_id) n FROM events")
rule("window_percentile", "events", [("p", "percentile_cont(0.5) WITHIN GROUP (ORDER BY [This].value) OVER (PARTITION BY [This].event_type)")], EV + "round(p, 6) p", "SELECT event_id, round(p, 6) p FROM events JOIN (SELECT event_type t, quantile_cont(value, 0.5) p FROM events GROUP BY 1) ON event_type = t")
OVER = "OVER (PARTITION BY {t}event_type ORDER BY {t}value, {t}event_id)"
_T, _P = OVER.format(t="[This]."), OVER.format(t="")
rule("window_ranking", "events", [("rn", f"row_number() {_T}"), ("rk", f"rank() {_T}"), ("dr", f"dense_rank() {_T}"), ("nt", f"ntile(4) {_T}"), ("pr", f"percent_rank() {_T}"), ("cd", f"cume_dist() {_T}")], EV + "cast(rn as long) rn; cast(rk as long) rk; cast(dr as long) dr; cast(nt as long) nt; round(pr, 8) pr; round(cd, 8) cd", f"SELECT event_id, row_number() {_P} rn, rank() {_P} rk, dense_rank() {_P} dr, ntile(4) {_P} nt, round(percent_rank() {_P}, 8) pr, round(cume_dist() {_P}, 8) cd FROM events")
rule("window_lag_lead", "events", [("a", f"lag([This].value) {_T}"), ("b", f"lead([This].value, 2) {_T}"), ("c", f"first_value([This].value) {_T}"), ("d", f"nth_value([This].value, 2) {_T}"), ("e", f"last_value([This].value) {_T}")], EV + "a; b; c; d; e", f"SELECT event_id, lag(value) {_P} a, lead(value, 2) {_P} b, first_value(value) {_P} c, nth_value(value, 2) {_P} d, last_value(value) {_P} e FROM events")
rule("window_frame_rows", "events", [("m", "avg([This].value) OVER (PARTITION BY [This].user_id ORDER BY [This].ts, [This].event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")], EV + "round(m, 6) m", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) m FROM events")
rule("window_frame_range", "events", [("n", "count(*) OVER (PARTITION BY [This].user_id ORDER BY [This].ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")], EV + "n", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) n FROM events")
rule("window_over_lookup", "orders", [("rk", "rank() OVER (PARTITION BY [customer].c_mktsegment ORDER BY [This].o_totalprice)")], "o_orderkey; rk", "SELECT o_orderkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice)::INTEGER rk FROM orders LEFT JOIN customer ON o_custkey = c_custkey")

# outputs
out("output_feature_customer", "customer string, line_item_ship_date date, net double",
    [channel("lineitem", "c_name customer; ship_date line_item_ship_date; sum(net_price_int) net", True, filter="[This].l_shipdate BETWEEN timestamp'1996-01-01' AND timestamp'1999-12-31'")],
    "SELECT c_name customer, l_shipdate::DATE line_item_ship_date, round(sum((l_extendedprice - l_tax - l_discount) * 100), 2) net FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1, 2",
    rules={"lineitem": [("net_price_int", "([This].l_extendedprice - [This].l_tax - [This].l_discount)*100"), ("ship_date", "cast([This].l_shipdate as date)"), ("c_name", "[customer].c_name")]}, finish="customer; line_item_ship_date; round(net, 2) net")
out("output_projection", "id long, segment string", [channel("customer", "c_custkey id; [This].c_mktsegment segment")], "SELECT c_custkey id, c_mktsegment segment FROM customer")
out("output_unmapped_null", "id long, nothing int, name string", [channel("nation", "n_nationkey id; n_name name")], "SELECT n_nationkey::BIGINT id, NULL::INTEGER nothing, n_name AS name FROM nation")
out("output_struct_key", "id long, k int, kind string", [channel("nested", "event_id id; s.k k; [This].s.kind.name kind")], "SELECT event_id id, json_extract_string(props, '$.k')::INTEGER k, event_type kind FROM events", frames=_structs)
out("output_struct_key_group", "kind string, n long", [channel("nested", "s.kind.name kind; count(event_id) n", True)], "SELECT event_type kind, count(*) n FROM events GROUP BY 1", frames=_structs)
out("output_filter", "id long", [channel("orders", "o_orderkey id", filter="[This].o_orderpriority LIKE '1%' AND [This].o_totalprice > 1000")], "SELECT o_orderkey id FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 1000")
out("output_filter_on_rule", "id long, net double", [channel("lineitem", "l_orderkey id; net net", filter="[This].net > 50000")], "SELECT l_orderkey id, l_extendedprice * 2 net FROM lineitem WHERE l_extendedprice * 2 > 50000", rules={"lineitem": [("net", "[This].l_extendedprice * 2")]})
out("output_group_by", "flag string, status string, qty double, n long, top double", [channel("lineitem", "l_returnflag flag; l_linestatus status; sum(l_quantity) qty; count(l_orderkey) n; max(l_extendedprice) top", True)], "SELECT l_returnflag flag, l_linestatus status, sum(l_quantity) qty, count(l_orderkey) n, max(l_extendedprice) top FROM lineitem GROUP BY 1, 2")
out("output_agg_distinct", "flag string, supps long, total double", [channel("lineitem", "l_returnflag flag; count(distinct l_suppkey) supps; sum(distinct l_quantity) total", True)], "SELECT l_returnflag flag, count(DISTINCT l_suppkey) supps, sum(DISTINCT l_quantity) total FROM lineitem GROUP BY 1")
out("output_global_agg", "n long, most double", [channel("lineitem", "count(l_orderkey) n; max(l_quantity) most", True)], "SELECT count(l_orderkey) n, max(l_quantity) most FROM lineitem")
UNION = [channel("customer", "c_name name; c_acctbal balance"), channel("supplier", "s_name name; s_acctbal balance; s_suppkey supplier_id")]
out("output_union_channels", "name string, balance double, supplier_id long", UNION, "SELECT c_name AS name, c_acctbal balance, NULL::BIGINT supplier_id FROM customer UNION ALL SELECT s_name, s_acctbal, s_suppkey FROM supplier")
out("output_same_source_twice", "id long, side string", [channel("orders", "o_orderkey id; hi side", filter="[This].o_totalprice > 100000"), channel("orders", "o_orderkey id; o_orderstatus side", filter="[This].o_totalprice <= 100000")], "SELECT o_orderkey id, 'hi' side FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice <= 100000", rules={"orders": [("hi", "'hi'")]})
out("output_multi_channel_agg", "nation_id long, n long", [channel("customer", "c_nationkey nation_id; count(c_custkey) n", True), channel("supplier", "s_nationkey nation_id; count(s_suppkey) n", True)], "SELECT c_nationkey::BIGINT nation_id, count(*) n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey::BIGINT, count(*) FROM supplier GROUP BY 1")
out("output_status_filter", "id long", [channel("orders", "o_orderkey id", include_warn_flag=False)], f"SELECT o_orderkey id FROM orders WHERE {STATUS_SQL} = 'P'", rules={"orders": VALID}, by_status=True)
out("output_declared_casts", "id string, n int, whole long", [channel("customer", "c_custkey id; c_nationkey n; c_custkey whole")], "SELECT c_custkey::VARCHAR id, c_nationkey::INTEGER n, c_custkey whole FROM customer")
out("output_lazy_rules", "id long, c_name string", [channel("lineitem", "l_orderkey id; c_name c_name", filter="[This].l_quantity > 49")], "SELECT l_orderkey id, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 49", rules={"lineitem": [("c_name", "[customer].c_name"), ("unused", "[part].p_name")]}, relations=[("[lineitem]-part-[part]", "[This].l_partkey = [Related].p_partkey", "M-1")], trust_cardinality=True)
out("output_unpivot", "id long, what string, amount double", [channel("lineitem", "l_orderkey id; unpivot_name what; unpivot_value amount", operation_type="Unpivot", unpivot_columns=["l_quantity", "l_extendedprice", "net"], filter="[This].l_returnflag = 'R'")], "SELECT l_orderkey id, what, amount FROM (SELECT l_orderkey, l_quantity, l_extendedprice, l_extendedprice * 2 net FROM lineitem WHERE l_returnflag = 'R') UNPIVOT (amount FOR what IN (l_quantity, l_extendedprice, net))", rules={"lineitem": [("net", "[This].l_extendedprice * 2")]})
out("topk_by_window", "user_id long, event_id long", [channel("events", "user_id user_id; event_id event_id", filter="[This].rn <= 3")], "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) rn FROM events) WHERE rn <= 3", rules={"events": [("rn", "row_number() OVER (PARTITION BY [This].user_id ORDER BY [This].value DESC, [This].event_id)")]})


def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that calls a function of the project, computed on Arrow batches."""

    def tag(names: pd.Series) -> pd.Series:
        return names.str.lower().str[::-1]

    p = _project(spark, sf_dir, {"nation": [("mirrored", "weft_tag([This].n_name)")]})
    p.register_function("weft_tag", F.pandas_udf(tag, "string"))
    return Engine(spark, p).source("nation").select("n_nationkey", "mirrored")


QUERIES["registered_function"] = registered_function
ORACLES["registered_function"] = "SELECT n_nationkey, reverse(lower(n_name)) mirrored FROM nation"


def materialised_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source with rules, read by two paths of another, written once and read."""
    p = _project(spark, sf_dir, {"customer": [("seg", "lower([This].c_mktsegment)"), ("orders_n", "count([orders].o_orderkey)")], "nation": [("builders", "count_if([customer].seg = 'building')"), ("orders_n", "sum([customer].orders_n)")]})
    return Engine(spark, p, materialise=True).source("nation").select("n_nationkey", "builders", "orders_n")


QUERIES["materialised_hub"] = materialised_hub
ORACLES["materialised_hub"] = "SELECT n_nationkey, count(*) FILTER (lower(c_mktsegment) = 'building') builders, sum(n)::BIGINT orders_n FROM nation LEFT JOIN (SELECT c_nationkey, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) n FROM customer) ON c_nationkey = n_nationkey GROUP BY 1"


def stream_static_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of orders enriched by customers, run to its end into files."""
    import uuid

    from weft.sources.folders import shared_folder
    from weft.streaming import enrich_stream

    folder = f"{shared_folder(spark)}/weft-stream-{uuid.uuid4().hex}"
    customer = {"source_name": "customer", "frame": spark.read.parquet(f"{sf_dir}/customer.parquet"), "raw_attributes": _columns(COLUMNS["customer"])}
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "orders.parquet").load(sf_dir)
    rules = [{"name": "c_name", "expression": "[customer].c_name"}, {"name": "big", "expression": "[This].o_totalprice > 100000"}]
    orders = {"source_name": "orders", "frame": stream, "processing_type": "stream", "raw_attributes": _columns(COLUMNS["orders"]), "rules": rules}
    engine = Engine(spark, Project.of([customer, orders], [{"name": n, "expression": e, "cardinality": c} for n, e, c in RELATIONS[1:2]]))
    rows = enrich_stream(engine, "orders", stream).select("o_orderkey", "c_name", "big")
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


QUERIES["stream_static_lookup"] = stream_static_lookup
ORACLES["stream_static_lookup"] = "SELECT o_orderkey, c_name, o_totalprice > 100000 big FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def build_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources and an output written as files; the output read back."""
    import uuid

    from weft.sources.folders import shared_folder

    spec = {"output_name": "feature", "columns": ["customer string", "n long"], "channels": [channel("orders", "c_name customer; count(o_orderkey) n", True)]}
    sources = [
        {"source_name": "orders", "frame": spark.read.parquet(f"{sf_dir}/orders.parquet"), "raw_attributes": _columns(COLUMNS["orders"]), "rules": [{"name": "c_name", "expression": "[customer].c_name"}]},
        {"source_name": "customer", "frame": spark.read.parquet(f"{sf_dir}/customer.parquet"), "raw_attributes": _columns(COLUMNS["customer"])},
    ]
    engine = Engine(spark, Project.of(sources, [{"name": n, "expression": e, "cardinality": c} for n, e, c in RELATIONS[1:2]], [spec]))
    folder = f"{shared_folder(spark)}/weft-build-{uuid.uuid4().hex}"
    engine.build(folder)
    return spark.read.parquet(f"{folder}/feature")


QUERIES["output_write"] = build_and_read
ORACLES["output_write"] = "SELECT c_name customer, count(*) n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["output_feature_customer"](spark, sf_dir)

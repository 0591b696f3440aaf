"""Registered queries for what the engine decides on the driver: small tables, each with what is expected as SQL.

What tables hold (types, measures that could be, tallies) is held against SQL over the tables
themselves; decisions (refusals, windows, tiers...) against values that are written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import Engine, close
from plumbline.errors import EXIT_STATUS, Refusal
from plumbline.functions import sqlexpr
from plumbline.loader import from_dict
from plumbline.model import Column, Principal, Source
from plumbline.operators import ingestion, knowledge, retrieval
from plumbline.plans import catalog, joins, trust
from plumbline.plans.finality import watermark
from plumbline.sources import catalog as relations

Rows = Callable[[SparkSession, str], Iterable[tuple]]


def _value(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def decided(name: str, schema: str, expected: list[tuple] | str) -> Callable[[Rows], Rows]:
    """Registers rows made on the driver; expected: the rows, or SQL for them."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def wrap(rows: Rows) -> Rows:
        catalog.QUERIES[name] = lambda spark, d: spark.createDataFrame([tuple(r) for r in rows(spark, d)], schema)
        told = expected if isinstance(expected, str) else f"VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in expected)}"
        catalog.ORACLE_SQL[name] = told if isinstance(expected, str) else f"SELECT * FROM ({told}) AS t({', '.join(columns)})"
        return rows

    return wrap


def _code(call: Callable[[], Any]) -> str:
    try:
        call()
    except Refusal as refusal:
        return refusal.code
    return "answered"


_MORE = {
    "metrics": [
        {"metric": "basket_average", "canonical": {"source": "baskets", "measure": "average_price"}},
        {"metric": "nested", "canonical": {"kind": "ratio", "numerator": "price_per_order", "denominator": "order_count"}},
        {"metric": "basket_median", "canonical": {"kind": "percentile", "source": "baskets", "column": "o_totalprice"}},
    ],
    "guardrails": [
        {"id": "by-status", "kind": "required_dimension", "applies_to": {"metric": "open_orders"}, "dimension": "o_orderstatus"},
        {"id": "by-type", "kind": "required_dimension", "applies_to": {"metric": "event_count"}, "dimension": "event_type", "severity": "warn"},
        {"id": "trusted", "kind": "min_trust", "applies_to": {"metric": "quantity"}, "level": "trusted", "context": "board"},
    ],
}


def _asked(spark: SparkSession, sf_dir: str, *parts: dict, principal: Principal | None = None, **query: Any) -> str:
    return _code(lambda: catalog.engine(spark, sf_dir, *parts).query(query, principal))


@decided("refusals", "asked string, code string", [
    ("a metric that isn't there", "unresolved"), ("an alias that is taken", "validation_failed"), ("a dimension of two roles", "ambiguous"), ("a dimension out of reach", "unreachable"),
    ("a filter that can't be read", "validation_failed"), ("no metric", "validation_failed"), ("an operator that isn't known", "validation_failed"), ("a mean behind a fan-out", "fanout_unsafe"),
    ("a percentile behind a fan-out", "fanout_unsafe"), ("a ratio of ratios", "unsupported_measure"), ("a look-up by another grain", "unsupported_measure"), ("without a required dimension", "guardrail_block"),
    ("with the required dimension", "answered"), ("filtered on the required dimension", "answered"), ("a required dimension that only warns", "answered"), ("too little trust", "guardrail_block"),
    ("too little trust in another context", "answered"), ("no tenant", "tenant_unresolved"), ("SQL without the right", "tenant_forbidden"), ("SQL that writes", "read_only_violation"), ("SQL on another table", "read_only_violation"),
])
def _refusals(spark: SparkSession, d: str) -> Iterable[tuple]:
    ask = lambda *parts, **query: _asked(spark, d, *parts, **query)
    sql = lambda text, roles: _code(lambda: catalog.engine(spark, d, catalog.TENANTS).run_sql(text, Principal({"roles": roles, "segment": "BUILDING"})))
    yield "a metric that isn't there", ask(metrics=["nothing"])
    yield "an alias that is taken", ask({"metrics": [{"metric": "Net Revenue", "canonical": {"source": "orders", "measure": "revenue"}}]}, metrics=["revenue"])
    yield "a dimension of two roles", ask(metrics=["quantity"], dimensions=["n_name"])
    yield "a dimension out of reach", ask(metrics=["revenue"], dimensions=["p_brand"])
    yield "a filter that can't be read", ask(metrics=["revenue"], filters=["o_orderstatus ="])
    yield "no metric", ask(dimensions=["o_orderstatus"])
    yield "an operator that isn't known", ask(metrics=["revenue"], filters=[{"field": "o_orderstatus", "op": "~", "value": "F"}])
    yield "a mean behind a fan-out", ask(_MORE, metrics=["basket_average"], dimensions=["l_returnflag"])
    yield "a percentile behind a fan-out", ask(_MORE, metrics=["basket_median"], dimensions=["l_returnflag"])
    yield "a ratio of ratios", ask(_MORE, metrics=["nested"])
    yield "a look-up by another grain", ask(metrics=["account_balance"], dimensions=["c_mktsegment"])
    yield "without a required dimension", ask(_MORE, metrics=["open_orders"])
    yield "with the required dimension", ask(_MORE, metrics=["open_orders"], dimensions=["o_orderstatus"])
    yield "filtered on the required dimension", ask(_MORE, metrics=["open_orders"], filters=["o_orderstatus = 'O'"])
    yield "a required dimension that only warns", ask(_MORE, metrics=["event_count"])
    yield "too little trust", ask(_MORE, metrics=["quantity"], context="board")
    yield "too little trust in another context", ask(_MORE, metrics=["quantity"], context="desk")
    yield "no tenant", ask(catalog.TENANTS, metrics=["customer_count"])
    yield "SQL without the right", sql("select 1", ["plain"])
    yield "SQL that writes", sql("drop table orders", ["sql"])
    yield "SQL on another table", sql("select * from secrets", ["sql"])


_WINDOWS = [
    ("o_orderdate <= '1999-01-01'", True), ("o_orderdate <= '2001-01-01'", False), ("o_orderdate between '1998-01-01' and '2001-01-01'", False), ("o_orderdate between '1998-01-01' and '1999-01-01'", True),
    ("o_orderdate <= timestamp_ntz '2001-01-01'", False), ("'2001-01-01' >= o_orderdate", False), ("o_orderdate <= '1999-01-01' and o_orderdate <= '2001-01-01'", True), ("o_orderdate >= '2001-01-01'", False),
    ("o_orderdate >= '1998-01-01'", True), ("o_orderdate = date '2001-01-01'", False), ("o_orderdate < '1999-01-01' or o_orderdate < '2001-01-01'", False), ("not o_orderdate > '2001-01-01'", False), ("o_orderstatus = 'F'", True),
]


@decided("final_windows", "filter string, allowed boolean", _WINDOWS)
def _windows(spark: SparkSession, d: str) -> Iterable[tuple]:
    final = {"guardrails": [{"id": "final", "kind": "restrict_source", "applies_to": {"metric": "settled_revenue"}, "restrict_to": {"role": "final"}, "context": "board"}]}
    for text, _ in _WINDOWS:
        yield text, _asked(spark, d, final, metrics=["settled_revenue"], filters=[text], context="board", as_of=catalog.AS_OF) == "answered"


@decided("watermarks", "expr string, as_of string, until string", [
    ("business_day", "2025-03-14T12:00:00", "2025-03-14T23:59:59-04:00"), ("business_day", "2025-03-15T12:00:00", "2025-03-14T23:59:59-04:00"), ("business_day - 1 day", "2025-03-17T12:00:00", "2025-03-14T23:59:59-04:00"),
    ("business_day - 3 days", "2025-03-14T12:00:00", "2025-03-11T23:59:59-04:00"), ("business_day + 1 day", "2025-03-14T12:00:00", "2025-03-14T23:59:59-04:00"), ("business_day", "2025-01-06T12:00:00", "2025-01-06T23:59:59-05:00"),
])
def _watermarks(spark: SparkSession, d: str) -> Iterable[tuple]:
    for expr, at in (("business_day", "2025-03-14"), ("business_day", "2025-03-15"), ("business_day - 1 day", "2025-03-17"), ("business_day - 3 days", "2025-03-14"), ("business_day + 1 day", "2025-03-14"), ("business_day", "2025-01-06")):
        yield expr, f"{at}T12:00:00", watermark(expr, "America/New_York", f"{at}T12:00:00").isoformat()


_TYPES = "CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'json' END"
_NAMES = (*catalog.TABLES, "embeddings")
_COLUMNS = f"(SELECT table_name AS relation, column_name AS name, {_TYPES} AS type, data_type FROM information_schema.columns WHERE table_name IN {_NAMES})"


def _relations(spark: SparkSession, d: str) -> dict[str, list[Column]]:
    return {t: relations.introspect(spark.read.parquet(f"{d}/{t}.parquet"))[0] for t in _NAMES}


@decided("table_columns", "relation string, name string, type string", f"SELECT relation, name, type FROM {_COLUMNS}")
def _columns(spark: SparkSession, d: str) -> Iterable[tuple]:
    return [(t, c.name, c.type) for t, columns in _relations(spark, d).items() for c in columns]


_IS_KEY = "regexp_matches(name, '(^|_)(id|key|fk|pk)$', 'i')"


@decided("inferred_measures", "relation string, measure string, expr string", f"""SELECT relation, 'total_' || name AS measure, 'sum(' || name || ')' AS expr FROM {_COLUMNS}
WHERE type IN ('int', 'float') AND NOT {_IS_KEY} UNION ALL SELECT DISTINCT relation, 'row_count', 'count(*)' FROM {_COLUMNS}""")  # fmt: skip
def _inferred_measures(spark: SparkSession, d: str) -> Iterable[tuple]:
    return [(t, m["name"], m["expr"]) for t, columns in _relations(spark, d).items() for m in ingestion.measures(ingestion.Relation(t, tuple(columns)))]


@decided("inferred_dimensions", "relation string, dimension string", f"SELECT relation, name AS dimension FROM {_COLUMNS} WHERE type = 'timestamp' OR type = 'string' AND NOT {_IS_KEY}")
def _inferred_dimensions(spark: SparkSession, d: str) -> Iterable[tuple]:
    return [(t, m["name"]) for t, columns in _relations(spark, d).items() for m in ingestion.dimensions(ingestion.Relation(t, tuple(columns)))]


@decided("relative_dates", "written string, day date", """SELECT * FROM (VALUES ('DATE(''now'')', current_date), ('DATE(''now'', ''-3 months'', ''start of month'')', date_trunc('month', current_date - INTERVAL 3 MONTH)::DATE),
  ('DATE(''now'', ''start of year'', ''+1 day'')', (date_trunc('year', current_date) + INTERVAL 1 DAY)::DATE), ('DATE(''now'', ''start of quarter'')', date_trunc('quarter', current_date)::DATE)) AS t(written, day)""")  # fmt: skip
def _relative(spark: SparkSession, d: str) -> Iterable[tuple]:
    texts = ["DATE('now')", "DATE('now', '-3 months', 'start of month')", "DATE('now', 'start of year', '+1 day')", "DATE('now', 'start of quarter')"]
    row = spark.range(1).select(*[F.expr(sqlexpr.dates(t)).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    return list(zip(texts, row))


_FLAGS = {"o_orderstatus:IN:F,O": "o_orderstatus IN ('F', 'O')", "o_totalprice>=1000": "o_totalprice >= 1000", "o_orderpriority!=5-LOW": "o_orderpriority <> '5-LOW'", "o_orderpriority:LIKE:1%": "o_orderpriority LIKE '1%'"}


@decided("flag_filters", "flag string, kept long", " UNION ALL ".join(f"SELECT {_value(k)} AS flag, count(*) AS kept FROM orders WHERE {v}" for k, v in _FLAGS.items()))
def _flags(spark: SparkSession, d: str) -> Iterable[tuple]:
    engine = catalog.engine(spark, d)
    return [(k, engine.query({"metrics": ["order_count"], "filters": [sqlexpr.parse_flag(k)]}).df.first()[0]) for k in _FLAGS]


@decided("finality_tally", "role string, answers long", """SELECT CASE WHEN o_orderdate <= TIMESTAMP '1999-06-16 03:59:59' THEN 'final' ELSE 'provisional' END AS role,
  count(DISTINCT date_trunc('year', o_orderdate)) AS answers FROM orders GROUP BY 1""")  # fmt: skip
def _tally(spark: SparkSession, d: str) -> Iterable[tuple]:
    planned = catalog.engine(spark, d).query({"metrics": ["settled_revenue"], "dimensions": ["order_year"], "as_of": catalog.AS_OF})
    return list(planned.finality_rows().items())


@decided("result_sets", "asked long, columns string, given long, truncated boolean", "SELECT * FROM (SELECT n AS asked, 'c_mktsegment:string customer_count:int' AS columns, least(n, k) AS given, k > n AS truncated FROM (SELECT unnest([2, 100]) AS n), (SELECT count(DISTINCT c_mktsegment) AS k FROM customer))")
def _result_sets(spark: SparkSession, d: str) -> Iterable[tuple]:
    planned = catalog.engine(spark, d).query({"metrics": ["customer_count"], "dimensions": ["c_mktsegment"]})
    for n in (2, 100):
        told = planned.to_result_set(n)
        yield n, " ".join(f"{c['name']}:{c['type']}" for c in told["columns"]), len(told["rows"]), told["truncated"]


@decided("report_sections", "title string, given long, error string", "SELECT * FROM (VALUES ('gone', NULL, 'unresolved'), ('kept', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'), NULL)) AS t(title, given, error)")
def _sections(spark: SparkSession, d: str) -> Iterable[tuple]:
    sections = [{"title": "kept", "query": {"metrics": ["customer_count"]}}, {"title": "gone", "query": {"metrics": ["nothing"]}}]
    for s in catalog.engine(spark, d).report(sections, ("c_mktsegment = 'BUILDING'",)):
        yield s["title"], s["result"]["rows"][0][0] if "result" in s else None, s["error"]["code"] if "error" in s else None


@decided("report_checks", "report string, code string", [("sound", "answered"), ("another metric", "validation_failed"), ("another page", "validation_failed"), ("a filter out of reach", "validation_failed")])
def _report_checks(spark: SparkSession, d: str) -> Iterable[tuple]:
    engine = catalog.engine(spark, d, catalog.TENANTS)
    section = {"query": {"metrics": ["customer_count"]}, "narrative_from": "intro"}
    check = lambda *args, **more: _code(lambda: engine.check_report("r", *args, pages=("intro",), **more))
    yield "sound", check([section])
    yield "another metric", check([section, {"query": {"metrics": ["nothing"]}}])
    yield "another page", check([{**section, "narrative_from": "gone"}])
    yield "a filter out of reach", check([section], filters=("p_brand = 'x'",))


@decided("assertions", "id string, passed boolean", [("right", True), ("wrong", False), ("refused", False)])
def _assertions(spark: SparkSession, d: str) -> Iterable[tuple]:
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    made = [{"id": i, "query": {"metrics": [m]}, "expect": {"rows": 1, "values": {m: v}, "tolerance": 0.001}} for i, m, v in (("right", "customer_count", n), ("wrong", "customer_count", n * 2), ("refused", "nothing", 1))]
    return [(r["id"], r["passed"]) for r in catalog.engine(spark, d, {"assertions": made}).check_assertions()["results"]]


@decided("close_values", "found double, wanted double, tolerance double, near boolean", [(100.5, 100.0, 0.01, True), (102.0, 100.0, 0.01, False), (0.001, 0.0, 0.01, True), (None, None, 0.0, True), (None, 1.0, 0.5, False)])
def _close(spark: SparkSession, d: str) -> Iterable[tuple]:
    return [(a, b, t, close(a, b, t)) for a, b, t in ((100.5, 100.0, 0.01), (102.0, 100.0, 0.01), (0.001, 0.0, 0.01), (None, None, 0.0), (None, 1.0, 0.5))]


@decided("trust_tiers", "signals string, tier string", [("", "trusted"), ("provisional", "provisional"), ("provisional,caution", "caution"), ("provisional rows", "provisional"), ("stale", "provisional"), ("wrong", "caution")])
def _tiers(spark: SparkSession, d: str) -> Iterable[tuple]:
    for given in ((), ("provisional",), ("provisional", "caution")):
        yield ",".join(given), trust.score([(t, "why") for t in given])[0]
    yield "provisional rows", trust.score(trust.served_signals(3))[0]
    yield "stale", trust.score(trust.served_signals(stale=("a",)))[0]
    yield "wrong", trust.score(trust.served_signals(2, ("a",), ("m",)))[0]


@decided("error_codes", "code string, status int", [("unresolved", 2), ("ambiguous", 3), ("guardrail_block", 8), ("read_only_violation", 11), ("connection_error", 13), ("tenant_forbidden", 24)])
def _codes(spark: SparkSession, d: str) -> Iterable[tuple]:
    return [(c, EXIT_STATUS[c]) for c in ("unresolved", "ambiguous", "guardrail_block", "read_only_violation", "connection_error", "tenant_forbidden")]


@decided("reachable", "owner string, dimension string", [
    ("customer", "c_custkey"), ("customer", "c_mktsegment"), ("customer", "n_name"), ("customer", "r_name"), ("nation", "n_name"), ("nation", "r_name"),
    ("supplier", "n_name"), ("supplier", "r_name"), ("supplier", "s_name"), ("baskets", "l_returnflag"), ("baskets", "o_orderdate"), ("baskets", "o_orderkey"),
    ("baskets", "o_orderpriority"), ("baskets", "o_orderstatus"), ("baskets", "order_month"), ("baskets", "order_year"),
])
def _reachable(spark: SparkSession, d: str) -> Iterable[tuple]:
    sources = catalog.project().sources
    return [(s, n) for s in ("customer", "nation", "supplier", "baskets") for n in joins.reachable_dimensions(s, sources)]


@decided("join_paths", "target string, way string", [("customer", "lineitem_order > customer"), ("part", "part"), ("region", "ambiguous_join_path"), ("region via supplier", "supplier > supplier_nation > region"), ("events", "unreachable")])
def _paths(spark: SparkSession, d: str) -> Iterable[tuple]:
    sources = catalog.project().sources

    def way(target: str, via: tuple[str, ...] = ()) -> str:
        try:
            return " > ".join(e.alias for e in joins.plan("lineitem", {target}, sources, via))
        except Refusal as refusal:
            return refusal.code

    return [*((t, way(t)) for t in ("customer", "part", "region", "events")), ("region via supplier", way("region", ("supplier",)))]


@decided("listed_metrics", "metric string, kind string", [("average_discount", "weighted_avg"), ("buyers", "distinct_count"), ("last_level", "semi_additive"), ("median_price", "percentile"), ("price_per_order", "ratio"), ("revenue", "single")])
def _listed(spark: SparkSession, d: str) -> Iterable[tuple]:
    shown = {m["metric"]: m["kind"] for m in catalog.engine(spark, d).list_metrics()}
    assert "account_balance" not in shown  # look-ups aren't listed
    return [(m, shown[m]) for m in ("average_discount", "buyers", "last_level", "median_price", "price_per_order", "revenue")]


@decided("described_metric", "field string, told string", [("aliases", "net revenue"), ("guardrails", "no-pending"), ("kind", "single"), ("sources", "orders"), ("tier", "provisional")])
def _described(spark: SparkSession, d: str) -> Iterable[tuple]:
    told = catalog.engine(spark, d, catalog.GUARDED).describe_metric("safe_revenue")
    return [(k, ",".join(told[k]) if isinstance(told[k], list) else told[k]) for k in ("aliases", "guardrails", "kind", "sources", "tier")]


@decided("declared_columns", "what string, told string", [("as declared", "b"), ("another type", "schema_mismatch"), ("a column is gone", "schema_mismatch"), ("unknown connection", "connection_error"), ("by schema and pattern", "m.orders")])
def _declared(spark: SparkSession, d: str) -> Iterable[tuple]:
    df = spark.sql("select 1 a, 'x' b")
    source = lambda *columns: Source("s", "s", columns=columns)
    yield "as declared", ",".join(relations.probe(source(Column("a", "int")), df))
    yield "another type", _code(lambda: relations.probe(source(Column("a", "string")), df))
    yield "a column is gone", _code(lambda: relations.probe(source(Column("z", "int")), df))
    yield "unknown connection", _code(lambda: relations.read(spark, {}, "x", "t"))
    yield "by schema and pattern", ",".join(relations.select_relations(["m.orders", "m.x", "n.orders"], ("m",), ("ord*",)))


_DDL = 'CREATE TABLE m.t (id BIGINT PRIMARY KEY, "name" VARCHAR(10) NOT NULL, price NUMERIC(8,2), at TIMESTAMP, x BLOB)'


@decided("ddl_columns", "name string, type string, nullable boolean", [("id", "int", False), ("name", "string", False), ("price", "decimal", True), ("at", "timestamp", True), ("x", "json", True)])
def _ddl(spark: SparkSession, d: str) -> Iterable[tuple]:
    return [(c.name, c.type, c.nullable) for c in relations.from_ddl(_DDL)["m.t"][0]]


@decided("reconciled", "what string, action string, applied boolean", [
    ("new", "add", False), ("a person's", "contradiction", False), ("inferred", "edit", False), ("inferred, sure", "edit", True), ("inferred, grain", "edit", False), ("same", "no_op", False), ("frozen", "no_op", False), ("gone", "prune", False),
])
def _reconciled(spark: SparkSession, d: str) -> Iterable[tuple]:
    new = ingestion.propose(ingestion.Relation("t", (Column("id", "int"), Column("price", "float")), ("id",)))
    old, other = {**new, "meta": {"provenance": "human_curated"}, "description": "x"}, {**new, "description": "x"}
    cases = [("new", {}, new, {}), ("a person's", old, new, {}), ("inferred", other, new, {}), ("inferred, sure", other, new, {"auto_apply": True, "confidence": {"t": 0.96}}),
             ("inferred, grain", {**new, "grain": []}, new, {"auto_apply": True, "confidence": {"t": 1.0}}), ("same", new, new, {}), ("frozen", old, new, {"frozen": ["t"]}), ("gone", new, None, {})]
    for case, before, after, options in cases:
        (made,) = ingestion.reconcile({"t": before} if before else {}, {"t": after} if after else {}, **options)
        yield case, made.action, made.applied


@decided("contradiction_notes", "page string, body string", [("contradiction-t", "t differs from what a person declared (description).")])
def _notes(spark: SparkSession, d: str) -> Iterable[tuple]:
    new = ingestion.propose(ingestion.Relation("t", (Column("id", "int"),), ("id",)))
    old = {"t": {**new, "meta": {"provenance": "human_curated"}, "description": "x"}, "u": new}
    return [(p.id, p.body) for p in ingestion.notes(ingestion.reconcile(old, {"t": new, "u": new, "v": new}))]


@decided("knowledge_pages", "what string, told string", [("around a", "a,b,c"), ("one step", "a,b"), ("drifted", "m"), ("stale", "a"), ("broken", "c: page d is gone;c: x is no definition"), ("pruned", "m"), ("rendered", "is 5 of {{ sl:z }}")])
def _knowledge(spark: SparkSession, d: str) -> Iterable[tuple]:
    now = datetime(2025, 1, 10)
    made = [knowledge.Page("a", refs=("b",), fingerprints=(("m", "1"), ("n", "2"))), knowledge.Page("b", refs=("c",), validated=now), knowledge.Page("c", refs=("d",), sl_refs=("m", "x"), validated=now)]
    pages = {p.id: p for p in made}
    yield "around a", ",".join(knowledge.expand(pages, "a"))
    yield "one step", ",".join(knowledge.expand(pages, "a", 1))
    yield "drifted", ",".join(knowledge.drifted(pages["a"], {"m": "9", "n": "2"}))
    yield "stale", ",".join(i for i, p in pages.items() if knowledge.stale(p, now, timedelta(days=7)))
    yield "broken", ";".join(knowledge.broken(pages, {"m"}))
    yield "pruned", ",".join(knowledge.pruned(pages, {"m"})["c"].sl_refs)
    yield "rendered", knowledge.rendered("is {{ sl:a.b }} of {{ sl:z }}", {"a.b": "5"}.get)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: a scope, a tag and a reference that follow from the id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scope = F.when(F.col("doc_id") % 4 > 0, "global").otherwise(F.when(F.col("doc_id") % 8 == 0, "me").otherwise("you"))
    return docs.select(
        F.floor(F.col("doc_id") / 4).cast("string").alias("page_id"), scope.alias("scope"), F.array(F.col("lang")).alias("tags"), F.col("source").alias("body"),
        F.array(F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string"))).alias("refs"), (F.col("doc_id") % 5 == 0).alias("is_caveat"),
    ).filter(F.col("doc_id") % 4 < 2)


_PAGES = """p AS (SELECT (doc_id // 4)::VARCHAR AS page_id, CASE WHEN doc_id % 4 > 0 THEN 'global' WHEN doc_id % 8 = 0 THEN 'me' ELSE 'you' END AS scope, lang, source AS body,
  'r' || (doc_id % 7) AS ref, doc_id % 5 = 0 AS is_caveat FROM documents WHERE doc_id % 4 < 2)"""
catalog.QUERIES["visible_pages"] = lambda spark, d: retrieval.visible(_pages(spark, d), "me", ["en", "fr"]).select("page_id", "scope", "annotation")
catalog.ORACLE_SQL["visible_pages"] = f"""WITH {_PAGES}, v AS (SELECT * FROM p WHERE scope IN ('global', 'me') AND lang IN ('en', 'fr')), g AS (SELECT * FROM v WHERE scope = 'global'), m AS (SELECT * FROM v WHERE scope = 'me')
SELECT g.page_id, g.scope, m.body AS annotation FROM g LEFT JOIN m ON g.page_id = m.page_id UNION ALL SELECT page_id, scope, NULL FROM m WHERE page_id NOT IN (SELECT page_id FROM g)"""


def _caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).filter("scope = 'global'")
    return retrieval.caveats(pages.filter("page_id = '1'"), pages, 3).withColumn("triggered_by", F.array_join("triggered_by", ","))


catalog.QUERIES["caveat_pages"] = _caveats
catalog.ORACLE_SQL["caveat_pages"] = f"WITH {_PAGES}, g AS (SELECT * FROM p WHERE scope = 'global') SELECT page_id, string_agg(DISTINCT ref, ',' ORDER BY ref) AS triggered_by FROM g WHERE is_caveat AND page_id <> '1' AND ref IN (SELECT ref FROM g WHERE page_id = '1') GROUP BY 1 ORDER BY page_id LIMIT 3"


@decided("semantic_yaml", "what string, told string", [("sources", "s"), ("grain", "id"), ("metrics", "m"), ("a type that isn't known", "validation_failed"), ("a column that isn't there", "validation_failed"), ("no expression", "validation_failed")])
def _yaml(spark: SparkSession, d: str) -> Iterable[tuple]:
    source = {"name": "s", "grain": ["id"], "columns": [{"name": "id", "type": "int"}], "measures": [{"name": "n", "expr": "count(*)"}], "dimensions": [{"name": "id", "column": "id"}]}
    made = from_dict({"sources": [source], "metrics": [{"metric": "m", "canonical": {"source": "s", "measure": "n"}}]})
    yield "sources", ",".join(made.sources)
    yield "grain", ",".join(made.sources["s"].grain)
    yield "metrics", ",".join(b.metric for b in made.bindings)
    for what, change in (("a type that isn't known", {"columns": [{"name": "id", "type": "money"}]}), ("a column that isn't there", {"dimensions": [{"name": "x", "column": "x"}]}), ("no expression", {"measures": [{"name": "n"}]})):
        yield what, _code(lambda change=change: from_dict({"sources": [{**source, **change}]}))


@decided("compiled_only", "node string, planned boolean", [("Scan parquet", True), ("HashAggregate", True), ("PushedFilters: [IsNotNull(o_orderstatus)", True)])
def _compiled(spark: SparkSession, d: str) -> Iterable[tuple]:
    plan = Engine(spark, catalog.project(), catalog.tables(spark, d)).explain({"metrics": ["order_count"], "filters": ["o_orderstatus = 'F'"]})
    return [(n, n in plan) for n in ("Scan parquet", "HashAggregate", "PushedFilters: [IsNotNull(o_orderstatus)")]

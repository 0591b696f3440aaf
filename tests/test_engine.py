"""Planning and refusals over small tables made here."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.engine import Engine, close
from plumbline.errors import EXIT_STATUS, Refusal
from plumbline.functions.sqlexpr import parse_flag
from plumbline.loader import from_dict
from plumbline.model import Principal
from plumbline.plans import compose
from plumbline.plans.finality import watermark


def cols(text):
    return [{"name": n, "type": t} for n, t in (x.split(":") for x in text.split())]


ORDERS = {
    "name": "sales", "grain": ["sale_id"], "columns": cols("sale_id:string client_id:string status:string price:decimal sold_at:timestamp"),
    "measures": [{"name": "price_sum", "expr": "sum(price)"}, {"name": "sale_count", "expr": "count(*)"},
                 {"name": "exact_sales", "expr": "count(distinct sale_id)", "additivity": "non_additive"}, {"name": "odd", "expr": "avg(price)"}],
    "dimensions": [{"name": "sold_on", "column": "sold_at", "granularity": "day"}, {"name": "status", "column": "status"}],
    "joins": [{"to": "clients", "on": "sales.client_id = clients.client_id"}, {"to": "articles_sold", "on": "sales.sale_id = articles_sold.sale_id", "relationship": "one_to_many"}],
}
LIVE = {**ORDERS, "name": "sales_live", "joins": ORDERS["joins"][:1]}
LIVE["joins"] = [{"to": "clients", "on": "sales_live.client_id = clients.client_id"}]
PROJECT = {
    "sources": [
        ORDERS, LIVE,
        {"name": "clients", "grain": ["client_id"], "columns": cols("client_id:string area:string"), "dimensions": [{"name": "area", "column": "area"}], "measures": [{"name": "client_count", "expr": "count(*)"}]},
        {"name": "articles_sold", "grain": ["line_id"], "columns": cols("line_id:string sale_id:string article:string quantity:decimal"), "dimensions": [{"name": "article", "column": "article"}],
         "measures": [{"name": "pieces", "expr": "sum(quantity)"}], "joins": [{"to": "sales_of", "on": "articles_sold.sale_id = sales_of.sale_id"}]},
        {"name": "sales_of", "table": "sales", "grain": ["sale_id"], "columns": ORDERS["columns"], "joins": [{"to": "buyers", "on": "sales_of.client_id = buyers.client_id"}]},
        {"name": "buyers", "table": "clients", "grain": ["client_id"], "columns": cols("client_id:string area:string"), "dimensions": [{"name": "buyer_area", "column": "area"}]},
        {"name": "levels", "grain": ["item", "day"], "columns": cols("item:string day:date level:int"), "measures": [{"name": "level", "expr": "sum(level)"}],
         "dimensions": [{"name": "day", "column": "day"}, {"name": "item", "column": "item"}]},
    ],
    "metrics": [
        {"metric": "takings", "aliases": ["top", "net takings"], "canonical": {"source": "sales", "measure": "price_sum"}},
        {"metric": "sales_n", "canonical": {"source": "sales", "measure": "sale_count"}},
        {"metric": "exact_sales_n", "canonical": {"source": "sales", "measure": "exact_sales"}},
        {"metric": "odd", "canonical": {"source": "sales", "measure": "odd"}},
        {"metric": "units", "canonical": {"source": "articles_sold", "measure": "pieces"}},
        {"metric": "clients_n", "canonical": {"source": "clients", "measure": "client_count"}},
        {"metric": "aov", "canonical": {"kind": "ratio", "numerator": "takings", "denominator": "sales_n"}},
        {"metric": "nested", "canonical": {"kind": "ratio", "numerator": "aov", "denominator": "sales_n"}},
        {"metric": "median", "canonical": {"kind": "percentile", "source": "sales", "column": "price"}},
        {"metric": "buyers_n", "canonical": {"kind": "distinct_count", "source": "sales", "distinct_on": "client_id"}},
        {"metric": "level_of", "canonical": {"kind": "opaque", "source": "levels", "measure": "level", "native_grain": ["item", "day"]}},
        *({"metric": f"{a}_level", "canonical": {"kind": "semi_additive", "source": "levels", "measure": "level", "collapse_dimension": "day", "collapse_agg": a}} for a in ("last", "first", "avg", "min", "max")),
    ],
}


@pytest.fixture(scope="module")
def tables(spark):
    at = lambda d, h=12: dt.datetime(2025, 3, d, h)
    sales = [("o1", "c1", "completed", Decimal("10.50"), at(3)), ("o2", "c1", "refunded", Decimal("5.00"), at(4)), ("o3", "c2", "completed", Decimal("20.00"), at(5)),
              ("o4", "c3", None, None, at(13)), ("o5", "c2", "completed", Decimal("1.00"), at(14))]
    items = [("i1", "o1", "a", 1), ("i2", "o1", "b", 2), ("i3", "o2", "a", 3), ("i4", "o3", "b", 4), ("i5", "o3", "b", 5)]
    kind = "sale_id string, client_id string, status string, price decimal(12,2), sold_at timestamp"
    day = lambda d: dt.date(2025, 1, d)
    return {
        "sales": spark.createDataFrame(sales, kind), "sales_live": spark.createDataFrame(sales, kind),
        "clients": spark.createDataFrame([("c1", "east"), ("c2", "north"), ("c3", "west")], "client_id string, area string"),
        "articles_sold": spark.createDataFrame(items, "line_id string, sale_id string, article string, quantity int"),
        "levels": spark.createDataFrame([("x", day(1), 5), ("x", day(2), 7), ("y", day(1), 1), ("y", day(3), 4)], "item string, day date, level int"),
    }


@pytest.fixture(scope="module")
def make(spark, tables):
    def build(**parts):
        given = {k: list(v) for k, v in PROJECT.items()}
        for k, v in parts.items():
            given[k] = given.get(k, []) + v
        return Engine(spark, from_dict(given), tables)

    return build


@pytest.fixture(scope="module")
def engine(make):
    return make()


def rows(planned):
    return sorted((tuple(r) for r in planned.df.collect()), key=str)


def ask(engine, *metrics, by=(), where=(), principal=None, **more):
    return engine.query({"metrics": metrics, "dimensions": by, "filters": where, **more}, principal)


def refused(code, call, *args, **kwargs):
    with pytest.raises(Refusal) as caught:
        call(*args, **kwargs)
    assert caught.value.code == code and caught.value.exit_status == EXIT_STATUS[code]
    return caught.value


def test_codes():
    assert (EXIT_STATUS["unresolved"], EXIT_STATUS["connection_error"], EXIT_STATUS["tenant_forbidden"]) == (2, 13, 24)


def test_names(engine):
    assert ask(engine, "TOP").resolved == {"TOP": "takings"}
    assert "takings" in refused("unresolved", ask, engine, "taking", "nothing").candidates
    assert "area" in refused("unreachable", ask, engine, "takings", by=["areas"]).candidates
    refused("unreachable", ask, engine, "takings", where=["nowhere = 1"])
    refused("validation_failed", ask, engine, "takings", where=["status ="])
    assert list(ask(engine, "takings", by=["status"]).df.columns) == ["status", "price_sum"]


def test_fanout(engine):
    assert rows(ask(engine, "takings", by=["article"])) == [("a", Decimal("15.50")), ("b", Decimal("20.00")), (None, Decimal("1.00"))]
    assert rows(ask(engine, "sales_n", where=["article = 'b'"])) == [(2,)]
    assert rows(ask(engine, "buyers_n", where=["article = 'b'"])) == [(2,)]
    refused("fanout_unsafe", ask, engine, "exact_sales_n", by=["article"])
    refused("fanout_unsafe", ask, engine, "median", by=["article"])
    assert rows(ask(engine, "exact_sales_n")) == [(5,)]
    refused("unsupported_measure", ask, engine, "odd")


def test_composites(engine):
    assert rows(ask(engine, "aov", by=["area"])) == [("east", 7.75), ("north", 10.5), ("west", None)]
    refused("unsupported_measure", ask, engine, "nested")


def test_absent_is_null(engine):
    got = rows(ask(engine, "takings", "clients_n", by=["area"]))
    assert got == [("east", Decimal("15.50"), 1), ("north", Decimal("21.00"), 1), ("west", None, 1)]
    got = rows(ask(engine, "sales_n", "buyers_n", by=["status"]))
    assert got == [("completed", 3, 2), ("refunded", 1, 1), (None, 1, 1)]


METRICS = ["takings", "sales_n", "aov", "buyers_n", "median", "clients_n"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(METRICS), min_size=2, max_size=4, unique=True), st.sampled_from([(), ("area",)]))
def test_together_as_alone(engine, metrics, by):
    together = {tuple(r)[: len(by)]: r.asDict() for r in ask(engine, *metrics, by=by).df.collect()}
    for m in metrics:
        alone = ask(engine, m, by=by).df
        name = alone.columns[-1]
        for r in alone.collect():
            assert together[tuple(r)[: len(by)]][name] == r[name]


def test_fusion_changes_nothing(engine, monkeypatch):
    asked = ("takings", "sales_n", "aov", "buyers_n")
    fused = rows(ask(engine, *asked, by=["area"]))
    monkeypatch.setattr(compose, "_SHARED", set())
    assert rows(ask(engine, *asked, by=["area"])) == fused


def test_semi_additive(engine):
    level = lambda name, by=(): rows(ask(engine, name, by=by))
    assert level("last_level") == [(11,)] and level("first_level") == [(6,)]
    assert level("min_level") == [(4,)] and level("max_level") == [(7,)]
    assert level("avg_level") == [((6 + 7 + 4) / 3,)]
    assert level("last_level", ["item"]) == [("x", 7), ("y", 4)]
    assert level("last_level", ["day"]) == [(dt.date(2025, 1, 1), 6), (dt.date(2025, 1, 2), 7), (dt.date(2025, 1, 3), 4)]
    refused("unsupported_measure", ask, engine, "level_of")


def test_joins(make):
    twice = {"sources": [{"name": "trips", "table": "sales", "grain": ["sale_id"], "columns": cols("sale_id:string client_id:string status:string"), "measures": [{"name": "n", "expr": "count(*)"}],
             "joins": [{"to": "clients", "on": "trips.client_id = clients.client_id", "name": "sender"}, {"to": "clients", "on": "trips.status = clients.client_id", "name": "receiver"}]}],
             "metrics": [{"metric": "trips", "canonical": {"source": "trips", "measure": "n"}}]}
    engine = make(**twice)
    assert refused("ambiguous", ask, engine, "trips", by=["area"]).candidates == ["receiver.area", "sender.area"]
    planned = ask(engine, "trips", by=["sender.area", "receiver.area"])
    assert planned.df.columns == ["sender.area", "receiver.area", "n"] and ("east", None, 2) in rows(planned)
    assert ask(engine, "trips", by=["sender.area"]).df.columns == ["area", "n"]
    ways = {"sources": [{"name": "a", "table": "sales", "grain": ["sale_id"], "columns": cols("sale_id:string client_id:string"), "measures": [{"name": "n", "expr": "count(*)"}],
            "joins": [{"to": "b1", "on": "a.sale_id = b1.sale_id"}, {"to": "b2", "on": "a.sale_id = b2.sale_id"}]},
            *({"name": b, "table": "sales", "grain": ["sale_id"], "columns": cols("sale_id:string client_id:string"), "joins": [{"to": "ends", "on": f"{b}.client_id = ends.client_id"}]} for b in ("b1", "b2")),
            {"name": "ends", "table": "clients", "grain": ["client_id"], "columns": cols("client_id:string area:string"), "dimensions": [{"name": "end_area", "column": "area"}]}],
            "metrics": [{"metric": "a_n", "canonical": {"source": "a", "measure": "n"}}]}
    engine = make(**ways)
    assert refused("ambiguous_join_path", ask, engine, "a_n", by=["end_area"]).candidates == ["b1 > ends", "b2 > ends"]
    assert rows(ask(engine, "a_n", by=["end_area"], via=["b2"])) == [("east", 2), ("north", 2), ("west", 1)]
    refused("unreachable", ask, engine, "a_n", by=["end_area"], via=["b3"])


FINALITY = [{"metric": "takings", "realizations": [{"source": "sales", "role": "final", "watermark": "business_day - 1 day", "tz": "UTC"}, {"source": "sales_live", "role": "provisional"}]}]


def test_finality(make):
    engine = make(finality=FINALITY)
    planned = ask(engine, "top", by=["sold_on"], as_of="2025-03-14T09:00:00")
    assert planned.finality["watermark"].isoformat() == "2025-03-13T23:59:59+00:00"
    assert [(r.is_final, r.price_sum) for r in planned.df.orderBy("sold_on").collect()] == [(True, Decimal("10.50")), (True, Decimal("5.00")), (True, Decimal("20.00")), (True, None), (False, Decimal("1.00"))]
    assert planned.finality_rows() == {"final": 4, "provisional": 1}
    assert ask(engine, "takings", by=["area"]).finality is None
    assert planned.served_trust()[0] == "provisional" and "provisional rows are included" in planned.served_trust()[1]
    assert planned.served_trust(wrong=("takings", "other")) == ("caution", ["takings: confirmed wrong"])
    both = ask(engine, "top", "buyers_n", by=["sold_on"], as_of="2025-03-14T09:00:00").df
    assert both.filter("not is_final").count() == 1 and both.filter("is_final").count() == 5


@pytest.mark.parametrize(
    "expr, as_of, wanted",
    [("business_day", "2025-03-15T12:00:00", "2025-03-14"), ("business_day - 1 day", "2025-03-17T12:00:00", "2025-03-14"), ("business_day - 3 days", "2025-03-14T12:00:00", "2025-03-11"), ("business_day + 1 day", "2025-03-14T12:00:00", "2025-03-14")],
)
def test_watermarks(expr, as_of, wanted):
    assert watermark(expr, "America/New_York", as_of).date().isoformat() == wanted
    with pytest.raises(ValueError):
        watermark("yesterday", "UTC")
    with pytest.raises(ValueError):
        watermark("business_day", "Mars/Base")


def test_guardrails(make):
    rail = lambda id, kind, on, **more: {"id": id, "kind": kind, "applies_to": on, **more}
    no_refunds = rail("no-refunds", "mandatory_filter", {"source": "sales", "measure": "price_sum"}, filter="status != 'refunded'", severity="warn")
    engine = make(guardrails=[no_refunds])
    planned = ask(engine, "takings", "sales_n")
    assert rows(planned) == [(Decimal("31.50"), 5)] and planned.guardrails == [{"id": "no-refunds", "applied": True}] and planned.warnings
    by_region = rail("east-only", "mandatory_filter", {"metric": "sales_n"}, filter="clients.area = 'east'")
    assert rows(ask(make(guardrails=[by_region]), "sales_n")) == [(2,)]
    grouped = rail("by-status", "required_dimension", {"metric": "sales_n"}, dimension="status")
    engine = make(guardrails=[grouped])
    refused("guardrail_block", ask, engine, "sales_n")
    assert ask(engine, "sales_n", where=["status='completed'"]) and ask(engine, "sales_n", by=["status"])
    trusted = rail("trusted", "min_trust", {"metric": "takings"}, level="trusted", context="board")
    engine = make(guardrails=[trusted], assertions=[{"id": "a", "query": {"metrics": ["takings"]}, "expect": {"rows": 1, "values": {"takings": 36.5}, "tolerance": 0.01}}])
    assert ask(engine, "takings").tier == "provisional"
    refused("guardrail_block", ask, engine, "takings", context="board")
    assert engine.check_assertions()["passed"] == 1
    assert ask(engine, "takings", context="board").tier == "trusted"
    final = rail("final-only", "restrict_source", {"metric": "takings"}, restrict_to={"role": "final"}, context="board")
    engine = make(guardrails=[final], finality=FINALITY)
    refused("guardrail_block", ask, engine, "takings", where=["sold_on < '2025-04-01'"], context="board", as_of="2025-03-14T09:00:00")
    assert ask(engine, "takings", where=["sold_on <= '2025-03-10'"], context="board", as_of="2025-03-14T09:00:00")
    assert ask(engine, "takings", where=["sold_on < '2025-04-01'"], as_of="2025-03-14T09:00:00")


@pytest.mark.parametrize(
    "where, allowed",
    [("sold_on <= '2025-03-10'", True), ("sold_on <= '2025-04-01'", False), ("sold_at between '2025-01-01' and '2025-04-01'", False), ("sold_at between '2025-01-01' and date '2025-03-01'", True),
     ("sold_at <= timestamp '2025-04-01'", False), ("'2025-04-01' >= sold_at", False), ("'2025-03-01' >= sold_at", True), ("sold_at <= '2025-03-01' and sold_at <= '2025-04-01'", True),
     ("sold_at <= '2025-03-01' or sold_at <= '2025-04-01'", False), ("sold_at >= '2025-04-01'", False), ("sold_at >= '2025-03-01'", True), ("not sold_at > '2025-04-01'", False),
     ("sold_at in ('2025-03-01', '2025-04-01')", False), ("sold_at = cast('2025-04-01' as timestamp)", False), ("sold_at < current_date()", False), ("sold_at <= '2025-03-14T01:00:00+02:00'", True),
     ("sold_at <= '2025-03-13T23:59:59'", True), ("sold_at <= '2025-03-14T00:00:00'", False), ("status = 'completed'", True), ({"field": "sold_at", "op": "<=", "value": "2025-04-01"}, False),
     ({"field": "sold_at", "op": "IN", "value": ["2025-03-01"]}, True)],
)
def test_questions_beyond_the_final_rows(make, where, allowed):
    final = {"id": "final-only", "kind": "restrict_source", "applies_to": {"metric": "takings"}, "restrict_to": {"role": "final"}, "context": "board"}
    anywhere = {**final, "id": "no-context"}
    del anywhere["context"]
    more = {"where": [where], "as_of": "2025-03-14T09:00:00"}
    engine = make(guardrails=[final], finality=FINALITY)
    if allowed:
        assert ask(engine, "takings", context="board", **more).guardrails == [{"id": "final-only", "applied": False}]
    else:
        refused("guardrail_block", ask, engine, "takings", context="board", **more)
    # Without a context, of the query or of the guardrail, nothing is blocked.
    assert ask(engine, "takings", **more) and ask(make(guardrails=[anywhere], finality=FINALITY), "takings", context="board", **more)


TENANCY = {"schema": "tenancy/v1", "claim": "area", "scoped_sources": [{"source": "clients", "column": "area"}], "shared_sources": ["sales"]}
ROLES = {"schema": "roles/v1", "claim": "roles", "default_role": "viewer", "roles": {
    "viewer": {"metrics": {"allow": ["takings", "clients_n"]}}, "admin": {"inherits": "viewer", "metrics": {"allow": ["*"], "deny": ["aov"]}, "run_sql": True},
    "hidden": {"inherits": "admin", "masking": [{"column": "clients.area", "strategy": "partial"}], "tenancy_exempt": True},
}}


def test_tenants_and_roles(make):
    engine = make(policies=[TENANCY, ROLES])
    east = Principal({"area": "east"})
    assert rows(ask(engine, "takings", by=["area"], principal=east)) == [("east", Decimal("15.50"))]
    assert rows(ask(engine, "clients_n", principal=Principal({"area": "x' OR '1'='1"}))) == [(0,)]
    refused("tenant_unresolved", ask, engine, "takings")
    refused("unresolved", ask, engine, "sales_n", principal=east)
    refused("unresolved", ask, engine, "aov", principal=Principal({"area": "east", "roles": ["admin"]}))
    refused("tenant_scope_missing", ask, engine, "units", principal=Principal({"area": "east", "roles": ["admin"]}))
    hidden = Principal({"roles": ["hidden"]})
    assert rows(ask(engine, "clients_n", by=["area"], where=["area = 'east'"], principal=hidden)) == [("ea***", 1)]
    refused("tenant_forbidden", engine.run_sql, "select 1", east)
    refused("tenant_forbidden", engine.run_sql, "select 1", Principal({"area": "east", "roles": ["admin"]}))
    assert engine.run_sql("select count(*) n from clients", hidden).first().n == 3
    assert [m["metric"] for m in engine.list_metrics(east)] == ["clients_n", "takings"]


@pytest.mark.parametrize(
    "sql",
    ["drop table clients", "insert into clients select 1, 2", "create table x as select 1", "select 1; select 2", "set a = 1", "select reflect('java.lang.System', 'exit', 1)",
     "select * from parquet.`/etc`", "select * from other", "select * from clients where exists (select * from other)", "with c as (select * from other) select * from c", "cache table clients", "explain select 1", "select * from range(5)"],
)
def test_only_reading_sql(engine, sql):
    refused("read_only_violation", engine.run_sql, sql)


@pytest.mark.parametrize("sql", ["select 1", "with c as (select * from clients) select count(*) from c", "select area from clients union all select status from sales order by 1 limit 2", "select (select max(price) from sales) m"])
def test_reading_sql(engine, sql):
    assert engine.run_sql(sql).count() > 0


def test_filters(engine):
    assert rows(ask(engine, "sales_n", where=[parse_flag("status:IN:completed,refunded"), parse_flag("price>=5")])) == [(3,)]
    assert parse_flag("a.b!=x y") == {"field": "a.b", "op": "!=", "value": "x y"} and parse_flag("n:<=:1.5")["value"] == 1.5
    refused("validation_failed", parse_flag, "nothing")
    refused("validation_failed", ask, engine, "sales_n", where=[{"field": "status", "op": "IN", "value": "x"}])
    refused("validation_failed", ask, engine, "sales_n", where=[{"field": "status", "op": "~", "value": "x"}])
    assert rows(ask(engine, "sales_n", where=[{"field": "status", "value": "it's"}])) == [(0,)]
    assert rows(ask(engine, "sales_n", where=["sold_at >= DATE('now', '-1 months', 'start of month') or true"])) == [(5,)]
    limited = ask(engine, "sales_n", by=["status"], limit=2)
    assert [tuple(r) for r in limited.df.collect()] == [("completed", 3), ("refunded", 1)]
    assert limited.to_result_set(1)["truncated"]


def test_discovery_and_reports(engine, tmp_path):
    told = engine.describe_metric("aov")
    assert told["sources"] == ["sales"] and "area" in told["dimensions"]
    assert "sales" in engine.overview() and engine.trust_report()["aov"][0] == "provisional"
    out = engine.report([{"title": "a", "query": {"metrics": ["sales_n"]}}, {"title": "b", "query": {"metrics": ["gone"]}}], filters=("status = 'completed'",))
    assert out[0]["result"]["rows"] == [[3]] and out[1]["error"]["code"] == "unresolved"
    assert ask(engine, "takings").related["metrics"]
    engine.log = tmp_path / "log.ndjson"
    ask(engine, "takings")
    refused("unresolved", ask, engine, "gone")
    served, failed = map(json.loads, engine.log.read_text().splitlines())
    assert served["error"] is None and served["guardrails"] == [] and failed["error"] == "unresolved" and failed["bytes_scanned"] is None
    engine.log = None


def test_assertions_on_a_query(make):
    wrong = [{"id": "a", "query": {"metrics": ["sales_n"]}, "expect": {"values": {"sales_n": 6}}}]
    engine = make(assertions=wrong)
    assert engine.checked({"metrics": ["sales_n"]})[1] == ["a: sales_n is 5, not 6"]
    assert engine.checked({"metrics": ["sales_n"], "dimensions": ["status"]})[1] == []
    refused("assertion_failed", engine.checked, {"metrics": ["sales_n"]}, harness=True)
    assert engine.check_assertions()["passed"] == 0 and ask(engine, "sales_n").tier == "caution"
    assert "HashAggregate" in engine.explain({"metrics": ["sales_n"]})


def test_assertions():
    assert close(100.5, 100, 0.01) and not close(102, 100, 0.01) and close(0.001, 0, 0.01) and not close(True, 1, 0.5) and close(None, None, 0)

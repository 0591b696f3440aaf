"""Loading, validation, sources, ingestion, and what surrounds the numbers."""

import datetime as dt
import json
import time

import pytest

from plumbline.errors import Refusal
from plumbline.functions.html import read as read_html
from plumbline.loader import from_dict, project, read
from plumbline.model import Column, Source
from plumbline.operators import event_log, ingestion, knowledge, retrieval
from plumbline.operators.ingestion import Relation
from plumbline.plans.catalog import QUERIES
from plumbline.plans.validate import validate
from plumbline.sources import catalog
from plumbline.streaming import event_log as stream

SOURCE = """
name: orders
grain: [order_id]
columns:
  - { name: order_id, type: int, nullable: false }
  - { name: status, type: string }
  - { name: amount, type: decimal }
measures:
  - { name: revenue, expr: sum(amount) }
dimensions:
  - { name: status, column: status }
joins:
  - to: customers
    on: orders.order_id = customers.order_id
"""
METRIC = "metric: revenue\naliases: [rev]\ncanonical: { source: orders, measure: revenue }\n"


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/")
        path = path.with_suffix(".yaml")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return folder


def test_a_folder(tmp_path):
    root = write(
        tmp_path, semantics__a__orders=SOURCE, contracts__metrics__revenue=METRIC,
        contracts__guardrails__g="id: g\nkind: mandatory_filter\napplies_to: { source: orders, measure: revenue }\nfilter: status != 'x'\n",
        contracts__assertions__a="id: a\nquery: { metrics: [revenue] }\nexpect: { rows: 1, values: { revenue: 1 }, tolerance: 0.1 }\n",
        contracts__policies__t="schema: tenancy/v1\nclaim: m\nscoped_sources:\n  - { source: orders, column: status }\n",
    )
    (root / "contracts/guardrails/finality-r.yaml").write_text("metric: revenue\nrealizations:\n  - { source: orders, role: final, watermark: business_day, tz: UTC }\n")
    p = project(root)
    assert p.sources["orders"].joins[0].on == "orders.order_id = customers.order_id"
    assert [b.metric for b in p.bindings] == ["revenue"] and p.guardrails[0].filter == "status != 'x'"
    assert p.finality[0].metric == "revenue" and p.assertions[0].tolerance == 0.1 and p.tenancy.scoped == {"orders": "status"}


@pytest.mark.parametrize(
    "change, line, what",
    [
        (("column: status", "column: nothing"), 2, "nothing"),
        (("grain: [order_id]", "grain: [other]"), 2, "other"),
        (("type: decimal", "type: money"), 7, "money"),
        (("name: amount", "name: status"), 2, "twice"),
        (("expr: sum(amount)", "spelled: x"), 9, "expr"),
    ],
)
def test_errors_have_a_place(tmp_path, change, line, what):
    root = write(tmp_path, semantics__orders=SOURCE.replace(*change))
    with pytest.raises(Refusal) as caught:
        project(root)
    assert what in caught.value.message and f"orders.yaml:{line}:" in caught.value.message


def test_names_are_unique(tmp_path):
    for files in ({"semantics__a": SOURCE, "semantics__b": SOURCE}, {"contracts__metrics__a": METRIC, "contracts__metrics__b": METRIC.replace("metric: revenue", "metric: other")}):
        with pytest.raises(Refusal):
            project(write(tmp_path / next(iter(files)), **files))
    with pytest.raises(Refusal):
        read("a: [", "x")


def test_validation(spark):
    given = {
        "sources": [
            {"name": "a", "grain": ["id", "day"], "columns": [{"name": "id", "type": "int"}, {"name": "day", "type": "date"}], "measures": [{"name": "n", "expr": "count(*)"}, {"name": "bad", "expr": "sum(gone)"}],
             "dimensions": [{"name": "day", "column": "day"}], "joins": [{"to": "nowhere", "on": "a.id = nowhere.id"}]},
        ],
        "metrics": [
            {"metric": "x", "canonical": {"source": "b", "measure": "n"}}, {"metric": "y", "canonical": {"source": "a", "measure": "m", "population_filter": "other = 1"}},
            {"metric": "z", "canonical": {"kind": "ratio", "numerator": "z", "denominator": "x"}}, {"metric": "s", "canonical": {"kind": "semi_additive", "source": "a", "measure": "n", "collapse_dimension": "day"}},
            {"metric": "o", "canonical": {"kind": "opaque", "source": "a", "measure": "n", "native_grain": ["id"]}},
        ],
        "guardrails": [{"id": "g", "kind": "mandatory_filter", "applies_to": {"metric": "none"}, "filter": "a = 1"}],
        "policies": [{"schema": "tenancy/v1", "claim": "c", "scoped_sources": [{"source": "a", "column": "none"}]}, {"schema": "roles/v1", "roles": {"r": {"inherits": "none"}}}],
    }
    errors, warnings = validate(spark, from_dict(given))
    text = "\n".join(errors)
    for part in ("gone is no column", "no source b", "no measure m", "other can't", "metric z", "grain column id", "native grain", "no metric none", "a.none", "role r"):
        assert part in text, part
    assert any("nowhere" in w for w in warnings)


def test_the_tpch_project_is_valid(spark):
    from plumbline.plans import catalog as tpch

    errors, _ = validate(spark, tpch.project(tpch.GUARDED, tpch.TENANTS))
    assert [e for e in errors if "native grain" not in e] == []


def test_relations(spark, tmp_path):
    df = spark.sql("select 1 a, 'x' b, cast(1.5 as decimal(5,2)) c, array(1) d, current_date() e, timestamp_ntz'2024-01-01' f, true g, 1e0 h, x'00' i, interval 1 day j")
    columns, warnings = catalog.introspect(df)
    assert [c.type for c in columns] == ["int", "string", "decimal", "json", "date", "timestamp", "bool", "float", "json", "string"] and not warnings
    assert catalog.fingerprint(columns) != catalog.fingerprint(columns[:-1])
    assert catalog.probe(Source("s", "s", columns=(Column("a", "int"),)), df) == list("bcdefghij")
    with pytest.raises(Refusal) as caught:
        catalog.probe(Source("s", "s", columns=(Column("a", "string"), Column("z"))), df)
    assert caught.value.code == "schema_mismatch" and "z is missing" in caught.value.message
    assert catalog.select_relations(["m.orders", "m.x", "n.orders"], ("m",), ("ord*",)) == ["m.orders"]
    df.select("a", "b").write.parquet(str(tmp_path / "t.parquet"))
    got = catalog.read(spark, {"files": {"type": "parquet", "path": str(tmp_path)}}, "files", "t")
    assert got.count() == 1
    for name in ("files", "other"):
        with pytest.raises(Refusal):
            catalog.read(spark, {"files": {"type": "parquet", "path": str(tmp_path)}}, name, "gone")
    stats = {r.column: r for r in catalog.column_stats(spark.sql("select id, id % 2 half, if(id < 5, null, 1) some from range(10)")).collect()}
    assert stats["id"].is_unique and not stats["half"].is_unique and stats["some"].null_fraction == 0.5 and stats["half"].n_distinct == 2


def test_nearly_unique_columns_are_counted(spark):
    df = spark.sql("select id, if(id < 200, 0, id) repeated, if(id = 7, null, id) some, id % 10 few from range(20000)")
    stats = {r.column: r for r in catalog.column_stats(df).collect()}
    assert {c: (r.n_distinct, r.is_unique) for c, r in stats.items()} == {"id": (20000, True), "repeated": (19801, False), "some": (19999, False), "few": (10, False)}
    assert stats["repeated"].uniqueness_ratio == pytest.approx(0.99005) and stats["some"].null_fraction == pytest.approx(1 / 20000)
    assert catalog.column_stats(df.limit(0)).count() == 4


def test_registered_column_stats_hold_the_counts(spark):
    orders = "/root/testdata/sf0.01/orders.parquet"
    stats = {r.column: r for r in QUERIES["column_stats"](spark, "/root/testdata/sf0.01").collect()}
    assert (stats["o_orderkey"].n_distinct, stats["o_orderkey"].is_unique) == (15000, True)
    assert (stats["o_totalprice"].n_distinct, stats["o_totalprice"].is_unique) == (14999, False)
    for c in spark.read.parquet(orders).columns:
        assert stats[c].n_distinct == pytest.approx(spark.read.parquet(orders).select(c).distinct().count(), rel=0.03)


def test_jdbc_options():
    made = catalog.jdbc_options("d", "read only", {"url": "jdbc:redshift://h/db", "timeout": 7, "iam": {"DbUser": "u"}, "options": {"fetchsize": 5}}, "t")
    assert made == {"url": "jdbc:redshift:iam://h/db", "dbtable": "t", "queryTimeout": 7, "fetchsize": 5, "driver": "d", "sessionInitStatement": "read only", "DbUser": "u"}


def test_ddl():
    found = catalog.from_ddl('CREATE TABLE IF NOT EXISTS m.t (id BIGINT PRIMARY KEY, "name" VARCHAR(10) NOT NULL, price NUMERIC(8,2), at TIMESTAMP, -- no\n x BLOB, CHECK (price > 0));'
                             "create table u (a int, b text, constraint k primary key (a, b));")  # fmt: skip
    columns, key = found["m.t"]
    assert [(c.name, c.type, c.nullable) for c in columns] == [("id", "int", False), ("name", "string", False), ("price", "decimal", True), ("at", "timestamp", True), ("x", "json", True)]
    assert key == ("id",) and found["u"][1] == ("a", "b")


RELATION = Relation("trips", tuple(Column(n, t) for n, t in [("trip_id", "int"), ("from_id", "int"), ("to_id", "int"), ("price", "decimal"), ("status", "string"), ("code_key", "string"), ("day", "date")]), ("trip_id",), (("from_id", "places", "place_id"), ("to_id", "places", "place_id")))


def test_inference():
    made = ingestion.propose(RELATION)
    assert [m["name"] for m in made["measures"]] == ["row_count", "total_price"]
    assert [d["name"] for d in made["dimensions"]] == ["status", "day"]
    assert [(j["name"], j["on"]) for j in made["joins"]] == [("from", "trips.from_id = from.place_id"), ("to", "trips.to_id = to.place_id")]
    assert from_dict({"sources": [made]}).sources["trips"].grain == ("trip_id",)


def test_reconciliation():
    new = ingestion.propose(RELATION)
    old = {**new, "meta": {"provenance": "human_curated"}, "description": "mine"}
    decide = lambda a, b, **more: [(d.name, d.action, d.applied) for d in ingestion.reconcile(a, b, **more)]
    assert decide({}, {"t": new}) == [("t", "add", False)]
    assert decide({"t": old}, {"t": new}) == [("t", "contradiction", False)]
    assert decide({"t": {**new, "description": "x"}}, {"t": new}) == [("t", "edit", False)]
    assert decide({"t": {**new, "description": "x"}}, {"t": new}, auto_apply=True, confidence={"t": 0.96}) == [("t", "edit", True)]
    assert decide({"t": {**new, "grain": []}}, {"t": new}, auto_apply=True, confidence={"t": 1.0}) == [("t", "edit", False)]
    assert decide({"t": new}, {"t": new}) == [("t", "no_op", False)] and decide({"t": old}, {"t": new}, frozen=["t"]) == [("t", "no_op", False)]
    assert decide({"t": new}, {}) == [("t", "prune", False)] and decide({"t": old}, {}) == [("t", "contradiction", False)]
    assert "+description: mine" in ingestion.diff("t", new, old)
    p = from_dict({"sources": [new, {**new, "name": "other"}]})
    assert [b.metric for b in ingestion.bindings(p.sources.values())] == ["row_count", "total_price", "other_row_count", "other_total_price"]
    assert ingestion.examples([{"text": "b", "metrics": ["m"]}, {"text": "a", "metrics": ["m"]}, {"text": "c", "uses": 9, "metrics": ["m"]}], "m", 2) == ["c", "a"]


def test_acquisition():
    got = ingestion.acquire(["trips", "u", "v"], {"trips": RELATION}, ("ddl", {"trips": RELATION, "u": RELATION}))
    assert got.origin == {"trips": "live", "u": "ddl"} and got.gaps == ["v"]
    with pytest.raises(Refusal):
        ingestion.acquire(["trips"], {"trips": RELATION}, ("ddl", {"trips": Relation("trips", (Column("price", "int"),))}))


def test_dbt():
    manifest = {"metadata": {"dbt_schema_version": "https://schemas/manifest/v12.json"}, "semantic_models": {"x": {"name": "orders", "entities": [{"name": "id", "type": "primary", "expr": "order_id"}],
                "measures": [{"name": "n", "agg": "count", "expr": "order_id"}, {"name": "mrr", "agg": "sum", "non_additive_dimension": {"name": "month"}}, {"name": "odd", "agg": "nothing"}],
                "dimensions": [{"name": "day", "type": "time", "expr": "at", "type_params": {"time_granularity": "day"}}]}},
                "metrics": {"a": {"name": "orders_n", "type": "simple", "type_params": {"measure": {"name": "n"}}}, "b": {"name": "r", "type": "ratio", "type_params": {"numerator": {"name": "orders_n"}, "denominator": "orders_n"}}}}
    sources, metrics = ingestion.from_dbt(json.dumps(manifest))
    assert [m["additivity"] for m in sources[0]["measures"]] == ["additive", "semi_additive"] and sources[0]["dimensions"][0]["granularity"] == "day"
    assert [b.kind for b in from_dict({"sources": sources, "metrics": metrics}).bindings] == ["single", "ratio"]
    assert not sources[0]["joins"]
    more = {**manifest, "semantic_models": {**manifest["semantic_models"], "y": {"name": "lines", "entities": [{"name": "id", "type": "foreign", "expr": "order_ref"}, {"name": "none", "type": "foreign"}],
            "measures": [{"name": "p90", "agg": "percentile", "expr": "price", "agg_params": {"percentile": 0.9}}]}}, "metrics": {**manifest["metrics"], "c": {"name": "odd", "type": "conversion"}}}
    warnings = []
    sources, _ = ingestion.from_dbt(more, warnings)
    assert sources[1]["joins"] == [{"to": "orders", "on": "lines.order_ref = orders.order_id", "relationship": "many_to_one"}]
    assert sources[1]["measures"] == [{"name": "p90", "expr": "percentile_cont(0.9) within group (order by price)", "additivity": "non_additive"}]
    assert len(warnings) == 2 and "orders.odd" in warnings[0] and "conversion" in warnings[1]
    with pytest.raises(Refusal):
        ingestion.from_dbt({"metadata": {"dbt_schema_version": "v9/manifest/v9.json"}})


def test_event_log(spark, tmp_path):
    at = lambda m: f"2025-01-01T00:{m:02}:00Z"
    lines = [
        {"event": "served_answer", "ts": at(0), "seq": 1, "query_hash": "h", "latency_ms": 10, "trust_tier": "trusted", "resolved": {"r": "revenue"}, "bytes_scanned": 500, "stale": True, "guardrails": ["g"]},
        {"event": "served_answer", "ts": at(1), "seq": 2, "query_hash": "g", "latency_ms": 30, "error": "unresolved", "trust_tier": "caution", "resolved": {}},
        {"event": "answer_outcome", "ts": at(2), "seq": 3, "ref": "h", "outcome": "wrong_definition", "binding": "b"}, {"event": "answer_outcome", "ts": at(3), "seq": 4, "ref": "h", "outcome": "wrong_definition", "binding": "b"},
        {"event": "answer_outcome", "ts": at(4), "seq": 5, "ref": "z", "outcome": "correct", "binding": "c"}, {"event": "funnel_milestone", "ts": at(5), "seq": 6, "milestone": "first"},
    ]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, lines)))
    log = spark.read.schema(event_log.SCHEMA).json(str(tmp_path))
    told = event_log.answer_report(log).first()
    assert (told.answers, told.errors, told.latency_min, told.latency_p50, told.latency_p95, told.bytes_total, told.stale_answers, told.guardrail_coverage) == (2, 1, 10.0, 10.0, 30.0, 500, 1, 1)
    assert event_log.calibration(log).collect() == [("trusted", 1, 1, 1.0)] and event_log.unmatched(log).first().unmatched == 1
    # An answer that was marked again counts once; one that was right in the end doesn't count.
    assert event_log.recurring_corrections(log).count() == 0
    again = [{"event": "served_answer", "seq": 7, "query_hash": "k", "resolved": {"r": "revenue"}}, {"event": "answer_outcome", "seq": 8, "ref": "k", "outcome": "wrong_data"}]
    (tmp_path / "more.json").write_text("\n".join(map(json.dumps, again)))
    more = spark.read.schema(event_log.SCHEMA).json(str(tmp_path))
    assert event_log.recurring_corrections(more).collect() == [("revenue", 2)]
    (tmp_path / "more.json").unlink()
    reached = event_log.funnel_report(log, ("first", "second")).first()
    assert (reached.reached, reached.dropped_after) == (["first"], "first") and event_log.funnel_report(log).first().dropped_after is None
    payload = event_log.telemetry(log, accuracy=0.5).first().asDict()
    assert payload["error_distribution"] == {"ok": 1, "unresolved": 1} and payload["accuracy"] == 0.5 and "baseline_accuracy" not in payload
    none = log.limit(0)
    assert event_log.answer_report(none).first().answers == 0 and event_log.telemetry(none).first().answer_count == 0
    assert [r.binding for r in event_log.capped_bindings(log, 7, "2025-01-02").collect()] == ["b"] and not event_log.capped_bindings(log, 7, "2025-02-02").count()
    assert event_log.funnel(log).first().milestone == "first" and event_log.event_counts(log).count() == 4
    query = stream.windowed(stream.follow(spark, str(tmp_path))).writeStream.format("memory").queryName("told").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.error, r.answers) for r in spark.table("told").collect()} == {(None, 1), ("unresolved", 1)}


def test_retrieval(spark):
    pages = spark.createDataFrame([("a", "refund rules", ["money"], "refunds are excluded"), ("b", "orders", ["refund"], "nothing"), ("c", "other", [], "words")], "page_id string, summary string, tags array<string>, body string")
    hits = {r.page_id: r.score for r in retrieval.bm25(pages, "Refund!").collect()}
    assert set(hits) == {"a", "b"} and hits["b"] > hits["a"] > 0
    assert retrieval.bm25(pages, " ").count() == 0
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [3.0, 4.0]), ("d", [-1.0, 0.0]), ("e", [0.0, 0.0])], "page_id string, v array<double>")
    near = retrieval.cosine(vectors, [1.0, 0.0], "page_id", "v")
    assert {r.page_id: round(r.score, 6) for r in near.collect()} == {"a": 1.0, "c": 0.6}
    fused = {r.page_id: r.score for r in retrieval.fuse([(retrieval.bm25(pages, "refund"), 1.0), (near, 1.0)], "page_id").collect()}
    assert fused == pytest.approx({"a": 1 / 60 + 1 / 61, "b": 1 / 60, "c": 1 / 61})
    only = retrieval.fuse([(near, 1.0)], "page_id", pages.filter("page_id = 'c'"))
    assert only.first().score == pytest.approx(1 / 60)
    scoped = spark.createDataFrame([("a", "global", ["public"], "x", ["r"], False), ("a", "me", ["public"], "note", ["r"], False), ("b", "global", [], "y", ["r"], True), ("c", "you", ["public"], "z", [], True)], "page_id string, scope string, tags array<string>, body string, refs array<string>, is_caveat boolean")
    seen = {r.page_id: r.annotation for r in retrieval.visible(scoped, "me").collect()}
    assert seen == {"a": "note", "b": None} and [r.page_id for r in retrieval.visible(scoped, "me", ["public"]).collect()] == ["a"]
    assert retrieval.caveats(scoped.filter("page_id = 'a' and scope = 'global'"), scoped).collect() == [("b", ["r"])]


def test_fusion_ranks_every_hit(spark):
    n = 1000
    arms = [{i: float(i * 37 % 250) for i in range(n)}, {i: float(i * 11 % n) for i in range(0, n, 2)}]
    expected = dict.fromkeys(arms[0], 0.0)
    for arm in arms:
        for rank, i in enumerate(sorted(arm, key=lambda i: (-arm[i], i))):
            expected[i] += 1 / (60 + rank)
    dfs = [(spark.createDataFrame(list(arm.items()), "id long, score double").repartition(5), 1.0) for arm in arms]
    got = {r.id: r.score for r in retrieval.fuse(dfs, "id").collect()}
    assert got == pytest.approx(expected)
    best = sorted(expected, key=lambda i: (-expected[i], i))[:3]
    assert {r.id for r in retrieval.fuse(dfs, "id", top=3).collect()} == set(best)


def test_knowledge():
    day = dt.datetime(2025, 1, 10)
    page = lambda i, *refs, **more: knowledge.Page(i, refs=refs, **more)
    pages = {p.id: p for p in (page("a", "b", "c"), page("b", "d"), page("c", "gone", sl_refs=("m", "n"), fingerprints=(("m", "1"),), validated=day), page("d", "e", scope="me"), page("e"))}
    assert knowledge.expand(pages, "a") == ["a", "b", "c", "d"] and knowledge.expand(pages, "a", most=2) == ["a", "b"]
    assert knowledge.drifted(pages["c"], {"m": "2"}) == ["m"] and not knowledge.drifted(pages["c"], {"m": "1"})
    assert knowledge.stale(pages["a"], day, dt.timedelta(1)) and not knowledge.stale(pages["c"], day, dt.timedelta(1))
    assert knowledge.broken(pages, {"m"}) == ["b: d isn't visible to all", "c: n is no definition", "c: page gone is gone"]
    assert knowledge.pruned(pages, {"m"})["c"].refs == () and knowledge.pruned(pages, {"m"})["c"].sl_refs == ("m",)
    assert knowledge.rendered("{{ sl:a.b }} and {{sl:c}}", {"a.b": "1"}.get) == "1 and {{sl:c}}"


def test_html():
    assert read_html("<title> T </title><p>a <b>b</b></p><script>x</script><style>y</style>c") == ("T", "a\nb\nc")
    assert read_html(None) == ("", "")
    assert read_html('<a title="a>b">x</a><b c=\'>\'>y</b>&amp;<!-- <p>z --><p d="e>f') == ("", "x\ny\n&\nf")
    assert read_html("a<br/>b < c<script>d") == ("", "a\nb < c")
    for odd in ("<a ", "<", '<a b="', "<!--", "<script>", "</", "&"):
        began = time.time()
        read_html(odd * 100_000 + '"')
        assert time.time() - began < 5

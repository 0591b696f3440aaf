"""A project over the driver's tables, the registered queries over it and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import Engine
from plumbline.functions.html import page_text
from plumbline.loader import from_dict
from plumbline.model import Principal, Project
from plumbline.operators import event_log as event_logs
from plumbline.operators import retrieval
from plumbline.sources.catalog import column_stats

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _columns(text: str) -> list[dict]:
    kinds = {"i": "int", "s": "string", "f": "float", "t": "timestamp", "d": "decimal"}
    return [{"name": n, "type": kinds[k]} for n, k in (x.split(":") for x in text.split())]


def _dims(*names: str) -> list[dict]:
    return [{"name": n, "column": n} for n in names]


MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"


def _source(name: str, table: str, grain: list[str], columns: str, measures: list[tuple], dimensions: list[dict], joins: list[tuple] = ()) -> dict:
    return {
        "name": name, "table": table, "grain": grain, "columns": _columns(columns),
        "measures": [dict(zip(("name", "expr", "additivity", "semi_additive_over"), m)) for m in measures],
        "dimensions": dimensions, "joins": [dict(zip(("to", "on", "relationship", "name"), j)) for j in joins],
    }


_ORDERS = "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s"
_ORDER_DIMS = [
    *_dims("o_orderstatus", "o_orderpriority", "o_orderdate", "o_orderkey"),
    {"name": "order_month", "column": "o_orderdate", "granularity": "month"}, {"name": "order_year", "column": "o_orderdate", "granularity": "year"},
]
_ORDER_MEASURES = [
    ("revenue", MONEY.format("o_totalprice")), ("order_count", "count(o_orderkey)"), ("average_price", "avg(o_totalprice)", "non_additive"),
    ("open_orders", "count(o_orderkey) filter (where o_orderstatus = 'O')"), ("priced_quantity", MONEY.format("o_totalprice * 2")),
]
_TO_CUSTOMER = [("customer", "orders.o_custkey = customer.c_custkey", "many_to_one")]

PROJECT = {
    "sources": [
        _source("region", "region", ["r_regionkey"], "r_regionkey:i r_name:s", [("region_count", "count(*)")], _dims("r_name")),
        _source("nation", "nation", ["n_nationkey"], "n_nationkey:i n_name:s n_regionkey:i", [("nation_count", "count(*)")], _dims("n_name"),
                [("region", "nation.n_regionkey = region.r_regionkey", "many_to_one")]),
        _source("customer", "customer", ["c_custkey"], "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s",
                [("customer_count", "count(c_custkey)"), ("balance", "c_acctbal"), ("balance_sum", MONEY.format("c_acctbal"))], _dims("c_mktsegment", "c_custkey"),
                [("nation", "customer.c_nationkey = nation.n_nationkey", "many_to_one", "customer_nation")]),
        _source("supplier", "supplier", ["s_suppkey"], "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f", [("supplier_count", "count(*)")], _dims("s_name"),
                [("nation", "supplier.s_nationkey = nation.n_nationkey", "many_to_one", "supplier_nation")]),
        _source("part", "part", ["p_partkey"], "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f", [("part_count", "count(*)")], _dims("p_brand", "p_size")),
        _source("orders", "orders", ["o_orderkey"], _ORDERS, _ORDER_MEASURES, _ORDER_DIMS,
                _TO_CUSTOMER),
        _source("baskets", "orders", ["o_orderkey"], _ORDERS, _ORDER_MEASURES, _ORDER_DIMS, [("lines", "baskets.o_orderkey = lines.l_orderkey", "one_to_many")]),
        _source("lines", "lineitem", [], "l_orderkey:i l_quantity:f l_returnflag:s", [], _dims("l_returnflag")),
        _source("orders_final", "orders", ["o_orderkey"], _ORDERS, _ORDER_MEASURES, _ORDER_DIMS),
        _source("orders_live", "orders", ["o_orderkey"], _ORDERS, _ORDER_MEASURES, _ORDER_DIMS),
        _source("lineitem", "lineitem", [], "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
                [("quantity", MONEY.format("l_quantity")), ("line_count", "count(*)"), ("gross", MONEY.format("l_extendedprice")),
                 ("discounted", "cast(sum(cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(6,2)) as decimal(24,4))) as double)"),
                 ("ship_days", "count(distinct l_shipdate)", "non_additive")],
                [*_dims("l_returnflag", "l_linestatus", "l_shipdate"), {"name": "ship_year", "column": "l_shipdate", "granularity": "year"}],
                [("lineitem_order", "lineitem.l_orderkey = lineitem_order.o_orderkey", "many_to_one"), ("part", "lineitem.l_partkey = part.p_partkey", "many_to_one"),
                 ("supplier", "lineitem.l_suppkey = supplier.s_suppkey", "many_to_one")]),
        _source("lineitem_order", "orders", ["o_orderkey"], _ORDERS, [], _dims("o_orderpriority"),
                [("customer", "lineitem_order.o_custkey = customer.c_custkey", "many_to_one")]),
        _source("snapshots", "snapshots", ["user_id", "snap"], "user_id:i snap:t level:f", [("level", MONEY.format("level"))], _dims("snap", "user_id"),
                [("customer", "snapshots.user_id = customer.c_custkey", "many_to_one")]),
        _source("events", "events", ["event_id"], "event_id:i ts:t user_id:i event_type:s value:f props:s", [("event_count", "count(*)")],
                [*_dims("event_type"), {"name": "event_day", "column": "ts", "granularity": "day"}, {"name": "event_week", "column": "ts", "granularity": "week"}],
                [("customer", "events.user_id = customer.c_custkey", "many_to_one")]),
    ],
    "metrics": [
        *({"metric": m, "canonical": {"source": s, "measure": x}} for m, s, x in (
            ("revenue", "orders", "revenue"), ("order_count", "orders", "order_count"), ("average_price", "orders", "average_price"),
            ("open_orders", "orders", "open_orders"), ("quantity", "lineitem", "quantity"), ("line_count", "lineitem", "line_count"), ("gross", "lineitem", "gross"),
            ("discounted", "lineitem", "discounted"), ("customer_count", "customer", "customer_count"), ("event_count", "events", "event_count"),
            ("basket_revenue", "baskets", "revenue"), ("basket_count", "baskets", "order_count"), ("settled_revenue", "orders_final", "revenue"), ("settled_orders", "orders_final", "order_count"),
        )),
        {"metric": "safe_revenue", "aliases": ["net revenue"], "canonical": {"source": "orders", "measure": "revenue", "population_filter": "o_orderpriority != '5-LOW'"}},
        {"metric": "price_per_order", "canonical": {"kind": "ratio", "numerator": "revenue", "denominator": "order_count"}},
        {"metric": "revenue_per_open", "canonical": {"kind": "ratio", "numerator": "revenue", "denominator": "open_orders", "on_zero_denominator": "zero"}},
        {"metric": "revenue_per_open_null", "canonical": {"kind": "ratio", "numerator": "revenue", "denominator": "open_orders"}},
        {"metric": "settled_per_order", "canonical": {"kind": "ratio", "numerator": "settled_revenue", "denominator": "settled_orders"}},
        {"metric": "average_discount", "canonical": {"kind": "weighted_avg", "weighted_sum": "discounted", "weight": "gross"}},
        {"metric": "buyers", "canonical": {"kind": "distinct_count", "source": "orders", "distinct_on": "o_custkey"}},
        {"metric": "basket_buyers", "canonical": {"kind": "distinct_count", "source": "baskets", "distinct_on": "o_custkey"}},
        {"metric": "median_price", "canonical": {"kind": "percentile", "source": "orders", "column": "o_totalprice", "percentile": 0.5}},
        {"metric": "p90_price", "canonical": {"kind": "percentile", "source": "orders", "column": "o_totalprice", "percentile": 0.9, "approach": "nearest_rank"}},
        *({"metric": f"{agg}_level", "canonical": {"kind": "semi_additive", "source": "snapshots", "measure": "level", "collapse_dimension": "snap", "collapse_agg": agg}} for agg in ("last", "first", "avg", "min", "max")),
        {"metric": "account_balance", "canonical": {"kind": "opaque", "source": "customer", "measure": "balance", "native_grain": ["c_custkey"]}},
    ],
    "finality": [{"metric": m, "realizations": [
        {"source": "orders_final", "role": "final", "watermark": "business_day - 1 day", "tz": "America/New_York"}, {"source": "orders_live", "role": "provisional"},
    ]} for m in ("settled_revenue", "settled_orders")],
}
GUARDED = {
    "guardrails": [
        {"id": "no-pending", "kind": "mandatory_filter", "applies_to": {"source": "orders", "measure": "revenue"}, "filter": "o_orderstatus != 'P'"},
        {"id": "no-machinery", "kind": "mandatory_filter", "applies_to": {"metric": "order_count"}, "filter": "customer.c_mktsegment != 'MACHINERY'", "severity": "warn"},
    ],
    "policies": [],
}
TENANTS = {
    "policies": [
        {"schema": "tenancy/v1", "claim": "segment", "scoped_sources": [{"source": "customer", "column": "c_mktsegment"}],
         "shared_sources": [t for t in (*TABLES, "snapshots", "orders_final", "orders_live", "lineitem_order", "baskets", "lines") if t != "customer"]},
        {"schema": "roles/v1", "claim": "roles", "roles": {
            "null": {"masking": [{"column": "customer.c_mktsegment", "strategy": "null"}]},
            "hash": {"masking": [{"column": "c_mktsegment", "strategy": "hash"}], "tenancy_exempt": True},
            "partial": {"masking": [{"column": "c_mktsegment", "strategy": "partial"}], "tenancy_exempt": True},
            "plain": {"run_sql": False}, "sql": {"run_sql": True, "tenancy_exempt": True},
        }},
    ],
}


def project(*parts: dict) -> Project:
    given = {k: list(v) for k, v in PROJECT.items()}
    for part in parts:
        for k, v in part.items():
            given[k] = given.get(k, []) + v
    return from_dict(given)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    def load(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def snapshots() -> DataFrame:
        day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("snap")
        return load("events")().groupBy("user_id", day).agg(F.max("value").alias("level"))

    return {**{t: load(t) for t in TABLES}, "snapshots": snapshots}


def engine(spark: SparkSession, sf_dir: str, *parts: dict) -> Engine:
    return Engine(spark, project(*parts), tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "1999-06-16T12:00:00-04:00"


def register(name: str, sql: str, query: dict, *parts: dict, claims: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        principal = Principal(claims) if claims else None
        return engine(spark, sf_dir, *parts).query(query, principal).df

    QUERIES[name], ORACLE_SQL[name] = run, sql


M = "sum(o_totalprice::DECIMAL(18,2))::DOUBLE"
_LEFT = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_SNAPS = "(SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS snap, max(value) AS level FROM events GROUP BY 1, 2)"
_LEVEL = "sum(level::DECIMAL(18,2))::DOUBLE"

register(
    "single_by_month",
    f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS order_month, {M} AS revenue FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    {"metrics": ["revenue"], "dimensions": ["order_month"]}, GUARDED,
)
register(
    "filter_ops",
    f"SELECT o_orderpriority, {M} AS revenue, count(*) AS order_count FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%-%' AND o_orderpriority <> '5-LOW' AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1",
    {"metrics": ["revenue", "order_count"], "dimensions": ["o_orderpriority"], "filters": [
        {"field": "o_totalprice", "op": ">=", "value": 1000}, {"field": "o_orderstatus", "op": "IN", "value": ["F", "O"]},
        {"field": "o_orderpriority", "op": "LIKE", "value": "%-%"}, "o_orderpriority != '5-LOW'", "order_month < timestamp_ntz '2000-01-01'",
    ]},
)
register("left_join_dim", f"SELECT c_mktsegment, {M} AS revenue FROM {_LEFT} GROUP BY 1", {"metrics": ["revenue"], "dimensions": ["c_mktsegment"]})
register("two_hop_join", f"SELECT r_name, {M} AS revenue FROM {_LEFT} GROUP BY 1", {"metrics": ["revenue"], "dimensions": ["r_name"]})
register(
    "role_join",
    """SELECT c.n_name AS "customer_nation.n_name", s.n_name AS "supplier_nation.n_name", sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation c ON c_nationkey = c.n_nationkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2""",
    {"metrics": ["quantity"], "dimensions": ["customer_nation.n_name", "supplier_nation.n_name"]},
)
_FANNED = "SELECT DISTINCT ON (o_orderkey) o_orderkey, o_totalprice, l_returnflag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey {} ORDER BY o_orderkey, l_returnflag NULLS LAST"
register("fanout_dedup", f"SELECT l_returnflag, {M} AS revenue FROM ({_FANNED.format('')}) GROUP BY 1", {"metrics": ["basket_revenue"], "dimensions": ["l_returnflag"]})
register(
    "fanout_filter", f"SELECT {M} AS revenue, count(o_orderkey) AS order_count FROM ({_FANNED.format('WHERE l_quantity > 45')})",
    {"metrics": ["basket_revenue", "basket_count"], "filters": ["lines.l_quantity > 45"]},
)
register(
    "multi_metric_two_grains",
    f"""WITH a AS (SELECT c_mktsegment, {M} AS revenue FROM {_LEFT} GROUP BY 1), b AS (SELECT c_mktsegment, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1), c AS (SELECT c_mktsegment, count(*) AS customer_count FROM customer GROUP BY 1)
    SELECT s.c_mktsegment, revenue, quantity, customer_count FROM (SELECT c_mktsegment FROM a UNION SELECT c_mktsegment FROM b UNION SELECT c_mktsegment FROM c) s
    LEFT JOIN a ON s.c_mktsegment IS NOT DISTINCT FROM a.c_mktsegment LEFT JOIN b ON s.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment LEFT JOIN c ON s.c_mktsegment IS NOT DISTINCT FROM c.c_mktsegment""",
    {"metrics": ["revenue", "quantity", "customer_count"], "dimensions": ["c_mktsegment"]},
)
register(
    "multi_metric_fused", f"SELECT o_orderstatus, {M} AS revenue, count(o_orderkey) AS order_count, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open_orders FROM orders GROUP BY 1",
    {"metrics": ["revenue", "order_count", "open_orders"], "dimensions": ["o_orderstatus"]},
)
register(
    "scalar_compose", f"SELECT (SELECT {M} FROM orders) AS revenue, (SELECT count(*) FROM lineitem) AS line_count, (SELECT count(*) FROM customer) AS customer_count",
    {"metrics": ["revenue", "line_count", "customer_count"]},
)
register("non_additive_plain", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS average_price FROM orders GROUP BY 1", {"metrics": ["average_price"], "dimensions": ["o_orderstatus"]})
QUERIES["non_additive_plain"] = lambda spark, d: engine(spark, d).query({"metrics": ["average_price"], "dimensions": ["o_orderstatus"]}).df.withColumn("average_price", F.round("average_price", 4))
register("ratio_per_order", f"SELECT o_orderpriority, {M} / count(o_orderkey)::DOUBLE AS price_per_order FROM orders GROUP BY 1", {"metrics": ["price_per_order"], "dimensions": ["o_orderpriority"]})
_OPEN = f"{M} / nullif(count(o_orderkey) FILTER (o_orderstatus = 'O'), 0)::DOUBLE"
register("ratio_null", f"SELECT o_orderstatus, {_OPEN} AS revenue_per_open_null FROM orders GROUP BY 1", {"metrics": ["revenue_per_open_null"], "dimensions": ["o_orderstatus"]})
register("ratio_zero", f"SELECT o_orderstatus, coalesce({_OPEN}, 0) AS revenue_per_open FROM orders GROUP BY 1", {"metrics": ["revenue_per_open"], "dimensions": ["o_orderstatus"]})
register(
    "weighted_avg",
    "SELECT l_returnflag, sum((l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(6,2))::DECIMAL(24,4))::DOUBLE / sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS average_discount FROM lineitem GROUP BY 1",
    {"metrics": ["average_discount"], "dimensions": ["l_returnflag"]},
)
register(
    "population_filter", f"SELECT o_orderstatus, {M} FILTER (o_orderpriority <> '5-LOW') AS safe_revenue, count(*) AS order_count FROM orders GROUP BY 1",
    {"metrics": ["net revenue", "order_count"], "dimensions": ["o_orderstatus"]},
)
ORACLE_SQL["population_filter"] = f"SELECT o_orderstatus, (sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderpriority <> '5-LOW'))::DOUBLE AS revenue, count(*) AS order_count FROM orders GROUP BY 1"
register("distinct_count", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1", {"metrics": ["buyers"], "dimensions": ["o_orderstatus"]})
register("distinct_count_fanout", "SELECT l_returnflag, count(DISTINCT o_custkey) AS basket_buyers FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", {"metrics": ["basket_buyers"], "dimensions": ["l_returnflag"]})
register("percentile", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price FROM orders GROUP BY 1", {"metrics": ["median_price"], "dimensions": ["o_orderstatus"]})
QUERIES["percentile"] = lambda spark, d: engine(spark, d).query({"metrics": ["median_price"], "dimensions": ["o_orderstatus"]}).df.withColumn("median_price", F.round("median_price", 4))
register(
    "percentile_nearest_rank",
    "SELECT o_orderstatus, min(o_totalprice) AS p90_price FROM (SELECT *, cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS c FROM orders) WHERE c >= 0.9 GROUP BY 1",
    {"metrics": ["p90_price"], "dimensions": ["o_orderstatus"]},
)
for _agg, _order in (("last", "DESC"), ("first", "ASC")):
    register(
        f"semi_{_agg}",
        f"SELECT c_mktsegment, {_LEVEL} AS {_agg}_level FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY snap {_order}) AS n FROM {_SNAPS}) LEFT JOIN customer ON user_id = c_custkey WHERE n = 1 GROUP BY 1",
        {"metrics": [f"{_agg}_level"], "dimensions": ["c_mktsegment"]},
    )
for _agg in ("avg", "min", "max"):
    _round = "round({}, 4)" if _agg == "avg" else "{}"
    register(
        f"semi_{_agg}",
        f"SELECT c_mktsegment, {_round.format(f'{_agg}(m)')} AS {_agg}_level FROM (SELECT c_mktsegment, snap, {_LEVEL} AS m FROM {_SNAPS} LEFT JOIN customer ON user_id = c_custkey GROUP BY 1, 2) GROUP BY 1",
        {"metrics": [f"{_agg}_level"], "dimensions": ["c_mktsegment"]},
    )
QUERIES["semi_avg"] = lambda spark, d: engine(spark, d).query({"metrics": ["avg_level"], "dimensions": ["c_mktsegment"]}).df.withColumn("avg_level", F.round("avg_level", 4))
register("semi_grouped", f"SELECT snap, {_LEVEL} AS level FROM {_SNAPS} GROUP BY 1", {"metrics": ["last_level"], "dimensions": ["snap"]})
register("opaque_lookup", "SELECT c_custkey, c_acctbal AS balance FROM customer", {"metrics": ["account_balance"], "dimensions": ["c_custkey"]})
_FINAL = "date_trunc('year', o_orderdate)::TIMESTAMP AS order_year, o_orderdate <= TIMESTAMP '1999-06-16 03:59:59' AS is_final"
register("finality_union", f"SELECT {_FINAL}, {M} AS revenue FROM orders GROUP BY 1, 2", {"metrics": ["settled_revenue"], "dimensions": ["order_year"], "as_of": AS_OF})
register("finality_composite", f"SELECT {_FINAL}, {M} / count(*)::DOUBLE AS settled_per_order FROM orders GROUP BY 1, 2", {"metrics": ["settled_per_order"], "dimensions": ["order_year"], "as_of": AS_OF})
register(
    "tenant_scope", f"SELECT c_mktsegment, {M} AS revenue FROM {_LEFT} WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    {"metrics": ["revenue"], "dimensions": ["c_mktsegment"]}, TENANTS, claims={"segment": "BUILDING", "roles": ["plain"]},
)
for _mask, _sql in (("hash", "md5(c_mktsegment)"), ("partial", "substr(c_mktsegment, 1, 2) || '***'")):
    register(f"mask_{_mask}", f"SELECT {_sql} AS c_mktsegment, count(*) AS customer_count FROM customer GROUP BY 1", {"metrics": ["customer_count"], "dimensions": ["c_mktsegment"]}, TENANTS, claims={"roles": [_mask]})
register(
    "mask_null", "SELECT NULL::VARCHAR AS c_mktsegment, count(*) AS customer_count FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    {"metrics": ["customer_count"], "dimensions": ["c_mktsegment"]}, TENANTS, claims={"roles": "null", "segment": "BUILDING"},
)
register(
    "mandatory_filter_via_join", f"SELECT o_orderstatus, count(o_orderkey) AS order_count FROM {_LEFT} WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1",
    {"metrics": ["order_count"], "dimensions": ["o_orderstatus"]}, GUARDED,
)
register(
    "limit_ordered", f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS order_month, {M} AS revenue FROM orders GROUP BY 1 ORDER BY 1 LIMIT 7",
    {"metrics": ["revenue"], "dimensions": ["order_month"], "limit": 7},
)
register(
    "time_buckets", "SELECT date_trunc('day', ts)::TIMESTAMP AS event_day, date_trunc('week', ts)::TIMESTAMP AS event_week, event_type, count(*) AS event_count FROM events GROUP BY 1, 2, 3",
    {"metrics": ["event_count"], "dimensions": ["event_day", "event_week", "event_type"]},
)

_RAW = "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
QUERIES["raw_sql"] = lambda spark, d: engine(spark, d, TENANTS).run_sql(_RAW, Principal({"roles": ["sql"]}))
ORACLE_SQL["raw_sql"] = _RAW

# The event log, read off the events table: views are served answers, other events their outcomes.
_LOG = """
SELECT event_id AS seq, ts, CASE WHEN event_type IN ('view', 'error') THEN 'served_answer' WHEN event_type = 'click' THEN 'funnel_milestone' ELSE 'answer_outcome' END AS event,
  CASE WHEN event_type IN ('view', 'error') THEN CAST(user_id AS STRING) END AS query_hash, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(user_id AS STRING) END AS ref,
  CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'unresolved' ELSE 'unreachable' END END AS error, CAST(value AS DOUBLE) AS latency_ms,
  CASE WHEN value > 30 THEN 'trusted' ELSE 'provisional' END AS trust_tier, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'wrong_definition' END AS outcome,
  CASE WHEN event_type = 'click' THEN CASE user_id % 5 {milestones} END END AS milestone, CONCAT('m', CAST(user_id % 7 AS STRING)) AS binding,
  CASE WHEN event_type IN ('view', 'error') AND user_id % 3 > 0 THEN user_id * 100 END AS bytes_scanned, event_type = 'view' AND value < 10 AS stale, user_id % 4 AS fired FROM {table}"""
# The last milestone is met by no row.
_LOG = _LOG.replace("{milestones}", " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(event_logs.MILESTONES[:-1])))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.sql(_LOG.format(table="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    guardrails = F.transform(F.sequence(F.lit(1), F.col("fired")), lambda i: i.cast("string"))
    log = log.withColumn("guardrails", F.when(F.col("fired") > 0, guardrails).otherwise(F.array().cast("array<string>"))).drop("fired")
    return log.withColumn("resolved", F.create_map(F.lit("metric"), F.col("binding")))


def _log_query(name: str, report: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: report(event_log(spark, d))
    ORACLE_SQL[name] = f"WITH log AS ({_LOG.format(table='events').replace('STRING', 'VARCHAR')}) {sql}"


_LAST = "(SELECT ref, outcome, ts FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY seq DESC) AS n FROM log WHERE ref IS NOT NULL) WHERE n = 1)"
_SERVED = "(SELECT query_hash, trust_tier, binding FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY seq DESC) AS n FROM log WHERE event = 'served_answer') WHERE n = 1)"
_ANSWERS = """count(*) AS answers, count(error) AS errors, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts, min(latency_ms) AS latency_min, max(latency_ms) AS latency_max,
    round(avg(latency_ms), 4) AS latency_avg, sum(bytes_scanned)::BIGINT AS bytes_total, min(bytes_scanned) AS bytes_min, max(bytes_scanned) AS bytes_max, round(avg(bytes_scanned), 4) AS bytes_avg,
    count(*) FILTER (stale) AS stale_answers, count(*) FILTER (fired > 0) AS guardrail_coverage, quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95"""


def _averages(df: DataFrame) -> DataFrame:
    return df.withColumn("latency_avg", F.round("latency_avg", 4)).withColumn("bytes_avg", F.round("bytes_avg", 4))


_log_query("event_report", lambda log: _averages(event_logs.answer_report(log)), f"SELECT {_ANSWERS} FROM log WHERE event = 'served_answer'")
_log_query("event_recent", lambda log: event_logs.recent(log).select("seq", "query_hash", "error"), "SELECT seq, query_hash, error FROM log WHERE event = 'served_answer' ORDER BY seq DESC LIMIT 10")
_log_query("error_distribution", event_logs.error_distribution, "SELECT coalesce(error, 'ok') AS error, count(*) AS answers FROM log WHERE event = 'served_answer' GROUP BY 1")
_log_query("errors_by_code", lambda log: event_logs.errors_by_code(log), "SELECT error, count(*) AS answers FROM log WHERE error IS NOT NULL GROUP BY 1")
_log_query("latest_outcomes", lambda log: event_logs.latest_outcomes(log), f"SELECT ref, outcome, ts FROM {_LAST}")
_TIERS = f"SELECT s.trust_tier AS tier, count(*) AS judged, count(*) FILTER (outcome LIKE 'wrong%') AS incorrect, count(*) FILTER (outcome LIKE 'wrong%') / count(*)::DOUBLE AS incorrect_rate FROM {_LAST} o JOIN {_SERVED} s ON o.ref = s.query_hash WHERE s.trust_tier IS NOT NULL GROUP BY 1"
_RECUR = f"SELECT s.binding, count(*) AS corrections FROM {_LAST} o JOIN {_SERVED} s ON o.ref = s.query_hash WHERE o.outcome LIKE 'wrong%' GROUP BY 1 HAVING count(*) > 1"
_log_query("calibration", event_logs.calibration, _TIERS)
_log_query("calibration_unmatched", event_logs.unmatched, f"SELECT count(*) FILTER (s.trust_tier IS NULL) AS unmatched FROM {_LAST} o LEFT JOIN {_SERVED} s ON o.ref = s.query_hash")
_log_query("recurring_corrections", event_logs.recurring_corrections, _RECUR)
_REACHED = f"(SELECT coalesce(list(m ORDER BY i), []) FROM (SELECT unnest({list(event_logs.MILESTONES)}) AS m, unnest(range({len(event_logs.MILESTONES)})) AS i) WHERE m IN (SELECT milestone FROM log WHERE milestone IS NOT NULL))"
_FIRST = "(SELECT arg_min(ts, seq) FROM log WHERE milestone = '{}')"
_TOOK = f"(epoch_us({_FIRST.format('first_answer_served')}) - epoch_us({_FIRST.format('setup_started')})) / 1e6"
_log_query(
    "funnel_report", lambda log: event_logs.funnel_report(log).withColumn("reached", F.array_join("reached", ",")),
    f"SELECT array_to_string(r, ',') AS reached, {_TOOK} AS time_to_first_answer_seconds, CASE WHEN len(r) BETWEEN 1 AND 4 THEN r[-1] END AS dropped_after FROM (SELECT {_REACHED} AS r)",
)
_log_query("funnel", lambda log: event_logs.funnel(log), "SELECT milestone, min(seq) AS place, arg_min(ts, seq) AS first FROM log WHERE event = 'funnel_milestone' GROUP BY 1")
_log_query(
    "capped_bindings", lambda log: event_logs.capped_bindings(log.withColumn("ts", F.col("ts").cast("timestamp")), 20, "2024-01-31"),
    """SELECT binding FROM (SELECT *, row_number() OVER (PARTITION BY binding ORDER BY seq DESC) AS n FROM log WHERE outcome IS NOT NULL) WHERE n = 1 AND outcome = 'wrong_definition'
    AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""",
)
_log_query("event_counts", event_logs.event_counts, "SELECT event, error, count(*) AS n FROM log GROUP BY 1, 2")


def _payload(log: DataFrame) -> DataFrame:
    tier = F.transform("trust_calibration", lambda x: F.concat_ws(":", x["tier"], x["judged"], x["incorrect"]))
    errors = F.transform(F.map_entries("error_distribution"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    made = _averages(event_logs.telemetry(log, accuracy=0.5)).withColumns({"trust_calibration": F.array_join(tier, ","), "error_distribution": F.array_join(errors, ",")})
    return made.withColumn("funnel_reached", F.array_join("funnel_reached", ","))


_log_query(
    "telemetry", _payload,
    f"""SELECT '1' AS schema_version, a.* EXCLUDE (answers, errors, first_ts, last_ts, stale_answers, guardrail_coverage), answers AS answer_count, stale_answers AS stale_answer_count,
    guardrail_coverage AS guardrail_hit_count, (SELECT string_agg(e || ':' || n, ',' ORDER BY e) FROM (SELECT coalesce(error, 'ok') AS e, count(*) AS n FROM log WHERE event = 'served_answer' GROUP BY 1)) AS error_distribution,
    (SELECT string_agg(tier || ':' || judged || ':' || incorrect, ',' ORDER BY tier) FROM ({_TIERS})) AS trust_calibration, (SELECT count(*) FROM ({_RECUR})) AS recurring_binding_count,
    array_to_string({_REACHED}, ',') AS funnel_reached, {_TOOK} AS time_to_first_answer_seconds, 0.5::DOUBLE AS accuracy FROM (SELECT {_ANSWERS} FROM log WHERE event = 'served_answer') a""",
)

# Retrieval over documents and embeddings.
SEARCH = "token password the"


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    return retrieval.bm25(docs, SEARCH, {"body": 1.0}, "doc_id")


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors.filter("vec_id = 0").first()["embedding"]
    return retrieval.cosine(vectors, query).withColumnRenamed("vec_id", "doc_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_TERMS = sorted(SEARCH.split())
_BM25 = f"""t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT doc_id, len(w) AS length, {', '.join(f"len(list_filter(w, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(_TERMS))} FROM t),
s AS (SELECT count(*) AS pages, avg(length) AS mean, {', '.join(f'count(*) FILTER (n{i} > 0) AS df{i}' for i in range(len(_TERMS)))} FROM n),
bm AS (SELECT doc_id, {' + '.join(f'ln(1 + (pages - df{i} + 0.5) / (df{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * length / mean))' for i in range(len(_TERMS)))} AS score
  FROM n, s WHERE {' OR '.join(f'n{i} > 0' for i in range(len(_TERMS)))})"""
_COS = """q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q.e) AS score FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], q.e) > 0)"""
QUERIES["bm25_search"], ORACLE_SQL["bm25_search"] = lambda spark, d: _rounded(_bm25(spark, d)), f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm"
QUERIES["cosine_search"], ORACLE_SQL["cosine_search"] = lambda spark, d: _rounded(_cosine(spark, d)), f"WITH {_COS} SELECT doc_id, round(score, 6) AS score FROM cs"
QUERIES["rrf_search"] = lambda spark, d: _rounded(retrieval.fuse([(_bm25(spark, d), 1.0), (_cosine(spark, d), 1.0)], "doc_id"))
_RANK = "SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM {}"
ORACLE_SQL["rrf_search"] = f"WITH {_BM25}, {_COS} SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score FROM ({_RANK.format('bm')} UNION ALL {_RANK.format('cs')}) GROUP BY 1"
QUERIES["page_text"] = lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", page_text(F.col("html")).alias("t")).select("page_id", "t.*")
# The entities are those that these pages have.
_PLAIN = "trim(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), E' \\t\\n\\r')"
_CUT = "regexp_replace(coalesce(html, ''), '<!--.*?-->|<script[\\s>].*?</script>|<style[\\s>].*?</style>', chr(1), 'gis')"
_TITLE = "<title[^>]*>(.*?)</title>"
ORACLE_SQL["page_text"] = f"""WITH c AS (SELECT page_id, {_CUT} AS h FROM pages), s AS (SELECT page_id, regexp_extract(h, '{_TITLE}', 1, 'is') AS title,
  string_split(regexp_replace(regexp_replace(h, '{_TITLE}', chr(1), 'gis'), '<[^>]*>', chr(1), 'g'), chr(1)) AS parts FROM c)
SELECT page_id, {_PLAIN.format('title')} AS title, array_to_string(list_filter(list_transform(parts, lambda x: {_PLAIN.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM s"""


_ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()
QUERIES["column_stats"] = lambda spark, d: column_stats(spark.read.parquet(f"{d}/orders.parquet"), exact=True)
ORACLE_SQL["column_stats"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) / count(*)::DOUBLE AS uniqueness_ratio, avg(({c} IS NULL)::INT)::DOUBLE AS null_fraction,
    count(DISTINCT {c}) = count(*) AND count(*) > 0 AS is_unique FROM orders""" for c in _ORDER_COLUMNS
)


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    real = column_stats(orders, exact=True).select("column", F.col("n_distinct").alias("real"), F.col("is_unique").alias("unique"))
    near = F.abs(F.col("n_distinct") - F.col("real")) <= F.col("real") * 0.05
    return column_stats(orders).join(real, "column").select("column", near.alias("near"), (F.col("is_unique") == F.col("unique")).alias("settled"))


QUERIES["column_estimates"] = _estimates
ORACLE_SQL["column_estimates"] = f"SELECT unnest({_ORDER_COLUMNS}) AS \"column\", true AS near, true AS settled"

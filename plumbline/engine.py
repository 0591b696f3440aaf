"""The engine: a semantic query in, a lazy DataFrame and what is to be known about it out."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions import sqlexpr
from plumbline.model import SYSTEM, Assertion, Binding, Principal, Project, Query, Source
from plumbline.plans import compose, joins, trust
from plumbline.plans.finality import watermark
from plumbline.plans.leaf import Dim, Leaf, Notes, Planner
from plumbline.plans.resolver import Policy, Resolver

#: Rows that ``to_result_set`` fetches at most.
ROW_LIMIT = 10_000


@dataclass
class Planned:
    """A planned query: ``df`` is lazy, the rest is known without a Spark job."""

    df: DataFrame
    query: Query
    resolved: dict[str, str]
    guardrails: list[dict]
    warnings: list[str]
    tier: str
    reasons: list[str]
    finality: dict[str, Any] | None = None
    tenants: list[str] = field(default_factory=list)
    related: dict[str, list[str]] = field(default_factory=dict)
    signals: list[trust.Signal] = field(default_factory=list)

    def served_trust(self, stale: tuple[str, ...] = (), wrong: tuple[str, ...] = ()) -> tuple[str, list[str]]:
        """The tier of the answer as served, and why: what was known before, provisional rows in it (runs it), stale sources, metrics confirmed wrong."""
        asked = set(self.resolved.values())
        late = trust.served_signals(self.finality_rows().get("provisional", 0), stale, tuple(m for m in wrong if m in asked))
        return trust.score([*self.signals, *late])

    def finality_rows(self) -> dict[str, int]:
        """Final and provisional rows of the answer (runs it)."""
        if not self.finality:
            return {}
        rows = {r["is_final"]: r["count"] for r in self.df.groupBy("is_final").count().collect()}
        return {"final": rows.get(True, 0), "provisional": rows.get(False, 0)}

    def to_result_set(self, limit: int = ROW_LIMIT) -> dict[str, Any]:
        return result_set(self.df, limit)


def result_set(df: DataFrame, limit: int = ROW_LIMIT) -> dict[str, Any]:
    """Columns with normalised types and at most ``limit`` rows; one more is asked for to tell whether there are more."""
    from plumbline.sources.catalog import normalised

    rows = df.limit(limit + 1).collect()
    columns = [{"name": f.name, "type": normalised(f.dataType)[0]} for f in df.schema.fields]
    return {"columns": columns, "rows": [list(r) for r in rows[:limit]], "truncated": len(rows) > limit}


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        project: Project,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None,
        verdicts: dict[str, bool] | None = None,
        log: str | Path | None = None,
        rls_enforced: bool = False,
    ) -> None:
        self.spark, self.project, self.tables = spark, project, dict(tables or {})
        self.resolver, self.verdicts, self.log, self.rls_enforced = Resolver(project), verdicts, log, rls_enforced

    def table(self, source: Source) -> DataFrame:
        found = self.tables.get(source.table, self.tables.get(source.name))
        if callable(found) and not isinstance(found, DataFrame):
            found = self.tables[source.table] = found()
        return self.spark.table(source.table) if found is None else found

    # Queries

    def query(self, query: Query | dict, principal: Principal | None = None) -> Planned:
        query, began = Query.of(query) if isinstance(query, dict) else query, time.time()
        error: str | None = None
        planned: Planned | None = None
        try:
            planned = self._plan(query, principal)
            return planned
        except Refusal as refusal:
            error = refusal.code
            raise
        finally:
            self._event(query, planned, error, time.time() - began)

    def explain(self, query: Query | dict, principal: Principal | None = None) -> str:
        """The physical plan of a query; nothing runs."""
        plan = self.query(query, principal).df._jdf.queryExecution()
        return self.spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "formatted")

    def checked(self, query: Query | dict, principal: Principal | None = None, harness: bool = False) -> tuple[Planned, list[str]]:
        """A query with what the assertions on the very same question find; under the harness that is refused."""
        query = Query.of(query) if isinstance(query, dict) else query
        planned, problems = self.query(query, principal), []
        same = [a for a in self.project.assertions if Query.of(a.query) == query]
        if same:
            rows = [r.asDict() for r in planned.df.limit(ROW_LIMIT).collect()]
            bound = {m: self.resolver.find(m)[0] for m in query.metrics}
            problems = [f"{a.id}: {p}" for a in same for p in mismatches(a, rows, bound)]
        if problems and harness:
            raise Refusal("assertion_failed", "; ".join(problems))
        return planned, problems

    def _plan(self, query: Query, principal: Principal | None) -> Planned:
        if not query.metrics:
            raise Refusal("validation_failed", "a query asks for at least one metric")
        policy, notes = self.resolver.policy(principal), Notes()
        if policy.unscoped:
            notes.warn("the caller has no tenant; the answer isn't scoped")
        bindings = self.resolver.metrics(query.metrics, policy)
        planner = Planner(self, query, policy, notes)
        leaves_of = [self.resolver.leaves(b) for b in bindings]
        signals = trust.static_signals(bindings, self.project.assertions, self.verdicts)
        tier, reasons = trust.score(signals)
        for b, own in zip(bindings, leaves_of):
            for leaf in own:
                self._required(leaf, b, query, planner, notes)
                self._trusted(leaf, b, query, tier, reasons, notes)

        leaves: list[Leaf] = []
        outputs: list[tuple[str, str, Any]] = []
        for i, (b, own) in enumerate(zip(bindings, leaves_of)):
            if b.composite:
                population = (b.population_filter,) if b.population_filter else ()
                made = [planner.leaf(c, f"__m{i}{part}", population) for c, part in zip(own, "nd")]
                leaves += made
                if b.on_zero_denominator == "null":
                    notes.warn(f"{b.metric}: null where {b.denominator} is zero")
                outputs.append((b.metric, b.metric, compose.ratio(F.col(f"__m{i}n"), F.col(f"__m{i}d"), b.on_zero_denominator)))
            else:
                made = planner.leaf(b, f"__m{i}")
                leaves.append(made)
                short = b.measure if b.kind in ("single", "opaque") or b.kind == "semi_additive" and made.key[0] == "single" else b.metric
                outputs.append((short, b.metric, F.col(f"__m{i}")))
            if b.kind == "single":
                self._restricted(b, query, planner, notes)

        dims = planner.dimensions(self.resolver.leaves(bindings[0])[0].source)
        by = [f"__d{i}" for i in range(len(dims))]
        metrics = [n for leaf in leaves for n, _ in (leaf.aggregates or leaf.branches[0].aggregates)]
        fused = compose.fuse(leaves)
        df = compose.stack(fused, by, metrics)
        final = any(leaf.final for leaf in leaves)
        short = [s for s, _, _ in outputs]
        names = [s if short.count(s) == 1 else metric for s, metric, _ in outputs]
        shown = [F.col(d).alias(n) for d, n in zip(by, dimension_names(dims))]
        df = df.select(*shown, *([F.col("is_final")] if final else []), *[c.alias(n) for n, (_, _, c) in zip(names, outputs)])
        if query.limit is not None:
            ordered = [F.col(f"`{n}`").asc_nulls_last() for n in [*dimension_names(dims), *(["is_final"] if final else [])]]
            df = (df.orderBy(*ordered) if ordered else df).limit(int(query.limit))
        known = [leaf.finality for leaf in leaves if leaf.finality]
        finality = {"watermark": min(k["watermark"] for k in known), "sources": sorted({s for k in known for s in k["sources"]})} if known else None
        guards = [{"id": g, "applied": a} for g, a in sorted(notes.guardrails.items())]
        resolved = {asked: b.metric for asked, b in zip(query.metrics, bindings)}
        return Planned(df, query, resolved, guards, notes.warnings, tier, reasons, finality, sorted(set(notes.tenants)), self._related(bindings, query, policy), signals)

    def _block(self, severity: str, text: str, notes: Notes) -> None:
        if severity == "error":
            raise Refusal("guardrail_block", text)
        notes.warn(text)

    def _required(self, leaf: Binding, b: Binding, query: Query, planner: Planner, notes: Notes) -> None:
        for g in self._on(leaf, b, "required_dimension", query.context):
            d = self.project.sources[leaf.source].dimension(g.dimension) if leaf.source in self.project.sources else None
            have = {x.dimension.name for x in planner.dimensions(leaf.source)} | {x.asked for x in planner.dimensions(leaf.source)}
            filtered = d and (leaf.source, d.column) in planner.filter_columns(leaf.source)
            fine = g.dimension in have or bool(filtered)
            notes.guardrails[g.id] = not fine
            if not fine:
                self._block(g.severity, f"{g.id}: {b.metric} is to be grouped by or filtered on {g.dimension}", notes)

    def _on(self, leaf: Binding, b: Binding, kind: str, context: str | None) -> list:
        found = self.resolver.guardrails(leaf, kind, context) + (self.resolver.guardrails(b, kind, context) if b is not leaf else [])
        return list({g.id: g for g in found}.values())

    def _trusted(self, leaf: Binding, b: Binding, query: Query, tier: str, reasons: list[str], notes: Notes) -> None:
        for g in self._on(leaf, b, "min_trust", query.context):
            fine = trust.at_least(tier, g.level)
            notes.guardrails[g.id] = not fine
            if not fine:
                self._block(g.severity, f"{g.id}: trust is {tier}, {g.level} is asked for ({'; '.join(reasons)})", notes)

    def _restricted(self, b: Binding, query: Query, planner: Planner, notes: Notes) -> None:
        """Blocks questions that reach beyond the final rows: by the upper bound of their times or, where it is open, by the lower."""
        rule = self.resolver.finality(b)
        for g in self.resolver.guardrails(b, "restrict_source", query.context):
            notes.guardrails.setdefault(g.id, False)
            if not rule or g.restrict_to != "final":
                continue
            end = rule.role("final")
            cut = watermark(end.watermark, end.tz, query.as_of)
            asked = time_window(query, self.project.sources[b.source], planner)
            bound = asked.lower if asked.upper is None else asked.upper
            if bound and bound > cut:
                notes.guardrails[g.id] = True
                self._block(g.severity, f"{g.id}: the time asked for reaches beyond {cut.isoformat()}", notes)

    def _related(self, bindings: list[Binding], query: Query, policy: Policy) -> dict[str, list[str]]:
        """Up to five further dimensions that every source of the query has, and further metrics of these sources."""
        owners = {c.source for b in bindings for c in self.resolver.leaves(b)}
        common = set.intersection(*(set(joins.reachable_dimensions(o, self.project.sources)) for o in owners))
        asked = {b.metric for b in bindings}
        near = [b.metric for b in self.resolver.active if b.source in owners and b.metric not in asked and policy.sees(b.metric)]
        return {"dimensions": sorted(common - set(query.dimensions))[:5], "metrics": sorted(near)[:5]}

    def run_sql(self, sql: str, principal: Principal | None = None) -> DataFrame:
        """One read-only query over the project's tables, if the caller's role allows it and rows are scoped elsewhere."""
        policy = self.resolver.policy(principal)
        if not policy.run_sql:
            raise Refusal("tenant_forbidden", "the caller's role doesn't allow SQL")
        if self.project.tenancy and not policy.exempt and not self.rls_enforced:
            raise Refusal("tenant_forbidden", "the connection doesn't vouch for row-level security")
        names = {s.name for s in self.project.sources.values()}
        sqlexpr.assert_read_only(self.spark, sql, names)
        for s in self.project.sources.values():
            if re.search(rf"\b{re.escape(s.name)}\b", sql, re.I):
                self.table(s).createOrReplaceTempView(s.name)
        return self.spark.sql(sql)

    # Discovery

    def list_metrics(self, principal: Principal | None = None) -> list[dict]:
        policy = self.resolver.policy(principal)
        shown = [b for b in self.resolver.active if b.kind != "opaque" and policy.sees(b.metric)]
        return [{"metric": b.metric, "kind": b.kind, "label": b.label, "aliases": sorted(b.aliases)} for b in sorted(shown, key=lambda b: b.metric)]

    def describe_metric(self, name: str, principal: Principal | None = None) -> dict:
        (b,) = self.resolver.metrics((name,), self.resolver.policy(principal))
        own = self.resolver.leaves(b)
        dims = set.intersection(*(set(joins.reachable_dimensions(c.source, self.project.sources)) for c in own))
        guards = sorted({g.id for c in own for kind in ("mandatory_filter", "restrict_source", "min_trust", "required_dimension") for g in self.project.guardrails if g.kind == kind and g in self.resolver.guardrails(c, kind, g.context)})
        tier, reasons = trust.score(trust.static_signals([b], self.project.assertions, self.verdicts))
        return {"metric": b.metric, "kind": b.kind, "label": b.label, "aliases": sorted(b.aliases), "sources": sorted({c.source for c in own}), "dimensions": sorted(dims), "guardrails": guards, "tier": tier, "reasons": reasons}

    def overview(self, principal: Principal | None = None) -> dict[str, list[str]]:
        """Visible metrics by owning source."""
        policy, out = self.resolver.policy(principal), {}
        for b in self.resolver.active:
            if policy.sees(b.metric):
                try:
                    out.setdefault(self.resolver.leaves(b)[0].source, []).append(b.metric)
                except Refusal:  # bound to components that can't be had; validation tells
                    continue
        return {s: sorted(out[s]) for s in sorted(out)}

    def trust_report(self) -> dict[str, tuple[str, list[str]]]:
        return {b.metric: trust.score(trust.static_signals([b], self.project.assertions, self.verdicts)) for b in self.resolver.active}

    # Assertions and reports

    def check_assertions(self) -> dict[str, Any]:
        """Runs every assertion; the verdict of a metric is its worst."""
        results, verdicts = [], {}
        for a in self.project.assertions:
            try:
                rows = self.query(dict(a.query), SYSTEM).df.limit(ROW_LIMIT).collect()
                problems = mismatches(a, [r.asDict() for r in rows], {m: self.resolver.find(m)[0] for m in a.query.get("metrics") or () if self.resolver.find(m)})
            except Refusal as refusal:
                problems = [f"{refusal.code}: {refusal.message}"]
            results.append({"id": a.id, "passed": not problems, "problems": problems})
            for m in a.query.get("metrics") or ():
                verdicts[m] = verdicts.get(m, True) and not problems
        self.verdicts = verdicts
        return {"passed": sum(r["passed"] for r in results), "total": len(results), "results": results}

    def report(self, sections: list[dict], filters: tuple = (), principal: Principal | None = None) -> list[dict]:
        """Sections in order; one that fails becomes an entry with its error.  The caller's filters are added to each."""
        out = []
        for section in sections:
            query = dict(section["query"])
            query["filters"] = [*(query.get("filters") or []), *filters]
            try:
                out.append({"title": section.get("title"), "result": self.query(query, principal).to_result_set()})
            except Refusal as refusal:
                out.append({"title": section.get("title"), "error": {"code": refusal.code, "message": refusal.message}})
        return out

    def check_report(self, name: str, sections: list[dict], filters: tuple = (), pages: tuple[str, ...] = ()) -> None:
        """Refuses a report of which a section can't be planned, whoever asks, or takes its words from a page that isn't there; nothing runs."""
        for i, section in enumerate(sections):
            query = dict(section["query"])
            query["filters"] = [*(query.get("filters") or []), *filters]
            try:
                self._plan(Query.of(query), SYSTEM)
            except Refusal as refusal:
                raise Refusal("validation_failed", f"report {name}, section {i}: {refusal.message}", refusal.candidates) from None
            if (page := section.get("narrative_from")) and page not in pages:
                raise Refusal("validation_failed", f"report {name}, section {i}: there is no page {page!r}")

    # Events

    def _event(self, query: Query, planned: Planned | None, error: str | None, seconds: float) -> None:
        """Appends to the event log; a log that can't be written never breaks a query."""
        if not self.log:
            return
        asked = {"metrics": list(query.metrics), "dimensions": list(query.dimensions), "filters": [str(f) for f in query.filters]}
        line = {
            "event": "served_answer", "ts": datetime.now().astimezone().isoformat(), "query": asked, "error": error,
            "query_hash": hashlib.sha256(json.dumps(asked, sort_keys=True).encode()).hexdigest(), "latency_ms": seconds * 1000,
            "resolved": planned.resolved if planned else {}, "trust_tier": planned.tier if planned else None, "stale": False,
            "bytes_scanned": scanned(planned.df) if planned else None, "guardrails": [g["id"] for g in planned.guardrails if g["applied"]] if planned else [],
        }
        try:
            with open(self.log, "a", encoding="utf-8") as file:
                file.write(json.dumps(line) + "\n")
        except OSError:
            pass


def scanned(df: DataFrame) -> int | None:
    """Bytes of the tables that the plan reads, by Spark's statistics; nothing runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if all(s < 2**60 for s in sizes) else None


def dimension_names(dims: list[Dim]) -> list[str]:
    """Bare names, save those that repeat, which keep their role."""
    bare = [d.dimension.name for d in dims]
    return [n if bare.count(n) == 1 else f"{d.alias}.{n}" for d, n in zip(dims, bare)]


def time_window(query: Query, source: Source, planner: Planner) -> sqlexpr.Window:
    """What the query's filters leave of the source's own times."""

    def is_time(parts: tuple[str, ...]) -> bool:
        alias, column = planner.place(parts, source.name)
        declared = source.column(column) if alias == source.name else None
        return bool(declared and declared.type in ("date", "timestamp"))

    found = sqlexpr.Window()
    for f in query.filters:
        found &= sqlexpr.window(planner.spark, f, is_time)
    return found


def close(found: Any, wanted: Any, tolerance: float) -> bool:
    """Equal, or numbers within the relative tolerance (absolute around 0); truth values are no numbers."""
    numbers = not isinstance(found, bool) and not isinstance(wanted, bool)
    try:
        if numbers and found is not None and wanted is not None:
            a, b = float(found), float(wanted)
            return abs(a - b) <= tolerance * (abs(b) or 1.0)
    except (TypeError, ValueError):
        pass
    return numbers is not (isinstance(found, bool) and isinstance(wanted, bool)) and found == wanted


def mismatches(a: Assertion, rows: list[dict], bindings: dict[str, Binding]) -> list[str]:
    out = [f"{len(rows)} rows, not {a.rows}"] if a.rows is not None and len(rows) != a.rows else []
    first = rows[0] if rows else {}
    for name, wanted in a.values.items():
        column = name if name in first else getattr(bindings.get(name), "measure", None)
        if column not in first:
            out.append(f"{name} isn't in the answer")
        elif not close(first[column], wanted, a.tolerance):
            out.append(f"{name} is {first[column]}, not {wanted}")
    return out

"""Leaves: one source's rows, joined, filtered and grouped, with what is to be aggregated.

A leaf stays unaggregated until all leaves of a query are known, so leaves alike in
everything but their measures share one aggregation.  Inside, dimensions are called __d0,
__d1...; this keeps names with dots and names that repeat apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from difflib import get_close_matches
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import Refusal
from plumbline.functions import sqlexpr
from plumbline.model import Binding, Dimension, FinalityRule, Query, Source
from plumbline.operators.percentile import exact_percentile
from plumbline.operators.rows import collapse_edges, one_row_per_grain
from plumbline.plans import joins
from plumbline.plans.finality import watermark
from plumbline.plans.resolver import Policy


def q(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


@dataclass(frozen=True)
class Dim:
    asked: str
    alias: str
    source: str
    dimension: Dimension


@dataclass
class Leaf:
    """rows: dimensions __d*, is_final where it applies, and what the aggregates read."""

    key: tuple
    rows: DataFrame | None
    by: list[str]
    aggregates: list[tuple[str, Column]]
    final: bool = False
    shaped: bool = False
    finality: dict[str, Any] | None = None
    branches: list[Leaf] = field(default_factory=list)

    def aggregated(self) -> DataFrame:
        if self.branches:
            out = None
            for b in self.branches:
                part = b.aggregated()
                out = part if out is None else out.unionByName(part)
            return out
        made = [c.alias(n) for n, c in self.aggregates]
        if self.shaped:
            return self.rows.select(*self.by, *made)
        return self.rows.groupBy(*self.by).agg(*made)


@dataclass
class Notes:
    warnings: list[str] = field(default_factory=list)
    guardrails: dict[str, bool] = field(default_factory=dict)
    tenants: list[str] = field(default_factory=list)

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)


class Planner:
    """Plans leaves of one query."""

    def __init__(self, engine: Any, query: Query, policy: Policy, notes: Notes) -> None:
        self.engine, self.query, self.policy, self.notes = engine, query, policy, notes
        self.sources: dict[str, Source] = engine.project.sources
        self.spark = engine.spark

    # Names

    def dimension(self, name: str, owner: str) -> Dim:
        tree = joins.alias_tree(owner, self.sources)
        if "." in name:
            alias, _, bare = name.partition(".")
            found = self.sources[tree[alias]].dimension(bare) if alias in tree else None
            if found:
                return Dim(name, alias, tree[alias], found)
        elif found := self.sources[owner].dimension(name):
            return Dim(name, owner, owner, found)
        else:
            at = [(a, s) for a, s in tree.items() if a != owner and self.sources[s].dimension(name)]
            if len(at) == 1:
                return Dim(name, at[0][0], at[0][1], self.sources[at[0][1]].dimension(name))
            if at:
                raise Refusal("ambiguous", f"dimension {name!r} is on {len(at)} joined sources", [f"{a}.{name}" for a, _ in sorted(at)])
        near = get_close_matches(name, joins.reachable_dimensions(owner, self.sources), 5, 0.5)
        raise Refusal("unreachable", f"dimension {name!r} can't be reached from {owner}", near)

    def dimensions(self, owner: str) -> list[Dim]:
        return [self.dimension(d, owner) for d in self.query.dimensions]

    def place(self, parts: tuple[str, ...], owner: str) -> tuple[str, str]:
        """Alias and column of a name in a filter or an expression."""
        tree = joins.alias_tree(owner, self.sources)
        if len(parts) >= 2:
            alias, name = parts[-2], parts[-1]
            if alias not in tree:
                alias = next((a for a, s in tree.items() if self.sources[s].table.split(".")[-1] == alias), alias)
            if alias in tree:
                source = self.sources[tree[alias]]
                if source.column(name) or not source.columns:
                    return alias, name
                if found := source.dimension(name):
                    return alias, found.column
        else:
            name = parts[0]
            own = self.sources[owner]
            # A filter on a bucketed dimension is one on its column.
            if found := own.dimension(name):
                return owner, found.column
            if own.column(name):
                return owner, name
            dims = [(a, self.sources[s].dimension(name)) for a, s in tree.items() if a != owner and self.sources[s].dimension(name)]
            if len(dims) > 1:
                raise Refusal("ambiguous", f"{name!r} is on several joined sources", sorted(f"{a}.{name}" for a, _ in dims))
            if dims:
                return dims[0][0], dims[0][1].column
            for alias in sorted(tree):
                if self.sources[tree[alias]].column(name):
                    return alias, name
        raise Refusal("unreachable", f"{'.'.join(parts)!r} is no column that can be reached from {owner}")

    def predicate(self, text: str, owner: str) -> tuple[Column, set[str], str]:
        """A written predicate on qualified columns, the aliases it needs, and its spelling."""
        needs: set[str] = set()

        def name(parts: tuple[str, ...]) -> str:
            alias, column = self.place(parts, owner)
            needs.add(alias)
            return q(alias, column)

        spelled = sqlexpr.renamed(self.spark, text, name)
        return F.expr(spelled), needs, spelled

    def filter(self, given: Any, owner: str) -> tuple[Column, set[str], str]:
        if isinstance(given, str):
            return self.predicate(given, owner)
        needs: set[str] = set()

        def column(name: str) -> Column:
            alias, found = self.place(tuple(name.split(".")), owner)
            needs.add(alias)
            return F.col(q(alias, found))

        made = sqlexpr.structured(given, column)
        return made, needs, repr(sorted((k, str(v)) for k, v in given.items()))

    def filter_columns(self, owner: str) -> set[tuple[str, str]]:
        out = set()
        for f in self.query.filters:
            names = sqlexpr.attributes(self.spark, f) if isinstance(f, str) else {tuple(str(f.get("field")).split("."))}
            out |= {self.place(n, owner) for n in names}
        return out

    # Rows

    def guards(self, binding: Binding) -> list[str]:
        out = []
        for g in self.engine.resolver.guardrails(binding, "mandatory_filter"):
            self.notes.guardrails[g.id] = True
            if g.severity == "warn":
                self.notes.warn(f"{g.id}: {g.rationale or g.filter}")
            out.append(g.filter)
        return out

    def tenant_conditions(self, owner: str, edges: list[joins.Edge]) -> list[tuple[Column, str]]:
        tenancy = self.engine.project.tenancy
        if not tenancy or self.policy.exempt or self.policy.unscoped:
            return []
        out = []
        for alias, source in [(owner, owner), *((e.alias, e.join.to) for e in edges)]:
            if column := tenancy.scoped.get(source):
                # On a joined side that has no match the tenant is null, and the row goes.
                own = F.col(q(alias, column)) == F.lit(self.policy.tenant)
                out.append((own, f"tenant:{alias}"))
                self.notes.tenants.append(f"{alias}.{column}")
            elif source not in tenancy.shared:
                if tenancy.undeclared_source == "deny":
                    raise Refusal("tenant_scope_missing", f"source {source} is neither scoped nor shared")
                self.notes.warn(f"source {source} is neither scoped nor shared")
        return out

    def scan(self, owner: str, edges: list[joins.Edge]) -> DataFrame:
        rows = self.engine.table(self.sources[owner]).alias(owner)
        for edge in edges:
            target, origin = self.sources[edge.join.to], edge.origin

            def name(parts: tuple[str, ...], edge: joins.Edge = edge, target: Source = target, origin: str = origin) -> str:
                known_target = {edge.alias, edge.join.to, target.table, target.table.split(".")[-1]}
                at = parts[-2] if len(parts) > 1 else None
                if at == edge.alias or at in known_target and at != origin:
                    return q(edge.alias, parts[-1])
                return q(origin, parts[-1])

            on = F.expr(sqlexpr.renamed(self.spark, edge.join.on, name))
            rows = rows.join(self.engine.table(target).alias(edge.alias), on, "left")
        return rows

    def dim_column(self, d: Dim) -> Column:
        """Bucketed first, then masked; the same for output and grouping."""
        out = F.col(q(d.alias, d.dimension.column))
        if d.dimension.granularity:
            out = F.date_trunc(d.dimension.granularity, out).cast(self.time_type(d))
        masks = self.policy.masks
        strategy = masks.get(f"{d.source}.{d.dimension.column}") or masks.get(d.dimension.column)
        if strategy == "null":
            return F.lit(None).cast("string")
        if strategy == "hash":
            return F.md5(out.cast("string"))
        if strategy == "partial":
            return F.concat(F.substring(out.cast("string"), 1, 2), F.lit("***"))
        return out

    def time_type(self, d: Dim) -> str:
        kind = self.engine.table(self.sources[d.source]).schema[d.dimension.column].dataType
        return "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"

    def prepare(self, owner: str, written: list[Any], extra: set[str] = frozenset()) -> tuple[DataFrame, list[Dim], list[joins.Edge], tuple]:
        """Joined and filtered rows under their aliases, the dimensions, the joins, and what tells leaves apart."""
        dims = self.dimensions(owner)
        made = [self.filter(f, owner) for f in (*self.query.filters, *written)]
        needs = {d.alias for d in dims} | {a for _, n, _ in made for a in n} | extra
        edges = joins.plan(owner, needs - {owner}, self.sources, self.query.via)
        scoped = self.tenant_conditions(owner, edges)
        rows = self.scan(owner, edges)
        for condition in [c for c, _ in scoped] + [c for c, _, _ in made]:
            rows = rows.where(condition)
        said = (owner, tuple(d.asked for d in dims), tuple(sorted({s for _, s in scoped} | {s for _, _, s in made})), tuple((e.origin, e.alias) for e in edges))
        return rows, dims, edges, said

    def measure_column(self, expr: str, owner: str) -> str:
        """An aggregate on the owner's own columns, qualified."""

        def name(parts: tuple[str, ...]) -> str:
            column = self.sources[owner].dimension(parts[-1]) if not self.sources[owner].column(parts[-1]) else None
            return q(owner, column.column if column else parts[-1])

        return sqlexpr.renamed(self.spark, expr, name)

    def grouped(self, dims: list[Dim], rows: DataFrame, owner: str, edges: list[joins.Edge], inputs: list[str]) -> DataFrame:
        """The dimensions as __d* beside the owner's columns; one row per grain of the owner where joins fan out.

        All declared columns are carried, so that leaves can share rows; Catalyst drops what no measure reads.
        """
        have = self.engine.table(self.sources[owner]).columns
        declared = [c.name for c in self.sources[owner].columns if c.name in have] or have
        own = [F.col(q(owner, c)).alias(c) for c in sorted({*declared, *inputs})]
        named = [self.dim_column(d).alias(f"__d{i}") for i, d in enumerate(dims)]
        if any(e.fans for e in edges):
            grain = self.sources[owner].grain
            keys = [F.col(q(owner, c)).alias(f"__g{i}") for i, c in enumerate(grain)]
            kept = one_row_per_grain(rows.select(*keys, *named, *own), [f"__g{i}" for i in range(len(grain))], [f"__d{i}" for i in range(len(dims))])
            return kept.alias(owner)
        return rows.select(*named, *own).alias(owner)

    def inputs(self, owner: str, *texts: str) -> list[str]:
        out = set()
        for text in texts:
            for parts in sqlexpr.attributes(self.spark, text):
                d = self.sources[owner].dimension(parts[-1])
                out.add(parts[-1] if self.sources[owner].column(parts[-1]) or not d else d.column)
        return sorted(out)

    # Kinds

    def source_of(self, b: Binding) -> Source:
        if b.source not in self.sources:
            raise Refusal("unresolved", f"{b.metric}: there is no source {b.source!r}")
        return self.sources[b.source]

    def measure_of(self, b: Binding) -> Any:
        found = self.source_of(b).measure(b.measure)
        if not found:
            raise Refusal("unresolved", f"{b.metric}: {b.source} has no measure {b.measure!r}")
        return found

    def leaf(self, b: Binding, name: str, population: tuple[str, ...] = ()) -> Leaf:
        population = (*population, *([b.population_filter] if b.population_filter else []))
        return getattr(self, f"_{b.kind}")(b, name, population)

    def _single(self, b: Binding, name: str, population: tuple[str, ...]) -> Leaf:
        measure, owner = self.measure_of(b), b.source
        rule = self.engine.resolver.finality(b)
        times = [d for d in self.dimensions(owner) if self.is_time(d)]
        if rule and times:
            return self._final(b, name, population, rule, times[0].asked)
        rows, dims, edges, said = self.prepare(owner, [*population, *self.guards(b)])
        self.floor(b, measure, dims, edges)
        expr = self.measure_column(measure.expr, owner)
        grouped = self.grouped(dims, rows, owner, edges, self.inputs(owner, measure.expr))
        # Counting rows needs no column; the grouped rows are one per row of the owner.
        return Leaf(("single", *said), grouped, [f"__d{i}" for i in range(len(dims))], [(name, F.expr(expr))])

    def floor(self, b: Binding, measure: Any, dims: list[Dim], edges: list[joins.Edge]) -> None:
        """What can't be summed safely is refused."""
        fans = any(e.fans for e in edges)
        if fans and not self.sources[b.source].grain:
            raise Refusal("fanout_unsafe", f"{b.metric}: {b.source} has no grain to keep its rows apart behind a fan-out")
        if measure.additivity == "additive":
            function, distinct = sqlexpr.aggregate_of(self.spark, measure.expr)
            if function not in sqlexpr.ADDITIVE or distinct:
                raise Refusal("unsupported_measure", f"{b.metric}: {measure.expr} isn't additive")
        elif fans:
            raise Refusal("fanout_unsafe", f"{b.metric}: {measure.name} is {measure.additivity} and a join fans out")
        if measure.additivity == "semi_additive":
            have = {d.dimension.name for d in dims}
            if missing := [d for d in measure.semi_additive_over if d not in have]:
                raise Refusal("unsupported_measure", f"{b.metric}: {measure.name} needs the dimension {missing[0]}")

    def is_time(self, d: Dim) -> bool:
        declared = self.sources[d.source].column(d.dimension.column)
        return bool(declared and declared.type in ("date", "timestamp"))

    def _final(self, b: Binding, name: str, population: tuple[str, ...], rule: FinalityRule, time: str) -> Leaf:
        """Final rows up to the watermark and provisional ones after it, aggregated apart and marked."""
        end = rule.role("final")
        cut = watermark(end.watermark, end.tz, self.query.as_of)
        branches, key = [], ()
        for part in rule.realizations:
            own = Binding(**{**b.__dict__, "source": part.source})
            measure = self.measure_of(own)
            rows, dims, edges, said = self.prepare(part.source, [*population, *self.guards(b), *(g for g in self.guards(own) if part.source != b.source)])
            self.floor(own, measure, dims, edges)
            d = self.dimension(time, part.source)
            column = F.col(q(d.alias, d.dimension.column))
            limit = self.instant(d, cut)
            rows = rows.where(column <= limit if part.role == "final" else column > limit)
            grouped = self.grouped(dims, rows, part.source, edges, self.inputs(part.source, measure.expr))
            grouped = grouped.withColumn("is_final", F.lit(part.role == "final"))
            by = [*(f"__d{i}" for i in range(len(dims))), "is_final"]
            expr = F.expr(self.measure_column(measure.expr, part.source))
            branches.append(Leaf(("branch", *said), grouped.alias(part.source), by, [(name, expr)], final=True))
            key += (part.source, said)
        known = {"watermark": cut, "sources": [r.source for r in rule.realizations]}
        return Leaf(("final", cut.isoformat(), *key), None, branches[0].by, [], final=True, finality=known, branches=branches)

    def instant(self, d: Dim, at: datetime) -> Column:
        kind = self.engine.table(self.sources[d.source]).schema[d.dimension.column].dataType
        if isinstance(kind, T.DateType):
            return F.lit(at.date())
        if isinstance(kind, T.TimestampType):
            return F.lit(at)
        # Times without a zone are read as UTC.
        return F.lit(at.astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")

    def _semi_additive(self, b: Binding, name: str, population: tuple[str, ...]) -> Leaf:
        measure, owner = self.measure_of(b), b.source
        source = self.sources[owner]
        function, distinct = sqlexpr.aggregate_of(self.spark, measure.expr)
        if measure.additivity == "non_additive" or function not in sqlexpr.ADDITIVE or distinct:
            raise Refusal("unsupported_measure", f"{b.metric}: {measure.expr} can't be collapsed")
        collapse = source.dimension(b.collapse_dimension)
        if not collapse:
            raise Refusal("unsupported_measure", f"{b.metric}: {owner} has no dimension {b.collapse_dimension!r}")
        rows, dims, edges, said = self.prepare(owner, [*population, *self.guards(b)])
        if any(e.fans for e in edges):
            raise Refusal("fanout_unsafe", f"{b.metric}: snapshots can't be kept apart behind a fan-out")
        by = [f"__d{i}" for i in range(len(dims))]
        expr = self.measure_column(measure.expr, owner)
        inputs = self.inputs(owner, measure.expr)
        if any(d.source == owner and d.dimension.column == collapse.column for d in dims):
            return Leaf(("single", *said), self.grouped(dims, rows, owner, edges, inputs), by, [(name, F.expr(expr))])
        named = [self.dim_column(d).alias(x) for d, x in zip(dims, by)]
        own = [F.col(q(owner, c)).alias(c) for c in inputs]
        at = F.col(q(owner, collapse.column)).alias("__at")
        if b.collapse_agg in ("last", "first"):
            keys = [c for c in source.grain if c != collapse.column]
            if len(keys) == len(source.grain):
                self.notes.warn(f"{b.metric}: {collapse.column} isn't in the grain of {owner}, so nothing collapses")
            slim = rows.select(*named, *own, at, *[F.col(q(owner, c)).alias(f"__g{i}") for i, c in enumerate(keys)])
            kept = collapse_edges(slim, [f"__g{i}" for i in range(len(keys))], "__at", b.collapse_agg)
            return Leaf(("edge", b.collapse_agg, collapse.column, *said), kept.alias(owner), by, [(name, F.expr(expr))])
        each = rows.select(*named, *own, at).alias(owner).groupBy(*by, "__at").agg(F.expr(expr).alias("__m"))
        outer = {"avg": F.avg, "min": F.min, "max": F.max}[b.collapse_agg]("__m")
        return Leaf((b.collapse_agg, collapse.column, measure.name, *said), each, by, [(name, outer)])

    def _distinct_count(self, b: Binding, name: str, population: tuple[str, ...]) -> Leaf:
        self.source_of(b)
        rows, dims, _, said = self.prepare(b.source, [*population, *self.guards(b)])
        named = [self.dim_column(d).alias(f"__d{i}") for i, d in enumerate(dims)]
        alias, column = self.place((b.distinct_on,), b.source)
        rows = rows.select(*named, F.col(q(alias, column)).alias(b.distinct_on)).alias(b.source)
        # A fan-out repeats values, which a distinct count doesn't mind.
        return Leaf(("distinct", b.distinct_on, *said), rows, [f"__d{i}" for i in range(len(dims))], [(name, F.count_distinct(F.col(q(b.distinct_on))))])

    def _percentile(self, b: Binding, name: str, population: tuple[str, ...]) -> Leaf:
        self.source_of(b)
        rows, dims, edges, said = self.prepare(b.source, [*population, *self.guards(b)])
        if any(e.fans for e in edges):
            raise Refusal("fanout_unsafe", f"{b.metric}: a fan-out would repeat the values of a percentile")
        named = [self.dim_column(d).alias(f"__d{i}") for i, d in enumerate(dims)]
        rows = rows.select(*named, F.col(q(b.source, b.column)).cast("double").alias("__v")).alias(b.source)
        by = [f"__d{i}" for i in range(len(dims))]
        nearest = b.approach == "nearest_rank"
        if nearest:
            self.notes.warn(f"{b.metric}: the percentile is a nearest rank")
        found = exact_percentile(rows, by, "__v", b.quantile, name, nearest)
        return Leaf(("shaped", b.approach, b.column, b.quantile, *said), found, by, [(name, F.col(name))], shaped=True)

    def _opaque(self, b: Binding, name: str, population: tuple[str, ...]) -> Leaf:
        measure, owner = self.measure_of(b), b.source
        asked = {self.dimension(d, owner).dimension.name for d in self.query.dimensions}
        if asked != set(b.native_grain):
            raise Refusal("unsupported_measure", f"{b.metric} can only be looked up by {', '.join(b.native_grain)}", b.native_grain)
        rows, dims, edges, said = self.prepare(owner, [*population, *self.guards(b)])
        if any(e.fans for e in edges):
            raise Refusal("fanout_unsafe", f"{b.metric}: a fan-out would repeat its rows")
        expr = self.measure_column(measure.expr, owner)
        named = [self.dim_column(d).alias(f"__d{i}") for i, d in enumerate(dims)]
        own = [F.col(q(owner, c)).alias(c) for c in self.inputs(owner, measure.expr)]
        return Leaf(("opaque", measure.name, *said), rows.select(*named, *own).alias(owner), [f"__d{i}" for i in range(len(dims))], [(name, F.expr(expr))], shaped=True)



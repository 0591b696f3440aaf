"""What is wrong with a project before anything is asked of it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.errors import Refusal
from plumbline.functions import sqlexpr
from plumbline.model import FANNING, Binding, Project
from plumbline.plans import joins
from plumbline.plans.resolver import Resolver


def validate(spark: SparkSession, project: Project) -> tuple[list[str], list[str]]:
    """Errors and warnings, each a line that begins with what it is about."""
    resolver, errors, warnings = Resolver(project), [], []
    sources = project.sources

    def names(about: str, source: str, text: str | None) -> None:
        """Every column of an expression can be had from the source."""
        if not text or source not in sources:
            return
        try:
            told = sqlexpr.attributes(spark, text)
        except Refusal as refusal:
            errors.append(f"{about}: {refusal.message}")
            return
        tree = joins.alias_tree(source, sources)
        for parts in told:
            at = [parts[-2]] if len(parts) > 1 else list(tree)
            if not any(a in tree and (not sources[tree[a]].columns or sources[tree[a]].column(parts[-1]) or sources[tree[a]].dimension(parts[-1])) for a in at):
                errors.append(f"{about}: {'.'.join(parts)} can't be reached from {source}")

    for s in sources.values():
        for m in s.measures:
            for parts in _attributes(spark, m.expr, errors, f"source {s.name}, measure {m.name}"):
                if s.columns and not s.column(parts[-1]):
                    errors.append(f"source {s.name}, measure {m.name}: {parts[-1]} is no column")
        for j in s.joins:
            if j.to not in sources:
                warnings.append(f"source {s.name}: it joins {j.to}, which isn't declared")
            if j.relationship in FANNING and not s.grain:
                warnings.append(f"source {s.name}: {j.alias} fans out and there is no grain to keep rows apart")

    for b in project.bindings:
        if b.status != "active":
            continue
        about = f"metric {b.metric}"
        try:
            own: list[Binding] = resolver.leaves(b)
        except Refusal as refusal:
            errors.append(f"{about}: {refusal.message}")
            continue
        for leaf in own:
            source = sources.get(leaf.source)
            if not source:
                errors.append(f"{about}: there is no source {leaf.source}")
                continue
            if leaf.measure and not source.measure(leaf.measure):
                errors.append(f"{about}: {leaf.source} has no measure {leaf.measure}")
            for column in filter(None, (leaf.distinct_on, leaf.column)):
                if source.columns and not source.column(column):
                    errors.append(f"{about}: {column} is no column of {leaf.source}")
            names(about, leaf.source, b.population_filter)
            names(about, leaf.source, leaf.population_filter)
        if b.kind == "semi_additive" and (source := sources.get(b.source)):
            collapse = source.dimension(b.collapse_dimension)
            if not collapse:
                errors.append(f"{about}: {b.collapse_dimension} is no dimension of {b.source}")
            elif collapse.column not in source.grain:
                warnings.append(f"{about}: {collapse.column} isn't in the grain, so nothing collapses")
            have = {d.column for d in source.dimensions}
            errors += [f"{about}: grain column {c} is no dimension" for c in source.grain if c not in have]
        if b.kind == "opaque" and (source := sources.get(b.source)):
            errors += [f"{about}: {d} of its native grain is no dimension" for d in b.native_grain if d not in joins.reachable_dimensions(b.source, sources)]

    for g in project.guardrails:
        about = f"guardrail {g.id}"
        if g.source and g.source not in sources:
            errors.append(f"{about}: there is no source {g.source}")
        elif g.source and g.measure and not sources[g.source].measure(g.measure):
            if any(g.measure in (b.distinct_on, b.column) for b in project.bindings):
                warnings.append(f"{about}: it names a column, not a measure, of {g.source}")
            else:
                errors.append(f"{about}: {g.source} has no measure {g.measure}")
        if g.metric and g.metric not in resolver.by_metric:
            errors.append(f"{about}: there is no metric {g.metric}")
        target = g.source or getattr(resolver.by_metric.get(g.metric), "source", None)
        if target:
            names(about, target, g.filter)

    for rule in project.finality:
        for r in rule.realizations:
            if r.source not in sources:
                errors.append(f"finality of {rule.metric}: there is no source {r.source}")
    if tenancy := project.tenancy:
        for name, column in tenancy.scoped.items():
            if name not in sources or sources[name].columns and not sources[name].column(column):
                errors.append(f"tenancy: {name}.{column} isn't there")
        both = sorted(set(tenancy.scoped) & set(tenancy.shared))
        errors += [f"tenancy: {n} is both scoped and shared" for n in both]
        open_ = sorted(set(sources) - set(tenancy.scoped) - set(tenancy.shared))
        (errors if tenancy.undeclared_source == "deny" else warnings).extend(f"tenancy: {n} is neither scoped nor shared" for n in open_)
    for role in project.roles.values():
        if role.inherits and role.inherits not in project.roles:
            errors.append(f"role {role.name}: it inherits {role.inherits}, which isn't there")
    return sorted(set(errors)), sorted(set(warnings))


def _attributes(spark: SparkSession, text: str, errors: list[str], about: str) -> set[tuple[str, ...]]:
    try:
        return sqlexpr.attributes(spark, text)
    except Refusal as refusal:
        errors.append(f"{about}: {refusal.message}")
        return set()

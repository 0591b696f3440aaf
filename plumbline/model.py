"""What a project declares: semantic sources, bindings, guardrails, finality, policies."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

TYPES = ("string", "int", "decimal", "float", "bool", "date", "timestamp", "json")
RELATIONSHIPS = ("one_to_one", "many_to_one", "one_to_many", "many_to_many")
FANNING = ("one_to_many", "many_to_many")
ADDITIVITY = ("additive", "semi_additive", "non_additive")
KINDS = ("single", "ratio", "weighted_avg", "semi_additive", "distinct_count", "percentile", "opaque")
COLLAPSES = ("last", "first", "avg", "min", "max")
GUARDS = ("mandatory_filter", "restrict_source", "min_trust", "required_dimension")


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    nullable: bool = True


@dataclass(frozen=True)
class Measure:
    name: str
    expr: str
    additivity: str = "additive"
    semi_additive_over: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str
    granularity: str | None = None
    label: str | None = None
    description: str | None = None
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Join:
    to: str
    on: str
    relationship: str = "many_to_one"
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.name or self.to


@dataclass(frozen=True)
class Source:
    name: str
    table: str
    grain: tuple[str, ...] = ()
    columns: tuple[Column, ...] = ()
    measures: tuple[Measure, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    joins: tuple[Join, ...] = ()
    connection: str | None = None
    description: str | None = None
    filters: tuple[dict, ...] = ()
    meta: dict = field(default_factory=dict, hash=False)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def measure(self, name: str) -> Measure | None:
        return next((m for m in self.measures if m.name == name), None)

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name or name in d.aliases), None)


@dataclass(frozen=True)
class Binding:
    """A metric's one authoritative definition."""

    metric: str
    kind: str = "single"
    source: str | None = None
    measure: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    on_zero_denominator: str = "null"
    collapse_dimension: str | None = None
    collapse_agg: str = "last"
    distinct_on: str | None = None
    column: str | None = None
    quantile: float = 0.5
    approach: str = "continuous"
    native_grain: tuple[str, ...] = ()
    population_filter: str | None = None
    aliases: tuple[str, ...] = ()
    label: str | None = None
    provenance: str = "human_curated"
    status: str = "active"

    @property
    def composite(self) -> bool:
        return self.kind in ("ratio", "weighted_avg")


@dataclass(frozen=True)
class Guardrail:
    id: str
    kind: str
    source: str | None = None
    measure: str | None = None
    metric: str | None = None
    filter: str | None = None
    restrict_to: str | None = None
    level: str | None = None
    dimension: str | None = None
    context: str | None = None
    severity: str = "error"
    rationale: str | None = None


@dataclass(frozen=True)
class Realization:
    source: str
    role: str
    watermark: str | None = None
    tz: str = "UTC"


@dataclass(frozen=True)
class FinalityRule:
    metric: str
    realizations: tuple[Realization, ...]

    def role(self, role: str) -> Realization | None:
        return next((r for r in self.realizations if r.role == role), None)


@dataclass(frozen=True)
class Assertion:
    id: str
    query: dict = field(hash=False)
    rows: int | None = None
    values: dict[str, Any] = field(default_factory=dict, hash=False)
    tolerance: float = 0.0


@dataclass(frozen=True)
class Tenancy:
    claim: str
    scoped: dict[str, str] = field(default_factory=dict, hash=False)
    shared: tuple[str, ...] = ()
    on_missing_principal: str = "deny"
    undeclared_source: str = "deny"


@dataclass(frozen=True)
class Role:
    name: str
    inherits: str | None = None
    given: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Principal:
    claims: dict[str, Any] = field(default_factory=dict, hash=False)
    system: bool = False


SYSTEM = Principal(system=True)


@dataclass(frozen=True)
class Query:
    """What a caller asks for."""

    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[Any, ...] = ()
    via: tuple[str, ...] = ()
    context: str | None = None
    limit: int | None = None
    as_of: Any = None

    @staticmethod
    def of(given: dict) -> Query:
        lists = {k: tuple(given.get(k) or ()) for k in ("metrics", "dimensions", "filters", "via")}
        return Query(**lists, **{k: given.get(k) for k in ("context", "limit", "as_of")})


@dataclass
class Project:
    sources: dict[str, Source] = field(default_factory=dict)
    bindings: list[Binding] = field(default_factory=list)
    guardrails: list[Guardrail] = field(default_factory=list)
    finality: list[FinalityRule] = field(default_factory=list)
    assertions: list[Assertion] = field(default_factory=list)
    tenancy: Tenancy | None = None
    roles: dict[str, Role] = field(default_factory=dict)
    role_claim: str = "roles"
    default_role: str | None = None

"""Names to definitions: metrics, components, guardrails, roles, tenancy."""

from __future__ import annotations

from dataclasses import dataclass, field
from difflib import get_close_matches

from plumbline.errors import Refusal
from plumbline.model import Binding, FinalityRule, Guardrail, Principal, Project


@dataclass(frozen=True)
class Mask:
    column: str
    strategy: str


@dataclass
class Policy:
    """What a principal may do."""

    allow: list[str] = field(default_factory=lambda: ["*"])
    deny: list[str] = field(default_factory=list)
    masks: dict[str, str] = field(default_factory=dict)
    tags: list[str] = field(default_factory=lambda: ["*"])
    run_sql: bool = True
    exempt: bool = False
    tenant: object = None
    unscoped: bool = False

    def sees(self, *names: str) -> bool:
        return not any(n in self.deny for n in names) and ("*" in self.allow or any(n in self.allow for n in names))


class Resolver:
    def __init__(self, project: Project) -> None:
        self.project = project
        self.active = [b for b in project.bindings if b.status == "active"]
        self.by_metric = {b.metric: b for b in self.active}

    def find(self, name: str) -> list[Binding]:
        asked = name.casefold()
        return [b for b in self.active if asked in {n.casefold() for n in (b.metric, *b.aliases)}]

    def metrics(self, names: tuple[str, ...], policy: Policy) -> list[Binding]:
        """The bindings of the names; a refusal tells of every name that fails.  Denied metrics look as if they weren't there."""
        missing, several, out = [], [], []
        for name in names:
            found = [b for b in self.find(name) if policy.sees(b.metric)]
            (out if len(found) == 1 else several if found else missing).append(found[0] if len(found) == 1 else name)
        if missing:
            known = sorted({n for b in self.active if policy.sees(b.metric) for n in (b.metric, *b.aliases)})
            near = [c for n in missing for c in get_close_matches(n, known, 5, 0.5)]
            raise Refusal("unresolved", f"no metric is named {', '.join(map(repr, missing))}", near)
        if several:
            raise Refusal("ambiguous", f"{', '.join(map(repr, several))} names several metrics", [b.metric for n in several for b in self.find(n)])
        return out

    def component(self, name: str, of: Binding) -> Binding:
        found = self.find(name)
        if len(found) != 1:
            raise Refusal("ambiguous" if found else "unresolved", f"{of.metric}: component {name!r} isn't one metric")
        if found[0].metric == of.metric or found[0].composite and self._circle(found[0], {of.metric}):
            raise Refusal("unresolved", f"{of.metric}: its components lead back to it")
        if found[0].kind != "single":
            raise Refusal("unsupported_measure", f"{of.metric}: component {name!r} is {found[0].kind}, not single")
        return found[0]

    def _circle(self, b: Binding, met: set[str]) -> bool:
        if b.metric in met:
            return True
        return b.composite and any(self._circle(c, met | {b.metric}) for n in (b.numerator, b.denominator) for c in self.find(n))

    def leaves(self, b: Binding) -> list[Binding]:
        """The bindings that are aggregated for a metric: itself, or its components."""
        return [self.component(n, b) for n in (b.numerator, b.denominator)] if b.composite else [b]

    def guardrails(self, b: Binding, kind: str, context: str | None = None) -> list[Guardrail]:
        """The guardrails on a leaf, by id: those on its source, on its measure, or on a metric of the same measure."""
        measure = b.measure or b.distinct_on or b.column

        def applies(g: Guardrail) -> bool:
            if g.metric:
                target = self.by_metric.get(g.metric)
                if g.metric == b.metric:
                    return True
                return bool(target and target.source == b.source and target.measure and target.measure == b.measure)
            return g.source == b.source and (g.measure is None or g.measure == measure)

        asked = {"mandatory_filter": lambda g: True, "required_dimension": lambda g: g.context in (None, context)}
        # The other kinds are for one context, and only queries that state it.
        fits = asked.get(kind, lambda g: context is not None and g.context == context)
        return sorted((g for g in self.project.guardrails if g.kind == kind and applies(g) and fits(g)), key=lambda g: g.id)

    def finality(self, b: Binding) -> FinalityRule | None:
        return next((r for r in self.project.finality if r.metric == b.metric), None)

    # Roles and tenants

    def role(self, name: str, met: tuple[str, ...] = ()) -> dict:
        """A role's fields over those it inherits, field by field."""
        role = self.project.roles[name]
        if name in met:
            raise Refusal("validation_failed", f"role {name!r} inherits from itself")
        base = self.role(role.inherits, (*met, name)) if role.inherits in self.project.roles else {}
        return base | {k: v for k, v in role.given.items() if k != "inherits"}

    def policy(self, principal: Principal | None) -> Policy:
        out = Policy()
        if principal is not None and principal.system:
            out.exempt = True
            return out
        claims = principal.claims if principal else {}
        if self.project.roles:
            named = claims.get(self.project.role_claim) or ([self.project.default_role] if self.project.default_role else [])
            named = [named] if isinstance(named, str) else list(named)
            known = [self.role(n) for n in named if n in self.project.roles]
            part = lambda r, k: r.get(k) or {}
            out.allow = [n for r in known for n in part(r, "metrics").get("allow", ["*"])]
            out.deny = [n for r in known for n in part(r, "metrics").get("deny", [])]
            out.tags = [t for r in known for t in part(r, "knowledge").get("allow_tags", [])]
            out.run_sql = any(r.get("run_sql", False) for r in known)
            out.exempt = any(r.get("tenancy_exempt", False) for r in known)
            # Of several roles' masks of a column the one that hides most counts.
            rank = ["partial", "hash", "null"]
            for m in (m for r in known for m in r.get("masking") or ()):
                if m["strategy"] not in rank:
                    raise Refusal("validation_failed", f"{m['strategy']!r} is no masking strategy")
                before = out.masks.get(m["column"])
                out.masks[m["column"]] = max(m["strategy"], before or m["strategy"], key=rank.index)
        if (tenancy := self.project.tenancy) and not out.exempt:
            out.tenant = claims.get(tenancy.claim)
            if out.tenant is None:
                if tenancy.on_missing_principal == "deny":
                    raise Refusal("tenant_unresolved", f"the caller has no {tenancy.claim}")
                out.unscoped = True
        return out

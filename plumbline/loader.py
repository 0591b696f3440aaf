"""Projects from YAML files; what is wrong is refused with file and line."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

import yaml

from plumbline import model as m
from plumbline.errors import Refusal


class Located(dict):
    """A mapping that knows its place."""

    place = ""


def _loader(name: str) -> type[yaml.SafeLoader]:
    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> Located:
        out = Located(loader.construct_mapping(node, deep=True))
        out.place = f"{name}:{node.start_mark.line + 1}"
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Loader


def read(text: str, name: str = "<text>") -> Located:
    try:
        found = yaml.load(text, _loader(name))  # noqa: S506  a SafeLoader
    except yaml.YAMLError as error:
        raise Refusal("validation_failed", f"{name}: {error}") from None
    if not isinstance(found, dict):
        raise Refusal("validation_failed", f"{name}:1: a mapping is expected")
    return found


def _bad(at: Any, what: str) -> Refusal:
    return Refusal("validation_failed", f"{getattr(at, 'place', '?')}: {what}")


def _need(given: dict, key: str) -> Any:
    if given.get(key) in (None, "", []):
        raise _bad(given, f"{key} is missing")
    return given[key]


def _one_of(given: dict, key: str, allowed: tuple[str, ...], default: str) -> str:
    value = given.get(key) or default
    if value not in allowed:
        raise _bad(given, f"{key} is {value!r}, not one of {', '.join(allowed)}")
    return value


def source(given: dict) -> m.Source:
    name = _need(given, "name")
    columns = tuple(m.Column(_need(c, "name"), _one_of(c, "type", m.TYPES, "string"), c.get("nullable", True)) for c in given.get("columns") or ())
    measures = tuple(
        m.Measure(_need(x, "name"), _need(x, "expr"), _one_of(x, "additivity", m.ADDITIVITY, "additive"), tuple(x.get("semi_additive_over") or ()))
        for x in given.get("measures") or ()
    )
    dimensions = tuple(
        m.Dimension(_need(d, "name"), _need(d, "column"), d.get("granularity"), d.get("label"), d.get("description"), tuple(d.get("aliases") or ()))
        for d in given.get("dimensions") or ()
    )
    # YAML 1.1 reads a bare ``on`` as true.
    joins = tuple(
        m.Join(_need(j, "to"), j.get("on") or _need(j, True), _one_of(j, "relationship", m.RELATIONSHIPS, "many_to_one"), j.get("name"))
        for j in given.get("joins") or ()
    )
    known = {c.name for c in columns}
    for what, names in (
        ("column", [c.name for c in columns]), ("measure", [x.name for x in measures]),
        ("dimension", [d.name for d in dimensions]), ("join", [j.alias for j in joins]),
    ):
        if again := sorted({n for n in names if names.count(n) > 1}):
            raise _bad(given, f"{name}: {what} {again[0]!r} is declared twice")
    for what, names in (("grain", given.get("grain") or ()), ("dimension column", [d.column for d in dimensions])):
        if known and (missing := sorted(set(names) - known)):
            raise _bad(given, f"{name}: {what} {missing[0]!r} is no column")
    return m.Source(
        name, given.get("table") or name, tuple(given.get("grain") or ()), columns, measures, dimensions, joins,
        given.get("connection"), given.get("description"), tuple(given.get("filters") or ()), dict(given.get("meta") or {}),
    )


#: Fields that each kind of metric needs.
_NEEDED = {
    "single": ("source", "measure"), "ratio": ("numerator", "denominator"), "weighted_avg": ("weighted_sum", "weight"),
    "semi_additive": ("source", "measure", "collapse_dimension"), "distinct_count": ("source", "distinct_on"),
    "percentile": ("source", "column"), "opaque": ("source", "measure", "native_grain"),
}


def binding(given: dict) -> m.Binding:
    ref = _need(given, "canonical")
    kind = _one_of(ref, "kind", m.KINDS, "single")
    for key in _NEEDED[kind]:
        _need(ref, key)
    zero = ref.get("on_zero_denominator", "null")
    quantile = float(ref.get("percentile", ref.get("quantile", 0.5)))
    if not 0 <= quantile <= 1:
        raise _bad(ref, f"quantile {quantile} isn't between 0 and 1")
    return m.Binding(
        metric=_need(given, "metric"),
        kind=kind,
        **{k: ref.get(k) for k in ("source", "measure", "collapse_dimension", "distinct_on", "column", "population_filter")},
        numerator=ref.get("numerator") or ref.get("weighted_sum"),
        denominator=ref.get("denominator") or ref.get("weight"),
        on_zero_denominator="null" if zero is None else _one_of({"on_zero_denominator": zero}, "on_zero_denominator", ("null", "zero", "error"), "null"),
        collapse_agg=_one_of(ref, "collapse_agg", m.COLLAPSES, "last"),
        quantile=quantile,
        approach=_one_of(ref, "approach", ("continuous", "nearest_rank"), "continuous"),
        native_grain=tuple(ref.get("native_grain") or ()),
        aliases=tuple(given.get("aliases") or ()),
        label=given.get("label"),
        provenance=given.get("provenance") or "human_curated",
        status=given.get("status") or "active",
    )


def guardrail(given: dict) -> m.Guardrail:
    kind, on = _one_of(given, "kind", m.GUARDS, ""), _need(given, "applies_to")
    _need(given, {"mandatory_filter": "filter", "restrict_source": "restrict_to", "min_trust": "level", "required_dimension": "dimension"}[kind])
    return m.Guardrail(
        _need(given, "id"), kind, on.get("source"), on.get("measure"), on.get("metric"), given.get("filter"),
        (given.get("restrict_to") or {}).get("role"), given.get("level"), given.get("dimension"), given.get("context"),
        _one_of(given, "severity", ("error", "warn"), "error"), given.get("rationale"),
    )


def finality_rule(given: dict) -> m.FinalityRule:
    from plumbline.plans.finality import watermark

    parts = tuple(m.Realization(_need(r, "source"), _need(r, "role"), r.get("watermark"), r.get("tz") or "UTC") for r in _need(given, "realizations"))
    finals = [r for r in parts if r.role == "final"]
    if len(finals) != 1 or any(r.role not in ("final", "provisional") for r in parts):
        raise _bad(given, "exactly one realization is final, the others provisional")
    try:
        watermark(finals[0].watermark or "", finals[0].tz)
    except ValueError as error:
        raise _bad(given, str(error)) from None
    return m.FinalityRule(_need(given, "metric"), parts)


def assertion(given: dict) -> m.Assertion:
    expect = given.get("expect") or {}
    return m.Assertion(_need(given, "id"), dict(_need(given, "query")), expect.get("rows"), dict(expect.get("values") or {}), expect.get("tolerance") or 0.0)


def tenancy(given: dict) -> m.Tenancy:
    scoped = {_need(s, "source"): _need(s, "column") for s in given.get("scoped_sources") or ()}
    choices = {k: _one_of(given, k, allowed, "deny") for k, allowed in (("on_missing_principal", ("deny", "allow_unscoped")), ("undeclared_source", ("deny", "warn")))}
    return m.Tenancy(_need(given, "claim"), scoped, tuple(given.get("shared_sources") or ()), **choices)


def project(folder: str | Path) -> m.Project:
    """The project under a folder: semantics/**, contracts/{metrics,guardrails,assertions,policies}/**."""
    root, out = Path(folder), m.Project()

    def each(pattern: str, build: Callable[[dict], Any], keep: Callable[[Path], bool] = lambda p: True) -> list[Any]:
        found = sorted(p for p in root.glob(pattern) if keep(p))
        return [build(read(p.read_text(encoding="utf-8"), str(p))) for p in found]

    for s in each("semantics/**/*.yaml", source):
        if s.name in out.sources:
            raise Refusal("validation_failed", f"source {s.name!r} is declared twice")
        out.sources[s.name] = s
    out.bindings = each("contracts/metrics/**/*.yaml", binding)
    is_finality = lambda p: p.name.startswith("finality-")
    out.guardrails = each("contracts/guardrails/**/*.yaml", guardrail, lambda p: not is_finality(p))
    out.finality = each("contracts/guardrails/**/*.yaml", finality_rule, is_finality)
    out.assertions = each("contracts/assertions/**/*.yaml", assertion)
    for given in each("contracts/policies/**/*.yaml", dict_of):
        policies(out, given)
    check_names(out)
    return out


def dict_of(given: dict) -> dict:
    return given


def policies(out: m.Project, given: dict) -> None:
    if str(given.get("schema", "")).startswith("tenancy"):
        out.tenancy = tenancy(given)
    elif str(given.get("schema", "")).startswith("roles"):
        out.role_claim, out.default_role = given.get("claim") or "roles", given.get("default_role")
        out.roles = {name: m.Role(name, (r or {}).get("inherits"), dict(r or {})) for name, r in (given.get("roles") or {}).items()}
    else:
        raise _bad(given, "a policy's schema is tenancy/... or roles/...")


def check_names(out: m.Project) -> None:
    seen: dict[str, str] = {}
    for b in (b for b in out.bindings if b.status == "active"):
        for name in {b.metric, *b.aliases}:
            if (other := seen.setdefault(name.casefold(), b.metric)) != b.metric:
                raise Refusal("validation_failed", f"{name!r} names both {other} and {b.metric}")
    names = [b.metric for b in out.bindings if b.status == "active"]
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise Refusal("validation_failed", f"metric {again[0]!r} is bound twice")


def from_dict(given: dict) -> m.Project:
    """A project from lists of the same mappings that the files hold."""
    out = m.Project()
    for s in map(source, given.get("sources") or ()):
        if s.name in out.sources:
            raise Refusal("validation_failed", f"source {s.name!r} is declared twice")
        out.sources[s.name] = s
    out.bindings = [binding(x) for x in given.get("metrics") or ()]
    out.guardrails = [guardrail(x) for x in given.get("guardrails") or ()]
    out.finality = [finality_rule(x) for x in given.get("finality") or ()]
    out.assertions = [assertion(x) for x in given.get("assertions") or ()]
    for x in given.get("policies") or ():
        policies(out, x)
    check_names(out)
    return out

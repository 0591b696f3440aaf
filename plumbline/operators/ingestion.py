"""From live schemas to proposals: what a source could measure and group by, and how it meets what is declared."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

from plumbline.errors import Refusal
from plumbline.model import Binding, Column, Source
from plumbline.operators.knowledge import Page

PROVENANCE = ("inferred", "human_curated", "board_approved")
_KEY = re.compile(r"(^|_)(id|key|fk|pk)$", re.I)
#: What is never applied without a review, whatever the confidence.
REVIEWED = ("grain", "joins", "measures")


@dataclass(frozen=True)
class Relation:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # column, relation, its column


def measures(relation: Relation) -> list[dict]:
    """Rows, and the total of every number that is no key."""
    keys = {*relation.primary_key, *(k for k, _, _ in relation.foreign_keys)}
    numbers = [c.name for c in relation.columns if c.type in ("int", "decimal", "float") and c.name not in keys and not _KEY.search(c.name)]
    return [{"name": "row_count", "expr": "count(*)", "additivity": "additive"}] + [{"name": f"total_{n}", "expr": f"sum({n})", "additivity": "additive"} for n in numbers]


def dimensions(relation: Relation) -> list[dict]:
    """Times, truth values, and strings that don't look like keys."""
    fits = lambda c: c.type in ("date", "timestamp", "bool") or c.type == "string" and not _KEY.search(c.name)
    return [{"name": c.name, "column": c.name} for c in relation.columns if fits(c)]


def joins(relation: Relation) -> list[dict]:
    """A join for each foreign key, named after its column where a target repeats."""
    targets = [t for _, t, _ in relation.foreign_keys]
    out = []
    for column, target, key in relation.foreign_keys:
        alias = _KEY.sub("", column) or column if targets.count(target) > 1 else target
        out.append({"to": target, "on": f"{relation.name}.{column} = {alias}.{key}", "relationship": "many_to_one", **({"name": alias} if alias != target else {})})
    return out


def propose(relation: Relation, grain: Iterable[str] | None = None) -> dict:
    """A source as YAML would hold it; without a primary key the grain must be given."""
    return {
        "name": relation.name, "table": relation.name, "grain": list(relation.primary_key or grain or ()),
        "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable} for c in relation.columns],
        "measures": measures(relation), "dimensions": dimensions(relation), "joins": joins(relation), "meta": {"provenance": "inferred"},
    }


@dataclass
class Decision:
    name: str
    action: str  # add, edit, no_op, contradiction, prune
    reason: str
    changed: list[str] = field(default_factory=list)
    applied: bool = False


def reconcile(declared: Mapping[str, dict], proposed: Mapping[str, dict], frozen: Iterable[str] = (), auto_apply: bool = False, confidence: Mapping[str, float] | None = None) -> list[Decision]:
    """What to do about each source.

    A proposal edits what is of no higher provenance; against anything higher it is a
    contradiction for a person to settle.  Frozen sources are left alone.
    """
    out = []
    rank = lambda d: PROVENANCE.index((d.get("meta") or {}).get("provenance", "human_curated"))
    strip = lambda d: {k: v for k, v in d.items() if k != "meta"}
    for name in sorted({*declared, *proposed}):
        old, new = declared.get(name), proposed.get(name)
        if old is None:
            made = Decision(name, "add", "is new", sorted(strip(new)))
        elif name in set(frozen):
            made = Decision(name, "no_op", "is frozen")
        elif new is None:
            made = Decision(name, "prune", "is no longer there") if rank(old) == 0 else Decision(name, "contradiction", "is declared but no longer there")
        else:
            changed = sorted(k for k in {*strip(old), *strip(new)} if old.get(k) != new.get(k))
            if not changed:
                made = Decision(name, "no_op", "is the same")
            elif rank(new) >= rank(old):
                made = Decision(name, "edit", "differs", changed)
            else:
                made = Decision(name, "contradiction", "differs from what a person declared", changed)
        sure = (confidence or {}).get(name, 0.0) >= 0.95
        made.applied = auto_apply and sure and made.action in ("add", "edit") and not set(made.changed) & set(REVIEWED)
        out.append(made)
    return out


def notes(decisions: Iterable[Decision]) -> list[Page]:
    """A knowledge page for each contradiction, for a person to settle; the others need none."""
    out = []
    for d in decisions:
        if d.action == "contradiction":
            about = f" ({', '.join(d.changed)})" if d.changed else ""
            out.append(Page(f"contradiction-{d.name}", f"{d.name} {d.reason}{about}.", f"{d.name}: to be settled", ("contradiction",), sl_refs=(d.name,)))
    return out


def diff(name: str, old: dict | None, new: dict | None) -> str:
    """A unified diff of the YAML before and after."""
    text = lambda d: yaml.safe_dump(d, sort_keys=False, allow_unicode=True).splitlines(keepends=True) if d else []
    return "".join(difflib.unified_diff(text(old), text(new), f"a/semantics/{name}.yaml", f"b/semantics/{name}.yaml"))


def bindings(sources: Iterable[Source], taken: Iterable[str] = ()) -> list[Binding]:
    """A binding for every measure, with the source's name in front where the short one is taken."""
    used, out = {t.casefold() for t in taken}, []
    for s in sources:
        for m in s.measures:
            name = m.name if m.name.casefold() not in used else f"{s.name}_{m.name}"
            if name.casefold() not in used:
                used.add(name.casefold())
                out.append(Binding(name, source=s.name, measure=m.name, provenance="inferred"))
    return out


def examples(usages: Iterable[Mapping[str, Any]], metric: str, most: int = 3) -> list[str]:
    """The most used questions about a metric, ties by text."""
    own = [(-int(u.get("uses", 1)), str(u["text"])) for u in usages if metric in u.get("metrics", ())]
    return [text for _, text in sorted(own)][:most]


#: Aggregations of dbt measures: the function's spelling and how it adds up (fixed values).
DBT = {
    "sum": ("sum({})", "additive"), "count": ("count({})", "additive"), "min": ("min({})", "additive"), "max": ("max({})", "additive"),
    "sum_boolean": ("sum(case when {} then 1 else 0 end)", "additive"), "count_distinct": ("count(distinct {})", "non_additive"),
    "average": ("avg({})", "non_additive"), "median": ("median({})", "non_additive"),
}


def _dbt_percentile(measure: dict) -> tuple[str, str]:
    """A percentile measure's spelling: interpolated, or a value that is there where it says so."""
    told = measure.get("agg_params") or {}
    kind = "percentile_disc" if told.get("use_discrete_percentile") else "percentile_cont"
    return f"{kind}({float(told.get('percentile') or 0.5)}) within group (order by {{}})", "non_additive"


def _dbt_joins(models: list[dict]) -> dict[str, list[dict]]:
    """Joins by model: a foreign entity leads to the one model that has it as its own key."""
    owners: dict[str, list[tuple[str, str]]] = {}
    for model in models:
        for e in model.get("entities") or ():
            if e.get("type") in ("primary", "natural", "unique"):
                owners.setdefault(e["name"], []).append((model["name"], e.get("expr") or e["name"]))
    out: dict[str, list[dict]] = {}
    for model in models:
        for e in model.get("entities") or ():
            ends = [x for x in owners.get(e["name"], ()) if x[0] != model["name"]]
            if e.get("type") == "foreign" and len(ends) == 1:
                on = f"{model['name']}.{e.get('expr') or e['name']} = {ends[0][0]}.{ends[0][1]}"
                out.setdefault(model["name"], []).append({"to": ends[0][0], "on": on, "relationship": "many_to_one"})
    return out


def from_dbt(manifest: str | dict, warnings: list[str] | None = None) -> tuple[list[dict], list[dict]]:
    """Sources, with joins along their entities, and metrics of a dbt manifest (version 10 or later); warnings gets what is left out."""
    warnings = [] if warnings is None else warnings
    given = json.loads(manifest) if isinstance(manifest, str) else manifest
    version = re.search(r"/v(\d+)", str((given.get("metadata") or {}).get("dbt_schema_version", "")))
    if not version or int(version[1]) < 10:
        raise Refusal("validation_failed", "a manifest of version 10 or later is needed")
    sources, metrics = [], []
    joined = _dbt_joins(list((given.get("semantic_models") or {}).values()))
    for model in (given.get("semantic_models") or {}).values():
        grain = [e.get("expr") or e["name"] for e in model.get("entities") or () if e.get("type") in ("primary", "natural")]
        made = []
        for m in model.get("measures") or ():
            agg = str(m.get("agg")).strip().lower()
            spelled, adds = _dbt_percentile(m) if agg == "percentile" else DBT.get(agg, (None, None))
            if not spelled:
                warnings.append(f"{model['name']}.{m['name']}: the aggregation {m.get('agg')!r} isn't known; the measure is left out")
                continue
            over = m.get("non_additive_dimension") or {}
            made.append({"name": m["name"], "expr": spelled.format(m.get("expr") or m["name"]), "additivity": "semi_additive" if over else adds, **({"semi_additive_over": [over["name"]]} if over else {})})
        dims = [{"name": d["name"], "column": d.get("expr") or d["name"], **({"granularity": d["type_params"]["time_granularity"]} if d.get("type") == "time" and (d.get("type_params") or {}).get("time_granularity") else {})} for d in model.get("dimensions") or ()]
        sources.append({"name": model["name"], "table": (model.get("node_relation") or {}).get("alias") or model["name"], "grain": grain, "measures": made, "dimensions": dims, "joins": joined.get(model["name"], []), "meta": {"provenance": "inferred"}})
    owner = {m["name"]: s["name"] for s in sources for m in s["measures"]}
    for metric in (given.get("metrics") or {}).values():
        told = metric.get("type_params") or {}
        name = lambda x: x.get("name") if isinstance(x, dict) else x
        if metric.get("type") == "simple" and name(told.get("measure")) in owner:
            metrics.append({"metric": metric["name"], "canonical": {"source": owner[name(told["measure"])], "measure": name(told["measure"])}, "provenance": "inferred"})
        elif metric.get("type") == "ratio":
            metrics.append({"metric": metric["name"], "canonical": {"kind": "ratio", "numerator": name(told["numerator"]), "denominator": name(told["denominator"])}, "provenance": "inferred"})
        else:
            warnings.append(f"metric {metric['name']}: type {metric.get('type')!r} isn't taken over")
    return sources, metrics


@dataclass
class Acquired:
    relations: dict[str, Relation]
    origin: dict[str, str]
    gaps: list[str]


def acquire(wanted: Iterable[str], live: Mapping[str, Relation], *supplements: tuple[str, Mapping[str, Relation]]) -> Acquired:
    """Relations from the first origin that has them, live ones first; supplements are held against what is live."""
    found, origin, gaps = {}, {}, []
    for name in wanted:
        for kind, relations in (("live", live), *supplements):
            if name in relations and name not in found:
                found[name], origin[name] = relations[name], kind
            elif name in relations and origin[name] == "live":
                types = {c.name: c.type for c in live[name].columns}
                wrong = [c.name for c in relations[name].columns if types.get(c.name) != c.type]
                if wrong:
                    raise Refusal("schema_mismatch", f"{name}: {kind} and live differ in {', '.join(wrong)}")
        if name not in found:
            gaps.append(name)
    return Acquired(found, origin, gaps)

"""How far an answer can be trusted: the lowest cap of any signal counts."""

from __future__ import annotations

from plumbline.model import Assertion, Binding

TIERS = ("caution", "provisional", "trusted")
Signal = tuple[str, str]


def static_signals(bindings: list[Binding], assertions: list[Assertion], verdicts: dict[str, bool] | None = None) -> list[Signal]:
    """Caps known before a query runs.  verdicts: metric -> whether its assertion passed the harness."""
    asserted = {m for a in assertions for m in a.query.get("metrics") or ()}
    out: list[Signal] = []
    for b in bindings:
        if b.provenance == "inferred":
            out.append(("provisional", f"{b.metric}: the binding is inferred"))
        if b.metric not in asserted:
            out.append(("provisional", f"{b.metric}: no assertion covers it"))
        elif (verdicts or {}).get(b.metric) is None:
            out.append(("provisional", f"{b.metric}: its assertion has no verdict yet"))
        elif not verdicts[b.metric]:
            out.append(("caution", f"{b.metric}: its assertion failed"))
    return out


def served_signals(provisional_rows: int = 0, stale: tuple[str, ...] = (), wrong: tuple[str, ...] = ()) -> list[Signal]:
    """Caps known when rows were served: provisional rows, stale sources, metrics confirmed wrong of late."""
    out: list[Signal] = [("provisional", "provisional rows are included")] if provisional_rows else []
    out += [("provisional", f"stale: {', '.join(sorted(stale))}")] if stale else []
    return out + [("caution", f"{m}: confirmed wrong") for m in wrong]


def score(signals: list[Signal]) -> tuple[str, list[str]]:
    """The tier and the reasons that set it."""
    tier = min((t for t, _ in signals), key=TIERS.index, default="trusted")
    return tier, [reason for t, reason in signals if t == tier and tier != "trusted"]


def at_least(tier: str, level: str) -> bool:
    return TIERS.index(tier) >= TIERS.index(level)

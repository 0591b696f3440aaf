"""Expressions that projects and callers write, read with Catalyst's own parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import Refusal

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]+`(?:\.`[^`]+`)*|[A-Za-z_]\w*(?:\s*\.\s*(?:[A-Za-z_]\w*|`[^`]+`))*|\d[\w.]*|.", re.S)
#: Functions that are written without parentheses.
_NILADIC = {"current_date", "current_timestamp", "current_user", "localtimestamp"}


def _walk(node: Any, found: list[Any]) -> list[Any]:
    found.append(node)
    children = node.children()
    for i in range(children.size()):
        _walk(children.apply(i), found)
    return found


def _parse(spark: SparkSession, text: str) -> Any:
    try:
        return spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except (PySparkException, Exception) as error:
        raise Refusal("validation_failed", f"{text!r} can't be read: {str(error).splitlines()[0]}") from None


def attributes(spark: SparkSession, text: str) -> set[tuple[str, ...]]:
    """The name parts of the columns that an expression refers to."""
    out = set()
    for node in _walk(_parse(spark, dates(text)), []):
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            parts = node.nameParts()
            name = tuple(parts.apply(i) for i in range(parts.size()))
            if not (len(name) == 1 and name[0].lower() in _NILADIC):
                out.add(name)
    return out


def renamed(spark: SparkSession, text: str, name: Callable[[tuple[str, ...]], str]) -> str:
    """text with each column reference replaced by name(its parts)."""
    known = attributes(spark, text)
    out, text = [], dates(text)
    tokens = _TOKEN.findall(text)
    for i, token in enumerate(tokens):
        parts = tuple(p.strip().strip("`") for p in re.split(r"\.(?=(?:[^`]*`[^`]*`)*[^`]*$)", token))
        called = next((t for t in tokens[i + 1 :] if not t.isspace()), "") == "("
        out.append(name(parts) if parts in known and token[0] not in "'\"" and not called else token)
    return "".join(out)


_DATE = re.compile(r"\bDATE\s*\(\s*'now'\s*((?:,\s*'[^']*'\s*)*)\)", re.I)
_SHIFT = re.compile(r"([+-]?)\s*(\d+)\s+(day|month|year)s?")
_START = re.compile(r"start of (day|week|month|quarter|year)")


def dates(text: str) -> str:
    """DATE('now', '-3 months', 'start of month') as Spark SQL; modifiers apply from left to right."""

    def spell(found: re.Match) -> str:
        out = "current_date()"
        for change in re.findall(r"'([^']*)'", found[1]):
            if shift := _SHIFT.fullmatch(change.strip().lower()):
                out = f"({out} {shift[1] or '+'} INTERVAL {shift[2]} {shift[3]})"
            elif start := _START.fullmatch(change.strip().lower()):
                out = f"cast(date_trunc('{start[1]}', {out}) as date)"
            else:
                return found[0]
        return out

    return re.sub(r"::\s*([A-Za-z]+(?:\(\d+(?:,\s*\d+)?\))?)", r"::\1", _DATE.sub(spell, text))


def aggregate_of(spark: SparkSession, text: str) -> tuple[str, bool]:
    """The first aggregate function of an expression, in upper case, and whether it is distinct."""
    for node in _walk(_parse(spark, text), []):
        if node.getClass().getSimpleName() == "UnresolvedFunction":
            parts = node.nameParts()
            name = parts.apply(parts.size() - 1).upper()
            if name in AGGREGATES:
                return name, bool(node.isDistinct())
    return "", False


@dataclass(frozen=True)
class Window:
    """What a predicate leaves of a time: the least and the largest value, None where it is open; both may hold nothing."""

    lower: datetime | None = None
    upper: datetime | None = None

    def __and__(self, other: Window) -> Window:
        return Window(_of(max, self.lower, other.lower), _of(min, self.upper, other.upper))

    def __or__(self, other: Window) -> Window:
        both = lambda f, a, b: None if a is None or b is None else f(a, b)
        return Window(both(min, self.lower, other.lower), both(max, self.upper, other.upper))


def _of(choose: Callable, *given: datetime | None) -> datetime | None:
    return choose((x for x in given if x is not None), default=None)


#: Comparisons by class of Catalyst, and by operator: whether they bound from below and from above.
_BOUNDS = {
    "LessThan": (False, True), "LessThanOrEqual": (False, True), "GreaterThan": (True, False), "GreaterThanOrEqual": (True, False), "EqualTo": (True, True), "EqualNullSafe": (True, True),
    "<": (False, True), "<=": (False, True), ">": (True, False), ">=": (True, False), "=": (True, True),
}
_NEGATED = {"LessThan": "GreaterThanOrEqual", "LessThanOrEqual": "GreaterThan", "GreaterThan": "LessThanOrEqual", "GreaterThanOrEqual": "LessThan"}


def window(spark: SparkSession, given: Any, is_time: Callable[[tuple[str, ...]], bool]) -> Window:
    """What a filter, written or structured, leaves of the times that is_time names; times without a zone are UTC."""
    if isinstance(given, str):
        return _window(spark, _parse(spark, dates(given)), is_time, False)
    op, value = str(given.get("op", "=")).upper(), given.get("value")
    if not is_time(tuple(str(given.get("field")).split("."))):
        return Window()
    if op == "IN":
        found = [_instant(spark, F.lit(v)) for v in value or ()]
        return Window(min(found), max(found)) if found and None not in found else Window()
    below, above = _BOUNDS.get(op, (False, False))
    at = _instant(spark, F.lit(value))
    return Window(at if below else None, at if above else None)


def _window(spark: SparkSession, node: Any, is_time: Callable[[tuple[str, ...]], bool], negated: bool) -> Window:
    kind = node.getClass().getSimpleName()
    children = node.children()
    parts = [children.apply(i) for i in range(children.size())]

    def named(x: Any) -> bool:
        while x.getClass().getSimpleName() == "Cast":
            x = x.children().apply(0)
        if x.getClass().getSimpleName() != "UnresolvedAttribute":
            return False
        names = x.nameParts()
        return is_time(tuple(names.apply(i) for i in range(names.size())))

    if kind in ("And", "Or"):
        left, right = (_window(spark, x, is_time, negated) for x in parts)
        return left & right if (kind == "And") is not negated else left | right
    if kind == "Not":
        return _window(spark, parts[0], is_time, not negated)
    if kind == "UnresolvedFunction" and str(node.nameParts().apply(0)).lower() == "between" and named(parts[0]) and not negated:
        return Window(_constant(spark, parts[1]), _constant(spark, parts[2]))
    if kind == "In" and named(parts[0]) and not negated:
        found = [_constant(spark, x) for x in parts[1:]]
        return Window(min(found), max(found)) if found and None not in found else Window()
    if kind in _BOUNDS and len(parts) == 2:
        if negated:
            if kind not in _NEGATED:
                return Window()
            kind = _NEGATED[kind]
        below, above = _BOUNDS[kind]
        if named(parts[1]):
            parts, (below, above) = parts[::-1], (above, below)
        if named(parts[0]):
            at = _constant(spark, parts[1])
            return Window(at if below else None, at if above else None)
    return Window()


def _constant(spark: SparkSession, node: Any) -> datetime | None:
    """The value of a constant expression as a time; None if it is none."""
    if any(x.getClass().getSimpleName() == "UnresolvedAttribute" and x.name().lower() not in _NILADIC for x in _walk(node, [])):
        return None
    return _instant(spark, F.expr(node.sql()))


def _instant(spark: SparkSession, value: Column) -> datetime | None:
    try:
        row = spark.range(1).select(value.alias("v"))
        kind = row.schema["v"].dataType.typeName()
        zoned = kind == "timestamp"
        # A text may carry a zone of its own.
        if kind == "string" and (text := row.first()[0]) and _ZONED.search(text.strip()):
            value, zoned = F.to_timestamp(value), True
        micros = F.unix_micros(value.cast("timestamp")) if zoned else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value.cast("timestamp_ntz"))
        found = spark.range(1).select(micros.alias("v")).first()[0]
    except PySparkException:
        return None
    return None if found is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=found)


_ZONED = re.compile(r"\d{2}:\d{2}.*(?:[zZ]|[+-]\d{2}:?\d{2})$")


AGGREGATES = {"SUM", "COUNT", "MIN", "MAX", "AVG", "MEAN", "MEDIAN", "STDDEV", "VARIANCE", "PERCENTILE", "PERCENTILE_CONT", "PERCENTILE_DISC", "COUNT_IF", "ANY_VALUE", "FIRST", "LAST", "APPROX_COUNT_DISTINCT"}
ADDITIVE = {"SUM", "COUNT", "MIN", "MAX"}
OPERATORS = ("=", "!=", "<>", "<=", ">=", "<", ">", "LIKE", "IN")


def structured(given: dict, column: Callable[[str], Column]) -> Column:
    """A filter of field, op and value; the value becomes a literal and is never read as SQL."""
    field, op, value = given.get("field"), str(given.get("op", "=")).upper(), given.get("value")
    if not field or op not in OPERATORS:
        raise Refusal("validation_failed", f"{given!r} is no filter; the operators are {' '.join(OPERATORS)}")
    it = column(field)
    if op == "IN":
        if not isinstance(value, (list, tuple)):
            raise Refusal("validation_failed", f"IN on {field} needs a list")
        return it.isin(list(value))
    if op == "LIKE":
        return it.like(str(value))
    compare = {"=": it.__eq__, "!=": it.__ne__, "<>": it.__ne__, "<": it.__lt__, ">": it.__gt__, "<=": it.__le__, ">=": it.__ge__}
    return compare[op](F.lit(value))


def parse_flag(text: str) -> dict:
    """``field:op:value`` or ``field<op>value`` as a structured filter."""
    if (parts := text.split(":", 2)) and len(parts) == 3 and parts[1].strip().upper() in OPERATORS:
        field, op, value = parts[0].strip(), parts[1].strip().upper(), parts[2]
    elif found := re.match(r"\s*([\w.]+)\s*(<=|>=|!=|<>|=|<|>)(.*)", text, re.S):
        field, op, value = found[1], found[2], found[3]
    else:
        raise Refusal("validation_failed", f"{text!r} is no filter: field:op:value or field=value")
    if op == "IN":
        return {"field": field, "op": op, "value": [_scalar(v) for v in value.split(",")]}
    return {"field": field, "op": op, "value": _scalar(value)}


def _scalar(text: str) -> Any:
    text = text.strip()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


#: Plan nodes that only read.
_READING = (
    "Project Filter Aggregate Join Union Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedWith WithCTE UnresolvedInlineTable UnresolvedHaving Window Generate OneRowRelation Except "
    "Intersect Deduplicate Expand LateralJoin Pivot Unpivot WithWindowDefinition Sample UnresolvedTableValuedFunction"
).split()
_REFUSED = {"reflect", "java_method", "try_reflect"}


def assert_read_only(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Refuses whatever isn't one query over the given tables."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise Refusal("read_only_violation", f"not one readable query: {str(error).splitlines()[0]}") from None
    names = {t.lower() for t in tables}
    text = plan.toString()
    if calls := sorted({c for c in re.findall(r"'?(\w+)\(", text) if c.lower() in _REFUSED} | {c for c in _REFUSED if re.search(rf"\b{c}\s*\(", sql, re.I)}):
        raise Refusal("read_only_violation", f"{calls[0]} isn't allowed")
    with_names = {n.lower() for n in re.findall(r"(?:\bwith\b|,)\s*(?:recursive\s+)?`?(\w+)`?\s*(?:\([^)]*\)\s*)?as\s*\(", sql, re.I)}

    def look(node: Any) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in _READING:
            raise Refusal("read_only_violation", f"{kind} isn't a query")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            name = ".".join(parts.apply(i) for i in range(parts.size())).lower()
            if name not in names | with_names:
                raise Refusal("read_only_violation", f"{name} is no table of this project")
        if kind == "UnresolvedTableValuedFunction":
            raise Refusal("read_only_violation", "table functions aren't allowed")
        for many in (node.children(), node.innerChildren(), node.subqueries()):
            for i in range(many.size()):
                look(many.apply(i))

    look(plan)

"""Which stripes a conjunction of simple comparisons can't touch.

Pruning only ever leaves out stripes that hold no matching row: the full predicate is always applied to the rest,
so a pruned scan and a full one return the same rows.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..bounds import decoded
from ..manifest import Manifest, Part, Stripe
from ..types import stats_kind

@dataclass(frozen=True)
class Conjunct:
    column: str
    op: str  # < <= = >= > in is_null is_not_null
    value: Any = None

    def __str__(self) -> str:
        return f"{self.column} {self.op.replace('_', ' ')}" + ("" if self.op.startswith("is_") else f" {self.value!r}")


@dataclass
class ScanReport:
    """What a scan was planned to read."""

    quals: list[str]
    total: int
    skipped: int

    def __str__(self) -> str:
        return f"Stripe pruning quals: {' AND '.join(self.quals) or 'none'}\nStripes total: {self.total}\nStripes skipped: {self.skipped}"


def _aligned(kind: str, bound: Any, value: Any) -> tuple[Any, Any] | None:
    """Bound and constant in the type in which they are compared; None if that isn't certain."""
    if isinstance(value, bool) or value is None:
        return None
    if kind in ("int", "float", "decimal"):
        if isinstance(value, float):
            return None if math.isnan(value) else (float(bound), value)
        if not isinstance(value, (int, Decimal)):
            return None
        if kind == "float":
            return bound, float(value)
        return Decimal(bound), Decimal(value)
    if kind == "string":
        return (bound.encode(), value.encode()) if isinstance(value, str) else None
    if kind == "date":
        if isinstance(value, dt.datetime):
            return (dt.datetime.combine(bound, dt.time()), value) if value.tzinfo is None else None
        return (bound, value) if isinstance(value, dt.date) else None
    if isinstance(value, dt.datetime):
        return (bound, value) if (bound.tzinfo is None) == (value.tzinfo is None) else None
    if isinstance(value, dt.date) and kind == "timestamp":
        return bound, dt.datetime.combine(value, dt.time())
    return None


def excludes(stripe: Stripe | Part, kind: str | None, c: Conjunct) -> bool:
    """Whether no row of the stripe, or of a part's stripes, satisfies the conjunct."""
    s = stripe.stats.get(c.column)
    if s is None or kind is None:
        return False
    low, high, nulls, nan = s
    if c.op == "is_null":
        return nulls == 0
    if nulls == stripe.rows:
        return True  # only nulls
    if c.op == "is_not_null":
        return False
    if c.op == "in":
        return all(v is None or excludes(stripe, kind, Conjunct(c.column, "=", v)) for v in c.value)
    low, high = decoded(kind, low), decoded(kind, high)

    def misses(bound: Any, test) -> bool:
        if bound is None:
            return False
        pair = _aligned(kind, bound, c.value)
        return pair is not None and test(*pair)

    if c.op == "<":
        return misses(low, lambda b, k: b >= k)
    if c.op == "<=":
        return misses(low, lambda b, k: b > k)
    if c.op == "=":
        return misses(low, lambda b, k: k < b) or not nan and misses(high, lambda b, k: k > b)
    if c.op == ">=":
        return not nan and misses(high, lambda b, k: b < k)
    if c.op == ">":
        return not nan and misses(high, lambda b, k: b <= k)
    return False


def prune(m: Manifest, conjuncts: list[Conjunct]) -> tuple[list[Stripe], ScanReport]:
    """Stripes that may hold rows that satisfy all conjuncts; only parts that may are read."""
    kinds = m.kinds
    usable = [c for c in conjuncts if c.column in kinds]
    admits = lambda s: not any(excludes(s, kinds[c.column], c) for c in usable)
    kept = [s for s in m.each(admits) if s.rows > s.deleted and admits(s)]
    return kept, ScanReport([str(c) for c in usable], m.count, m.count - len(kept))


_OPS = {"LessThan": "<", "LessThanOrEqual": "<=", "EqualTo": "=", "GreaterThanOrEqual": ">=", "GreaterThan": ">"}
_TURNED = {"<": ">", "<=": ">=", "=": "=", ">=": "<=", ">": "<"}


def _constant(e) -> tuple[bool, Any]:
    """Whether a parsed expression is a literal whose Python value is known, and the value."""
    if e.getClass().getSimpleName() != "Literal" or e.value() is None:
        return False, None
    kind, v = e.dataType().typeName(), e.value()
    if kind in ("integer", "long", "short", "byte", "double", "float"):
        return True, v
    if kind.startswith("decimal"):
        return True, Decimal(v.toString())
    if kind == "string":
        return True, v.toString()
    if kind == "date":
        return True, dt.date(1970, 1, 1) + dt.timedelta(days=v)
    if kind == "timestamp_ntz":
        return True, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=v)
    if kind == "timestamp":
        return True, dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=v)
    return False, None


_DATE, _STAMP = re.compile(r"\d{4}-\d{2}-\d{2}"), re.compile(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?")


def _as_compared(kind: str | None, value: Any, zone: str, listed: bool = False) -> Any:
    """A string constant as the date or time as which Spark compares it with a column of that kind; others as they are.

    Only plain forms are read. listed: among the values of IN, which Spark may compare as strings; there only dates
    read alike.
    """
    if not isinstance(value, str) or kind not in ("date", "timestamp", "timestamptz") or listed and kind != "date":
        return value
    try:
        if kind == "date":
            return dt.date.fromisoformat(value) if _DATE.fullmatch(value) else value
        if not (_DATE.fullmatch(value) or _STAMP.fullmatch(value)):
            return value
        moment = dt.datetime.fromisoformat(value)
        return moment.replace(tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc) if kind == "timestamptz" else moment
    except (ValueError, KeyError, OverflowError, OSError):
        return value


def conjuncts_of(spark: SparkSession, condition: str, schema: T.StructType) -> list[Conjunct]:
    """The comparisons of columns with constants among the AND-ed parts of an SQL condition; others are left out."""
    names = {f.name.lower(): f.name for f in schema}
    kinds = {f.name: stats_kind(f.dataType) for f in schema}
    zone = spark.conf.get("spark.sql.session.timeZone")

    def conjunct(c: str, op: str, v: Any) -> Conjunct:
        return Conjunct(c, op, _as_compared(kinds[c], v, zone))

    def column(e) -> str | None:
        return names.get(e.name().lower().strip("`")) if e.getClass().getSimpleName() == "UnresolvedAttribute" else None

    def walk(e) -> list[Conjunct]:
        kind = e.getClass().getSimpleName()
        if kind == "And":
            return walk(e.left()) + walk(e.right())
        if kind in _OPS:
            for a, b, op in ((e.left(), e.right(), _OPS[kind]), (e.right(), e.left(), _TURNED[_OPS[kind]])):
                ok, v = _constant(b)
                if ok and (c := column(a)):
                    return [conjunct(c, op, v)]
        if kind == "Between" or kind == "UnresolvedFunction" and e.nameParts().mkString(".").lower() == "between":
            kids = [e.children().apply(i) for i in range(e.children().size())]
            if len(kids) == 3 and (c := column(kids[0])):
                (ok1, low), (ok2, high) = _constant(kids[1]), _constant(kids[2])
                return [conjunct(c, ">=", low)] * ok1 + [conjunct(c, "<=", high)] * ok2
        if kind == "In" and (c := column(e.value())):
            values = [_constant(e.list().apply(i)) for i in range(e.list().size())]
            if all(ok for ok, _ in values):
                return [Conjunct(c, "in", tuple(_as_compared(kinds[c], v, zone, True) for _, v in values))]
        if kind in ("IsNull", "IsNotNull") and (c := column(e.child())):
            return [Conjunct(c, "is_null" if kind == "IsNull" else "is_not_null")]
        return []

    return walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(condition))

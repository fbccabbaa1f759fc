"""Bounds of columns: their JSON forms, the bounds of several stripes together, and what Parquet footers say of a file."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterable
from decimal import Decimal
from typing import Any

#: Longest string bound that is kept; a longer maximum has no bound, a longer minimum is cut.
BOUND_CHARS = 64


def encode_bounds(kind: str, low: Any, high: Any) -> tuple[Any, Any, bool]:
    """JSON forms of a column's minimum and maximum, and whether a NaN is among the values."""
    if low is None:
        return None, None, False
    if kind == "int":
        return int(low), int(high), False
    if kind == "float":
        nan = math.isnan(high)
        return (math.inf if math.isnan(low) else float(low)), (math.inf if nan else float(high)), nan
    if kind == "decimal":
        return str(low), str(high), False
    if kind == "string":
        return low[:BOUND_CHARS], high if len(high) <= BOUND_CHARS else None, False
    return low.isoformat(), high.isoformat(), False


def decoded(kind: str, x: Any) -> Any:
    if x is None or kind in ("int", "float", "string"):
        return x
    if kind == "decimal":
        return Decimal(x)
    return dt.date.fromisoformat(x) if kind == "date" else dt.datetime.fromisoformat(x)


def _order(kind: str) -> Callable[[Any], Any]:
    return (lambda x: x.encode()) if kind == "string" else (lambda x: decoded(kind, x))


def combined(each: Iterable[tuple[int, dict]], kinds: dict[str, str]) -> dict:
    """Of (rows, stats) of stripes: stats that hold for all of them together. A column that one of them lacks is left out."""
    each = list(each)
    out = {}
    for c, kind in kinds.items():
        if not all(c in stats for _, stats in each):
            continue
        known = [(rows, stats[c]) for rows, stats in each]
        filled = [s for rows, s in known if s[2] < rows]  # those of nulls alone bound nothing
        order = _order(kind)
        lows, highs = [s[0] for s in filled], [s[1] for s in filled]
        low = min(lows, key=order) if lows and None not in lows else None
        high = max(highs, key=order) if highs and None not in highs else None
        out[c] = [low, high, sum(s[2] for _, s in known), any(s[3] for _, s in known)]
    return out


def footer_stats(footer: Any, kinds: dict[str, str], groups: Iterable[Any] | None = None) -> dict:
    """Column stats from a Parquet footer as pyarrow reads it, or of some of its row groups; a column whose bounds it lacks is left out.

    Writers order NaN above all else or leave the bounds out where there is one.
    """
    groups = [footer.row_group(g) for g in range(footer.num_row_groups)] if groups is None else list(groups)
    where = {groups[0].column(i).path_in_schema: i for i in range(footer.num_columns)} if groups else {}
    out = {}
    for c, kind in kinds.items():
        if c not in where:
            continue
        each = [(g.num_rows, g.column(where[c]).statistics) for g in groups]
        if any(s is None or not s.has_null_count for _, s in each):
            continue
        nulls = sum(s.null_count for _, s in each)
        filled = [s for rows, s in each if s.null_count < rows]
        if any(not s.has_min_max for s in filled):
            continue
        try:
            lows, highs = [s.min for s in filled], [s.max for s in filled]
            if kind == "string":
                lows, highs = ([x if isinstance(x, str) else bytes(x).decode() for x in xs] for xs in (lows, highs))
            order = {"string": str.encode, "float": lambda x: (math.isnan(x), x)}.get(kind)
            low, high = (min(lows, key=order), max(highs, key=order)) if filled else (None, None)
            expected = {"int": int, "float": float, "decimal": Decimal, "string": str, "date": dt.date, "timestamp": dt.datetime, "timestamptz": dt.datetime}[kind]
            if filled and not (isinstance(low, expected) and isinstance(high, expected)):
                continue
            if kind in ("timestamp", "timestamptz") and filled:
                zone = dt.timezone.utc if kind == "timestamptz" else None
                low, high = (x.astimezone(zone) if x.tzinfo and zone else x.replace(tzinfo=zone) for x in (low, high))
            a, b, nan = encode_bounds(kind, low, high)
        except (UnicodeDecodeError, OverflowError, ValueError, TypeError):
            continue
        out[c] = [a, b, nulls, nan]
    return out

"""Five-field schedule expressions as predicates over a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields in order and their bounds; Sunday is 0.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))


def _values(field: str, low: int, high: int) -> list[int]:
    def whole(text: str) -> int:
        if not text.isascii() or not text.isdigit():
            raise ValueError(f"not a number in schedule field: {text!r}")
        return int(text)

    found: set[int] = set()
    for part in (p.strip() for p in field.split(",")):
        if part == "*":
            found.update(range(low, high + 1))
        elif part.startswith("*/"):
            step = whole(part[2:])
            if step == 0:
                raise ValueError("a schedule step must not be zero")
            found.update(range(low, high + 1, step))
        else:
            first, _, last = part.partition("-")
            a = whole(first)
            b = whole(last) if "-" in part else a
            if not low <= a <= b <= high:
                raise ValueError(f"{part} is outside {low}-{high}")
            found.update(range(a, b + 1))
    return sorted(found)


def parse_cron(expression: str) -> dict[str, list[int]]:
    """The values each field allows; ValueError when the expression is not valid."""
    parts = expression.split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"a schedule needs {len(FIELDS)} fields, got {len(parts)}")
    return {name: _values(part, low, high) for part, (name, low, high) in zip(parts, FIELDS)}


def is_valid_cron(expression: str) -> bool:
    try:
        parse_cron(expression)
    except ValueError:
        return False
    return True


def matches_cron(ts: Column, expression: str) -> Column:
    """Does the minute of ``ts`` fall on the schedule?  Both day fields must agree."""
    allowed = parse_cron(expression)
    actual = {
        "minute": F.minute(ts), "hour": F.hour(ts), "day": F.dayofmonth(ts), "month": F.month(ts), "weekday": F.dayofweek(ts) - 1,
    }
    condition = ts.isNotNull()
    for name, low, high in FIELDS:
        if len(allowed[name]) < high - low + 1:
            condition = condition & actual[name].isin(allowed[name])
    return condition

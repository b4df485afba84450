"""Predicates over flow columns (Column in, Column out).

A predicate that has nothing to test is ``None``; :func:`all_of` drops those.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.sqlcheck import check_expression
from flowlens.schema import DST, END, SRC, START

# Comparison operators and the words and patterns that a raw
# condition may not contain.
_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<>": operator.ne,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
}
FORBIDDEN_WORDS = ("DROP", "DELETE", "INSERT", "UPDATE", "CREATE", "ALTER", "TRUNCATE")
FORBIDDEN_TEXT = re.compile(
    rf";\s*(?:{'|'.join(FORBIDDEN_WORDS)})|--|/\*|\bUNION\s+(?:ALL\s+)?SELECT\b"
    r"|'\s*OR\s+'?1'?\s*=\s*'?1",
    re.IGNORECASE,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(column: Column | str, values: Iterable[Any]) -> Column | None:
    values = list(values or ())
    return _col(column).isin(*values) if values else None


def in_range(column: Column | str, low=None, high=None) -> Column | None:
    """Inclusive on both ends; either may be absent."""
    tests = []
    if low is not None:
        tests.append(_col(column) >= low)
    if high is not None:
        tests.append(_col(column) <= high)
    return reduce(operator.and_, tests) if tests else None


def contains(column: Column | str, text: str | None) -> Column | None:
    """Plain substring test: ``%`` and ``_`` mean themselves."""
    if not text or not text.strip():
        return None
    return _col(column).cast("string").contains(F.lit(text))


def compare(column: Column | str, op: str, value: Any) -> Column:
    if op not in _COMPARE:
        raise ValueError(f"invalid operator {op!r}; use one of {', '.join(_COMPARE)}")
    return _COMPARE[op](_col(column), F.lit(value))


def check_condition(text: str) -> None:
    """Refuse statement text in a condition."""
    if FORBIDDEN_TEXT.search(text):
        raise ValueError("condition holds a forbidden pattern")
    for word in text.upper().split():
        if word in FORBIDDEN_WORDS:
            raise ValueError(f"condition holds the forbidden word {word}")


def custom(text: str | None) -> Column | None:
    """A raw SQL condition, parsed by Spark as an expression."""
    if not text or not text.strip():
        return None
    check_condition(text)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        check_expression(spark, f"({text})")
    return F.expr(f"({text})")


def all_of(*predicates: Column | None) -> Column:
    present = [p for p in predicates if p is not None]
    return reduce(operator.and_, present) if present else F.lit(True)


def any_value_join(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """IN with a list too long for an expression: a left-semi join.

    ``values`` has one column; the optimizer chooses broadcast or shuffle from
    its size.
    """
    return df.join(values.toDF(column).distinct(), column, "left_semi")


@dataclass
class FlowFilter:
    """What a user asks for; turned into one predicate by :func:`flow_filter`."""

    start: int | None = None
    end: int | None = None
    src_ips: Sequence[str] = field(default_factory=list)
    dst_ips: Sequence[str] = field(default_factory=list)
    src_ports: Sequence[int] = field(default_factory=list)
    dst_ports: Sequence[int] = field(default_factory=list)
    protocols: Sequence[int] = field(default_factory=list)
    l7_protocols: Sequence[float] = field(default_factory=list)
    attack_types: Sequence[str] = field(default_factory=list)
    custom: str | None = None


def date_bounds(column: str, start: int | None, end: int | None) -> Column | None:
    """Partition predicate implied by start >= ``start`` and end <= ``end``.

    A flow starts no later than it ends, so its start date lies in the range.
    """
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    return in_range(
        column,
        None if start is None else day(start),
        None if end is None else day(end),
    )


def flow_filter(spec: FlowFilter, date_column: str | None = None) -> Column:
    """The conjunction described by ``spec``.

    ``date_column`` names the table's date partition column, when it has one,
    so that the time range also prunes partitions.
    """
    return all_of(
        date_bounds(date_column, spec.start, spec.end) if date_column else None,
        in_range(START, low=spec.start),
        in_range(END, high=spec.end),
        is_in(SRC, spec.src_ips),
        is_in(DST, spec.dst_ips),
        is_in("L4_SRC_PORT", spec.src_ports),
        is_in("L4_DST_PORT", spec.dst_ports),
        is_in("PROTOCOL", spec.protocols),
        is_in("L7_PROTO", spec.l7_protocols),
        is_in("Attack", spec.attack_types),
        custom(spec.custom),
    )


def column_filters(filters: dict[str, Any]) -> Column:
    """Per-column filters: a list means one-of (as text), a text means contains."""
    tests = []
    for name, value in filters.items():
        if isinstance(value, (list, tuple)):
            tests.append(is_in(F.col(name).cast("string"), [str(v) for v in value]))
        elif isinstance(value, str):
            tests.append(contains(name, value))
    return all_of(*tests)

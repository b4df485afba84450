"""Row selection, paging and display projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.predicates import all_of, compare, date_bounds, in_range
from flowlens.schema import DATE, DST, END, FLOW_ID, FLOW_TYPES, SRC, START, STATE

# What a user may call a column, and the columns of the two views.
LABELS = {
    "source ip": SRC,
    "destination ip": DST,
    "src ip": SRC,
    "dst ip": DST,
    "source port": "L4_SRC_PORT",
    "destination port": "L4_DST_PORT",
    "src port": "L4_SRC_PORT",
    "dst port": "L4_DST_PORT",
    "protocol": "PROTOCOL",
    "attack type": "Attack",
    "attack": "Attack",
    "in bytes": "IN_BYTES",
    "out bytes": "OUT_BYTES",
    "hmm state": STATE,
    "cluster": STATE,
    "connection state": "CONN_STATE",
    "conn state": "CONN_STATE",
}
PREVIEW_COLUMNS = [
    SRC, DST, "PROTOCOL", "L4_DST_PORT", "IN_BYTES", "OUT_BYTES",
    "FLOW_DURATION_MILLISECONDS", "CONN_STATE", "SERVICE", "MITRE_TACTIC", "MITRE_TECHNIQUE",
]
TABLE_COLUMNS = [
    SRC, "L4_SRC_PORT", DST, "L4_DST_PORT", "PROTOCOL", "IN_BYTES", "OUT_BYTES", "Attack", STATE,
]


def hide_benign(f: DataFrame) -> DataFrame:
    return f.where(F.col("Attack") != "Benign")


def session_flows(f: DataFrame, src_ip: str, start: int, end: int) -> DataFrame:
    return f.where(
        all_of(compare(SRC, "=", src_ip), in_range(START, low=start), in_range(END, high=end))
    )


def state_flows(f: DataFrame, state: int) -> DataFrame:
    return f.where(F.col(STATE) == state)


def filter_by(f: DataFrame, label: str, value, limit: int | None = None) -> DataFrame:
    """``label = value`` where the label is what the user calls the column."""
    column = LABELS.get(label.strip().lower())
    if column is None:
        raise ValueError(f"unknown label {label!r}")
    typed = F.lit(value).cast(FLOW_TYPES[column])
    hits = f.where(F.col(column) == typed)
    return hits if limit is None else hits.orderBy(START, FLOW_ID).limit(limit)


def display_flows(f: DataFrame, limit: int | None = None) -> DataFrame:
    rows = hide_benign(f)
    return rows if limit is None else rows.orderBy(START, FLOW_ID).limit(limit)


def _newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col(START).desc_nulls_last(), F.col(FLOW_ID).asc())


def page_rows(
    f: DataFrame, where: Column | None = None, limit: int = 1000, offset: int = 0,
    after: tuple[int, int] | None = None,
) -> DataFrame:
    """The (start, flow id) of the rows of a page; no other column is read but those of ``where``."""
    rows = f.where(all_of(where, _beyond(after))).select(START, FLOW_ID)
    rows = _newest_first(rows)
    return rows.offset(offset).limit(limit) if offset else rows.limit(limit)


def _beyond(after: tuple[int, int] | None) -> Column | None:
    if after is None:
        return None
    start, flow_id = after
    return (F.col(START) <= start) & ((F.col(START) < start) | (F.col(FLOW_ID) > flow_id))


def flow_page(
    f: DataFrame,
    where: Column | None = None,
    limit: int = 1000,
    offset: int = 0,
    after: tuple[int, int] | None = None,
) -> DataFrame:
    """One page, newest first; ties by flow id.

    Two steps: when called, a job finds the span of start times that the page covers from two columns; the table
    returned reads whole rows of that span only, by the date partitions and row groups that can hold it.
    ``offset`` keeps offset + limit rows per task, so walk deep with ``after``: the (start, flow id) of the last
    row already shown.
    """
    rows = f.where(all_of(where, _beyond(after)))
    span = page_rows(f, where, limit, offset, after).agg(
        F.min(START), F.max(START), F.count_if(F.col(START).isNull()), F.count(F.lit(1))
    )
    low, high, without, found = span.first()
    if not found:
        return _newest_first(rows.where(F.lit(False)))
    if low is None:  # only rows without a start, which come last
        inside, above = F.col(START).isNull(), F.col(START).isNotNull()
    else:
        inside = in_range(START, None if without else low, high)
        if DATE in f.columns and not without:
            inside = inside & date_bounds(DATE, low, high)
        if without:
            inside = inside | F.col(START).isNull()
        above = F.col(START) > high
    skip = offset - rows.where(above).count() if offset else 0
    page = _newest_first(rows.where(inside))
    return page.offset(skip).limit(limit) if skip else page.limit(limit)


def preview(f: DataFrame) -> DataFrame:
    return f.select(*PREVIEW_COLUMNS)


def table_view(f: DataFrame) -> DataFrame:
    return f.select(*TABLE_COLUMNS)

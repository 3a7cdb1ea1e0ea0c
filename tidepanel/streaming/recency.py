"""Weeks since the last promotion, kept as state per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepanel.schema import SERIES

OUT_SCHEMA = "sku string, channel string, region string, week date, promo_recency double"
STATE_SCHEMA = "weeks_since long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one series in week order; a micro-batch holds at most the new weeks of the series."""
    since = state.get[0] if state.exists else -1
    rows = pd.concat(list(frames)).sort_values("week")
    out = []
    for flag in rows["promotion_flag"]:
        since = 0 if flag == 1 else (since + 1 if since >= 0 else -1)
        out.append(float(since) if since >= 0 else None)
    state.update((since,))
    yield pd.DataFrame({"sku": key[0], "channel": key[1], "region": key[2], "week": rows["week"].values,
                        "promo_recency": pd.Series(out, dtype="float64").values})


def promo_recency_stream(stream: DataFrame) -> DataFrame:
    """Input rows (series, week, promotion_flag) must arrive in week order across micro-batches."""
    return stream.groupBy(*SERIES).applyInPandasWithState(
        _advance, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)

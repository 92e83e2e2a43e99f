"""Queries over events in another order than that of their ids, and of equal times."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from oracle import assert_same

from tidewell.plans import ORACLES, QUERIES

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.parametrize("name", ["compacted_ticks", "consolidated_ticks"])
def test_latest_row_whatever_the_order_of_the_input(spark, tmp_path, name):
    events = pq.read_table(EVENTS).sort_by([("event_id", "descending")])
    pq.write_table(events, f"{tmp_path}/events.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], events=events)


def test_every_event_of_a_millisecond_counts(spark, tmp_path):
    events = pq.read_table(EVENTS)
    again = events.slice(0, 300)
    ids = pc.add(again["event_id"], 1_000_000)
    events = pa.concat_tables([events, again.set_column(again.column_names.index("event_id"), "event_id", ids)])
    pq.write_table(events, f"{tmp_path}/events.parquet")
    assert_same(QUERIES["consolidated_spots"](spark, str(tmp_path)), ORACLES["consolidated_spots"], events=events)

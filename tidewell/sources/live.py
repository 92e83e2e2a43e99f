"""Live feeds as a streaming data source: a partition a subscription, which reads its connection on an executor.

The transport is a parameter: poll(subscription, batch) gives the messages that have arrived since the batch before (a picklable
function over a socket, a recording or a test alike). What a socket has handed out it does not hand out again, so a batch
that is repeated after a failure has what the transport still gives for it; staging by batch number keeps it from counting twice.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feeds import patient

Poll = Callable[[Any, int], Iterable[str]]
SCHEMA = "value string, recv_ns bigint, shard int"

# workers of data sources start without the session's path, so what they run travels whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def live_source(name: str, poll: Poll, subscriptions: list, batches: int | None = None) -> type[DataSource]:
    """A data source class over the subscriptions (lists of tokens, say); batches: how many there are at most, for a feed that ends."""

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.last = 0

        def initialOffset(self) -> dict:
            return {"batch": 0}

        def latestOffset(self) -> dict:
            self.last = self.last + 1 if batches is None else batches
            return {"batch": self.last}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.last = max(self.last, end["batch"])
            return [InputPartition((i, s, start["batch"], end["batch"])) for i, s in enumerate(subscriptions)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            shard, subscription, first, last = partition.value
            for batch in range(first, last):
                for message in patient(lambda request: poll(subscription, request["batch"]))({"batch": batch}):
                    yield message, time.time_ns(), shard

        def commit(self, end: dict) -> None:
            pass

    class Live(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema: Any) -> DataSourceStreamReader:
            return Reader()

    return Live


def live_messages(spark: SparkSession, name: str, poll: Poll, subscriptions: list, batches: int | None = None) -> DataFrame:
    """A stream of (value, recv_ns, shard) for pipelines.route and pipelines.allowed."""
    spark.dataSource.register(live_source(name, poll, subscriptions, batches))
    return spark.readStream.format(name).load()

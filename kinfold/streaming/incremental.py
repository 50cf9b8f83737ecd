"""Runs for each micro-batch of a stream of entity snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.incremental import run_incremental


def each_batch(stream: DataFrame, config: Config, load_state: Callable[[], tuple[DataFrame | None, DataFrame | None]], save: Callable[[dict[str, DataFrame], int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch is a snapshot of organizations: the same plan as in batch, with the state that load_state gives and save keeps."""

    def step(batch: DataFrame, epoch: int) -> None:
        index, state = load_state()
        save(run_incremental(batch.sparkSession, batch, None, index, state, config), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental linkage: rows of a stream are joined with an indexed table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from pairsmith.operators import blocking
from pairsmith.plans.rules import Rule


def link_stream(stream: DataFrame, base: DataFrame, rules: list[Rule], path: str, checkpoint: str, key: str = "_id") -> DataStreamWriter:
    """A writer that appends to ``path``, for each micro-batch of new rows, the candidates (ltable_id of base, rtable_id of
    the batch, n_rules, batch_id) of the rules. A batch that is run again replaces what it wrote."""

    def link(batch: DataFrame, batch_id: int) -> None:
        blocking.block(rules, base, batch, key).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint)

"""Change feeds: streams of rows into relations, and committed changes out of them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrel.plans import ast as A
from spindrel.sources.catalog import Writer


def follow(session: Any, stream: DataFrame, relation: str, checkpoint: str, op: str = "put") -> StreamingQuery:
    """Apply each micro-batch of a streaming DataFrame to a relation (put or rm, by key).

    A batch that is repeated after a failure changes nothing more, as both are keyed.
    Triggers and callbacks of the relation run once per batch.
    """
    if op not in ("put", "rm"):
        raise ValueError("a feed puts or removes")

    def apply(batch: DataFrame, _: int) -> None:
        with session.transaction():
            change = Writer(session.catalog, A.Store(op, relation, None), batch).run()
            session._pending.append(change)
            session.trigger(change)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def publish(session: Any, relation: str, folder: str) -> int:
    """Append every committed change of a relation to a folder that others can stream from.

    Returns the callback's number.  A row of the feed has the operation, ``new`` or
    ``old`` as the side, and the relation's columns.
    """

    def write(op: str, new: DataFrame, old: DataFrame) -> None:
        both = new.select(F.lit(op).alias("_op"), F.lit("new").alias("_side"), "*").unionByName(
            old.select(F.lit(op).alias("_op"), F.lit("old").alias("_side"), "*"), allowMissingColumns=True
        )
        both.write.mode("append").parquet(folder)

    return session.register_callback(relation, write)

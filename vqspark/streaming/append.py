"""Codes that arrive in a stream are appended to a delta table below its root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vqspark.operators.codebook import Codebook
from vqspark.operators.encode import encode
from vqspark.operators.update import as_root_children


def append_vectors(stream: DataFrame, book: Codebook, delta_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Encodes the vectors of a stream and appends them to the Parquet delta table at ``delta_path``.

    A batch that runs again after a failure adds no id a second time.
    """

    def add(batch: DataFrame, _: int) -> None:
        delta = batch.sparkSession.read.parquet(delta_path)
        fresh = encode(batch, book).join(delta.select("vec_id"), "vec_id", "left_anti")
        rows = as_root_children(fresh, delta)
        rows.select(*(F.col(f.name).cast(f.dataType) for f in delta.schema)).write.mode("append").parquet(delta_path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

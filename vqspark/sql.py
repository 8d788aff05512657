"""Functions for SQL: registered under names that start with ``vq_``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vqspark.operators import blocks as B


@udtf(returnType="pos int, vec_id long, code array<int>")
class DecodeBlock:
    """The codes of one packed tree: ``vq_decode_block(payload, format, vec_ids, m)``."""

    def eval(self, payload, form: str, vec_ids, m: int):
        code = B.unpack_tree(bytes(payload), form, len(vec_ids), m)[0]
        for pos, (vec_id, own) in enumerate(zip(vec_ids, code.tolist())):
            yield pos, vec_id, own


def register(spark: SparkSession) -> None:
    """Temporary SQL functions on vectors and codes, and the table function that decodes blocks."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vq_quantize(v ARRAY<DOUBLE>) RETURNS ARRAY<BIGINT> RETURN transform(v, x -> CAST(floor((x + 1) * 127.5) AS BIGINT))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vq_squared_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vq_hamming(a ARRAY<INT>, b ARRAY<INT>) RETURNS INT RETURN size(filter(zip_with(a, b, (x, y) -> x <> y), x -> x))")
    spark.udtf.register("vq_decode_block", DecodeBlock)

"""What plain SQL gets: table functions and scalar functions under names of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .patterns import checked
from .scalar import SLOT_HIGH, SLOT_LOW, SLOT_PRIME


@udtf(returnType="pos long")
class FindAll:
    """find_all(data, pattern): the byte positions at which pattern occurs, overlapping ones included."""

    def eval(self, data, pattern):
        if data is None or pattern is None:
            return
        raw = data.encode() if isinstance(data, str) else bytes(data)
        needle = checked(pattern)
        at = raw.find(needle)
        while at >= 0:
            yield (at,)
            at = raw.find(needle, at + 1)


def _half(first: int) -> str:
    """Four bytes of w as a little-endian number."""
    return "(" + " + ".join(f"coalesce(CAST(conv(hex(substring(w, {first + k}, 1)), 16, 10) AS BIGINT), 0L) * {1 << 8 * k}L" for k in range(4)) + ")"


def register(spark: SparkSession) -> None:
    """find_all, and the bucket and size functions as SQL functions."""
    spark.udtf.register("find_all", FindAll)
    for name, args, body in (
        ("log2_bucket", "v BIGINT", "least(24, length(bin(greatest(v, 1L))) - 1)"),
        ("ratio_bucket", "c BIGINT, u BIGINT", "CASE WHEN u <= 0 OR c * 100 div u >= 100 THEN 10 ELSE c * 100 div u div 10 END"),
        ("window_slot", "w BINARY, base INT", f"({_half(1)} * {SLOT_LOW} + {_half(5)} * {SLOT_HIGH} + length(w)) % {SLOT_PRIME} % shiftleft(1L, base)"),
        ("reduced_slot", "slot BIGINT, base INT, reductions INT", "slot & (shiftleft(1L, base - reductions) - 1)"),
    ):
        kind = "INT" if name.endswith("bucket") else "BIGINT"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

"""Helpers on columns and tables: names as they are, joins that a hot key cannot hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table up to which it is broadcast; it is measured first.
BROADCAST_BYTES = 16 << 20
#: Copies of each row of a larger table, over which the rows of a hot key are dealt.
SALTS = 32


def named(name: str) -> Column:
    """The column of exactly this name, whatever dots or backticks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df measures at most so many bytes (as JSON, which is no less than its rows hold)."""
    return (df.select(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0) <= most


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with a table that has each key once (null is a key, too): broadcast if it measures small, else over salted keys, so that rows of a hot key go to many tasks."""
    if small(table, most):
        right, salt = F.broadcast(table), None
    else:
        salt = F.pmod(F.xxhash64(*[F.col(f"r.`{c}`") for c in rows.columns]), F.lit(SALTS)) == F.col("t.__salt")
        right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in on]
    joined = rows.alias("r").join(right.alias("t"), [*same, salt] if salt is not None else same, how)
    return joined.select("r.*", *[F.col(f"t.`{c}`") for c in table.columns if c not in on])

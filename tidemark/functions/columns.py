"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def moment(text: str) -> Column:
    """A timestamp without zone (UTC) from its text."""
    return F.expr(f"timestamp_ntz'{text}'")


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def blank_to_null(c: Column | str) -> Column:
    """The empty string counts as absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit_similarity(a: Column, b: Column) -> Column:
    """(1 + cos) / 2; 0 where lengths differ or a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), (1 + dot(a, b) / F.nullif(scale, F.lit(0.0))) / 2).otherwise(0.0)


def fenced(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def braced(c: Column) -> Column:
    """From the first { to the last }; empty where there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def tokens(c: Column) -> Column:
    """The estimate of tokens: none for nothing, else a quarter of the characters, one at least."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last by ``order``; one shuffle, no group is collected."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[o for o in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

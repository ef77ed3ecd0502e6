"""Table contracts: required columns, uniqueness, checked joins, conservation, disjointness.

Each check is one small aggregate; nothing but a count or one offending key
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a rule that the engine relies on."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_pair(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """The first pair of column aliases that the table has."""
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            return a, b
    raise ContractError(f"none of the column pairs {list(pairs)} is there")


def strict_double(name: str) -> Column:
    """The column as a finite double; anything else raises when it is read."""
    d = F.col(name).try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast(`{name}` as double)")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} is not a finite number: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))).otherwise(d)


def lenient_long(name: str) -> Column:
    """Numbers as long, anything else 0."""
    return F.coalesce(F.expr(f"try_cast(try_cast(`{name}` as double) as bigint)"), F.lit(0).cast("long"))


def lenient_bool(name: str) -> Column:
    text = F.lower(F.trim(F.col(name).cast("string")))
    return F.coalesce(text.isin("true", "t", "1", "1.0", "yes", "y"), F.lit(False))


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1).collect()
    if twice:
        raise ContractError(f"{what} has a duplicate key {twice[0].asDict()}")
    return df


def assert_non_null(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    bad = df.filter(" or ".join(f"`{n}` is null" for n in names)).limit(1).collect()
    if bad:
        raise ContractError(f"{what} has nulls: {bad[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose cardinality is checked first: one_to_one, one_to_many, many_to_one or many_to_many."""
    one_left, one_right = validate.split("_to_")
    if one_left == "one":
        assert_unique(left, on, "left side")
    if one_right == "one":
        assert_unique(right, on, "right side")
    return left.join(right, list(on), how)


def outer_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with ``merge``: both, left_only or right_only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, list(on), "full_outer").withColumn("merge", side).drop("_l", "_r")


def assert_conserved(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> None:
    """Sums of ``value`` by ``keys`` agree."""
    a = before.groupBy(*keys).agg(F.sum(value).alias("_a"))
    b = after.groupBy(*keys).agg(F.sum(value).alias("_b"))
    bad = a.join(b, list(keys), "full_outer").filter(F.abs(F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))) > tolerance).limit(1).collect()
    if bad:
        raise ContractError(f"not conserved: {bad[0].asDict()}")


def assert_disjoint(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    both = a.select(*keys).join(b.select(*keys), list(keys), "left_semi").limit(1).collect()
    if both:
        raise ContractError(f"not disjoint: {both[0].asDict()}")


def assert_same_keys(tables: Sequence[DataFrame], key: str) -> None:
    first = tables[0].select(key).distinct()
    for t in tables[1:]:
        other = t.select(key).distinct()
        if first.exceptAll(other).limit(1).count() or other.exceptAll(first).limit(1).count():
            raise ContractError(f"tables differ in {key}")


def from_composition(df: DataFrame, bin: str, cell: str, share: str, tolerance: float = 1e-4) -> DataFrame:
    """(bin, cell): the cell with the largest share of each bin, the least of equals; shares of a bin that do not sum to 1 raise."""
    g = df.groupBy(bin).agg(F.sum(share).alias("_t"), F.max_by(cell, F.struct(F.col(share), -F.col(cell))).alias(cell))
    wrong = F.raise_error(F.concat(F.lit("shares do not sum to 1 in bin "), F.col(bin).cast("string"))).cast(df.schema[cell].dataType)
    return g.select(bin, F.when(F.abs(F.col("_t") - 1) <= tolerance, F.col(cell)).otherwise(wrong).alias(cell))

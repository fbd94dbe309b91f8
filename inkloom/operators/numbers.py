"""Digit tests and checksums on number columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_digits(rows: DataFrame, column: str, group: str) -> DataFrame:
    """group, n, chi_square of the first digits' shares against Benford's law (on shares, so at most about 20)."""
    digit = F.regexp_extract(F.format_string("%.6f", F.abs(F.col(column).cast("double"))), "[1-9]", 0)
    d = rows.select(group, digit.alias("d")).where("d <> ''").groupBy(group, "d").agg(F.count("*").alias("c"))
    wide = d.groupBy(group).agg(F.sum("c").alias("n"), *[F.coalesce(F.sum(F.when(F.col("d") == str(k), F.col("c"))), F.lit(0)).alias(f"d{k}") for k in range(1, 10)])
    chi = sum(((F.col(f"d{k}") / F.col("n") - F.log10(F.lit(1 + 1 / k))) ** 2 / F.log10(F.lit(1 + 1 / k)) for k in range(1, 10)), F.lit(0.0))
    return wide.select(group, "n", F.round(chi, 6).alias("chi_square"))


def last_digits(rows: DataFrame, column: str, group: str) -> DataFrame:
    """group, n, chi_square of the last cents digit's shares against equal ones, share of 0 and 5."""
    digit = F.pmod(F.round(F.col(column).cast("double") * 100).cast("long"), F.lit(10))
    d = rows.select(group, digit.alias("d")).groupBy(group)
    wide = d.agg(F.count("*").alias("n"), *[F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(10)])
    chi = sum(((F.col(f"d{k}") / F.col("n") - 0.1) ** 2 / 0.1 for k in range(10)), F.lit(0.0))
    return wide.select(group, "n", F.round(chi, 6).alias("chi_square"), F.round((F.col("d0") + F.col("d5")) / F.col("n"), 6).alias("round_share"))


def mod11_check(digits: Column) -> Column:
    """ISO 7064 MOD 11-2 check character of a string of digits."""
    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(places, F.lit(0).cast("long"), lambda t, i: (t + F.substring(digits, i, F.lit(1)).cast("long")) * 2 % 11)
    rest = (12 - total) % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))

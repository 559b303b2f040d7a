"""Detection in Catalyst alone: matches with code-point offsets, and validators.

For pattern detectors whose filters are expressible; the kernel of
``operators.engine`` is the exact form of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_OCTET = r"\d{1,3}"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def matches(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, cstart, cend, match, before, after): leftmost matches of a pattern that is never empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = df.filter(F.col(text).rlike(pattern)).select(*keys, t.alias("__t"), F.split(t, pattern, -1).alias("__p"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("__m"))
    ends = F.aggregate(
        F.sequence(F.lit(0), F.size("__m") - 1), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,m:string>>)").alias("out")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.col("__p")[i]) + F.length(F.col("__m")[i])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + F.length(F.col("__p")[i])).alias("s"), F.col("__m")[i].alias("m"))).alias("out"),
        ),
    )["out"]
    flat = cut.select(*keys, "__t", F.inline(ends).alias("cstart", "match")).withColumn("cend", F.col("cstart") + F.length("match"))
    before = F.when(F.col("cstart") > 0, F.substring(F.col("__t"), F.col("cstart"), F.lit(1))).otherwise(F.lit(""))
    return flat.select(*keys, "cstart", "cend", "match", before.alias("before"), F.substring(F.col("__t"), F.col("cend") + 1, F.lit(1)).alias("after"))


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    d = only_digits(x)
    return (F.length(d) >= 13) & F.luhn_check(d)


def weighted(d: Column, weights: list[int]) -> Column:
    """Sum of a string's digits times weights."""
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.substring(d, i, 1).cast("int") * w
    return total


def bsn(d: Column) -> Column:
    return weighted(d, [*range(9, 1, -1), -1]) % 11 == 0


def ipv4(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """IPv4 findings without a kernel."""
    octet = F.split("match", r"\.")
    sound = F.forall(octet, lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))
    edge = "^[A-Za-z0-9_.:%-]$"
    return matches(df, keys, text, IPV4).filter(sound & ~F.col("before").rlike(edge) & ~F.col("after").rlike(edge)).drop("before", "after")

"""Distinct counts from mergeable bitmaps (linear counting, Whang et al. 1990)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_error(most: float, bits: int) -> float:
    """Standard error, relative, of the estimate of ``most`` distinct items in a bitmap of ``bits``."""
    t = most / bits
    return math.sqrt(max(0.0, math.exp(min(t, 500.0)) - t - 1)) / (t * math.sqrt(bits)) if most else 0.0


def bits_for(error: float, most: int) -> int:
    """Smallest power of two of at least 64 bits whose standard error for up to ``most`` items is ``error`` at most."""
    bits = 64
    while relative_error(most, bits) > error or bits * 8 < most:
        bits *= 2
    return bits


def hashed(item: Column) -> Column:
    """The first 60 bits of the MD5 of an item's text, as any engine can make them; NULL for NULL."""
    return F.conv(F.substring(F.md5(item.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def partial_bitmaps(rows: DataFrame, groups: Sequence[str], item: str, bits: int) -> DataFrame:
    """The bitmap of every group, as the 64-bit words that have a bit set: ``word``, ``bits`` and the rows ``n``.

    A bitmap has the same fixed length in every group and load, so partial
    results of any parts join by :func:`merge_bitmaps`; words without a bit
    aren't stored, so a small group costs no more than its items. A hot
    group's rows are spread over its words. Rows without an item set no bit
    and are counted under the NULL word.
    """
    known = F.pmod(hashed(F.col(item)), F.lit(bits))
    placed = rows.select(*groups, F.shiftright(known, 6).alias("word"), F.when(known.isNotNull(), _one_bit(known)).alias("__bit"))
    return placed.groupBy(*groups, "word").agg(F.bit_or("__bit").alias("bits"), F.count("*").alias("n"))


def merge_bitmaps(words: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Union of the bitmaps of coarser ``groups``."""
    return words.groupBy(*groups, "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def merge_sets(words: DataFrame, sets: Sequence[Sequence[str]], groups: Sequence[str], level: str = "level") -> DataFrame:
    """Unions for several sets of grouping columns at once; ``level`` has the names of the set, columns outside it are NULL."""
    keyed = F.array(*[F.struct(F.lit("+".join(s) or "all").alias(level), *[(F.col(g) if g in s else F.lit(None).cast(dict(words.dtypes)[g])).alias(g) for g in groups]) for s in sets])
    long = words.select(F.explode(keyed).alias("__k"), "word", "bits", "n").select("__k.*", "word", "bits", "n")
    return merge_bitmaps(long, [level, *groups])


def estimates(words: DataFrame, groups: Sequence[str], bits: int) -> DataFrame:
    """``n_rows``, ``n_distinct`` estimated from the share of empty bits, and ``error``, its relative standard error.

    A full bitmap can't tell how many items it saw: its estimate is that for
    one empty bit, and its error is NULL.
    """
    summed = words.groupBy(*groups).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("__set"))
    full = F.col("__set") >= bits
    guess = -bits * F.log(F.greatest(F.lit(bits) - F.col("__set"), F.lit(1)) / F.lit(float(bits)))
    t = guess / bits
    error = F.when(~full & (guess > 0), F.sqrt(F.greatest(F.exp(t) - t - 1, F.lit(0.0))) / (t * math.sqrt(bits)))
    return summed.select(*groups, "n_rows", "__set", guess.alias("n_distinct"), error.alias("error")).withColumnRenamed("__set", "bits_set")


def most_items(bits: int, deviations: float = 8.0, few: float = 3.0) -> Column:
    """Upper bound of the items of a row of :func:`estimates`; its ``bits_set`` is a lower bound that always holds.

    The estimate, 8 standard errors and 3 items more: for few items, whose
    lost bits are a Poisson number far below 1, the 3 are what counts. Either
    way it is exceeded with a chance below 1e-12. For a full bitmap only the
    rows bound the items.
    """
    high = F.col("n_distinct") * (1 + deviations * F.coalesce("error", F.lit(0.0))) + few
    return F.when(F.col("bits_set") >= bits, F.col("n_rows").cast("double")).otherwise(F.least(high, F.col("n_rows").cast("double")))


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))

"""Column-level data quality: exact profiles from column-value counts, and comparisons of loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from sedimenta.session import cut_lineage

#: Bin edges of :func:`load_drift` for numbers: 0 and a 1-2-5 series. Fixed values.
EDGES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 100000.0, 1000000.0)
#: Shares at or below p10, p50 and p90 by definition. Fixed values.
QUANTILES = (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))


@dataclass(frozen=True)
class Baseline:
    """What a column usually looks like; None where it has no such thing."""

    column: str
    null_share: float | None = None
    low: float | None = None
    high: float | None = None
    p10: float | None = None
    p50: float | None = None
    p90: float | None = None
    pattern: str | None = None


def read_baselines(df: DataFrame) -> list[Baseline]:
    """Baselines of a table with one row per profiled column; NaN in it means none."""

    def number(x: float | None) -> float | None:
        return None if x is None or x != x else float(x)

    return [Baseline(r["column_name"], *(number(r[k]) for k in ("null_share", "min_value", "max_value", "p10", "p50", "p90")), r["pattern"]) for r in df.collect()]


def value_counts(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``column_name``, value and ``n`` per group: the table unpivoted and counted.

    A value is in ``num`` (numbers, times as seconds, booleans) or in ``txt``;
    both are NULL for a missing value, NULL or NaN. Numbers are doubles, exact
    up to 2**53. Columns that the table doesn't have are skipped; other columns
    aren't read. The counts are partial before the shuffle, and a group is
    spread over its columns and values.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nums, txts = [], []
    for c in (c for c in columns if c in kinds):
        if isinstance(kinds[c], NumericType):
            num = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            nums.append((c, F.when(num == 0, F.lit(0.0)).otherwise(num)))
        elif isinstance(kinds[c], BooleanType):
            nums.append((c, F.col(c).cast("int").cast("double")))
        elif isinstance(kinds[c], (TimestampType, TimestampNTZType, DateType)):
            nums.append((c, F.col(c).cast("timestamp").cast("double")))
        else:
            txts.append((c, F.col(c) if isinstance(kinds[c], StringType) else F.to_json(F.struct(F.col(c)))))

    def counted(of: list[tuple[str, Column]]) -> DataFrame:
        # columns by number, so that numbers are counted under keys of fixed width
        parts = [x for i, (_, value) in enumerate(of) for x in (F.lit(i + 1), value)]
        long = df.select(group, F.stack(F.lit(len(of)), *parts).alias("__c", "__v"))
        name = F.element_at(F.array(*[F.lit(c) for c, _ in of]), F.col("__c")).alias("column_name")
        return long.groupBy(group, "__c", "__v").agg(F.count("*").alias("n")).select(group, name, "__v", "n")

    made = []
    if nums:
        made.append(counted(nums).select(group, "column_name", F.col("__v").alias("num"), F.lit(None).cast("string").alias("txt"), "n"))
    if txts:
        made.append(counted(txts).select(group, "column_name", F.lit(None).cast("double").alias("num"), F.col("__v").alias("txt"), "n"))
    if not made:
        raise ValueError("the table has none of the columns")
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def profile(counts: DataFrame, group: str, baselines: list[Baseline]) -> DataFrame:
    """Exact figures per group and column, from :func:`value_counts`.

    ``n_rows``, ``n_missing``, ``n_values``, ``n_distinct``, ``min_value`` and
    ``max_value`` (numbers), ``min_text`` and ``max_text``, ``n_off_pattern``,
    ``n_out_of_range`` and ``n_le_p10``, ``n_le_p50``, ``n_le_p90`` against the
    column's baseline, NULL where it has none. A pattern must match the whole
    text. Patterns are tried once per distinct value.
    """
    there = F.col("num").isNotNull() | F.col("txt").isNotNull()
    named = F.col("column_name")

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    def by_column(of: dict[str, Column]) -> Column:
        out = F.lit(None).cast("boolean")
        for c, condition in of.items():
            out = F.when(named == c, F.coalesce(condition, F.lit(False))).otherwise(out)
        return out

    off = by_column({b.column: ~F.col("txt").rlike(rf"\A(?:{b.pattern})\z") for b in baselines if b.pattern is not None})
    ranges = {}
    for b in baselines:
        if b.low is not None or b.high is not None:
            below = F.col("num") < b.low if b.low is not None else F.lit(False)
            ranges[b.column] = below | (F.col("num") > b.high) if b.high is not None else below
    marks = {q: by_column({b.column: F.col("num") <= getattr(b, q) for b in baselines if getattr(b, q) is not None}) for q, _ in QUANTILES}
    return counts.groupBy(group, "column_name").agg(
        F.sum("n").alias("n_rows"),
        counted(~there).alias("n_missing"),
        counted(there).alias("n_values"),
        F.sum(F.when(there, 1).otherwise(0)).cast("long").alias("n_distinct"),
        F.min("num").alias("min_value"),
        F.max("num").alias("max_value"),
        F.min("txt").alias("min_text"),
        F.max("txt").alias("max_text"),
        F.sum(F.when(off.isNotNull(), F.when(off, F.col("n")).otherwise(0))).alias("n_off_pattern"),
        F.sum(F.when((r := by_column(ranges)).isNotNull(), F.when(r, F.col("n")).otherwise(0))).alias("n_out_of_range"),
        *[F.sum(F.when(m.isNotNull(), F.when(m, F.col("n")).otherwise(0))).alias(f"n_le_{q}") for q, m in marks.items()],
    )


def findings(profiles: DataFrame, group: str, baselines: list[Baseline], null_off: float, drift_off: float, least_constant: int = 10) -> DataFrame:
    """One row for each group, baseline column and finding.

    ``null_share``: missing share off by more than ``null_off``; ``constant``:
    ``least_constant`` or more values, all equal; ``pattern``; ``out_of_range``;
    ``drift``: the share of values at or below a baseline quantile off by more
    than ``drift_off``. A column without values has no drift.
    """

    def of(field: str) -> Column:
        out = F.lit(None).cast("double")
        for b in baselines:
            if getattr(b, field) is not None:
                out = F.when(F.col("column_name") == b.column, F.lit(getattr(b, field))).otherwise(out)
        return out

    off = F.abs(F.try_divide(F.col("n_missing"), F.col("n_rows")) - of("null_share")) > null_off
    drifts = [F.abs(F.try_divide(F.col(f"n_le_{q}"), F.col("n_values")) - F.lit(at)) > drift_off for q, at in QUANTILES]
    drift = F.coalesce(drifts[0], F.lit(False)) | F.coalesce(drifts[1], F.lit(False)) | F.coalesce(drifts[2], F.lit(False))
    tests = {
        "null_share": off,
        "constant": (F.col("n_values") >= least_constant) & (F.col("n_distinct") == 1),
        "pattern": F.col("n_off_pattern") > 0,
        "out_of_range": F.col("n_out_of_range") > 0,
        "drift": drift,
    }
    known = profiles.where(F.col("column_name").isin([b.column for b in baselines]))
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return known.select(group, "column_name", F.explode(named).alias("finding"))


def baseline_drift(profiles: DataFrame, group: str, floor: float = 1e-6) -> DataFrame:
    """Population stability index of each group and column against the shares .1, .4, .4, .1 of its baseline's quantile bins."""
    below = [F.col(f"n_le_{q}") for q, _ in QUANTILES]
    seen = [below[0], below[1] - below[0], below[2] - below[1], F.col("n_values") - below[2]]
    index = F.lit(0.0)
    for n, usual in zip(seen, (0.1, 0.4, 0.4, 0.1)):
        share = F.greatest(F.try_divide(n, F.col("n_values")), F.lit(floor))
        index = index + (share - usual) * F.log(share / usual)
    return profiles.where(below[0].isNotNull() & (F.col("n_values") > 0)).select(group, "column_name", index.alias("psi_baseline"))


def load_drift(counts: DataFrame, group: str, floor: float = 1e-6, every_group: bool = False) -> DataFrame:
    """Stability index and chi-square of each group's columns against the group before.

    Bins: a number's place in ``EDGES``, a text itself; missing values are left
    out. Bins are counted before groups are compared, one shuffle per column
    and bin; no bin of either side is dropped. Chi-square takes the shares of
    the group before as expected, floored like those of the index.

    Groups in which a column has no value are passed over, so the next one is
    compared with the one before that. With ``every_group`` they aren't: all
    shares of a side without values are the floor, and two such sides have no
    bins and indices of 0. ``prev``, ``all`` and ``prev_all`` are the group
    before and the values of both.
    """
    has = F.col("num").isNotNull() | F.col("txt").isNotNull()
    place = F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: e <= F.col("num")))
    bin_of = F.when(F.col("num").isNotNull(), F.concat(F.lit("#"), place.cast("string"))).otherwise(F.concat(F.lit("="), F.col("txt")))
    bins = (counts if every_group else counts.where(has)).groupBy(group, "column_name", bin_of.alias("bin")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy("column_name").orderBy(group)  # one row per group and column: as many as there are loads
    if every_group:
        bins = cut_lineage(bins)  # with one of NULL for missing values; written, as each of its uses would count the rows again
        totals = bins.groupBy(group, "column_name").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0)).alias("all"))
        bins = bins.where(F.col("bin").isNotNull())
    else:
        totals = bins.groupBy(group, "column_name").agg(F.sum("n").alias("all"))
    totals = totals.withColumn("prev", F.lag(group).over(order)).withColumn("prev_all", F.lag("all").over(order))
    pairs = totals.where(F.col("prev").isNotNull())
    now = bins.join(pairs, [group, "column_name"]).select(group, "column_name", "bin", "n", F.lit(0).cast("long").alias("was"))
    was = bins.select(F.col(group).alias("prev"), "column_name", "bin", "n").join(pairs.select(group, "column_name", "prev"), ["prev", "column_name"])
    was = was.select(group, "column_name", "bin", F.lit(0).cast("long").alias("n"), F.col("n").alias("was"))
    both = now.unionByName(was).groupBy(group, "column_name", "bin").agg(F.sum("n").alias("n"), F.sum("was").alias("was")).join(pairs, [group, "column_name"], "right")
    share = lambda n, of: F.greatest(F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0)), F.lit(floor))
    a, e = share("n", "all"), share("was", "prev_all")
    chi = (a - e) * (a - e) / e * F.col("all")
    return both.groupBy(group, "column_name", "prev", "all", "prev_all").agg(F.count("bin").alias("n_bins"), F.sum((a - e) * F.log(a / e)).alias("psi_before"), F.sum(chi).alias("chi2_before"))

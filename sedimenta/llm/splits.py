"""Splits in given proportions that keep groups of records together."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sedimenta.operators.skew import skew_join

#: Widest target, in common parts of the sizes, that one bitset takes; and the cells of the coarser search beyond it.
MOST_BITS, CELLS = 1 << 22, 1 << 20


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that the total is as near ``target`` as a subset can be.

    ``sizes`` has multiplicities. All is counted in the sizes' greatest common
    divisor. A target of up to ``MOST_BITS`` such parts is met by a subset-sum
    bitset, exactly. A wider one is searched with one total kept in each of
    ``CELLS`` cells up to twice the target: exact until two totals fall into
    one cell, and then off by a cell for each different size used at most. If
    that misses, single groups are exchanged as long as it comes nearer, and
    the smallest groups, kept back for it, fill by a bitset what is left; the
    nearer of both results is taken.
    """
    left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    if not left or target <= 0:
        return {}
    part = math.gcd(*left)
    left, goal = {s // part: n for s, n in left.items()}, target / part
    total = lambda taken: sum(s * k for s, k in taken.items())
    if goal <= MOST_BITS:
        taken = _by_bitset(left, goal)
    else:
        taken = _by_cells(left, goal)
        if total(taken) != goal:
            small, room = {}, MOST_BITS
            for s in sorted(left):
                small[s] = min(left[s], room // s)
                room -= small[s] * s
            large = {s: n - small[s] for s, n in left.items()}
            middle = goal - total(small) / 2
            other = _exchange(large, _by_cells(large, middle), middle)
            rest = _by_bitset(small, goal - total(other))
            other = {s: other.get(s, 0) + rest.get(s, 0) for s in left}
            taken = min(taken, other, key=lambda t: abs(total(t) - goal))
    return {s * part: k for s, k in taken.items() if k}


def _chunks(sizes: dict[int, int], most: float, largest_first: bool = False) -> list[tuple[int, int]]:
    """(size, groups of it to take or leave together): multiplicities in powers of two."""
    out = []
    for size in sorted(sizes, reverse=largest_first):
        n, chunk = min(sizes[size], int(most // size)), 1
        while n > 0:
            out.append((size, min(chunk, n)))
            n, chunk = n - chunk, chunk * 2
    return out


def _by_bitset(sizes: dict[int, int], target: float) -> dict[int, int]:
    """Exact: a bit of one integer for each total, and of each total the step that reached it first."""
    if target <= 0:
        return {}
    goal = int(target)
    width = 2 * goal + 2
    steps, reach, mask = _chunks(sizes, width), 1, (1 << width) - 1
    first = np.zeros(-(-width // 8) * 8, dtype=np.int32)
    for i, (size, k) in enumerate(steps):
        if reach >> goal & 1 and goal == target:
            break
        fresh = (reach << (size * k)) & mask & ~reach
        if fresh:
            reach |= fresh
            data = np.frombuffer(fresh.to_bytes(len(first) // 8, "little"), dtype=np.uint8)
            full = np.flatnonzero(data)
            byte, bit = np.nonzero(np.unpackbits(data[full][:, None], axis=1, bitorder="little"))
            first[full[byte] * 8 + bit] = i
    low = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    high = goal + (above & -above).bit_length() if above else None
    return _walk(steps, high if high is not None and high - target < target - low else low, lambda total: first[total])


def _by_cells(sizes: dict[int, int], target: float) -> dict[int, int]:
    """The nearest of the totals reached; the first one in each cell is kept."""
    width = 2 * int(target) + 2
    cell = -(-width // CELLS)
    steps = _chunks(sizes, width, largest_first=True)
    totals, first = np.full(-(-width // cell), -1, dtype=np.int64), np.zeros(-(-width // cell), dtype=np.int32)
    totals[0] = 0
    kept = totals[:1]
    for i, (size, k) in enumerate(steps):
        if (kept == target).any():
            break
        fresh = kept + size * k
        fresh = fresh[fresh < width]
        cells, at = np.unique(fresh // cell, return_index=True)
        empty = totals[cells] < 0
        if empty.any():
            totals[cells[empty]], first[cells[empty]] = fresh[at[empty]], i
            kept = totals[totals >= 0]
    return _walk(steps, int(kept[np.argmin(np.abs(kept - target))]), lambda total: first[total // cell])


def _exchange(sizes: dict[int, int], taken: dict[int, int], target: float, most: int = 100) -> dict[int, int]:
    """Takes one group, leaves one, or both, as long as the total comes nearer to ``target``."""
    taken = dict(taken)
    for _ in range(most):
        short = target - sum(s * k for s, k in taken.items())
        free = np.array([0, *sorted(s for s, n in sizes.items() if n > taken.get(s, 0))])
        held = np.array([0, *(s for s, k in taken.items() if k)])
        at = np.searchsorted(free, held + short)
        pairs = [(abs(float(f) - h - short), int(f), int(h)) for i in (at - 1, at) for f, h in zip(free[np.clip(i, 0, len(free) - 1)], held)]
        off, more, less = min(pairs)
        if off >= abs(short):
            break
        taken[more], taken[less] = taken.get(more, 0) + 1, taken.get(less, 0) - (more != less)
    return {s: k for s, k in taken.items() if s and k > 0}


def _walk(steps: list[tuple[int, int]], total: int, reached_by) -> dict[int, int]:  # noqa: ANN001
    """Back from a total: the step that first reached it was taken from a total reached earlier."""
    taken: dict[int, int] = {}
    while total:
        size, k = steps[reached_by(total)]
        taken[size] = taken.get(size, 0) + k
        total -= size * k
    return taken


def plan_splits(sizes: dict[int, int], shares: Sequence[float]) -> dict[int, list[int]]:
    """For each size, how many of its groups each split gets.

    Each split first takes its share of every size, rounded down; what its
    total then lacks is made up by :func:`closest_subset` of the groups left
    over. The largest split goes last and takes the rest.
    """
    everything = sum(s * n for s, n in sizes.items())
    plan = {s: [0] * len(shares) for s in sizes}
    scale = sum(shares) or 1.0
    order = sorted(range(len(shares)), key=lambda i: (shares[i], i))
    left = dict(sizes)
    for i in order[:-1]:
        for s, n in sizes.items():
            plan[s][i] = int(n * shares[i] / scale)
            left[s] -= plan[s][i]
    for i in order[:-1]:
        short = round(everything * shares[i] / scale) - sum(s * plan[s][i] for s in plan)
        for s, k in closest_subset(left, short).items():
            plan[s][i] += k
            left[s] -= k
    for s, n in left.items():
        plan[s][order[-1]] = n
    return plan


def assign_groups(groups: DataFrame, group: str, size: str, shares: Sequence[tuple[str, float]], bucket_rows: int = 100_000) -> DataFrame:
    """``group`` and ``split_name``: the groups of each size dealt out as planned, in the order of a hash.

    The driver gets one number per distinct size. A group's place among those
    of its size is its bucket's offset and its place within the bucket, so no
    task sorts more than a bucket of about ``bucket_rows`` groups.
    """
    sizes = {int(r[0]): int(r[1]) for r in groups.groupBy(size).count().collect()}
    plan = plan_splits(sizes, [share for _, share in shares])
    buckets = max(16, -(-sum(sizes.values()) // bucket_rows))
    ends = [(s, [sum(counts[: i + 1]) for i in range(len(counts))]) for s, counts in plan.items()]
    schema = StructType([StructField(size, groups.schema[size].dataType), StructField("__ends", ArrayType(LongType()))])
    lookup = groups.sparkSession.createDataFrame(ends, schema)
    hashed = groups.select(group, size, F.xxhash64(group).alias("__h")).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    before = Window.partitionBy(size).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    offsets = hashed.groupBy(size, "__b").agg(F.count("*").alias("__n"))
    offsets = offsets.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(lookup, size).drop("__n")
    within = F.row_number().over(Window.partitionBy(size, "__b").orderBy("__h", group))
    placed = hashed.withColumn("__i", within).join(offsets, [size, "__b"])
    names = F.array(*[F.lit(name) for name, _ in shares])
    passed = F.size(F.filter("__ends", lambda e: e < F.col("__from") + F.col("__i")))
    return placed.select(group, F.element_at(names, passed + 1).alias("split_name"))


def split_records(records: DataFrame, record: str, group: str, shares: Sequence[tuple[str, float]], heavy_share: float = 0.005) -> DataFrame:
    """``records`` with ``split_name``; all records of a group get the same one.

    Every record has a group, its own if it stands alone. Groups that hold
    ``heavy_share`` of the records or more, at most 1 / ``heavy_share``, meet
    their records by broadcast; the others shuffle. Of equal shares the
    earlier named split is served first.
    """
    groups = records.groupBy(group).agg(F.count("*").alias("__size"))
    n = records.count()
    heavy = groups.where(F.col("__size") >= max(2, heavy_share * n)).select(group).limit(int(1 / heavy_share) + 1)
    local = records.sparkSession.createDataFrame(heavy.collect(), StructType([records.schema[group]]))
    return skew_join(records.select(record, group), assign_groups(groups, group, "__size", shares), [group], local)

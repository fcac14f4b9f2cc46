"""Totals over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import ship_package

#: Day cells of one dense piece; bounds a worker's memory.
CELLS = 1_000_000


def trailing(days: np.ndarray, width: int) -> np.ndarray:
    """Totals of the last ``width`` columns up to each column, rows apart.

    Columns are cut into blocks of ``width``. A window that ends at column i is
    the suffix of one block and the prefix of the next, or one whole block.
    """
    rows, n = days.shape
    blocks = -(-n // width)
    padded = np.zeros((rows, blocks * width), dtype=days.dtype)
    padded[:, :n] = days
    cut = padded.reshape(rows, blocks, width)
    prefix = np.cumsum(cut, axis=2).reshape(rows, -1)
    suffix = np.cumsum(cut[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    total = prefix[:, :n].copy()
    ends = np.arange(width, n)
    ends = ends[(ends + 1) % width != 0]
    total[:, ends] += suffix[:, ends - width + 1]
    return total


def rolling_totals(daily: DataFrame, entity: str, day: str, amount: str, widths: tuple[int, ...], last_day: int, keep: Callable[[np.ndarray, dict[int, np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """``t{w}`` for each entity and each day from its first day to ``last_day``.

    ``daily`` has one row per entity and day at most (long columns; see
    :func:`daily_totals`), so an entity has as many rows as there are days and
    none is too long for a task. ``keep(days, totals)`` may drop rows of the
    result where they arise. Days after ``last_day`` are left out; NULL amounts
    are 0; rows without entity or day are left out.
    """
    ship_package(daily.sparkSession)
    rows = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & (F.col(day) <= last_day))
    rows = rows.select(F.col(entity).cast("long").alias("e"), F.col(day).cast("long").alias("d"), F.coalesce(F.col(amount).cast("long"), F.lit(0).cast("long")).alias("a"))
    ordered = rows.repartition("e").sortWithinPartitions("e", "d")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = [np.empty(0, dtype=np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last entity may go on in the next batch
            held = [x[cut:] for x in now]
            if cut:
                yield tuple(x[:cut] for x in now)
        if len(held[0]):
            yield tuple(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, d, a in pieces(batches):
            starts = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            span = int(last_day - d[starts].min() + 1)
            step = max(1, CELLS // span)
            for at in range(0, len(starts), step):
                low = starts[at]
                high = starts[at + step] if at + step < len(starts) else len(e)
                yield from _dense(e[low:high], d[low:high], a[low:high])

    def _dense(e: np.ndarray, d: np.ndarray, a: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, e[1:] != e[:-1]]
        row, first = np.cumsum(new) - 1, d[new]
        base = int(first.min())
        cells = np.zeros((len(first), last_day - base + 1), dtype=np.int64)
        np.add.at(cells, (row, d - base), a)
        totals = {w: trailing(cells, w) for w in widths}
        days = np.arange(base, last_day + 1)
        mask = days[None, :] >= first[:, None]
        if keep is not None:
            mask &= keep(days[None, :], totals)
        r, c = np.nonzero(mask)
        for at in range(0, len(r), 100_000):
            i, j = r[at : at + 100_000], c[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(e[new][i]), pa.array(days[j]), *(pa.array(totals[w][i, j]) for w in widths)], names=[entity, day, *(f"t{w}" for w in widths)])

    return ordered.mapInArrow(run, f"`{entity}` long, `{day}` long, " + ", ".join(f"t{w} long" for w in widths))


def daily_totals(rows: DataFrame, entity: str, day: str, amount: str) -> DataFrame:
    """Total per entity and day; sums within the map side first, so a hot entity is a few rows per task."""
    return rows.groupBy(entity, day).agg(F.sum(amount).alias(amount))

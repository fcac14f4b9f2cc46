"""Mixing sources to target shares by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.sources.tables import bounded


@dataclass(frozen=True)
class Share:
    """One source's part of the mix; ``repeats`` is how often its documents occur on average."""

    source: str
    target: float
    most: int
    tokens: int
    short: bool
    planned: float
    repeats: float


def water_fill(targets: Sequence[tuple[str, float, int]], tokens: dict[str, int], size: float | None = None) -> list[Share]:
    """Plan for (source, target share, most repeats): tokens and repeats of each source.

    A source gets its share of ``size`` (the tokens of all sources named, if
    not given), but no more than its tokens ``most`` times. What the clamped
    sources leave is dealt to the others by their targets, until none is above
    its cap; if all are, the mix is smaller than ``size``. ``short`` sources
    can't reach their target even at the cap. A source without documents gets
    nothing. NULL caps or shares count as 0.
    """
    rows = [(s, float(w or 0), int(m or 0), int(tokens.get(s, 0))) for s, w, m in targets]
    everything = sum(n for *_, n in rows)
    rest = float(everything if size is None else size)
    total = rest
    planned: dict[str, float] = {}
    active = list(rows)
    while active:
        weight = sum(w for _, w, _, _ in active)
        over = [(s, m * n) for s, w, m, n in active if weight <= 0 or m * n < rest * w / weight]
        if not over:
            planned |= {s: rest * w / weight for s, w, _, _ in active}
            break
        planned |= {s: float(cap) if weight > 0 else 0.0 for s, cap in over}
        rest -= sum(planned[s] for s, _ in over)
        gone = {s for s, _ in over}
        active = [r for r in active if r[0] not in gone]
    return [Share(s, w, m, n, m * n < w * total, planned[s], min(float(m), planned[s] / n) if n else 0.0) for s, w, m, n in rows]


def sample_mix(counted: DataFrame, doc_id: str, source: str, plan: Sequence[Share], seed: int = 0) -> DataFrame:
    """Documents of the mix with ``repeats``, how often each occurs.

    Every document of a source occurs the whole part of its repeats; the
    fraction is a seeded draw per document by hash, the same each time and on
    any number of executors. No shuffle, unless there are more than 20,000 sources. Documents of other sources, and those
    that occur 0 times, have no row.
    """
    rows = [(p.source, int(p.repeats), p.repeats - int(p.repeats)) for p in plan]
    side = counted.sparkSession.createDataFrame(rows, f"`{source}` string, __whole int, __part double")
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    joined = counted.join(bounded(side), source).withColumn("repeats", F.col("__whole") + (draw < F.col("__part")).cast("int"))
    return joined.where("repeats > 0").drop("__whole", "__part")

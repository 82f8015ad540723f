"""Exact quantiles without sorting or shuffling whole columns.

For every requested rank a sketch (``percentile_approx``) names a narrow bracket of
values that must hold it.  A counting pass checks the bracket - how many values lie below
it and how many inside - and brackets that are still too full are narrowed again.  Only
the values inside the final brackets are grouped and ranked, so hot values collapse in the
partial aggregate and no task ever holds a whole column.  The check makes the answer exact
whatever the sketch did; a bracket that fails it is widened and tried again.

Quantiles interpolate linearly between the two nearest ranks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.columns import number

DIRECT_ROWS = 200_000      # below this the plain percentile aggregate holds few enough values
BRACKET_ROWS = 2_000_000   # a bracket with more values than this is narrowed again
SKETCH_ACCURACY = 20_000
MARGIN = 3.0 / SKETCH_ACCURACY


@dataclass
class _Target:
    name: str
    prob: float
    n: int
    low: float
    high: float
    below: int = 0
    inside: int = 0
    open: bool = False  # whether the bracket excludes its two ends
    margin: float = MARGIN
    found: dict[int, float] = field(default_factory=dict)

    @property
    def position(self) -> float:
        return (self.n - 1) * self.prob

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    @property
    def pending(self) -> list[int]:
        return sorted({r for r in self.ranks if r not in self.found})

    def value(self) -> float:
        a, b = (self.found[r] for r in self.ranks)
        if a == b:  # also equal infinities
            return a
        low, high = self.ranks  # weighted as the percentile aggregate does
        return (high - self.position) * a + (self.position - low) * b


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float],
                    known: dict[str, tuple] | None = None,
                    direct_rows: int | None = None,
                    bracket_rows: int | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of several double expressions; NULLs are ignored.

    The returned numbers are one per (expression, probability); everything larger stays in
    Spark.  ``known`` gives (count, min, max) per expression when an earlier pass has them.
    ``direct_rows`` is the checked size up to which the plain percentile aggregate is used.
    """
    if not values:
        return {}
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    bracket_rows = BRACKET_ROWS if bracket_rows is None else bracket_rows
    names = list(values)
    base = df.select(*[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    if known is None:
        row = base.agg(*[F.struct(F.count(f"v{i}"), F.min(f"v{i}"), F.max(f"v{i}"))
                         for i in range(len(names))]).first()
        known = {n: tuple(row[i]) for i, n in enumerate(names)}

    if max(known[n][0] for n in names) <= direct_rows:
        at = f"array({', '.join(number(p) for p in probs)})"
        got = base.selectExpr(*[f"percentile(v{i}, {at}) AS q{i}" for i in range(len(names))]).first()
        return {n: list(got[i]) if got[i] is not None else [None] * len(probs)
                for i, n in enumerate(names)}

    targets = [_Target(f"v{i}", p, *known[n], inside=known[n][0])
               for i, n in enumerate(names) for p in probs if known[n][0]]
    for t in targets:
        if t.low == t.high:
            t.found = {r: t.low for r in t.ranks}
    _narrow(base, targets, bracket_rows)
    _rank(base, targets)
    by_key = {(t.name, t.prob): t.value() for t in targets}
    return {n: [by_key.get((f"v{i}", p)) for p in probs] for i, n in enumerate(names)}


def _inside(t: _Target) -> str:
    low, high = number(t.low), number(t.high)
    return f"({t.name} > {low} AND {t.name} < {high})" if t.open else f"({t.name} BETWEEN {low} AND {high})"


def _guess(base: DataFrame, active: list[_Target]) -> list[tuple[float, float]]:
    """A bracket per target from the sketches; targets over the same values share one sketch."""
    sketches: dict[str, list[float]] = {}
    wanted = []
    for t in active:
        at = (sum(t.pending) / len(t.pending) - t.below) / max(t.inside - 1, 1)
        whole = t.below == 0 and t.inside == t.n
        source = t.name if whole else f"CASE WHEN {_inside(t)} THEN {t.name} END"
        probs = sketches.setdefault(source, [])
        ends = []
        for p in (at - t.margin, at + t.margin):
            ends.append(len(probs) if 0 < p < 1 else None)
            if 0 < p < 1:
                probs.append(p)
        wanted.append((source, ends))
    used = {source: k for k, source in enumerate(s for s, probs in sketches.items() if probs)}
    row = base.selectExpr(*[
        f"percentile_approx({source}, array({', '.join(map(number, sketches[source]))}), {SKETCH_ACCURACY}) AS k{k}"
        for source, k in used.items()]).first() if used else ()
    return [tuple(edge if at is None else row[used[source]][at] for edge, at in zip((t.low, t.high), ends))
            for t, (source, ends) in zip(active, wanted)]


def _narrow(base: DataFrame, targets: list[_Target], bracket_rows: int) -> None:
    """Narrow until every bracket holds few values: a miss widens it, a full one loses its ends and is cut anew."""
    active = [t for t in targets if t.pending and t.inside > min(bracket_rows, t.n // 50)]
    while active:
        trial = _guess(base, active)
        seen = base.selectExpr(*[e for k, t in enumerate(active) for e in (
            f"count_if({t.name} < {number(trial[k][0])}) AS b{k}",
            f"count_if({t.name} <= {number(trial[k][1])}) AS u{k}")]).first()
        missed, full = [], []
        for k, t in enumerate(active):
            below, upto = seen[f"b{k}"], seen[f"u{k}"]
            if below <= t.pending[0] and upto > t.pending[-1]:
                (t.low, t.high), t.below, t.inside, t.open = trial[k], below, upto - below, False
                if t.low == t.high:
                    t.found |= {r: t.low for r in t.pending}
                elif t.inside > bracket_rows:
                    t.margin = MARGIN
                    full.append(t)
            else:
                t.margin *= 4  # the sketch missed: try again wider, in the end with all values
                missed.append(t)
        _trim(base, full)
        active = missed + [t for t in full if t.pending and t.inside > bracket_rows]


def _trim(base: DataFrame, full: list[_Target]) -> None:
    """Settle ranks that fall on the ends of a bracket and take the ends out of it.

    A hot value at an end would otherwise keep a bracket full however often it is narrowed.
    """
    if not full:
        return
    seen = base.selectExpr(*[e for k, t in enumerate(full) for e in (
        f"count_if({t.name} <= {number(t.low)}) AS e{k}", f"count_if({t.name} < {number(t.high)}) AS f{k}")]).first()
    for k, t in enumerate(full):
        after_low, before_high = seen[f"e{k}"], seen[f"f{k}"]
        t.found |= {r: t.low for r in t.pending if r < after_low}
        t.found |= {r: t.high for r in t.pending if r >= before_high}
        t.below, t.inside, t.open = after_low, before_high - after_low, True


def _rank(base: DataFrame, targets: list[_Target]) -> None:
    todo = [t for t in targets if t.pending]
    if not todo:
        return
    hits = [_inside(t) for t in todo]
    parts = ", ".join(f"{k}, CASE WHEN {hits[k]} THEN {t.name} END" for k, t in enumerate(todo))
    cells = base.where(" OR ".join(hits)).selectExpr(f"stack({len(todo)}, {parts}) AS (target, v)")
    freq = cells.where("v IS NOT NULL").groupBy("target", "v").agg(F.expr("count(1) AS cnt"))
    running = W.partitionBy("target").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("cnt").over(running)
    ranked = freq.select("target", "v", (upto - F.col("cnt")).alias("start"), upto.alias("stop"))
    wanted = " OR ".join(
        f"(target = {k} AND start <= {r - t.below} AND stop > {r - t.below})"
        for k, t in enumerate(todo) for r in t.pending)
    for row in ranked.where(wanted).collect():  # at most two rows per target
        t = todo[row["target"]]
        for r in t.pending:
            if row["start"] <= r - t.below < row["stop"]:
                t.found[r] = row["v"]


def median_abs_deviation(df: DataFrame, values: dict[str, Column], medians: dict[str, float | None],
                         **sizes) -> dict[str, float | None]:
    """Median of the distance to the median, unscaled."""
    dev = {n: F.abs(c - F.lit(medians[n])) for n, c in values.items() if medians[n] is not None}
    got = exact_quantiles(df, dev, [0.5], **sizes)
    return {n: got[n][0] if n in got else None for n in values}

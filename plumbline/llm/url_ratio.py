"""URL verdicts: allow and block rules, and a character language-model ratio for what no rule decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import slices

# symbols of the models: letters, digits and the marks of URLs; every other byte is one further symbol
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_:?="
WIDE = len(SYMBOLS) + 2  # 0 is the start of a URL, the last symbol any other byte
ORDER = 3  # most symbols of a context
CELLS = WIDE ** (ORDER + 1)
BINS = 4096  # cells of the calibration histogram
REACH = 8.0  # largest ratio a character that the histogram tells apart
CALIBRATION = 5  # one URL in so many calibrates the threshold and is not learned from
URLS = 4096  # URLs that are scored together

_PLACE = np.full(256, WIDE - 1, np.uint8)
for _i, _c in enumerate(SYMBOLS):
    _PLACE[ord(_c)] = _i + 1
    _PLACE[ord(_c.upper())] = _i + 1


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add host, path, rule (text of the longest rule that fits, else null) and decided (its verdict)."""
    host, path = host_and_path(F.col("url"))
    named = pages.withColumns({"host": host, "path": path})
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, decided = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(decided)
    return named.withColumns({"rule": rule, "decided": decided})


def cells(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, number of the URL) of every character: the cell names it and the ``ORDER`` symbols before it."""
    sizes = np.array([len(u) for u in urls], np.int64)
    symbols = _PLACE[np.frombuffer(b"".join(urls), np.uint8)].astype(np.int64)
    which = np.repeat(np.arange(len(urls)), sizes)
    inside = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = symbols.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros(len(symbols), np.int64)
        far = np.flatnonzero(inside >= back)
        before[far] = symbols[far - back]
        cell += before * WIDE ** back
    return cell, which


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probability of every cell: contexts of all lengths mixed by Witten and Bell's weights.

    A context seen n times with t different successors keeps n / (n + t) for its own counts and leaves the
    rest to the context shorter by one symbol, down to equal chances; one never seen is its shorter one.
    """
    chance = np.full(WIDE, 1.0 / WIDE, np.float32)
    for order in range(ORDER + 1):
        held = counts.reshape(-1, WIDE ** (order + 1)).sum(axis=0).reshape(-1, WIDE).astype(np.float32)
        seen, kinds = held.sum(axis=1, keepdims=True), (held > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(chance.reshape(-1, WIDE), (held.shape[0] // max(1, chance.size // WIDE), 1))
        chance = np.where(seen > 0, (held + kinds * shorter) / np.maximum(seen + kinds, 1), shorter)
    return np.log(chance).reshape(-1)


@dataclass(frozen=True)
class UrlModel:
    """``ratio`` is the log-likelihood ratio of every cell, accepted against rejected; None if a class is unseen."""

    ratio: np.ndarray | None
    threshold: float

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Mean log-likelihood ratio of the characters; 0 for an empty URL."""
        if self.ratio is None:
            return np.zeros(len(urls))
        cell, which = cells(urls)
        sums = np.bincount(which, weights=self.ratio[cell].astype(np.float64), minlength=len(urls))
        return sums / np.maximum([len(u) for u in urls], 1)


def _urls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches, URLS):
        yield batch, [u or b"" for u in batch.column("url").cast(pa.binary()).to_pylist()]


def fit(decided: DataFrame) -> UrlModel:
    """Models of the URLs that rules accept and reject, and the threshold between them.

    All decided URLs count: a fifth of them, by crc32 of the URL, calibrates, the others are learned from.
    Every task sums its own counts; what returns is at most ``CELLS`` numbers of each class (the number of
    symbol sequences, whatever the input) and a histogram.  The threshold is the bin edge that best
    separates the calibrating URLs (highest true less false acceptance, the one nearest to 0 on ties).
    """
    held = decided.where("decided IS NOT NULL AND url IS NOT NULL").select(
        "url", (F.col("decided") == "allow").alias("good"), (F.crc32(F.col("url").cast("binary")) % CALIBRATION == 0).alias("calibrates"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * CELLS, np.int64)
        for batch, urls in _urls(batches):
            cell, which = cells(urls)
            good = np.asarray(batch.column("good").to_pylist(), np.int64)
            there, n = np.unique(cell + good[which] * CELLS, return_counts=True)
            sums[there] += n
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["cell", "n"])

    table = held.where("NOT calibrates").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * CELLS, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    bad, good = counts[:CELLS], counts[CELLS:]
    if not bad.any() or not good.any():
        return UrlModel(None, 0.0)
    model = UrlModel((smoothed(good) - smoothed(bad)).astype(np.float32), 0.0)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS), np.int64)
        for batch, urls in _urls(batches):
            place = np.clip((model.scores(urls) / REACH + 1) * BINS / 2, 0, BINS - 1).astype(np.int64)
            np.add.at(sums, (np.asarray(batch.column("good").to_pylist(), np.int64), place), 1)
        kind, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), pa.array(sums[kind, place])], names=["good", "bin", "n"])

    sums = np.zeros((2, BINS), np.int64)
    for r in held.where("calibrates").mapInArrow(bins, "good long, bin long, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).collect():
        sums[r["good"], r["bin"]] = r["n"]
    return UrlModel(model.ratio, threshold_of(sums[1], sums[0]))


def threshold_of(good: np.ndarray, bad: np.ndarray) -> float:
    """Lower edge of the bins to accept; 0 if one of the histograms is empty."""
    if not good.sum() or not bad.sum():
        return 0.0
    gain = np.r_[good[::-1].cumsum()[::-1] / good.sum() - bad[::-1].cumsum()[::-1] / bad.sum(), 0.0]
    edges = (np.arange(BINS + 1) * 2 / BINS - 1) * REACH
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(edges[best[np.abs(edges[best]).argmin()]])


def judged(pages: DataFrame, rules: list[Rule], model: UrlModel | None = None) -> DataFrame:
    """pages with host, path, rule, score and verdict, allow or block.

    A rule decides for its host, all subdomains and every path that begins with its own; the longest wins.
    All other URLs are allowed when their score reaches the model's threshold.  A null or empty URL is
    blocked; if no rule accepts any URL, or none rejects any, nothing can be learned and all others are
    allowed.  Pages are judged row by row, so repeated rows agree; other columns stay unless they bear one
    of the names added.
    """
    named = ruled(pages.drop("host", "path", "rule", "decided", "score", "verdict"), rules)
    model = model or fit(named)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, urls in _urls(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(urls))], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    scored = named.mapInArrow(score, f"{kinds}, score double")
    good = (F.length("url") > 0) & (F.col("score") >= model.threshold)
    return scored.withColumn("verdict", F.coalesce("decided", F.when(good, "allow"), F.lit("block"))).drop("decided")

"""Secrets in text: fixed patterns, and character Markov models that tell random strings from identifiers."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the patterns of the base kinds
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the run is maximal, so this keeps exactly the runs of 20 and more
HEX = r"[0-9a-f]{24,}"
VALUE_LENGTH = 6  # least length of an assigned value

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"  # the parts of a dotted token are judged one by one
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{5,}"
TRAIN_DOCUMENTS = 5000  # documents without a base match that ordinary identifiers are learned from, about
PRIOR_ODDS = math.log(1e4)  # against a long token being a secret
MEAN_RATIO = 0.35  # least log-likelihood ratio of a character

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
RUN = 64  # elements walked by one fold, which copies what it has built at every step
HALVINGS = 31  # steps that find a place in an array of any length


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where it is used inside lambdas."""
    return F.transform(F.array(value), use)[0]


def runs(array: Column) -> Column:
    """The places of an array, from 1, in runs of ``RUN``; none for an empty array."""
    count = F.size(array)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1)), F.lit(RUN)),
                      lambda i: F.sequence(i, F.greatest(i, F.least(i + RUN - 1, count))))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<array<int>>"))


def begins(steps: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What all steps before each one come to, from 0."""
    none = F.array().cast("array<int>")
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda acc, n: F.struct(
        join(acc["at"], n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value of the group), in code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.arrays_zip(F.transform(hits, F.length).alias("size"), values.alias("value")), F.transform(gaps, F.length),
                       lambda hit, gap: F.struct(gap.alias("gap"), hit["size"].alias("size"), hit["value"].alias("value")))
    empty = F.array().cast(SPAN)

    def walk(parts: Column) -> Column:
        def size(run: Column) -> Column:
            return F.aggregate(run, F.lit(0), lambda n, i: n + F.element_at(parts, i)["gap"] + F.element_at(parts, i)["size"])

        def found(run: Column, begin: Column) -> Column:
            return F.aggregate(run, F.struct(begin.alias("at"), empty.alias("found")), lambda acc, i: once(
                F.element_at(parts, i), lambda p: F.struct((acc["at"] + p["gap"] + p["size"]).alias("at"), F.concat(acc["found"], F.array(F.struct(
                    (acc["at"] + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + p["gap"] + p["size"]).alias("end"),
                    p["value"].alias("value")))).alias("found"))))["found"]

        return once(runs(parts), lambda cut: F.flatten(F.zip_with(cut, begins(F.transform(cut, size), lambda at, n: at + n), found)))

    walked = once(F.filter(parts, lambda p: p["size"].isNotNull()), walk)
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """Add _base (spans of the base kinds, in order) and _tokens (long tokens that may be random)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= VALUE_LENGTH)
    return docs.withColumns({"_base": F.array_sort(F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))),
                             "_tokens": matches(text, TOKEN, 3)})


def identifiers(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Add _sample: the ordinary identifiers of about ``most`` documents, drawn by a hash of the text."""
    share = min(1_000_000, most * 1_000_000 // max(docs.count(), 1) + 1)
    drawn = F.pmod(F.xxhash64(F.lit("identifiers"), "text"), F.lit(1_000_000)) < share
    return docs.withColumn("_sample", F.when(drawn & (F.size("_base") == 0), F.regexp_extract_all(
        F.coalesce(F.col("text"), F.lit("")), F.lit(IDENTIFIER), F.lit(0))))


def _codes(token: Column) -> Column:
    """Places of a token's characters in the alphabet, from 1."""
    return F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda n: n > 0)


def _pairs(token: Column) -> Column:
    codes = _codes(token)
    return F.filter(F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))),
                               lambda a, b: (a - 1) * len(ALPHABET) + b), lambda n: n.isNotNull())


def train(found: DataFrame) -> list[float]:
    """Log-likelihood ratio of every pair of characters, random strings against ordinary identifiers.

    Random strings are the values of all base matches; identifiers come from ``_sample``.  Counts are
    summed by Spark; what returns is one row per pair of characters and class.  With no sample of a
    class its model is uniform.
    """
    wide = len(ALPHABET)
    both = found.select(F.lit(0).alias("random"), F.explode("_sample").alias("value")).unionByName(
        found.select(F.lit(1).alias("random"), F.explode(F.transform("_base", lambda s: s["value"])).alias("value")))
    counts = [[0.5] * (wide * wide) for _ in range(2)]
    for r in both.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        counts[r["random"]][r["pair"] - 1] += r["n"]
    logs = []
    for table in counts:
        sums = [sum(table[a * wide:(a + 1) * wide]) for a in range(wide)]
        logs.append([math.log(n / sums[i // wide]) for i, n in enumerate(table)])
    return [s - o for o, s in zip(*logs, strict=True)]


def with_spans(found: DataFrame, ratios: list[float]) -> DataFrame:
    """Add _spans: base spans and the tokens that the models take for random, in order of start and kind.

    A token with a letter is random when its log-likelihood ratio passes the prior odds and its mean
    passes ``MEAN_RATIO``; one that overlaps a base span is left to that span.
    """
    table = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")
    def is_random(span: Column) -> Column:
        score = F.aggregate(_pairs(span["value"]), F.lit(0.0), lambda s, n: s + F.element_at(table, n))
        return span["value"].rlike("[A-Za-z]") & (score >= PRIOR_ODDS) & (score >= MEAN_RATIO * (F.length(span["value"]) - 1))
    def clear(span: Column, own: Column, steps: Column) -> Column:
        """No span of ``own``, which are in order and do not overlap, overlaps this one: the last that begins before its end ends in time."""
        before = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (step <= F.size(own) - at) & (F.get(own, at + step - 1)["start"] < span["end"]), at + step).otherwise(at))
        return F.coalesce(F.get(own, before - 1)["end"] <= span["start"], F.lit(True))

    def added(kind: int, *others: tuple[Column, Column]) -> Column:
        if kind == 3:
            return F.filter("_tokens", lambda t: functools.reduce(Column.__and__, [clear(t, *o) for o in others]) & is_random(t))
        halvings = F.array(*[F.lit(1 << h) for h in range(HALVINGS)][::-1])
        return once(F.filter("_base", lambda s: s["kind"] == kind), lambda own: once(
            F.filter(halvings, lambda h: h <= F.size(own)), lambda steps: added(kind + 1, *others, (own, steps))))

    random = added(0)
    return found.withColumn("_spans", F.when(F.size("_tokens") == 0, F.col("_base")).otherwise(F.array_sort(F.concat("_base", random))))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs with _base and _spans.  A null or empty text has none; rows are judged one by one, so repeated rows agree."""
    found = candidates(docs)
    return with_spans(found, train(identifiers(found)))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of ``text`` replaced by ``mask``; overlapping spans become one mask."""
    found, text, spans = secret_spans(docs), F.col("text"), F.col("_spans")
    none = F.array().cast("array<string>")

    def last(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda at, i: F.greatest(at, F.element_at(spans, i)["end"]))

    def pieces(run: Column, begin: Column) -> Column:
        # cuts are made in the run's own stretch of text, since finding a place walks from the beginning
        stretch = F.substring(text, begin + 1, F.greatest(last(run) - begin, F.lit(0)))
        return once(stretch, lambda own: F.aggregate(run, F.struct(begin.alias("at"), none.alias("out")), lambda acc, i: once(
            F.element_at(spans, i), lambda s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.array(F.concat(F.substring(own, acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(mask)))))
                .otherwise(acc["out"]).alias("out"))))["out"])

    built = once(runs(spans), lambda cut: F.array_join(F.flatten(F.zip_with(
        cut, begins(F.transform(cut, last), F.greatest), pieces)), ""))
    end = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    return found.withColumn("text", F.when(F.size(spans) == 0, text).otherwise(
        F.concat(built, F.substring(text, end + 1, F.length(text))))).drop("_base", "_tokens", "_spans")

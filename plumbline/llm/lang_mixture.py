"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.common import held_out, slices

GRAMS = 1 << 15  # hashed trigrams
TRAIN_PER_LANGUAGE = 5000  # labelled documents a language's model is fitted on, about
ROUNDS = 50  # of expectation-maximisation, at most
STEADY = 1e-5  # change of every proportion below which it ends
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the lower-cased text (every non-letter is a gap) and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.concatenate(([0], np.where(letters[codes], codes, 0), [0])).astype(np.uint32)
    middle = codes[1:-1] > 0
    mixed = ((codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]) * np.uint32(0xC2B2AE35)
    return np.unique((mixed >> np.uint32(17))[middle], return_counts=True)


class LanguageMixture:
    """Smoothed trigram probabilities of each language; infers the languages of a text."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smoothed = counts.astype(np.float64) + 0.1
        self.prob = (smoothed / smoothed.sum(axis=1, keepdims=True)).T.astype(np.float64)  # gram x language

    def proportions(self, prob: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Maximum likelihood proportions of the given languages and the log-likelihood."""
        share = np.full(prob.shape[1], 1.0 / prob.shape[1])
        if prob.shape[1] > 1:
            for _ in range(ROUNDS):
                last = share
                share = share * ((weight / (prob @ share)) @ prob) / weight.sum()
                if np.abs(share - last).max() < STEADY:
                    break
        return share, float(weight @ np.log(prob @ share))

    def infer(self, found: np.ndarray, weight: np.ndarray) -> list[tuple[str, float]]:
        """Languages with their proportions, largest first.

        The full mixture ranks the languages; of the sets of the first k the one with the largest
        log-likelihood less (k - 1) / 2 * log(number of trigrams) is kept.  A language to which the full
        mixture gives less than one trigram is not tried.
        """
        if not len(found) or not self.languages:
            return []
        prob, n = self.prob[found], float(weight.sum())
        full = self.proportions(prob, weight)[0]
        ranked = np.argsort(-full, kind="stable")
        ranked = ranked[:max(1, int((full * n >= 1).sum()))]
        best: tuple[float, np.ndarray, np.ndarray] | None = None
        for k in range(1, len(ranked) + 1):
            share, likelihood = self.proportions(prob[:, ranked[:k]], weight)
            score = likelihood - 0.5 * (k - 1) * np.log(n)
            if best is not None and score <= best[0]:
                break
            best = (score, ranked[:k], share)
        order = np.argsort(-best[2], kind="stable")
        return [(self.languages[best[1][i]], float(best[2][i])) for i in order]


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageMixture:
    """Count trigrams by language over rows that are not held out, about ``per_language`` documents of each.

    The sample is drawn by a hash of the id, the counts are summed by Spark, and what reaches the
    driver is one row per language and trigram bucket.  Without labelled rows there are no languages.
    """
    labelled = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    place = {lang: i for i, lang in enumerate(languages)}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, per_language * 1_000_000 // n + 1)).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = letter_table(), np.zeros((len(languages), GRAMS), np.int64)
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found, n = grams(text, letters)
                table[place[lang], found] += n
        row, gram = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype("int32")), pa.array(gram.astype("int32")), pa.array(table[row, gram])],
                                         names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), GRAMS))
    table[counted["lang"].to_numpy(), counted["gram"].to_numpy()] = counted["n"].to_numpy()
    return LanguageMixture(languages, table)


def with_languages(docs: DataFrame, model: LanguageMixture) -> DataFrame:
    """Add lang_pred, score and languages (each language of the mixture with its proportion) to rows with a text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when no language
    was learned.  Every row is judged alone: repeated rows get equal answers.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    share = T.StructType().add("lang", "string").add("share", "double")
    schema = T.StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(share))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, np.asarray(model.prob, np.float64)))  # bounded: GRAMS x languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        own = LanguageMixture([], np.ones((1, 1)))
        own.languages, own.prob = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in slices(batches):
            told, scores, mixes = [], [], []
            for text in batch.column("text").to_pylist():
                mix = own.infer(*grams(text, letters)) if text else []
                told.append(mix[0][0] if mix else UNKNOWN)
                scores.append(min(1.0, mix[0][1]) if mix else 0.0)
                mixes.append([{"lang": lang, "share": share} for lang, share in mix])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)],
                                             names=[*batch.schema.names, "lang_pred", "score", "languages"])

    return kept.mapInArrow(judge, schema)

"""Phrase collocations by level-wise candidates and double-array tries over whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm import phrase_trie
from plumbline.llm.common import slices

# fixed values: what ends a piece, and what separates words
BREAKS = b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"

BITS = 26  # a filter of hashes has 2 to this power bits
PART = 500_000  # candidates of one trie
CHUNK = 4096  # counts that travel in one row
SHARDS = 64  # groups of tasks whose counts are added first
MEMO_WORDS = 150_000  # word hashes one worker keeps at a time
HELD_WORDS = 300_000  # distinct words one worker counts before it passes them on
HELD_KEYS = 2_000_000  # keys one worker gathers before it passes them on
TEXTS = 64  # texts that are taken up together

_FOLD = bytes(0xFF if c in BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))  # 0xFF is in no UTF-8 text
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, with 0xFF where a piece ends."""
    return (text or b"").translate(_FOLD).replace(b"\xff", b" \xff ").replace(b"\t", b" ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _FACTOR
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """64-bit hash of a word; 0 stands for the end of a piece only."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self[b"\xff"] = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > MEMO_WORDS:
            self.clear()
            self[b"\xff"] = 0
        self[word] = code = xxhash.xxh64_intdigest(word, seed=self.seed) or 1
        return code


def _language_key(lang: str, seed: int) -> np.uint64:
    import xxhash
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=seed + 1))


def _first_keys(words: np.ndarray, lang: str, seed: int) -> np.ndarray:
    return _mixed(words ^ _language_key(lang, seed))


def _next_keys(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(keys * np.uint64(31) + words)


def _by_language(batch: pa.RecordBatch, memo: _Hashes) -> Iterator[tuple[str, np.ndarray]]:
    """(language, word hashes of all its texts in the batch, 0 between pieces and texts)."""
    parts: dict[str, list[np.ndarray]] = {}
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
        words = words_of(text)
        if words:
            parts.setdefault(lang, []).append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
            parts[lang].append(np.zeros(1, np.uint64))
    for lang, held in parts.items():
        yield lang, np.concatenate(held)


class _Tally:
    """Counts of 64-bit keys, passed on in bounded batches."""

    def __init__(self) -> None:
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= HELD_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


class HashFilter:
    """A fixed number of bits that tells which keys may be in a set; none of the set is ever missed."""

    def __init__(self, keys: DataFrame) -> None:
        bit = f"key & {(1 << BITS) - 1}"
        rows = (keys.selectExpr(f"({bit}) >> 6 AS word", f"shiftleft(1L, CAST(({bit}) & 63 AS INT)) AS bits")
                .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())  # 2 ** 20 rows at most
        self.words = np.zeros(1 << (BITS - 6), np.uint64)
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        low = keys & np.uint64((1 << BITS) - 1)
        return (self.words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, hash, word, last, n) of every word; ``last`` differs from ``word`` if two words share a hash."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counted in held.items():
                counted.pop(b"\xff", None)
                memo, words = _Hashes(seed), list(counted)
                hashes = np.fromiter((memo[w] for w in words), np.uint64, len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(hashes.view(np.int64)), pa.array(words, pa.binary()),
                     pa.array(list(counted.values()), pa.int64())], names=["lang", "hash", "word", "n"])
            held.clear()

        for batch in slices(batches, TEXTS):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    found = docs.mapInArrow(count, "lang string, hash long, word binary, n long")
    return found.groupBy("lang", "hash").agg(F.min("word").alias("word"), F.max("word").alias("last"), F.sum("n").alias("n"))


def word_keys(words: DataFrame, seed: int) -> DataFrame:
    """The key of every (lang, hash)."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes = batch.column("lang").to_pylist(), batch.column("hash").to_numpy().view(np.uint64)
            own = {lang: _language_key(lang, seed) for lang in set(langs)}
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(hashes ^ np.array([own[x] for x in langs], np.uint64)).view(np.int64))], names=["key"])

    return words.select("lang", "hash").mapInArrow(keys, "key long")


def hashed_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """``word_counts`` under the first seed with which no two words of a language share a hash."""
    for seed in range(8):
        words = settle(word_counts(docs, seed))
        if words.where("word != last").isEmpty():
            return words, seed
    raise ValueError("eight seeds gave colliding word hashes")


def pair_support(docs: DataFrame, frequent: HashFilter, seed: int) -> DataFrame:
    """(key, n): hashed counts of neighbouring words that may both be frequent."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tally = _Hashes(seed), _Tally()
        for batch in slices(batches, TEXTS):
            for lang, words in _by_language(batch, memo):
                keys = _first_keys(words, lang, seed)
                fine = (words != 0) & frequent(keys)
                at = np.flatnonzero(fine[:-1] & fine[1:])
                yield from tally.add(_next_keys(keys[at], words[at + 1]))
        yield from tally.flush()

    return docs.mapInArrow(gather, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent_runs(docs: DataFrame, frequent: HashFilter, pairs: HashFilter, seed: int) -> DataFrame:
    """(lang, runs): the stretches of texts whose neighbouring words may all be frequent pairs, 0 between them."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes(seed)
        for batch in slices(batches, TEXTS):
            langs, runs = [], []
            for lang, words in _by_language(batch, memo):
                keys = _first_keys(words, lang, seed)
                fine = (words != 0) & frequent(keys)
                linked = np.zeros(len(words), bool)  # with the next word
                at = np.flatnonzero(fine[:-1] & fine[1:])
                linked[at] = pairs(_next_keys(keys[at], words[at + 1]))
                kept = linked.copy()
                kept[1:] |= linked[:-1]
                kept = np.flatnonzero(kept)
                if len(kept):
                    langs.append(lang)
                    runs.append(np.insert(words[kept], np.flatnonzero(~linked[kept]) + 1, 0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.binary())], names=["lang", "runs"])

    return docs.mapInArrow(cut, "lang string, runs binary")


def _levels(words: np.ndarray, lang: str, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, keys) of all sequences of k words without a break, for k from 2 on."""
    at = np.flatnonzero(words)
    keys = _first_keys(words[at], lang, seed)
    for k in range(2, longest + 1):
        inside = at + k - 1 < len(words)
        at, keys = at[inside], keys[inside]
        fine = words[at + k - 1] != 0
        at, keys = at[fine], keys[fine]
        keys = _next_keys(keys, words[at + k - 1])
        yield k, at, keys


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    for batch in slices(batches, 1):
        yield batch.column("lang")[0].as_py(), np.frombuffer(batch.column("runs")[0].as_py(), np.uint64)


def longer_support(runs: DataFrame, seed: int, longest: int) -> DataFrame:
    """(key, n): hashed counts of all sequences of three and more words inside runs."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for lang, words in _runs(batches):
            for k, _, keys in _levels(words, lang, seed, longest):
                if k > 2:
                    yield from tally.add(keys)
        yield from tally.flush()

    return runs.mapInArrow(gather, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def candidates(runs: DataFrame, longer: HashFilter, seed: int, longest: int) -> DataFrame:
    """Distinct (lang, words): sequences whose own hashed count and those of all their parts reach the support."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def distinct() -> int:
            for which, parts in held.items():
                keys, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                _, first, same = np.unique(keys, return_index=True, return_inverse=True)
                other = (rows != rows[first][same]).any(axis=1)  # another sequence of the same key
                kept = np.concatenate([first, np.flatnonzero(other)])
                held[which] = [(keys[kept], rows[kept])]
            return sum(parts[0][1].size for parts in held.values())

        def flush() -> Iterator[pa.RecordBatch]:
            distinct()
            for (lang, k), ((_, flat),) in held.items():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(flat) + 1, k), pa.int32()), pa.array(flat.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(flat), pa.string()), lists], names=["lang", "words"])
            held.clear()

        for lang, words in _runs(batches):
            below = np.zeros(len(words) + 1, bool)  # positions where a sequence of one word less is possible
            for k, at, keys in _levels(words, lang, seed, longest):
                if k > 2:
                    fine = longer(keys) & below[at] & below[at + 1]
                    at, keys = at[fine], keys[fine]
                below[:] = False
                below[at] = True
                if len(at):
                    held.setdefault((lang, k), []).append((keys, words[at[:, None] + np.arange(k)]))
                    size += k * len(at)
            if size >= HELD_KEYS:
                size = distinct()
                if 2 * size >= HELD_KEYS:
                    yield from flush()
                    size = 0
        yield from flush()

    return runs.mapInArrow(gather, "lang string, words array<long>").distinct()


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "sums": [sum(np.frombuffer(b, np.int64) for b in rows["sums"]).tobytes()]})


def _unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    counts = np.frombuffer(_added(rows)["sums"].iloc[0], np.int64)
    return pd.DataFrame({"number": np.arange(len(counts)) + int(rows["chunk"].iloc[0]) * CHUNK, "f": counts})


def phrase_counts(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, words, f): how often each candidate lies in the runs.

    Candidates are dealt by hash into tries of about ``PART``; each is built in a task and broadcast alone,
    so what travels is bounded and more candidates mean more passes over the runs.  A task returns its
    counts in chunks of ``CHUNK``; they are added up in two steps, so no task meets those of all others.
    """
    parts = max(1, -(-found.count() // PART))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        phrases = [(lang, tuple(words)) for lang, words in zip(rows["lang"], rows["words"], strict=True)]
        return pd.concat([pd.DataFrame({"part": rows["part"], "number": range(len(rows)), "lang": rows["lang"], "words": rows["words"], "trie": None}),
                          pd.DataFrame({"part": rows["part"].iloc[:1], "number": -1, "lang": None, "words": None, "trie": [phrase_trie.build(phrases)]})])

    dealt = found.withColumn("part", F.pmod(F.xxhash64("lang", "words"), F.lit(parts)).cast("int"))
    grown = settle(dealt.groupBy("part").applyInPandas(grow, "part int, number int, lang string, words array<long>, trie binary"))
    counted = []
    for part in range(parts):
        row = grown.where(f"part = {part} AND number = -1").select("trie").first()
        if row is None:
            continue
        data = bytes(row["trie"])

        def count(batches: Iterator[pa.RecordBatch], data: bytes = data) -> Iterator[pa.RecordBatch]:
            trie = phrase_trie.Trie(data)
            counts = np.zeros(trie.phrases, np.int64)
            for lang, words in _runs(batches):
                trie.count(lang, words.view(np.int64), counts)
            places = range(0, trie.phrases if counts.any() else 0, CHUNK)
            shard = TaskContext.get().partitionId() % SHARDS
            yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK for at in places], pa.int32()), pa.array([shard] * len(places), pa.int32()),
                                              pa.array([counts[at:at + CHUNK].tobytes() for at in places], pa.binary())], names=["chunk", "shard", "sums"])

        sums = runs.mapInArrow(count, "chunk int, shard int, sums binary").groupBy("chunk", "shard").applyInPandas(_added, "chunk int, sums binary")
        counted.append(settle(sums.groupBy("chunk").applyInPandas(_unpacked, "number int, f long").withColumn("part", F.lit(part))))
    every = counted[0] if counted else runs.sparkSession.createDataFrame([], "number int, f long, part int")
    for more in counted[1:]:
        every = every.unionByName(more)
    return grown.where("number >= 0").join(every, ["part", "number"]).select("lang", "words", "f")


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, words as text, f) of phrases of hashes."""
    each = phrases.select("lang", F.col("words").alias("hashes"), "f", F.posexplode("words").alias("at", "hash"))
    named = each.join(words.select("lang", "hash", F.col("word").cast("string").alias("word")), ["lang", "hash"])
    listed = named.groupBy("lang", "hashes").agg(F.first("f").alias("f"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return listed.select("lang", F.col("w.word").alias("words"), "f")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``BREAKS`` and into words at blanks and tabs.  A phrase
    has two to ``longest`` words of one piece and lies at least ``support`` times (a) in the texts of its
    language; its score is the least floor(1000 a n / (l r)) over its cuts into two parts of l and r
    occurrences, n being all words of the language.  A phrase inside a longer one that is as frequent is
    dropped.  Ties: the shortest first part, then higher a, then the phrase in byte order.

    Counting goes level by level.  Words are counted first; hashed counts of pairs of frequent words, then of
    longer sequences of such pairs, leave the candidates that may reach the support (a hash never hides one);
    tries of the candidates then count all positions of all texts.  A null language is ``und``; null and
    empty texts hold nothing; repeated rows count each time; extra columns are ignored; an empty table has
    no phrases.
    """
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text").where("text IS NOT NULL")
    every, seed = hashed_words(slim)
    words = settle(every.where(F.col("n") >= support).select("lang", "hash", "word", "n"))
    single = HashFilter(word_keys(words, seed))
    double = HashFilter(pair_support(slim, single, seed).where(F.col("n") >= support))
    runs = settle(frequent_runs(slim, single, double, seed))
    longer = HashFilter(longer_support(runs, seed, longest).where(F.col("n") >= support))
    found = settle(candidates(runs, longer, seed, longest))
    frequent = phrase_counts(runs, found).where(F.col("f") >= support)
    phrases = settle(_spelled(frequent, words))
    return scored(phrases, every, support, most)


def scored(phrases: DataFrame, words: DataFrame, support: int, most: int) -> DataFrame:
    """Rank phrases (lang, words, f) with the counts (lang, word, n) of all words."""
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.where(F.col("n") >= support).select("lang", F.array(F.col("word").cast("string")).alias("words"), F.col("n").alias("f")).unionByName(phrases)
    longest = F.col("words")
    cuts = phrases.select("lang", "words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "words", "f", "k", F.slice("words", 1, F.col("k")).alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("words").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = "CAST({} AS DECIMAL(19, 0))".format
    cuts = cuts.join(total, "lang").withColumn("score", F.expr(
        f"CAST((CAST(1000 * {wide('f')} AS DECIMAL(22, 0)) * CAST(n AS DECIMAL(16, 0))) DIV ({wide('l')} * {wide('r')}) AS BIGINT)"))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"), F.first("n").alias("n"))
    parts = phrases.where(F.size("words") > 2).select("lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size(longest) - m + 1), lambda i: F.slice(longest, i, m))))).alias("words"))
    inside = parts.groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "words"], "left").where("longer IS NULL OR longer < a").select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

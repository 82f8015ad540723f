"""Harmonic packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.sizing import local_frame, settle, small_batches
from plumbline.llm.common import numbered, slices, worker_kept

MEMO_WORDS = 400_000  # words whose ids one worker keeps at a time
LINE_WORDS = 2000  # new words that are tokenised together
TEXT_BYTES = 4_000_000  # of texts whose words are looked up together, or one text
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, size_class long"


def harmonic_cuts(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: each is the largest ``capacity // j`` that still fits."""
    cuts = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        while capacity // j > rest:
            j += 1
        cuts.append(capacity // j)
        rest -= capacity // j
    return cuts


# Letters that stand for themselves in the tokenizer's normal form: small and composed, or without case.
LETTERS = "a-zß-öø-ÿа-џ一-龥"
SIMPLE = re.compile(f"[!-&(-@\\[-~{LETTERS}]+")  # words of such letters and printable marks other than the apostrophe
WORD = re.compile(f"[{LETTERS}]+")
PARTS = re.compile(f"[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")  # what the tokenizer takes one by one in such a word
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as their own character
BYTES = {byte: 256 + i for i, byte in enumerate(sorted(set(range(256)).difference(SHOWN)))}  # and what the others are written as


class WordIds:
    """Ids of white-space separated words as little-endian bytes; a bounded memo in front of the tokenizer.

    The tokenizer never joins characters across white space, so ids of a text are those of its words.
    Plain words are cut into letters, digits and marks, and unknown ones go to the same model in long
    lines without the normaliser, which leaves them as they are; all other words take the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.plain.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text.  Arrow lowers, splits and numbers the words; each distinct one is looked up once."""
        texts = pc.fill_null(texts, "")
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # marks such as <|endoftext|> mind the case
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) + len(self.parts) > MEMO_WORDS:
            self.words.clear()
            self.parts.clear()
        found = list(map(self.words.get, distinct))
        self._look_up([w for w, ids in zip(distinct, found, strict=True) if ids is None])
        found = [self.words[w] if ids is None else ids for w, ids in zip(distinct, found, strict=True)]
        pool, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        words = coded.indices.to_numpy()
        length = sizes[words]
        ends = np.concatenate([[0], np.cumsum(length)])
        shift = (np.cumsum(sizes) - sizes)[words] - ends[:-1]
        raw = pool[np.repeat(shift, length) + np.arange(ends[-1])].tobytes()
        stops = (4 * ends[np.cumsum(split.value_lengths().to_numpy())]).tolist()
        return [raw[begin:end] for begin, end in zip([0, *stops], stops)]

    def _look_up(self, new: list[str]) -> None:
        words, mixed, odd = [], [], []
        for w in new:
            (words if WORD.fullmatch(w) else mixed if SIMPLE.fullmatch(w) and "<|" not in w else odd).append(w)
        cut = [PARTS.findall(w) for w in mixed]
        self._learn(self.words, words)
        self._learn(self.parts, list(set(chain.from_iterable(cut)).difference(self.parts)))
        for word, parts in zip(mixed, cut, strict=True):
            self.words[word] = b"".join(map(self.parts.__getitem__, parts))
        for word, code in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else [], strict=True):
            self.words[word] = np.asarray(code.ids, dtype="<u4").tobytes()

    def _learn(self, memo: dict[str, bytes], parts: list[str]) -> None:
        written = [p if p.isascii() else p.encode().decode("latin-1").translate(BYTES) for p in parts]
        lines = [" ".join(written[i:i + LINE_WORDS]) for i in range(0, len(written), LINE_WORDS)]
        codes = self.plain.encode_batch_fast(lines, add_special_tokens=False) if lines else []
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(code.ids, dtype="<u4") for code in codes)])
        ends, raw = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), ids.tobytes()
        memo.update(zip(parts, (raw[begin:end] for begin, end in zip([0, *ends], ends)), strict=True))


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about ``TEXT_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece of each document (id, text): where it starts, its length, a checksum of its ids.

    A null text is empty and becomes one piece holding ``end_id`` alone.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = worker_kept(("word ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            encoded = chain.from_iterable(map(memo.encode, portions(batch.column("text"))))
            for row, ids in enumerate(encoded):
                ids += last
                at = 0
                for length in harmonic_cuts(len(ids) // 4, capacity):
                    rows.append(row)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[4 * at:4 * (at + length)]))
                    totals.append(len(ids) // 4)
                    at += length
            size = np.asarray(lengths, dtype="int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, (
                    np.asarray(starts, "int64"), size, np.asarray(sums, "int64"), np.asarray(totals, "int64"),
                    capacity // np.maximum(size, 1)))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size_class"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(cut, PIECES.format(id=slim.schema["doc_id"].dataType.simpleString()))


def harmonic_pack(pieces: DataFrame, capacity: int = 2048, buckets: int = 1024) -> DataFrame:
    """Fill sequences class by class: a piece of length n shares its sequence with ``capacity // n`` such pieces.

    Every class has one length (``harmonic_cuts`` makes no other), so a piece's sequence and offset
    follow from its number inside its class.  The number comes from ``buckets`` independently ranked
    parts of each class and their totals; no class is sorted whole.  What a class leaves over (less
    than one sequence each, at most 2 * sqrt(capacity) classes) is merged first-fit by falling size.
    Sequence ids are gapless from 0; offsets are gapless inside a sequence.  No piece, no row.
    """
    spark = pieces.sparkSession
    part = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    classes = sorted((r["size_class"], r["length"], r["n"]) for r in part.groupBy("size_class", "length")
                     .agg(F.count("*").alias("n")).collect())  # bounded by the capacity, not by the data
    full = {c: n // c for c, _, n in classes}
    base, begin = {}, 0
    for c, _, _ in classes:
        base[c], begin = begin, begin + full[c]
    room: list[int] = []
    last: dict[int, tuple[int, int]] = {}
    for rest, c in sorted(((n % c) * length, c) for c, length, n in classes)[::-1]:
        if rest:
            at = next((i for i, used in enumerate(room) if used + rest <= capacity), len(room))
            if at == len(room):
                room.append(0)
            last[c] = (begin + at, room[at])
            room[at] += rest
    whole = pa.int64()
    plan = local_frame(spark, {
        "size_class": (whole, list(base)), "_base": (whole, list(base.values())), "_full": (whole, [full[c] for c in base]),
        "_last": (whole, [last.get(c, (0, 0))[0] for c in base]), "_shift": (whole, [last.get(c, (0, 0))[1] for c in base])})
    ranked = numbered(part, ["size_class"], "_part", ["doc_id", "start", "ids_crc32"], "_rank").join(F.broadcast(plan), "size_class")
    bin_no, place = F.expr("_rank div size_class"), F.col("_rank") % F.col("size_class")
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(bin_no < F.col("_full"), F.col("_base") + bin_no).otherwise(F.col("_last")).alias("sequence_id"),
        (F.when(bin_no < F.col("_full"), 0).otherwise(F.col("_shift")) + place * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack whole documents.  Repeated rows are packed as often as they occur; extra columns are ignored."""
    with small_batches(docs.sparkSession):
        pieces = settle(tokenised_pieces(docs, tokenizer_path, capacity=capacity))
    return harmonic_pack(pieces, capacity)

"""Packing and sharding: round trips against the tokenizer and plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import edge_docs, empty_docs
from pyspark.sql import functions as F

from plumbline.llm import histogram_sort, packing
from plumbline.llm.queries import QUERIES, word_tokenizer

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("length", [1, 2, 3, 100, 1023, 1025, 1500, 2047, 2048, 2049, 10_000])
def test_cuts_fill_their_class(length):
    cuts = packing.harmonic_cuts(length, 2048)
    assert sum(cuts) == length
    assert all(2048 // (2048 // n) == n for n in cuts)


def check_packing(rows, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(word_tokenizer())
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in ids.items():
        spans = sorted(set(pieces[k]))
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:] + [(len(own), 0)]))
    assert sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= 2048
    return sum(n for spans in bins.values() for _, n in spans) / (2048 * len(bins))


def test_packing_round_trip(spark):
    rows = QUERIES["op1_harmonic_packing"](spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert check_packing(rows, texts) > 0.97


def test_packing_hands_over_few_texts_at_a_time(spark, monkeypatch):
    """Texts reach Python in bounded batches while they are tokenised; the session's own setting comes back."""
    name, seen, settle = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.settle
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "settle", lambda df: (seen.append(int(spark.conf.get(name))), settle(df))[1])
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(5000)], "doc_id long, text string").repartition(1)
    assert packing.pack_documents(docs, word_tokenizer()).count() >= 5000
    assert 0 < seen[0] <= 2000 and spark.conf.get(name) == before


def test_packing_edges(spark):
    docs = edge_docs(spark)
    rows = packing.pack_documents(docs, word_tokenizer()).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packing(rows, texts)
    assert sum(r["doc_id"] == 2 and r["start"] == 0 for r in rows) == 2
    assert packing.pack_documents(empty_docs(spark), word_tokenizer()).collect() == []


def test_tokens_across_odd_white_space(spark):
    text = "a b c \x1c d\x85e  f'll <|endoftext|>x ẞİ oḱ"
    from tokenizers import Tokenizer
    own, = packing.WordIds(word_tokenizer()).encode(pa.array([text]))
    assert np.frombuffer(own, "<u4").tolist() == Tokenizer.from_file(word_tokenizer()).encode(text, add_special_tokens=False).ids


def test_words_learned_in_lines():
    """Accented, Cyrillic and Chinese words, final sigmas, decomposed and odd characters: as the whole tokenizer takes them."""
    from tokenizers import Tokenizer
    texts = ["leréen è, ñ-ñ 12ß ÿ÷×", "мир. ёлка й и\u0306 Мир", "漢字かな 中文,字 龥龦", "ΟΔΟΣ οδος ά", "e\u0301t\u00e9 ﬁ ª º µ", "don't l'été '", None, "", "  ",
             "<|endoftext|>é <|EndOfText|>", "a" * 5000 + "é" * 5000, "\x00\x01 \x7f \ufeff \u200b x\u200by", "𝒳 😀😀 é😀"]
    memo, whole = packing.WordIds(word_tokenizer()), Tokenizer.from_file(word_tokenizer())
    for _ in range(2):
        got = memo.encode(pa.array(texts))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert memo.encode(pa.array([], pa.string())) == []


def test_portions(monkeypatch):
    monkeypatch.setattr(packing, "TEXT_BYTES", 10)
    texts = ["aaaa", None, "bbbb", "cccc", "", "d" * 50, "é" * 5, "f"]
    runs = [p.to_pylist() for p in packing.portions(pa.array(texts))]
    assert sum(runs, []) == texts and all(len(r) == 1 or sum(len((t or "").encode()) for t in r) <= 10 for r in runs)
    assert list(packing.portions(pa.array([], pa.string()))) == []


def test_shards(spark):
    rows = QUERIES["op4_histogram_sort"](spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, mean = max(len(t.encode()) for t in docs.values()), sum(sizes.values()) / 16
    assert all(abs(sizes[s] - mean) <= largest + 1 for s in range(16))


def test_hot_key_is_split(spark):
    """A third of the rows share one text; shards still have near equal bytes and keep the order."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(
        F.concat(F.lit("text no "), F.col("id"))).alias("text"))
    key = histogram_sort.sort_key([F.col("text")], [F.col("doc_id")])
    rows = histogram_sort.shard_by_bytes(df, key, F.octet_length("text"), 16).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    assert len(rows) == 3000 and all(abs(n - mean) <= 0.02 * mean for n in sizes.values())


def test_shard_edges(spark):
    docs = edge_docs(spark)
    key = histogram_sort.sort_key([F.coalesce("text", F.lit(""))], [F.col("doc_id")])
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    rows = histogram_sort.shard_by_bytes(docs, key, size, 16).collect()
    assert len(rows) == docs.count()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert histogram_sort.shard_by_bytes(empty_docs(spark), key, size, 16).collect() == []

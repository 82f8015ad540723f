"""Near-duplicate documents and vectors and nearest codes against brute force."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from cases import edge_docs, empty_docs
from pyspark.sql import functions as F

from plumbline.llm import chosen_path, collision, common, multi_index
from plumbline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def smallest_reachable(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(texts, n=4):
    sets, holders, pairs = {k: shingles(t, n) for k, t in texts.items()}, {}, set()
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    for ks in holders.values():
        pairs.update(tuple(sorted(p)) for p in combinations(ks, 2))
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, smallest_reachable(texts, linked)


def near_texts(count, words=60, seed=1):
    """Many near copies of one text, each with a few words of its own, beside unlike texts."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(words)]
    texts = {}
    for i in range(count):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        texts[i] = " ".join(own) if i % 3 else " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(words))
    return texts


@pytest.mark.parametrize("source", ["table", "group"])
def test_near_duplicates(spark, source):
    if source == "table":
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
        rows = QUERIES["op6_chosen_path"](spark, SF_DIR).collect()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    else:  # one group far larger than a node
        texts = near_texts(240)
        rows = chosen_path.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    sets, expected = brute_components(texts)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {k: len(s) for k, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def template_texts(pairs, passage=170, own=30, changed=16, seed=3):
    """Texts that all share one passage; 2i and 2i + 1 also share most of their own words and reach the similarity."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    shared, texts = words(passage), {}
    for i in range(pairs):
        kept = words(own - changed)
        for j in (0, 1):
            texts[2 * i + j] = " ".join(shared + kept + words(changed))
    return texts


def test_near_duplicates_of_a_template(spark):
    """Pairs inside a family that shares a long passage: nodes stay large, so ten trees alone lose some."""
    texts = template_texts(300)
    sets = {k: shingles(t) for k, t in texts.items()}
    assert all(100 * len(sets[k] & sets[k + 1]) >= 80 * len(sets[k] | sets[k + 1]) for k in range(0, 600, 2))
    assert all(100 * len(sets[0] & sets[k]) < 80 * len(sets[0] | sets[k]) for k in range(2, 600))
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got.values()) <= set(got) and all(c in (k, k - k % 2) for k, c in got.items())
    assert sum(got[k] == got[k + 1] for k in range(0, 600, 2)) >= 0.99 * 300


@pytest.mark.parametrize("count, small, whole", [(10, 12, 4096), (40, 12, 4096), (40, 12, 20)])
def test_pairs_meet_only_across_components(spark, monkeypatch, count, small, whole):
    """Nodes compared pair by pair, in one task and in rounds: no pair of one component, none with other sketches."""
    monkeypatch.setattr(chosen_path, "NODE", small)
    monkeypatch.setattr(chosen_path, "SUBTREE", whole)
    alike, other = bytes(64), bytes([1] * 30 + [0] * 34)
    rows = [(0, 7, bytes([i]), bytes([0 if i < count - 2 else i]), alike if i < count - 1 else other) for i in range(count)]
    frame = spark.createDataFrame(rows, "tree int, node long, class_id binary, component binary, marks binary")
    pairs, rest, _ = chosen_path.walk(frame, 1, 3)
    found = pairs.collect() + (chosen_path.whole_pairs(rest).collect() if rest is not None else [])
    found = {tuple(x[0] for x in p) for p in found}
    lone = count - 2
    assert found == {(i, lone) for i in range(lone)} if count <= small else found and found <= {(i, lone) for i in range(lone)}


def test_near_duplicate_edges(spark):
    rows = chosen_path.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"] and by_id[1]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["kept"] for i in (3, 4, 5))
    assert by_id[10]["n_shingles"] == 1 and by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert chosen_path.near_duplicates(empty_docs(spark)).collect() == []


def words_of(rng, count):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(count)]


def test_near_duplicates_of_one_id_and_of_none(spark):
    """Every row counts by its own text, whether its id is repeated or null."""
    rng = random.Random(11)
    parts = [words_of(rng, 80) for _ in range(4)]
    ta, tb, tc, td = (" ".join(p) for p in parts)
    nb, nc, nd = (" ".join([*p[:-1], "other"]) for p in parts[1:])
    rows = [(5, ta, "x"), (5, tb, "x"), (9, nb, "x"), (None, tc, "x"), (None, nc, "x"), (None, tc, "y"),
            (3, td, "x"), (None, td, "x"), (None, nd, "x"), (3, td, "y"), (7, "", "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in chosen_path.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True), (None, None, True), (None, None, True),
                          (3, 3, True), (None, 3, False), (None, 3, False), (3, 3, True), (7, 7, True), (7, 7, True)], key=str)
    left = [tuple(r) for r in chosen_path.without_near_duplicates(docs).collect()]
    assert len(left) == 6 and set(left) <= set(rows)
    assert {(5, ta, "x"), (5, tb, "x")} <= set(left) and left.count((7, "", "x")) == 2
    assert sum(r[0] == 3 for r in left) == 1 and sum(r[0] is None and r[1] in (tc, nc) for r in left) == 1


def test_near_duplicates_removed_by_row(spark):
    """The rows that stay are one for each component, and a table without copies stays as it is."""
    texts = near_texts(90, seed=8)
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()] * 2, "doc_id long, text string")
    left = [r["doc_id"] for r in chosen_path.without_near_duplicates(docs, words=4).collect()]
    assert sorted(left) == sorted(set(brute_components(texts)[1].values()))
    assert sorted(tuple(r) for r in chosen_path.without_near_duplicates(docs.where("doc_id in (0, 3)").distinct()).collect()) == [(0, texts[0]), (3, texts[3])]
    assert chosen_path.without_near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 260)] + [
        (rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {i for p in pairs if p[0] != p[1] for i in p}
    assert got == smallest_reachable(ids, [p for p in pairs if p[0] != p[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def clouds(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        if i % 4:
            v = rng.normal(size=32)
        else:
            v = np.ones(32) + rng.normal(size=32) * 0.27  # cosines on both sides of the threshold
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)]
    return rows


def brute_links(rows, cosine=0.93):
    usable = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = []
    for (i, a, la), (j, b, lb) in combinations(usable, 2):
        if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
            pairs.append((i, j))
    return pairs


def test_near_vectors(spark):
    rows = clouds()
    got = collision.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    pairs = brute_links(rows)
    links = Counter(i for p in pairs for i in p)
    wanted = smallest_reachable([r[0] for r in rows], pairs)
    assert len(pairs) > 100
    assert sum(r["n_links"] for r in got) >= 0.995 * 2 * len(pairs)
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
    assert np.mean([r["component_id"] == wanted[r["vec_id"]] for r in got]) >= 0.99


@pytest.mark.parametrize("scale", [1e-200, 1e200, 5e-324 * 1000])
def test_near_vectors_of_extreme_lengths(spark, scale):
    """Squares that vanish or overflow in double precision change no link."""
    rng = np.random.default_rng(4)
    base = rng.integers(-40, 40, (30, 16)).astype(float)
    base[1::3] = base[::3] + rng.integers(-3, 4, (10, 16))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    rows = [(i, (v * (scale if i % 2 else 1.0)).tolist(), 1) for i, v in enumerate(base)]
    got = {r["vec_id"]: r["n_links"] for r in collision.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: int(linked[i].sum()) - 1 for i in range(30)} and any(got.values())


def test_near_vectors_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    pairs = brute_links(rows)
    links, wanted = Counter(i for p in pairs for i in p), smallest_reachable([r[0] for r in rows], pairs)
    got = QUERIES["op7_collision_counting"](spark, SF_DIR).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {r[0]: (links[r[0]], wanted[r[0]]) for r in rows}


EDGE_VECTORS = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [float("nan"), 1.0], 0),
                (7, [1.0, None], 0), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0),
                (11, [float("inf"), 1.0], 0), (1, [1.0, 0.0], 0)]


def test_near_vector_edges(spark):
    df = spark.createDataFrame(EDGE_VECTORS, VECTORS).withColumn("kept", F.lit("x")).withColumn("cell", F.lit("x"))
    got = collision.near_vectors(df).collect()
    assert len(got) == len(EDGE_VECTORS)
    by_id = {r["vec_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and by_id[2]["n_links"] == 2 and by_id[1]["n_links"] == 2
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert collision.near_vectors(df.limit(0)).collect() == []


def brute_nearest(rows, queries, k, bits):
    codes = [(i, [x > 0 for x in v]) for i, v, _ in rows]
    return {q: sorted((sum(a != b for a, b in zip(own, code)), i) for i, code in codes if i != q)[:k] for q, own in codes if q in queries}


@pytest.mark.parametrize("k", [1, 10, 500])
def test_nearest_codes(spark, k):
    rows = clouds()
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in multi_index.nearest_codes(df, df.where("vec_id % 100 = 0"), bits=32, k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    wanted = brute_nearest(rows, {i for i, _, _ in rows if i % 100 == 0}, k, 32)
    assert {q: [(d, i) for _, d, i in sorted(v)] for q, v in got.items()} == wanted


def test_nearest_code_edges(spark):
    df = spark.createDataFrame(EDGE_VECTORS, VECTORS).withColumn("distance", F.lit("x"))
    got = multi_index.nearest_codes(df, df, bits=2, k=3).collect()
    assert {r["query_id"] for r in got} == {1, 2, 8, 9} and all(r["distance"] == 0 for r in got)
    assert multi_index.nearest_codes(df.limit(0), df.limit(0), bits=2).collect() == []


def test_nearest_codes_twin(spark):
    """The SQL twin on DuckDB gives the same rows."""
    import duckdb

    from plumbline.llm.queries import ORACLES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    cursor = con.execute(ORACLES["op9_multi_index"])
    names = [d[0] for d in cursor.description]
    got = QUERIES["op9_multi_index"](spark, SF_DIR).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_nearest_codes_with_a_value_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "HOT", 50)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64))
    x[:, :16] = 1.0  # one value of the first segment
    x[:300] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in multi_index.nearest_codes(df, df.where("vec_id % 4000 = 0"), bits=64, k=5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
    signs = x > 0
    for q in range(0, 20_000, 4000):
        far = (signs != signs[q]).sum(axis=1)
        assert got[q] == sorted((int(d), i) for i, d in enumerate(far) if i != q)[:5]

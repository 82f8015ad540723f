"""Personal data, secrets, mixing and the pipeline against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import edge_docs, empty_docs, long_text
from pyspark.sql import functions as F
from test_duplicates_and_search import brute_components
from test_packing_and_sharding import check_packing

import corpus_pipeline
from plumbline.llm import lang_mixture, markov_secrets, mixing, pii_crf
from plumbline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"

PERSONAL = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
SECRET = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
          re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def plain_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")),
             lambda m: 12 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PERSONAL) for m in p.finditer(text) if tests[k](m))


def plain_secrets(text):
    tests = [lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(SECRET) for m in p.finditer(text) if tests[k](m))


def written(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


@pytest.mark.parametrize("query, plain, kinds", [
    ("op3_skip_chain_pii", plain_personal, ["email", "ip", "card", "phone"]), ("op8_markov_secrets", plain_secrets, ["assign", "access", "hex"])])
def test_base_spans(spark, query, plain, kinds):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES[query](spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        spans = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(written(spans, kinds).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(kind == i for _, kind, _ in spans) for i in range(len(kinds))]
        assert set(written(spans, kinds).split(",")) <= set(r["spans"].split(","))


HARD = ["a@b.c._x@d.e", "@x.y a@b a@b.", "x@y.z@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 00255.1.1.1", "4111 1111-1111 1111, 4111111111111112",
        "+1 (415) 555-0100 +1((( +12345678", "é𝒳 mail: a.b@c.de und 𝒳 10.0.0.1", "9" * 3000 + "." + "1" * 3000, "a" * 5000 + "@", ""]


def test_hard_personal():
    for text in HARD:
        assert pii_crf.base_spans(text) == plain_personal(text)


HARD_SECRETS = ["secret=a token=abcdefgh", "secret=token : abcdefgh", "API_KEY = 'Zx9' apikey:\"Zx9yyyyy\" TOKEN=é", "AKIAKIA" + "A" * 12 + "B" * 9,
                "𝒳 é " + "0a" * 14 + " AKIA" + "Z9" * 9, "token=token=abcdef", "deadbeef" * 3 + "g" + "0" * 23, "", "password: " + "x" * 30]


def test_hard_secrets(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD_SECRETS)] + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["_base"]] for r in markov_secrets.candidates(df).collect()}
    assert got == {i: plain_secrets(t) for i, t in enumerate(HARD_SECRETS)} | {99: []}


def test_markov_models(spark):
    """Random strings without a keyword are found, long identifiers are not; the ratio equals a plain loop."""
    rng = np.random.default_rng(4)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    random = lambda n: "".join(rng.choice(letters, n))
    rows = [(i, f"the token={random(32)} and some_ordinary_identifier here") for i in range(300)]
    ordinary = " ".join(f"value{c}name{c}size" for c in letters)
    rows += [(1000 + i, f"{ordinary} {i}") for i in range(300)]
    rows += [(5000, f"hidden {random(40)} value"), (5001, "a valueAnameBsizeCnameDsize value")]
    found = markov_secrets.identifiers(markov_secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string")))
    ratios = markov_secrets.train(found)
    told = {r["doc_id"]: r["_spans"] for r in markov_secrets.with_spans(found, ratios).where("doc_id >= 1000").collect()}
    assert [s["kind"] for s in told[5000]] == [3] and told[5000][0]["end"] - told[5000][0]["start"] == 40
    assert all(not told[i] for i in told if i != 5000)
    wide = len(markov_secrets.ALPHABET)
    counts = np.full((wide, wide), 0.5)
    for _, text in rows[:300]:
        value = re.search("token=([A-Za-z0-9]+)", text)[1]
        for a, b in zip(value, value[1:]):
            counts[markov_secrets.ALPHABET.index(a), markov_secrets.ALPHABET.index(b)] += 1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    usual = np.full((wide, wide), 0.5)
    for _, text in rows[300:]:
        for word in re.findall(markov_secrets.IDENTIFIER, text):
            for a, b in zip(word, word[1:]):
                if a in markov_secrets.ALPHABET and b in markov_secrets.ALPHABET:
                    usual[markov_secrets.ALPHABET.index(a), markov_secrets.ALPHABET.index(b)] += 1
    assert np.allclose(np.array(ratios).reshape(wide, wide), logs - np.log(usual / usual.sum(axis=1, keepdims=True)), atol=1e-9)


def test_dotted_secrets(spark):
    """The parts of a JWT and of a dotted key are judged one by one; file names and hosts are left."""
    rng = np.random.default_rng(6)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    random = lambda n: "".join(rng.choice(letters, n))
    rows = [(i, f"the token={random(32)} and some_ordinary_identifier here") for i in range(300)]
    ordinary = " ".join(f"value{c}name{c}size" for c in letters)
    rows += [(1000 + i, f"{ordinary} {i} some_module_name internal-service-host") for i in range(300)]
    jwt = ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"]
    plain = "see some_module_name_size.internal-service-host.value_name_size too"
    rows += [(5000, f"Bearer {'.'.join(jwt)} end"), (5001, f"SG.{random(22)}.{random(43)} end"), (5002, plain)]
    got = {r["doc_id"]: r["text"] for r in markov_secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 5000").collect()}
    assert got == {5000: "Bearer [SECRET].[SECRET].[SECRET] end", 5001: "SG.[SECRET].[SECRET] end", 5002: plain}


def test_redaction(spark):
    rows = [(1, "see password: hunter2hunter2 and 𝒳 " + "0f" * 12 + " end"), (2, "clean text"), (3, None), (4, "")]
    got = {r["doc_id"]: r["text"] for r in markov_secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "see [SECRET] and 𝒳 [SECRET] end", 2: "clean text", 3: None, 4: ""}
    assert markov_secrets.redacted(empty_docs(spark)).collect() == []
    assert markov_secrets.redacted(edge_docs(spark)).count() == edge_docs(spark).count()


def test_many_hits(spark, monkeypatch):
    """Spans, overlaps and redaction of texts with up to thousands of hits, against plain Python; every free token counts as random."""
    monkeypatch.setattr(markov_secrets, "train", lambda found: [1.0] * len(markov_secrets.ALPHABET) ** 2)
    rng, letters = random.Random(5), "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789"
    pieces = [lambda: rng.randbytes(16).hex(), lambda: "token=" + "".join(rng.choices(letters, k=20)), lambda: "AKIA" + "Z9" * 10,
              lambda: "".join(rng.choices(letters, k=30)), lambda: "token=AKIA" + "B7" * 9 + rng.randbytes(14).hex(), lambda: "plain é 𝒳"]
    texts = [" ".join(rng.choice(pieces)() for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 130, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in markov_secrets.secret_spans(docs).collect():
        base = plain_secrets(texts[r["doc_id"]])
        assert [(s["start"], s["kind"], s["end"]) for s in r["_base"]] == base
        tokens = [m.span() for m in re.finditer(markov_secrets.TOKEN, texts[r["doc_id"]])]
        assert [(s["start"], s["end"]) for s in r["_tokens"]] == tokens
        free = {(a, b) for a, b in tokens if re.search("[A-Za-z]", texts[r["doc_id"]][a:b]) and not any(s < b and a < e for s, _, e in base)}
        added = [(s["start"], s["end"]) for s in r["_spans"] if s["kind"] == 3]
        assert added == sorted(free)
        assert [(s["start"], s["kind"], s["end"]) for s in r["_spans"] if s["kind"] < 3] == base
    spans = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["_spans"]) for r in markov_secrets.secret_spans(docs).collect()}
    for r in markov_secrets.redacted(docs).collect():
        out, at = [], 0
        for start, end in spans[r["doc_id"]]:
            if start >= at:
                out += [texts[r["doc_id"]][at:start], "[SECRET]"]
            at = max(at, end)
        assert r["text"] == "".join(out) + texts[r["doc_id"]][at:]


def test_skip_chain(spark):
    """A phone number given once in full and once without its sign: the skip edge carries the label over."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        number = "".join(map(str, rng.integers(0, 10, 11)))
        rows.append((i, f"call +{number} today or {number} later or +{number}, order {rng.integers(100, 999)} of the list"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii_crf.fit(docs)
    assert field.skip[4, 4] > field.skip[4, 0]
    text = "call +49301234567 now. " + "filler words " * 200 + "call 49301234567 later, order 77"
    base = pii_crf.base_spans(text)
    repeated = pii_crf.Graph(text, base)
    field.weights[:] = 0  # leave only what the edges say
    field.weights[0, 0], field.skip[:] = 1.0, np.where(np.eye(pii_crf.LABELS) > 0, 6.0, 0.0)
    assert (0, 1) in repeated.skip
    marginal = field.marginals(repeated)
    assert marginal[1, 4] > 0.9 and marginal[2, 0] > 0.3
    assert pii_crf.added_spans(text, base, field)[0][1] == 3


def test_marginals_of_a_tree():
    """On a chain message passing is exact: compare with the sum over all labelings."""
    rng = np.random.default_rng(1)
    graph = pii_crf.Graph("12 34 56", [])
    field = pii_crf.Field(rng.normal(size=(pii_crf.FEATURES, pii_crf.LABELS)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    unary = [field.weights[f].sum(axis=0) for f in graph.features]
    total = np.zeros((3, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                p = np.exp(unary[0][a] + unary[1][b] + unary[2][c] + field.chain[a, b] + field.chain[b, c])
                total[[0, 1, 2], [a, b, c]] += p
    assert np.allclose(field.marginals(graph), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_personal_edges(spark):
    docs = edge_docs(spark)
    rows = pii_crf.personal_data(docs, pii_crf.fit(docs)).collect()
    assert len(rows) == docs.count() and {r["spans"] for r in rows if r["doc_id"] in (3, 4, 5)} == {""}
    assert pii_crf.personal_data(empty_docs(spark), pii_crf.fit(empty_docs(spark))).collect() == []


def plain_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = {}, share * sum(sizes.values()), set(order)
    while True:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not above:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= above


def test_mixing(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op5_block_mixing"](spark, SF_DIR).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op5_block_mixing"](spark, SF_DIR).collect()))
    sizes, taken = Counter(), Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(mixing.WORD, d["text"] or "")) and r["taken"] <= 2 * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
    targets = plain_targets(sizes)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
    assert len(rows) == len(docs) and all(abs(taken[s] - t) <= 0.02 * t for s, t in targets.items())


def test_small_sources(spark):
    """Sources of 1 to 4000 words come near their targets: within 5 %, or half a word and rounding."""
    sizes = [1, 2, 3, 7, 20, 50, 64, 99, 100, 128, 129, 500, 1000, 4000]
    rows = [(100 * i + j, " ".join(["w"] * part), f"s{i:02d}") for i, n in enumerate(sizes) for j, part in enumerate(x for x in (n // 3, n - n // 3) if x)]
    got = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().collect()
    taken, targets = Counter(), plain_targets({f"s{i:02d}": n for i, n in enumerate(sizes)})
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[f"s{r['doc_id'] // 100:02d}"] += r["taken"]
    assert all(abs(taken[s] - t) <= max(0.05 * t, 0.5) for s, t in targets.items())


def test_permutation(spark):
    for size in (1, 2, 7, 1000):
        got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("long"), [F.lit(3), F.lit(1)]).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(size))
    assert [r["p"] for r in got] != list(range(size))


def test_assigned_slots(spark):
    """Slots per source are exact, epochs run through all blocks, and shards differ as draws do."""
    rows = [(i, " ".join(f"w{j}" for j in range(50)), "abcd"[i % 4]) for i in range(400)]
    mixture = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16, slots_per_shard=64)
    sources = {r["source_no"]: r for r in mixture.sources.collect()}
    by_source = defaultdict(list)
    for r in mixture.assigned.collect():
        by_source[r["source_no"]].append(r)
    for no, slots in by_source.items():
        assert sorted(r["index"] for r in slots) == list(range(sources[no]["slots"]))
        first = [r["block"] for r in slots if r["epoch"] == 0]
        assert len(set(first)) == len(first) and all(r["epoch"] <= 1 for r in slots)


def test_mixing_edges(spark):
    docs = edge_docs(spark)
    rows = mixing.Mixture(docs).taken().collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
    wanted = Counter()
    for r in rows:
        wanted[r["doc_id"]] += r["taken"]
    assert +taken == +wanted
    assert mixing.Mixture(empty_docs(spark)).taken().collect() == [] and mixing.mixed_documents(empty_docs(spark)).collect() == []


def test_pipeline(spark, tmp_path):
    """Every stage's decision against plain Python on the smallest table."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept.append([r.asDict() for r in docs.collect()])
        assert i == 4 or docs.columns == before.columns
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in kept[0]} >= {k for k, t in raw.items() if t and len(t) > 200 and t.isascii() is False}
    _, groups = brute_components({r["doc_id"]: r["text"] for r in kept[0]}, 5)
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(set(groups.values()))
    assert len(kept[2]) == len(kept[1])
    for r in kept[2]:
        assert r["n_chars"] == len(r["text"]) and not plain_secrets(r["text"])
        assert r["text"] == raw[r["doc_id"]] or "[SECRET]" in r["text"]
    sizes, taken = Counter(), Counter()
    for r in kept[2]:
        sizes[r["source"]] += len(re.findall(mixing.WORD, r["text"]))
    for r in kept[3]:
        taken[r["source"]] += len(re.findall(mixing.WORD, r["text"]))
    assert all(abs(taken[s] - t) <= 130 for s, t in plain_targets(sizes).items())
    assert sum(r["length"] for r in kept[4]) == sum(r["doc_tokens"] for r in kept[4] if r["start"] == 0)
    assert Counter(r["doc_id"] for r in kept[4] if r["start"] == 0) == Counter(r["doc_id"] for r in kept[3])


def test_documents_in_several_languages_stay(spark):
    """Three languages with a third of the text each: only texts without a language go."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) > 600")
    parts = {r["lang"]: r["text"][:600] for r in docs.where("lang is not null").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    text = " ".join(parts[k] for k in sorted(parts)[:3])
    added = spark.createDataFrame([(10 ** 9, text), (10 ** 9 + 1, "123 456 !"), (10 ** 9 + 2, None)], "doc_id long, text string")
    both = docs.unionByName(added, allowMissingColumns=True)
    told = lang_mixture.with_languages(both, lang_mixture.fit(both)).where(f"doc_id = {10 ** 9}").first()
    assert len(told["languages"]) >= 3 and told["score"] < 0.5
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, SF_DIR).where(f"doc_id >= {10 ** 9}").collect()}
    assert kept == {10 ** 9}


def test_pipeline_edges(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), SF_DIR).collect() == [], name
        assert stage(spark, edge_docs(spark), SF_DIR).collect() is not None


def test_tokens_of_long_unbroken_texts():
    """The tokens with a digit or an at-sign are those a pattern finds, and a text without blanks takes time in proportion."""
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab1@ \t\u3000\x1f漢") for _ in range(rng.randrange(60)))
        assert pii_crf.node_spans(text) == [m.span() for m in re.finditer(r"\S*[0-9@]\S*", text)]
    for text in ("漢" * 200_000, "漢" * 100_000 + "7" + "字" * 100_000, "a1" * 100_000):
        begin = time.perf_counter()
        pii_crf.Graph(text, pii_crf.base_spans(text))
        assert time.perf_counter() - begin < 1

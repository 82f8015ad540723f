"""URL verdicts, collocations and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import ROWS, edge_docs, empty_docs, long_text
from pyspark.sql import functions as F

from plumbline.llm import collocations, hard_negatives, phrase_trie, url_ratio
from plumbline.llm.queries import ORACLES, QUERIES, URL_RULES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op12_collocations", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    asked = db.execute(ORACLES[name])
    names = [d[0] for d in asked.description]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(asked.fetchall())


# URLs

def plain_verdict(url):
    """(host, path, rule, verdict or None) of a URL by the rules."""
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def plain_log_chances(urls, context, symbol):
    """Witten and Bell's mixture for one symbol after a context, by recursion over counts of strings."""
    padded = [[0] * url_ratio.ORDER + [int(url_ratio._PLACE[b]) for b in u.encode()] for u in urls]

    def chance(ctx):
        if ctx is None:
            return 1 / url_ratio.WIDE
        after = Counter(p[i] for p in padded for i in range(url_ratio.ORDER, len(p)) if tuple(p[i - len(ctx):i]) == ctx)
        shorter = chance(ctx[1:] if ctx else None)
        seen, kinds = sum(after.values()), len(after)
        return (after[symbol] + kinds * shorter) / (seen + kinds) if seen else shorter

    return math.log(chance(tuple(context)))


def test_models_equal_a_plain_recursion():
    urls = ["http://a.org/x1", "http://b.org/", "HTTP://a.org/é"]
    cell, _ = url_ratio.cells([u.encode() for u in urls])
    logs = url_ratio.smoothed(np.bincount(cell, minlength=url_ratio.CELLS))
    rng = random.Random(4)
    for _ in range(60):
        context = [rng.choice([0, 1, 8, 15, 20, int(url_ratio._PLACE[ord("/")])]) for _ in range(url_ratio.ORDER)]
        symbol = rng.randrange(1, url_ratio.WIDE)
        place = sum(s * url_ratio.WIDE ** (url_ratio.ORDER - i) for i, s in enumerate(context)) + symbol
        assert logs[place] == pytest.approx(plain_log_chances(urls, context, symbol), abs=1e-4)
    chances = np.exp(logs.astype(np.float64)).reshape(-1, url_ratio.WIDE).sum(axis=1)
    assert np.allclose(chances, 1, atol=1e-3)


def test_threshold_separates_best():
    rng = np.random.default_rng(2)
    good, bad = rng.integers(0, 4, url_ratio.BINS), rng.integers(0, 4, url_ratio.BINS)
    good[:2000], bad[2500:] = 0, 0
    edge = url_ratio.threshold_of(good, bad)
    edges = (np.arange(url_ratio.BINS + 1) * 2 / url_ratio.BINS - 1) * url_ratio.REACH
    gains = [good[i:].sum() / good.sum() - bad[i:].sum() / bad.sum() for i in range(url_ratio.BINS + 1)]
    assert gains[int(np.flatnonzero(edges == edge)[0])] == pytest.approx(max(gains))
    assert url_ratio.threshold_of(good * 0, bad) == 0.0


def test_urls_of_the_table(spark):
    rows = QUERIES["op11_url_ratio"](spark, SF_DIR).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_verdict(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_ratio_tells_urls_apart(spark):
    rng = random.Random(5)

    def url(kind):
        host = "".join(rng.choice("xzqkw") if kind else rng.choice("aeinrst") for _ in range(9))
        return f"https://{host}.example.net/p{rng.randrange(1000)}"

    pages = [(i, url(i % 2)) for i in range(600)]
    decided = spark.createDataFrame([(i, u, "block" if i % 2 else "allow") for i, u in pages[:400]], "page_id long, url string, decided string")
    model = url_ratio.fit(decided)
    rows = url_ratio.judged(spark.createDataFrame(pages[400:], "page_id long, url string"), [], model).collect()
    right = sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in rows)
    assert right >= 0.95 * len(rows)


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://ORG", "http://Sub.ORG/", "http://org?x=/", "http://xorg/", "ftp://example.org/es/1#a", "http://www.example.org/en/17",
            "http://example.org/en/2", "x://y://z.com/fr/", "http://a.com/fr/?q=/de/", "http://a.com/de/", "http://a.net/" + "ab/" * 70_000, "http://é.net/ü", "http://a.com/fr/", "http://a.com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    clashing = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "score", "verdict", "decided", "cell", "n", "html")})
    rows = {r["page_id"]: r for r in url_ratio.judged(clashing, URL_RULES).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_verdict(u)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert verdict is None or rows[i]["verdict"] == verdict
    assert rows[0]["verdict"] == rows[1]["verdict"] == "block"
    assert url_ratio.judged(pages.limit(0), URL_RULES).count() == 0
    undecided = url_ratio.judged(pages.where("page_id IN (0, 2, 6, 13)"), URL_RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in undecided} == {0: "block", 2: "allow", 6: "allow", 13: "allow"}


# phrases

def plain_collocations(rows, support, longest, most):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, held in counts.items():
        found = {p: a for p, a in held.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in found.items():
            inside = any(len(o) > len(p) and b >= a and any(o[i:i + len(p)] == p for i in range(len(o) - len(p) + 1)) for o, b in found.items())
            if not inside:
                score, k = min((1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def test_trie_counts_like_a_loop():
    rng = random.Random(8)
    words = [rng.getrandbits(63) + 1 for _ in range(60)]
    phrases = list({(lang, tuple(rng.choice(words[:40]) for _ in range(rng.randrange(2, 6)))) for lang in ("a", "b") for _ in range(700)})
    phrases += [("a", (words[0], w)) for w in words if ("a", (words[0], w)) not in phrases]
    trie = phrase_trie.Trie(phrase_trie.build(phrases))
    text = [rng.choice([*words, 0]) for _ in range(4000)] + [w for _, p in phrases[:300] for w in (*p, 0)]
    counts = np.zeros(len(phrases), np.int64)
    trie.count("a", np.array(text, np.int64), counts)
    for (lang, p), n in zip(phrases, counts.tolist(), strict=True):
        assert n == (sum(tuple(text[i:i + len(p)]) == p for i in range(len(text))) if lang == "a" else 0)
    trie.count("c", np.array(text, np.int64), counts)
    one = phrase_trie.Trie(phrase_trie.build([("x", (7, 7))]))
    counts = np.zeros(1, np.int64)
    one.count("x", np.array([7, 7, 7, 0, 7], np.int64), counts)
    assert counts.tolist() == [2]


@pytest.mark.parametrize("part", [500_000, 40])
def test_collocations_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(collocations, "PART", part)  # several tries, too
    monkeypatch.setattr(collocations, "HELD_KEYS", 3000)
    monkeypatch.setattr(collocations, "HELD_WORDS", 50)
    rng = random.Random(6)
    words = ["the", "The", "of", "new", "york", "stock", "été", "a\u00a0b", "x\x1cy", "\x00", "-", "ÀB"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randrange(0, 40)):
            text += rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"])
        rows.append((text + "new york stock exchange " * rng.randrange(3), rng.choice(["en", "en", "fr", None])))
    rows += [(None, "en"), ("", None), (" \n\t ", "fr"), (long_text(), "de"), *rows[:3]]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("x") for c in ("n", "words", "phrase", "hash", "key", "rank")})
    for support, most in ((8, 2000), (3, 5)):
        got = [tuple(r) for r in collocations.collocations(docs.repartition(5), support, 5, most).collect()]
        assert sorted(got) == sorted(plain_collocations(rows, support, 5, most))


def test_collocation_cases(spark):
    assert collocations.collocations(empty_docs(spark)).collect() == []
    assert collocations.collocations(edge_docs(spark), support=10_000).collect() == []
    got = [tuple(r) for r in collocations.collocations(edge_docs(spark), support=2).collect()]
    assert sorted(got) == sorted(plain_collocations([(text, lang) for _, text, lang, _, _ in ROWS], 2, 5, 2000))


def test_scores_past_64_bits(spark):
    big = 4 * 10 ** 11
    phrases = spark.createDataFrame([("x", ["a", "b"], big)], "lang string, words array<string>, f long")
    words = spark.createDataFrame([("x", "a", big + 1, 0), ("x", "b", big + 2, 0), ("x", "c", 9 * 10 ** 14, 0)], "lang string, word string, n long, z int")
    row = collocations.scored(phrases, words, 100, 10).first()
    n = 9 * 10 ** 14 + 2 * big + 3
    assert (row["n"], row["score"]) == (n, 1000 * big * n // ((big + 1) * (big + 2)))


# hard negatives

def plain_negatives(rows, every=50):
    """(anchor, positive, rank, negative, scores) by scoring all pairs in Python integers."""
    def number(x):
        return math.floor(256 * x) if abs(x) < 2.0 ** 53 else int(x) * 256

    fit = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit[i] = min(fit.get(i, (label, v)), (label, v))
    whole = {i: (label, [number(x) for x in v]) for i, (label, v) in fit.items()}
    out = []
    for i, (label, v) in whole.items():
        if i % every:
            continue
        scores = {o: sum(a * b for a, b in zip(v, w, strict=True)) for o, (_, w) in whole.items() if o != i and len(w) == len(v)}
        order = sorted(scores, key=lambda o: (-scores[o], o))
        for p in [o for o in order if whole[o][0] == label][:5]:
            low, high = 50 * scores[p], 95 * scores[p]
            hard = [o for o in order if whole[o][0] != label and low <= 100 * scores[o] <= high][:3]
            out += [(i, p, rank, o, scores[p], scores[o]) for rank, o in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns(
        {c: F.lit("x") for c in ("id", "block", "group", "score", "rank", "own", "length", "vector")})
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **more).collect())


def vectors(count, dims, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dims)) / 8
    x = np.round(x * grid) / grid if grid else x.astype(np.float32).astype(np.float64)
    return x.tolist()


@pytest.mark.parametrize("grid", [None, 4])  # a coarse grid makes many ties and zero components
def test_negatives_equal_brute_force(spark, monkeypatch, grid):
    monkeypatch.setattr(hard_negatives, "BLOCK", 120)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "STEP", 8)
    rows = [(i, v, (i * 7) % 5) for i, v in enumerate(vectors(900, 6, 3, grid))]
    assert mined(spark, rows) == plain_negatives(rows)


def test_access_stops_early():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, 3))
    x[:, 0] = rng.permutation(4000)
    lists = hard_negatives.SortedLists(np.arange(4000), np.zeros(4000, object), x)
    read = 0
    for rows, _, threshold in lists.walk(np.array([2.0, 0, 0])):
        read += len(rows)
        if threshold is not None and threshold < 2 * 256 * 3990:
            break
    assert read < 200
    best = lists.best(np.array([2.0, 0, 0]), np.ones(4000, bool), [(None, None), (None, 2 * 256 * 100)], 2)
    assert [s for s, _ in best[0]] == [2 * 256 * 3999, 2 * 256 * 3998] and best[1][0][0] == 2 * 256 * 100


def test_negative_cases(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.4], 1), (3, [0.6, 0.5], 2), (4, [0.6, 0.5], 2), (5, [0.1, -0.9], 3), (50, [-1.0, 0.0], 2),
            (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 2), (8, None, 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (10, [0.0, 0.0], 2), (100, [0.0, 0.0], 2),
            (11, [0.8], 1), (12, [0.7, 0.1, 0.1], 1), (13, [], 1), (150, [], 2), (3, [0.6, 0.5], 2), (0, [1.0, 0.5], 1), (4, [0.5, 0.5], 3), (14, [float("inf"), 0.0], 1)]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_extreme_components(spark):
    rows = [(i, [x * 10.0 ** (3 * (i % 4)), 1e-200, -x], i % 2) for i, (x,) in enumerate(vectors(60, 1, 9))]
    assert mined(spark, rows, "double") == plain_negatives(rows)
    huge = [(i, [2.0 ** (15 + i % 8), 0.75 - i, 3.0], i % 3) for i in range(60)]
    assert mined(spark, huge, "double") == plain_negatives(huge)
    past = [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e10, 1.0], 2)]
    assert mined(spark, past, "double") is not None

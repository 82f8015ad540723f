"""Near-duplicate documents by a chosen-path similarity join over word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.sizing import settle, small_batches
from plumbline.llm.common import bounded, components, slices

TREES = 10  # of the first round; documents that need more for TARGET get fresh ones
TARGET = 0.99  # least chance that a pair at the similarity is compared
FRESH = 96  # most fresh trees of a document; those below TARGET after them are compared whole
SHALLOW = 8  # tokens a fresh tree may branch by
TILE = 256  # documents of a node, about, that are compared whole with as many others in one step
SKETCH = 64  # minwise tokens of a document
WIDE = 512  # of one that is compared whole with others of its kind
SUBTREE = 4096  # documents a node may hold to be walked to its end in one task
NODE = 12  # documents a node may hold to be compared pair by pair
FIRST = 3  # minwise tokens before the pairs found so far are verified
DEPTH = 16  # minwise tokens a tree may branch by
DEPTHS = range(FIRST, SHALLOW + 1)  # at which a document's trees are counted
ALIKE = 38  # equal sketch bytes below which a pair is not verified: 4 deviations under 0.8
WIDE_ALIKE = 373  # the same of ``WIDE`` bytes
TIGHT = 58  # equal sketch bytes with the pivot from which on a member needs no further node of its tree
MEMO_WORDS = 150_000  # word hashes one worker keeps at a time


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


def shingle_set(text: str | None, words: int, memo: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z in lower case, words between ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    mixed = np.full(len(parts) - width + 1, width if width < words else 0, np.uint64)
    for i in range(width):
        mixed = (mixed ^ codes[i:len(codes) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minwise(shingles: np.ndarray, count: int = SKETCH, seed: int = 17) -> np.ndarray:
    """Per hash function the smallest image of any shingle: its minwise token."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 2048 * SKETCH // count)
    for at in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[at:at + step, None] * factor + shift).min(axis=0))
    return least


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: a hash of its text, n_shingles, a digest of its set, the first node of each tree, a byte of each minwise token."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tree = WordHashes(), np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in slices(batches):
            sizes, digests, roots, marks = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, words, memo)
                sizes.append(len(found))
                least = minwise(found) if len(found) else None
                digests.append(digest_of(found) if len(found) else None)
                roots.append(None if least is None else ((least[:TREES] ^ tree) * np.uint64(0xFF51AFD7ED558CCD)).view(np.int64))
                marks.append(None if least is None else ((least * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(roots, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "roots", "marks"])

    slim = located(docs)
    return slim.mapInArrow(sketch, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, "
                                   "digest binary, roots array<long>, marks binary")


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash of the text, which together find a row again whether or not its id is null or repeated."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def texts_of(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """The texts that stand for the classes ``wanted`` (class_id, rep_id, rep_hash, ...): once for each repeat of the row."""
    return located(docs).join(bounded(wanted, rows), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))


def equal_marks(pairs: DataFrame) -> DataFrame:
    """Add ``alike``, the number of equal bytes of marks_a and marks_b, and drop the marks."""
    kept = [c for c in pairs.columns if c not in ("marks_a", "marks_b")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("marks_a", "marks_b"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array((left == right).sum(axis=1).astype("int32"))],
                                             names=[*kept, "alike"])

    fields = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in kept)
    return pairs.mapInArrow(count, f"{fields}, alike int")


def fresh_paths(docs: DataFrame, need: DataFrame, rows: int, words: int) -> DataFrame:
    """(class_id, tree, node, path): ``need`` fresh trees of each document, a token for each tree and depth.

    ``node`` is the first node and ``path`` a byte of the token of every depth; no token is used twice.
    """
    texts = texts_of(docs, need, rows).select("class_id", "text", "need")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, tree = WordHashes(), np.arange(1, FRESH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in slices(batches):
            roots, paths = [], []
            for text, trees in zip(batch.column("text").to_pylist(), batch.column("need").to_pylist(), strict=True):
                tokens = np.concatenate([minwise(shingle_set(text, words, memo), SHALLOW, 1000 + t)[None] for t in range(trees)])
                roots.append(((tokens[:, 0] ^ tree[:trees]) * np.uint64(0xFF51AFD7ED558CCD)).view(np.int64))
                paths.append([p.tobytes() for p in ((tokens * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(56)).astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(roots, pa.list_(pa.int64())), pa.array(paths, pa.list_(pa.binary()))],
                                             names=["class_id", "roots", "paths"])

    drawn = texts.mapInArrow(sketch, "class_id binary, roots array<long>, paths array<binary>")
    return drawn.dropDuplicates(["class_id"]).select("class_id", F.posexplode(F.arrays_zip("roots", "paths")).alias("tree", "z")).select(
        "class_id", "tree", F.col("z.roots").alias("node"), F.col("z.paths").alias("path"))


def token_order(tree: int) -> list[int]:
    """Which minwise tokens a tree of the first round branches by."""
    return np.random.default_rng(100 + tree).permutation(SKETCH)[:DEPTH].tolist()


def worth(one: np.ndarray, two: np.ndarray, component: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows differ in component and have alike sketches."""
    near = component[one] != component[two]
    near[near] = (marks[one[near]] == marks[two[near]]).sum(axis=1) >= ALIKE
    return near


def small_pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows (node, class_id, component, marks) of one node, at most ``NODE`` of them, that are worth comparing."""
    held = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("class_id", "component", "marks"))).alias("held")).select("held")
    kind = rows.schema["class_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            lists = batch.column("held")
            ids, component, marks = lists.flatten().flatten()
            component = component.dictionary_encode().indices.to_numpy()
            marks = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, SKETCH)
            sizes = lists.value_lengths().to_numpy()
            begins = np.cumsum(sizes) - sizes
            met = [(begins[sizes == n][:, None, None] + np.stack(np.triu_indices(n, 1))).transpose(1, 0, 2).reshape(2, -1) for n in np.unique(sizes)]
            one, two = np.concatenate(met, axis=1) if met else np.zeros((2, 0), np.int64)
            near = worth(one, two, component, marks)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(one[near])), ids.take(pa.array(two[near]))], names=["a", "b"])

    return held.mapInArrow(compare, f"a {kind}, b {kind}")


def subtree(members: pd.DataFrame, first: int, last: int, names: list[str]) -> pd.DataFrame:
    """All that ``walk`` finds below one node, in the columns ``names``: pairs (kind 0), stays (1) and rows that are left (2)."""
    members = members.sort_values("class_id", ignore_index=True)
    tree, count = int(members["tree"].iloc[0]), len(members)
    marks = np.frombuffer(b"".join(members["marks"]), np.uint8).reshape(count, SKETCH)
    if "path" in members:
        tokens = np.frombuffer(b"".join(members["path"]), np.uint8).reshape(count, -1)[:, 1:]
    else:
        tokens = marks[:, token_order(tree)]
    ids, component = members["class_id"].to_numpy(object), pd.factorize(members["component"])[0]  # objects: whole numbers stay whole beside nulls
    members = members.astype(object)
    pairs, stays, left = [], [], []
    waiting = [(np.arange(count), first, int(members["node"].iloc[0]))]
    while waiting:
        rows, depth, node = waiting.pop()
        if len(rows) <= NODE:
            one, two = (rows[x] for x in np.triu_indices(len(rows), 1))
            near = worth(one, two, component, marks)
            pairs.append((one[near], two[near]))
            continue
        pivot = rows[node % len(rows)]
        alike = (marks[rows] == marks[pivot]).sum(axis=1)
        star = rows[(alike >= ALIKE) & (component[rows] != component[pivot])]
        pairs.append((np.minimum(star, pivot), np.maximum(star, pivot)))
        if alike.min() >= TIGHT or (component[rows] == component[rows[0]]).all():
            continue
        stays.append((rows, depth))
        step = tokens[rows, depth - 1] if depth <= tokens.shape[1] else np.zeros(len(rows), np.uint8)
        for value in np.unique(step).tolist():
            below, code = rows[step == value], hash((node, depth, value))
            if depth == last:
                left.append((below, code))
            elif len(below) > 1:
                waiting.append((below, depth + 1, code))
    parts = [pd.DataFrame({"kind": 0, "a": ids[x], "b": ids[y]}) for x, y in pairs if len(x)]
    parts += [pd.DataFrame({"kind": 1, "class_id": ids[x], "depth": np.full(len(x), d, object)}) for x, d in stays]
    for x, code in left:
        held = members.iloc[x].assign(kind=2, node=np.full(len(x), code, object))
        parts.append(held[[c for c in names if c in held]])
    return pd.concat(parts).reindex(columns=names) if parts else members.iloc[:0].reindex(columns=names)


def walker(first: int, last: int, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def below(members: pd.DataFrame) -> pd.DataFrame:
        return subtree(members, first, last, names)
    return below


def walk(rows: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Branch the nodes of all trees by one minwise token after the other.

    ``rows`` holds (tree, node, class_id, component, marks), component being what the document is known to
    hang together with; with a column ``path`` it branches by that instead of the marks.  Returns the pairs
    to compare, (a, b), the rows of nodes that are still large after the last token, and the
    (class_id, depth) of all rows in nodes that were large and branched on at that depth.  A node of at most ``NODE`` documents is compared
    pair by pair.  In a larger one every document is compared with a pivot; unless all
    of them nearly equal it or hang together already, the node branches on with all its documents.
    Below a node of at most ``SUBTREE`` documents this happens in one task; only larger ones take Spark's rounds.
    Pairs of one component or with sketches that are not alike are dropped where they meet.
    """
    order = [token_order(t) for t in range(TREES)]
    fresh = [c for c in rows.columns if c == "path"]
    own = ["tree", "node", "class_id", "component", "marks", *fresh]
    kind = rows.schema["class_id"].dataType.simpleString()
    fields = {"kind": "int", "a": kind, "b": kind, "depth": "int"} | {c: t for c, t in rows.dtypes if c in own}
    small, pairs, stays, rest = [], [], [], []
    for depth in range(first, last + 1):
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(
            F.xxhash64("class_id", "node").alias("h"), F.col("class_id").alias("id"), F.col("marks").alias("marks"), F.col("component").alias("component"))).alias("p")).where("n > 1")
        level = settle(rows.join(nodes, "node").select(*own, "n", F.col("p.id").alias("pivot"),
                                                      F.col("p.component").alias("pivot_component"), F.col("p.marks").alias("marks_b")))
        small.append(level.where(F.col("n") <= NODE).select("node", "class_id", "component", "marks"))
        below = settle(level.where((F.col("n") > NODE) & (F.col("n") <= SUBTREE)).select(*own).groupBy("node").applyInPandas(
            walker(depth, last, list(fields)), ", ".join(f"{c} {t}" for c, t in fields.items())))
        pairs.append(below.where("kind = 0").select("a", "b"))
        stays.append(below.where("kind = 1").select("class_id", "depth"))
        rest.append(below.where("kind = 2").select(*own))
        byte = F.substring("path", depth + 1, 1) if fresh else F.substring(
            "marks", F.element_at(F.array(*[F.lit(o[depth - 1] + 1) for o in order]), F.col("tree") + 1), F.lit(1))
        rows = level.where(F.col("n") > SUBTREE)
        if rows.isEmpty():
            break
        large = settle(equal_marks(rows.select(*own, "pivot", "pivot_component", F.xxhash64("node", byte).alias("next"), F.col("marks").alias("marks_a"), "marks_b")))
        pairs.append(large.where((F.col("alike") >= ALIKE) & (F.col("component") != F.col("pivot_component"))).select(
            F.least("class_id", "pivot").alias("a"), F.greatest("class_id", "pivot").alias("b")))
        loose = large.groupBy("node").agg(F.min("alike").alias("least"), F.min("component").alias("c"), F.max("component").alias("d")).where(
            (F.col("least") < TIGHT) & (F.col("c") != F.col("d"))).select("node")
        rows = settle(large.join(loose, "node", "left_semi").select("tree", F.col("next").alias("node"), "class_id", "component", "marks", *fresh))
        stays.append(rows.select("class_id", F.lit(depth).alias("depth")))
        if depth == last:
            rest.append(rows.select(*own))
    small, pairs, rest = (united(x) for x in (small, pairs, rest))
    return small_pairs(small).unionByName(pairs).distinct(), (None if rest.isEmpty() else rest), stays


def united(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def with_need(seen: DataFrame, percent: int) -> DataFrame:
    """Add ``need``, the trees a document lacks for TARGET, to (class_id, trees, stay_d for every depth d of DEPTHS).

    A pair meets in a small node of a tree when it shares d tokens (probability J^d at least) and the node
    is small by then.  So the chance is at least J^d less the share of the document's trees that are
    still large after d tokens, at whichever d this is best; null needs stand for a chance of none.
    """
    chance = F.greatest(*[F.lit((percent / 100) ** d) - (F.col(f"stay_{d}") + 0.5) / (F.col("trees") + 1) for d in DEPTHS])
    return seen.withColumn("need", F.when(chance > 0, F.ceil(math.log(1 - TARGET) / F.log(1 - chance)) - F.col("trees")))


def counted(stays: list[DataFrame]) -> DataFrame:
    """(class_id, stay_d for every depth d of DEPTHS): trees in which the document's node was still large after d tokens."""
    return united(stays).groupBy("class_id").agg(*[F.count_if(F.col("depth") == d).alias(f"stay_{d}") for d in DEPTHS])


def wide_marks(docs: DataFrame, wanted: DataFrame, rows: int, words: int) -> DataFrame:
    """(class_id, marks): bytes of ``WIDE`` minwise tokens of each of these classes."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            ids, marks = [], []
            for own, text in zip(batch.column("class_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingle_set(text, words, memo)
                if digest_of(found) == own:  # not another text with the hash
                    ids.append(own)
                    marks.append(((minwise(found, WIDE, 23) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(marks, pa.binary())], names=["class_id", "marks"])

    return texts_of(docs, wanted, rows).select("class_id", "text").mapInArrow(sketch, "class_id binary, marks binary").dropDuplicates(["class_id"])


def whole_pairs(rows: DataFrame, least: int = ALIKE) -> DataFrame:
    """All pairs of rows (node, class_id, component, marks) of a node that differ in component and have ``least`` equal bytes of marks.

    Nodes are cut into tiles by hash; two tiles meet in one row, and only pairs with alike sketches leave it.
    """
    sized = rows.join(rows.groupBy("node").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.min("component").alias("c"),
                                               F.max("component").alias("d")).where("c != d").select("node", "tiles"), "node")
    tiles = sized.groupBy("node", "tiles", F.pmod(F.xxhash64(F.lit("tile"), "class_id"), F.col("tiles")).alias("tile")).agg(
        F.collect_list(F.struct("class_id", "component", "marks")).alias("held"))
    # each tile goes once to every other of its node: a row per pair of tiles, dealt by the pair
    other = tiles.select("node", "tile", "held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("o"))
    left = other.where("tile <= o").select("node", F.col("tile").alias("lo"), F.col("o").alias("hi"), F.col("held").alias("left"))
    right = other.where("tile >= o").select("node", F.col("o").alias("lo"), F.col("tile").alias("hi"), F.col("held").alias("right"))
    met = left.join(right, ["node", "lo", "hi"]).select("left", "right")
    kind = rows.schema["class_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            one, two = batch.column("left").to_pylist()[0], batch.column("right").to_pylist()[0]
            marks = np.frombuffer(b"".join(r["marks"] for r in two), np.uint8).reshape(len(two), -1)
            firsts, seconds = [], []
            for r in one:
                for i in np.flatnonzero((marks == np.frombuffer(r["marks"], np.uint8)).sum(axis=1) >= least).tolist():
                    if two[i]["component"] != r["component"]:
                        firsts.append(min(r["class_id"], two[i]["class_id"]))
                        seconds.append(max(r["class_id"], two[i]["class_id"]))
            yield pa.RecordBatch.from_arrays([pa.array(firsts, batch.schema.field("left").type.value_type.field("class_id").type),
                                              pa.array(seconds, batch.schema.field("left").type.value_type.field("class_id").type)], names=["a", "b"])

    return met.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def tested(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs, alike in sketch already, whose sizes allow the similarity."""
    left = reps.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"))
    right = reps.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity; sets are built anew for these classes only."""
    ids = settle(pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct())
    texts = texts_of(docs, reps.select("class_id", "rep_id", "rep_hash").join(ids, "class_id", "left_semi"), ids.count())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            own, found = batch.column("class_id").to_pylist(), [shingle_set(t, words, memo) for t in batch.column("text").to_pylist()]
            true = [i for i, f in enumerate(found) if digest_of(f) == own[i]]  # not another text with the hash
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in true], pa.binary()),
                                              pa.array([found[i].view(np.int64) for i in true], pa.list_(pa.int64()))], names=["id", "shingles"])

    full = settle(texts.select("class_id", "text").mapInArrow(sets, "id binary, shingles array<long>").dropDuplicates(["id"]))
    both = (pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(full.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).where(
        100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b").distinct()


def linked_classes(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the classes that link, from ``TREES`` trees and fresh ones up to ``TARGET``.

    After ``FIRST`` tokens the pairs found so far are verified; a large node whose documents are all
    connected by then is done.  Only the others branch on, up to ``DEPTH`` tokens, and what is still
    large then is compared with all of its node outside the own component.  A document whose nodes stay
    large so long that a pair may be lost gets fresh trees, and only as many as ``with_need`` says; a pair
    is safe when one of its documents is.  Those that ``FRESH`` of them do not bring to ``TARGET`` are compared with all others of the kind in their nodes of ``FIRST`` tokens, where a pair
    meets with probability 1 - (1 - J^FIRST)^TREES.
    """
    def link(pairs: DataFrame) -> DataFrame:
        return settle(verified(docs, reps, settle(tested(pairs, reps, percent)), words, percent))

    roots = reps.select("class_id", F.posexplode("roots").alias("tree", "node"))
    shared = roots.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    rows = roots.join(shared, "node", "left_semi").join(reps.select("class_id", "marks"), "class_id").select(
        "tree", "node", "class_id", F.col("class_id").alias("component"), "marks")
    pairs, rest, _ = walk(rows, 1, FIRST)
    links = link(pairs)
    linked = settle(components(links))
    if rest is None:
        return linked
    placed = linked.select(F.col("id").alias("class_id"), "component")
    known = rest.drop("component").join(placed, "class_id", "left").select(
        "tree", "node", "class_id", F.coalesce("component", "class_id").alias("component"), "marks")
    mixed = known.groupBy("node").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("node")
    rest = settle(known.join(mixed, "node", "left_semi"))
    if rest.isEmpty():
        return linked
    large = rest
    pairs, rest, stays = walk(rest, FIRST + 1, DEPTH)
    if rest is not None:
        pairs = pairs.unionByName(whole_pairs(rest)).distinct()

    def placed_rows(rows: DataFrame) -> DataFrame:
        return rows.join(linked.select(F.col("id").alias("class_id"), "component"), "class_id", "left").withColumn(
            "component", F.coalesce("component", "class_id"))

    links = links.unionByName(link(pairs))
    linked = settle(components(links))
    stays.append(large.select("class_id", F.lit(FIRST).alias("depth")))
    seen = counted(stays).withColumn("trees", F.lit(TREES).cast("long"))
    seen = settle(with_need(seen, percent).where("need > 0 or need is null").withColumn("need", F.least(F.coalesce("need", F.lit(FRESH)), F.lit(FRESH)).cast("int")))
    n = seen.count()
    if n < 2:
        return linked
    paths = fresh_paths(docs, reps.select("class_id", "rep_id", "rep_hash").join(seen.select("class_id", "need"), "class_id"), n, words)
    pairs, _, stays = walk(settle(placed_rows(paths.join(reps.select("class_id", "marks"), "class_id"))), 1, SHALLOW)
    links = links.unionByName(link(pairs))
    linked = settle(components(links))
    more = counted([*stays, seen.select("class_id", F.lit(0).alias("depth"))])
    counts = [f"stay_{d}" for d in DEPTHS]
    seen = seen.join(more.select("class_id", *[F.col(c).alias(f"more_{c}") for c in counts]), "class_id").select(
        "class_id", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in counts], (F.col("trees") + F.col("need")).alias("trees"))
    left = settle(with_need(seen, percent).where("need > 0 or need is null").select("class_id"))
    n = left.count()
    if n < 2:
        return linked
    wide = wide_marks(docs, reps.select("class_id", "rep_id", "rep_hash").join(bounded(left, n), "class_id", "left_semi"), n, words)
    pairs = whole_pairs(placed_rows(large.drop("component", "marks").join(settle(wide), "class_id")), WIDE_ALIKE)
    return components(links.unionByName(link(settle(pairs))))


def grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, n_shingles, digest), and the classes that have copies or links: (d, first).

    Classes are keyed by the digest of their set, so neither a null id nor one with several texts mixes
    them.  ``first`` is the group's row of smallest id (rows without an id come last) and text hash.
    """
    with small_batches(docs.sparkSession):
        table = settle(sketches(docs, words))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = settle(table.where(F.col("digest").isNotNull()).groupBy(F.col("digest").alias("class_id")).agg(
        smallest.alias("first"), F.count("*").alias("copies")))
    wanted = classes.select("class_id", F.col("first.doc_id").alias("rep_id"), F.col("first.text_hash").alias("rep_hash"))
    reps = settle(table.join(wanted, (F.col("digest") == F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
                             & (F.col("text_hash") == F.col("rep_hash")))
                  .select("class_id", "rep_id", "rep_hash", "n_shingles", "roots", "marks").dropDuplicates(["class_id"]))
    linked = settle(linked_classes(docs, reps, words, percent))
    known = classes.join(linked, F.col("class_id") == F.col("id"), "left")
    firsts = known.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("first").alias("group_first"))
    placed = known.where("copies > 1 or component is not null").join(firsts, F.col("component") == F.col("c"), "left").select(
        F.col("class_id").alias("d"), F.coalesce("group_first", "first").alias("first"))
    return table.select("doc_id", "text_hash", "n_shingles", "digest"), settle(placed)


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows with equal sets are one class, so a large group of copies costs one pre-aggregated key; only
    classes enter the trees.  Links are confirmed on full sets, and component_id is the smallest id
    reachable over them.  A text without words links with nothing.  Every row counts by its own text, also
    where its id is null or repeated; a row without an id is kept only if no row of its group has one.
    Extra columns are ignored.
    """
    table, placed = grouped(docs, words, percent)
    joined = table.join(bounded(placed, placed.count(), 200_000), F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every group of near copies: the smallest id (null ids last), then text hash.

    It is decided row by row: of rows with one id only those go whose own text is a copy.  Of rows equal in
    id and text one stays, by a hash of all its columns.  Texts without words all stay.
    """
    table, placed = grouped(docs, words, percent)
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    met = settle(table.join(bounded(placed, placed.count(), 200_000), F.col("digest") == F.col("d")).groupBy(
        F.col("doc_id").alias("__copy_id"), F.col("text_hash").alias("__copy_hash"), own.alias("own")).agg(F.count("*").alias("rows")))
    gone, repeated = (met.where(c).select("__copy_id", "__copy_hash") for c in ("not own", "own and rows > 1"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__copy_id")) & (F.col("__text_hash") == F.col("__copy_hash"))
    left = marked.join(bounded(gone, gone.count()), same, "left_anti")
    n = repeated.count()
    if n == 0:
        return left.select(*columns)
    one = left.join(bounded(repeated, n), same, "left_semi").groupBy("doc_id", "__text_hash").agg(
        F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns)))).alias("__row")).select("__row.*")
    return left.join(bounded(repeated, n), same, "left_anti").select(*columns).unionByName(one)

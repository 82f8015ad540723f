"""Mixing sources to target weights: fixed-length blocks, multinomial shards, permuted block indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.sizing import settle
from plumbline.llm.common import bounded, numbered, running_before

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
ROUNDS = 12  # of the index permutation
CELLS = 1024  # parts of the unit interval by which draws find their source
SLOTS_PER_TASK = 200_000
SPREAD = 20_000  # most tasks that draw out slots
BUCKETS = 1024  # parts in which a source's documents are numbered
LEAST_BLOCKS = 64  # blocks that a target is made of at least, if it has as many words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_no, source_size, target.

    Targets share ``share`` times all sizes by weight and stop at ``most`` times the source's size;
    the excess is shared again until none is above.  Sources in the order of ``most * size / weight``
    are the ones that stop first, so one running sum finds the level at which the rest share.
    Windows without a partition run over one row per source.
    """
    ordered = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    limits = ordered.withColumns({"weight": weight, "limit": most * F.col("source_size")}).withColumn(
        "level", F.col("limit") / F.col("weight"))
    before = Window.orderBy("level", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    share_level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    place = F.struct("level", "source_no")
    levels = limits.withColumns({"share_level": share_level, "place": place})
    level = F.min_by(F.col("share_level"), F.when(F.col("level") > F.col("share_level"), F.col("place"))).over(every)
    return levels.withColumn("rest", level).select("source", "source_no", "source_size", F.when(
        F.col("rest").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("rest"))).alias("target"))


def permuted(index: Column, size: Column, seed: list[Column], rounds: int = ROUNDS) -> Column:
    """Swap-or-not permutation of 0 .. size - 1 (Hoang, Morris and Rogaway, 2012), keyed by ``seed``.

    In each round an index and its mirror image around a keyed point swap places or do not, as a hash
    of the larger of the two says; every round is a bijection for any size.
    """
    def step(at: Column, turn: Column) -> Column:
        mirror = (F.pmod(F.xxhash64(turn, *seed), size) + size - at) % size
        return F.when(F.pmod(F.xxhash64(F.greatest(at, mirror), turn, *seed), F.lit(2)) == 1, mirror).otherwise(at)
    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index, step)


class Mixture:
    """A mix of documents (doc_id, text, source) in blocks of a fixed length for each source.

    The length is ``block`` words, less where the target holds fewer than ``LEAST_BLOCKS`` of them and
    one word at least, so a source of any size comes within three halves of a 64th of its target or
    half a word, whichever is more.  ``sources`` has one row per source with its target; ``assigned`` one row per slot of the mix
    (output shard, source, index, epoch, block); ``pieces`` one row per document and block it
    touches (begin and length in words, ``times`` the mix takes the block).  A null text has no
    words; null is a source of its own, the last.  Repeated rows count as often as they occur.
    Everything is drawn by seeded hashes: reruns agree.
    """

    def __init__(self, docs: DataFrame, block: int = 128, slots_per_shard: int = 16384, seed: int = 7,
                 share: float = 1.5, most: int = 2) -> None:
        spark = docs.sparkSession
        sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                   F.xxhash64("text").alias("text_hash")))
        targets = target_sizes(sized, share, most)
        # in blocks: a source whose last block is short needs more of them for the same words
        sources = targets.withColumn("block_size", F.expr(
            f"cast(greatest(least({block}, floor(target / {LEAST_BLOCKS})), 1) as long)")).withColumn(
            "blocks", F.expr("cast(ceil(source_size / block_size) as long)")).withColumn(
            "slots", F.least(most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.greatest(
                F.col("source_size"), F.lit(1))).cast("long")))
        self.sources = settle(sources.withColumn("first", F.coalesce(F.sum("slots").over(
            Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
        count, slots = self.sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
        small = bounded(self.sources, count)
        self.assigned = self._assign(spark, small, count, slots, slots_per_shard, seed)
        placed = sized.join(small.select(F.col("source").alias("_source"), "source_no", "block_size"),
                            F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        order = ["doc_id", "size", "text_hash"]
        self.placed = settle(numbered(placed.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(BUCKETS))),
                                      ["source_no"], "_part", order, "begin", "size").drop("_part"))
        times = self.assigned.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        last = F.expr("(begin + size - 1) div block_size")
        touched = (self.placed.where("size > 0").select(
            "source_no", "begin", "size", "block_size", F.explode(F.sequence(F.expr("begin div block_size"), last)).alias("block"))
            .withColumn("from", F.expr("greatest(block * block_size - begin, 0)"))
            .withColumn("words", F.expr("least((block + 1) * block_size - begin, size)") - F.col("from")))
        self.pieces = touched.join(times, ["source_no", "block"]).select(
            "source_no", "begin", "from", "words", "times")

    @staticmethod
    def _assign(spark, sources: DataFrame, count: int, slots: int, slots_per_shard: int, seed: int) -> DataFrame:
        """Draw every slot's source independently, so counts per shard are multinomial; then settle the totals.

        A source drawn more often than its target hands its last slots to the sources drawn too
        seldom, so each source gets its number of blocks exactly and none is taken more than it may.
        """
        cells = sources.where("slots > 0").select("source_no", "first", "slots", F.explode(F.sequence(
            F.expr(f"first * {CELLS} div {max(slots, 1)}"), F.expr(f"(first + slots - 1) * {CELLS} div {max(slots, 1)}"))).alias("cell"))
        drawn = spark.range(slots).select(
            F.expr(f"id div {slots_per_shard}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(slots, 1))).alias("u"))
        draws = settle(drawn.withColumn("cell", F.expr(f"u * {CELLS} div {max(slots, 1)}")).join(
            bounded(cells, count + CELLS), "cell").where("u >= first and u < first + slots")
            .groupBy("shard", "source_no").agg(F.count("*").alias("n")))
        totals = (sources.where("slots > 0").select("source_no", "slots", "blocks")
                  .join(draws.groupBy("source_no").agg(F.sum("n").alias("drawn")), "source_no", "left")
                  .withColumn("over", F.coalesce("drawn", F.lit(0)) - F.col("slots")))
        over_before = running_before(F.greatest("over", F.lit(0)), [], ["source_no"])
        short_before = running_before(F.greatest(-F.col("over"), F.lit(0)), [], ["source_no"])
        totals = bounded(settle(totals.withColumns({"over_before": over_before, "short_before": short_before})), count)
        # the counts are few rows, the slots many: spread them before they are drawn out
        spread = min(SPREAD, slots // SLOTS_PER_TASK + 1)
        slot = (draws.withColumn("base", running_before(F.col("n"), ["source_no"], ["shard"])).repartition(spread, "shard", "source_no")
                .select("shard", "source_no", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("index"))
                .join(totals, "source_no"))
        kept = slot.where("index < slots").select("shard", "source_no", "index", "blocks")
        spare = slot.where("index >= slots").select("shard", (F.col("over_before") + F.col("index") - F.col("slots")).alias("rank"))
        lacking = totals.where("over < 0").select("source_no", "blocks", "short_before", "slots", "over", F.explode(
            F.sequence(F.lit(0), -F.col("over") - 1)).alias("t")).select(
            "source_no", "blocks", (F.col("short_before") + F.col("t")).alias("rank"), (F.col("slots") + F.col("over") + F.col("t")).alias("index"))
        filled = spare.join(lacking, "rank").select("shard", "source_no", "index", "blocks")
        epoch = F.expr("index div blocks")
        return kept.unionByName(filled).withColumn("epoch", epoch).select(
            "shard", "source_no", "index", "epoch",
            permuted(F.col("index") % F.col("blocks"), F.col("blocks"), [F.col("source_no"), F.col("epoch"), F.lit(seed)]).alias("block"))

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken."""
        taken = self.pieces.groupBy("source_no", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        targets = self.sources.select("source_no", "source_size", "target")
        sized = self.placed.join(bounded(targets, self.sources.count(), 100_000), "source_no")
        key = F.when(F.col("size") > 0, F.col("begin"))  # a document without words shares its place with the next
        return sized.withColumn("at", key).join(
            taken.select(F.col("source_no").alias("s"), F.col("begin").alias("b"), "taken"),
            (F.col("source_no") == F.col("s")) & (F.col("at") == F.col("b")), "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: one per document and pass that takes words of it, with the words taken as text.

    A pass that takes the whole document keeps its text as it is; otherwise the taken words follow
    one another, joined by spaces.  A document of which nothing is taken, or without words, has no row.
    """
    mixture = Mixture(docs, **options)
    takes = (mixture.pieces.groupBy("source_no", "begin").agg(
        F.sort_array(F.collect_list(F.struct("from", "words", "times"))).alias("_takes"), F.max("times").alias("_most"))
        .join(mixture.placed.where("size > 0").select("doc_id", "source", "text_hash", "size", "source_no", "begin"), ["source_no", "begin"])
        .select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_text_hash"),
                F.col("size").alias("_size"), "_takes", F.explode(F.sequence(F.lit(1).cast("long"), "_most")).alias("_pass")))
    repeated = settle(mixture.placed.groupBy("doc_id", "source", "text_hash").agg(F.count("*").alias("_n")).where("_n > 1").select(
        F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_text_hash")))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_text_hash"))
    n = repeated.count()
    if n:  # rows alike in all of this stand once, and each of their places in the stream is joined to that row
        few = bounded(repeated, n)
        keyed = keyed.join(few, same, "left_anti").unionByName(
            keyed.join(few, same, "left_semi").dropDuplicates(["doc_id", "source", "_hash"]))
    taken = F.filter("_takes", lambda t: t["times"] >= F.col("_pass"))
    whole = F.aggregate(taken, F.lit(0).cast("long"), lambda s, t: s + t["words"]) == F.col("_size")
    cut = F.array_join(F.flatten(F.transform(taken, lambda t: F.slice(
        F.col("_words"), (t["from"] + 1).cast("int"), t["words"].cast("int")))), " ")
    return (keyed.join(takes, same).withColumn("_whole", whole)
            .withColumn("_words", F.when(~F.col("_whole"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
            .withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(cut))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))

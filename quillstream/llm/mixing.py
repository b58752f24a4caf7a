"""Mixing sources to target weights.

The words of a source, its documents one after another in a hashed order, form
one stream that is cut into blocks of a fixed number of words. A source's target
gives its number of slots; a multinomial draw per source deals these slots to the
output shards, and slot k of a source takes block perm(k mod blocks), with another
pseudorandom permutation in each pass over the blocks. So no block is taken once
more than another before all have been, and blocks are found by joining on
(source, block).

Positions come from three levels of sums (shelves of 1,024 hash buckets of a source, buckets, documents of
a bucket), so a source with a third of all rows is spread over many tasks. Slots are drawn in two levels, groups of `GROUP` shards and
their shards, and made in as many tasks as their number asks for.

Null texts have size 0 and are taken 0 words; a null source is a source of its own
and comes last. Repeated rows count as documents of their own. An empty table gives
an empty result. Columns besides id, text and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, Scratch, mix

WEIGHTS = (5, 2, 1)
#: Shards whose slots are drawn in one step; slots that a task makes.
GROUP, TASK_SLOTS = 4096, 1 << 18


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key: a Feistel network, walked until inside."""
    i, n, key = (np.asarray(x).astype(np.uint64) for x in (i, n, key))
    half = np.ones(len(i), np.uint64)
    while True:
        small = (np.uint64(1) << (half * np.uint64(2))) < n
        if not small.any():
            break
        half[small] += np.uint64(1)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.ones(len(i), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], low[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(4):
                left, right = right, left ^ (mix(right + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & m)
            out[todo] = (left << h) | right
            todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """src, source, source_size, weight, target of each source from (source, source_size).

    Shares follow the weights; what a source can't take beyond `most` times its size
    goes to the others by weight. The fill level is found from running sums over the
    sources in the order in which they fill up. There is one row per source here, and all sources in one task: a corpus has far fewer sources than documents.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("src", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    w = everything.orderBy("fills", "src")
    out = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    out = out.withColumn("fills", F.col("cap") / F.col("weight"))
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("open", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
    out = out.withColumn("level", (F.col("whole") - F.col("before")) / F.col("open"))
    out = out.withColumn("level", F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "src", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return out.select("src", "source", "source_size", "weight", target.alias("target"))


class Mixture:
    """The parts of a mix: documents with positions, sources with targets, slots of shards."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 16384, seed: int = 17, bucket_rows: int = 2000):
        self.block, self.seed, self.shard_slots, self.docs, self.text_col, self.id_col = block_words, seed, shard_slots, docs, text_col, id_col
        self.scratch = Scratch(docs.sparkSession, "mixing")
        n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")
        sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), F.xxhash64(text_col).alias("mark"))
        sized = self.scratch.save(sized.withColumn("uid", F.monotonically_increasing_id()), "sized")
        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
        sources = targets(totals).withColumn("blocks", blocks)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        rest = F.col("target") - F.col("passes") * F.col("source_size")
        part = F.when(F.col("source_size") > 0, F.round(rest * F.col("blocks") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        sources = sources.withColumn("passes", passes).withColumn("slots", F.col("passes") * F.col("blocks") + part)
        self.sources = self.scratch.save(sources, "sources")
        rows, = sized.agg(F.count("*")).first()
        buckets = max(64, -(-rows // bucket_rows))
        keyed = sized.join(self.sources.select("src", F.col("source").alias("name"), "source_size", "target"), sized.source.eqNullSafe(F.col("name"))).drop("name")
        keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(buckets)))
        sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("held")).withColumn("shelf", F.floor(F.col("bucket") / 1024))
        before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shelves = sums.groupBy("src", "shelf").agg(F.sum("held").alias("held"))
        shelves = shelves.select(F.col("src").alias("s0"), F.col("shelf").alias("h0"), before(Window.partitionBy("src").orderBy("shelf")).alias("low"))
        sums = sums.select(F.col("src").alias("s"), F.col("bucket").alias("b"), "shelf", before(Window.partitionBy("src", "shelf").orderBy("bucket")).alias("high"))
        sums = sums.join(shelves, (F.col("s") == F.col("s0")) & (F.col("shelf") == F.col("h0"))).select("s", "b", (F.col("low") + F.col("high")).alias("base"))
        inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "mark", "uid").rowsBetween(Window.unboundedPreceding, -1)
        placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        placed = placed.join(sums, (placed.src == sums.s) & (placed.bucket == sums.b))
        self.placed = placed.select("uid", "doc_id", "source", "src", "size", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"))

    def shards(self) -> DataFrame:
        """(src, blocks, shard, n, first): how many slots of a source each shard gets, drawn multinomially: first for groups of shards, then within them."""
        total, = self.sources.agg(F.sum("slots")).first()
        count, seed = max(1, -(-int(total or 0) // self.shard_slots)), self.seed
        self.tasks = max(1, -(-int(total or 0) // TASK_SLOTS))
        groups = -(-count // GROUP)
        sizes = np.minimum(GROUP, count - GROUP * np.arange(groups))

        def draw_groups(frames):
            for frame in frames:
                for src, blocks, slots in frame.itertuples(index=False):
                    n = np.random.default_rng([seed, int(src)]).multinomial(int(slots), sizes / count)
                    yield pd.DataFrame({"src": src, "blocks": blocks, "part": np.arange(groups), "n": n, "first": np.cumsum(n) - n})[n > 0]

        def draw(frames):
            for frame in frames:
                for src, blocks, part, slots, first in frame.itertuples(index=False):
                    size = min(GROUP, count - GROUP * int(part))
                    n = np.random.default_rng([seed, int(src), int(part)]).multinomial(int(slots), np.full(size, 1 / size))
                    yield pd.DataFrame({"src": src, "blocks": blocks, "shard": part * GROUP + np.arange(size), "n": n, "first": first + np.cumsum(n) - n})[n > 0]

        made = self.sources.where("slots > 0").select("src", "blocks", "slots").mapInPandas(draw_groups, "src long, blocks long, part long, n long, first long")
        return made.repartition(max(1, min(self.tasks, groups)), "src", "part").mapInPandas(draw, "src long, blocks long, shard long, n long, first long")

    def slots(self) -> DataFrame:
        """(src, shard, slot, pass, block): the block that each slot takes."""
        seed = self.seed

        def fill(frames):
            for frame in frames:
                for src, blocks, shard, n, first in frame.itertuples(index=False):
                    k = np.arange(first, first + n)
                    turn = k // blocks
                    key = mix((np.uint64(seed) << np.uint64(40)) + (np.uint64(src) << np.uint64(8)) + turn.astype(np.uint64))
                    yield pd.DataFrame({"src": src, "shard": shard, "slot": k, "pass": turn, "block": permute(k % blocks, np.full(n, blocks), key)})

        return self.shards().repartition(self.tasks, "src", "shard").mapInPandas(fill, "src long, shard long, slot long, pass long, block long")

    def pieces(self) -> DataFrame:
        """(uid, src, block, from, upto): where documents meet blocks, word positions in the source's stream."""
        b = F.lit(self.block)
        end = F.col("start") + F.col("size")
        spread = self.placed.where("size > 0").select("uid", "src", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block"))
        return spread.select("uid", "src", "start", "block", F.greatest("start", F.col("block") * b).alias("from"), F.least("end", (F.col("block") + 1) * b).alias("upto"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, source: one row per row of the documents."""
        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        times = times.hint("merge")  # made from a few sources, yet as many as there are blocks: size estimates are far off
        words = self.pieces().join(times, ["src", "block"]).groupBy("uid").agg(F.sum((F.col("upto") - F.col("from")) * F.col("times")).alias("words"))
        out = self.placed.join(words.hint("merge"), "uid", "left")
        return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source")

    def blocks(self) -> DataFrame:
        """(shard, slot, source, block, text): the mix itself, each slot with its block's words."""
        words = F.filter(F.split(F.col(self.text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        texts = self.docs.select(F.col(self.id_col).alias("doc_id"), F.xxhash64(self.text_col).alias("mark"), words.alias("words")).dropDuplicates(["doc_id", "mark"])
        marks = self.scratch.spark.read.parquet(f"{self.scratch.path}/sized").select("uid", "mark", F.col("doc_id").alias("d"))
        held = self.pieces().join(marks.hint("merge"), "uid").join(texts.hint("merge"), F.col("d").eqNullSafe(texts.doc_id) & (marks.mark == texts.mark))
        held = held.select("src", "block", F.struct("from", F.array_join(F.slice("words", (F.col("from") - F.col("start") + 1).cast("int"), (F.col("upto") - F.col("from")).cast("int")), " ").alias("t")).alias("part"))
        packed = held.groupBy("src", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), " ").alias("text"))
        named = self.sources.select("src", "source")
        return self.slots().join(packed.hint("merge"), ["src", "block"]).join(named, "src").select("shard", "slot", "source", "block", "text")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Words that the mix takes of each document. Reruns agree."""
    made = Mixture(docs, **options)
    return made.scratch.keep(made.taken())

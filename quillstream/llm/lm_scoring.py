"""Cross-entropy difference: matched target and background n-gram models.

Both models are bigram models with one vocabulary and one inventory: the words and the pairs of neighbouring words that occur
`least` times or more in all documents (the background). All other words are one class, the unknown word. With
n(.) a model's own counts, N its tokens, V the vocabulary's size, d the discount and N+(v) the number of v's pairs with n > 0, 1 at least:

* p1(w) = (n(w) + add) / (N + add * (V + 1)), the unknown word included.
* p(w | v) = (max(n(v w) - d, 0) + d * N+(v) * p1(w)) / n(v) for pairs of the inventory (p1(w) where n(v) = 0).
* p(w | v) = a(v) * p1(w) for all others, where a(v) makes the sum over w 1. After an unknown word and at the start a = 1.

A document's score is the mean per-token loss -ln p under the target model less that under the
background model: the lower, the more it resembles the target. Losses add up over words and pairs of the inventory, so
a document's loss is a sum over its n-grams of values that stand in one table, by key. That table grows with the
corpus. Its `hot` most frequent rows are sent to the executors, so that no frequent key is shuffled; all others meet the
documents' n-grams by a join on the key. Results do not depend on `hot`. Bitmaps of bounded size keep n-grams that are not in
the table from being moved. Keys are 64-bit hashes.

The counts are summed by task, then by key: the background's over all documents, the target's over those of the ids given.
A task's sums go in packs, one for each bucket of keys, and the packs of a bucket are added up as arrays: a shuffled row holds many sums.
Null texts and texts without words have 0 tokens
and a null score. Without target rows the target's p1 is uniform.
Repeated rows count each time. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, mix, released

LEAST, HOT, PARTS = 5, 1 << 16, 2
#: `prev` of rows that count words, and of the row that counts tokens. Word keys are not negative.
WORD, TOKENS = -1, -2
#: Tokens handled at a time in a task: four times as many are counted (a longer stretch moves fewer rows). Twice as many bytes of texts, hardly a third as many tokens, are split and scored.
CHUNK = 500_000
#: Rows handed over at a time.
ROWS = 100_000
#: Word numbers of a stretch at most, but for its last texts.
NUMBERS = 800_000
#: Buckets of keys, at least, and four for each shuffle partition: a bucket's sums of a pass must fit a task (a million of 24 bytes at 30 GB, reckoned from 0.5 GB). Sums packed at a time in a task, and packs handed over at a time. Sums added up at a time, if whole buckets are that small.
BUCKETS, PACKED, PACKS, ADDED = 4096, 400_000, 1024, 1_000_000


class Words:
    """Texts as arrays of numbers, and the keys of the words by number. A word has one number in a call, maybe others in others; numbers hold until `clear`."""

    def __init__(self):
        self.keys, self.size = [], 0

    def __len__(self) -> int:
        return self.size

    def of(self, text: str | None) -> np.ndarray:
        return self.all(pa.array([text], pa.string()))[0]

    def all(self, texts: pa.Array) -> list[np.ndarray]:
        """An array for each text. Arrow splits at the bytes at which bytes.split() does, but also gives empty words at the ends."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = split.flatten().dictionary_encode()
        number, known = found.indices.to_numpy(), found.dictionary.cast(pa.large_binary())
        at = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1].tolist() if len(known) else [0]
        data = known.buffers()[2].to_pybytes() if len(known) else b""
        keys = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], 8) for a, b in zip(at, at[1:])), np.uint64, len(known))
        empty = np.flatnonzero(np.diff(at) == 0)
        if len(empty):
            real = number != empty[0]
            ends = np.append(0, np.cumsum(real))[ends]
            number = number[real]
        number = number + np.int32(self.size)
        self.keys.append((keys >> np.uint64(1)).view(np.int64))
        self.size += len(keys)
        return [number[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def keys_held(self) -> np.ndarray:
        """Keys of the words by their numbers, 0 to 2^63 - 1."""
        return np.concatenate(self.keys) if self.keys else np.empty(0, np.int64)

    def clear(self) -> None:
        self.keys, self.size = [], 0


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)


def slices(texts: pa.Array):
    """Where texts of 2 * `CHUNK` bytes at most begin and end, or one longer text."""
    ends = np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + 2 * CHUNK, "right")) - 1)
        yield start, end
        start = end


def pair_key(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of pairs, all negative, so none is a word's."""
    with np.errstate(over="ignore"):
        made = mix(mix(prev.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ word.view(np.uint64))
    return (made | np.uint64(1 << 63)).view(np.int64)


def packs(batches, buckets: int):
    """Batches of counts as batches of (bucket, prev, word, t, b), a row for each bucket that has any, its numbers as bytes. A stretch's counts fit 4 bytes."""

    def packed(held):
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(4)]
        held.clear()
        bucket = (pair_key(columns[0], columns[1]).view(np.uint64) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")  # a radix sort, as these are 2 bytes
        bucket = bucket[order]
        new = runs(bucket)
        ends = np.append(new, len(bucket))
        out = [pa.array(bucket[new].astype(np.int32))]
        for c, kind in enumerate((np.int64, np.int64, np.int32, np.int32)):
            values = columns[c][order].astype(kind, copy=False)
            columns[c] = None
            out.append(pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)]))
        made = pa.RecordBatch.from_arrays(out, ["bucket", "prev", "word", "t", "b"])
        for s in range(0, len(new), PACKS):
            yield made.slice(s, PACKS)

    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield from packed(held)
    if held:
        yield from packed(held)


def added(columns, least: int) -> list[np.ndarray]:
    """(prev, word, t, b) with t and b summed by prev and word, where b is `least` or more, and the count of tokens."""
    prev, word, t, b = columns
    key = pair_key(prev, word)
    order = np.argsort(key)
    new = runs(key[order])
    for again in (False, True):
        if again:  # keys of different pairs clash
            order = np.lexsort((word, prev))
        by_prev, by_word = prev[order], word[order]
        starts = np.flatnonzero(np.r_[True, (by_prev[1:] != by_prev[:-1]) | (by_word[1:] != by_word[:-1])])
        if len(starts) == len(new):
            break
    by_prev, by_word = by_prev[starts], by_word[starts]
    t, b = (np.add.reduceat(n[order], starts, dtype=np.int64) for n in (t, b))
    kept = (b >= least) | (by_prev == TOKENS)
    return [x[kept] for x in (by_prev, by_word, t, b)]


def unpacked(made: DataFrame, least: int) -> DataFrame:
    """Sums of packed counts (prev, word, t, b): words and pairs of `least` occurrences or more, and the tokens. Whole buckets are added up, one or more at a time."""

    def values(batch):
        out = []
        for c, kind in enumerate((np.int64, np.int64, np.int32, np.int32), 1):
            column, size = batch.column(c), np.dtype(kind).itemsize
            ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
            out.append(np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0]))
        return out

    def whole(held):
        sums = added([np.concatenate(c) for c in zip(*map(values, held))], least)
        for s in range(0, len(sums[0]), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + ROWS]) for c in sums], ["prev", "word", "t", "b"])

    def run(batches):
        held, size, at = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # where the last bucket begins, which may go on in the next batch
            if size >= ADDED and (cut or bucket[0] != at):
                yield from whole([*held, batch.slice(0, cut)] if cut else held)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column(1).nbytes // 8
            at = bucket[-1]
        if held:
            yield from whole(held)

    return made.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(run), "prev bigint, word bigint, t bigint, b bigint")


def counts(docs: DataFrame, part: int = 0, parts: int = 1, skip: Bitmap | None = None, buckets: int = 0) -> DataFrame:
    """(prev, word, t, b) of rows (text, target, key): occurrences of words (prev = WORD), of pairs, and of tokens (prev = TOKENS), in rows of the target and in all, summed within a task's stretches. Pairs are those whose first word's key falls in `part`; words and tokens come with part 0. Rows whose key may be in `skip` are left out; those without a key are not. With `buckets` they are packed, for `unpacked`."""

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], ["prev", "word", "t", "b"])

    def summed(texts, flags, words):
        lens = np.array([len(x) for x in texts])
        key, number = np.unique(words.keys_held(), return_inverse=True)
        word, flag = number.astype(np.int32)[np.concatenate(texts)], np.repeat(np.array(flags, np.int8), lens)
        texts.clear()
        del number
        if part == 0:
            yield rows(*(np.array([x]) for x in (TOKENS, 0, flag.sum(dtype=np.int64), len(word))))
            n = np.bincount(word)
            single, t = np.flatnonzero(n), np.bincount(word[flag == 1], minlength=len(n))
            for s in range(0, len(single), ROWS):
                i = single[s : s + ROWS]
                yield rows(np.full(len(i), WORD), key[i], t[i], n[i])
            del n, single, t
        begins = (key % parts == part)[word]
        begins[np.cumsum(lens) - 1] = False  # no pair starts at a text's last word
        at, bits = np.flatnonzero(begins), max(1, len(key).bit_length())
        code = word[at].astype(np.int64)  # in place from here on: these are the largest arrays of a task
        code <<= bits
        code |= word[1:][at] if len(at) else 0
        code <<= 1
        code |= flag[at]
        del word, flag, begins, at
        code.sort()
        new, low = runs(code >> 1), (1 << bits) - 1
        for s in range(0, len(new), ROWS):
            i, end = new[s : s + ROWS], new[s + ROWS] if s + ROWS < len(new) else len(code)
            pair = code[i] >> 1
            yield rows(key[pair >> bits], key[pair & low], np.add.reduceat(code[i[0] : end] & 1, i - i[0]), np.diff(np.append(i, end)))

    def run(batches):
        words, texts, flags, size = Words(), [], [], 0
        for batch in batches:
            if skip is not None:
                key = batch.column(2)
                out = skip.has(key.fill_null(0).to_numpy()) & key.is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(~out))
            for s, e in slices(batch.column(0)):
                for word, flag in zip(words.all(batch.column(0).slice(s, e - s)), batch.column(1).slice(s, e - s).to_pylist()):
                    if len(word):
                        texts.append(word)
                        flags.append(flag)
                        size += len(word)
                if size > 4 * CHUNK or size and len(words) > NUMBERS:
                    yield from summed(texts, flags, words)
                    texts, flags, size = [], [], 0
                    words.clear()
        if size:
            yield from summed(texts, flags, words)

    docs = docs.select("text", "target", "key")
    if buckets:
        return docs.mapInArrow(released(lambda batches: packs(run(batches), buckets)), "bucket int, prev binary, word binary, t binary, b binary")
    return docs.mapInArrow(released(run), "prev bigint, word bigint, t bigint, b bigint")


@dataclass
class Models:
    """The table: (key, xt, xb, at, ab), the losses that an n-gram adds as a word or pair, and as the context of the next word. Losses of an unknown word. The most frequent rows, and `first`, their `spots`."""

    table: DataFrame
    known: Bitmap
    unknown: tuple[float, float]
    hot: dict[str, np.ndarray]


def train(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, hot: int = HOT, parts: int = PARTS, add: float = 0.5, discount: float = 0.75) -> Models:
    """Models of all rows and of those whose id is in `target`, a table of one column of ids. The pairs are counted in `parts` passes over the texts, so that disks hold a part of them at a time."""
    scratch = Scratch(docs.sparkSession, "lm-counts")
    ids = target.toDF("qs_id").where("qs_id IS NOT NULL").distinct()
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    maybe = Bitmap(ids, F.xxhash64("qs_id"), scratch)
    few = maybe.keep(rows.where("key IS NOT NULL"), F.col("key"))
    few = few.join(ids.hint("merge"), F.col("id") == F.col("qs_id"), "left").withColumn("target", F.col("qs_id").isNotNull())  # the ids grow with the corpus; of the texts hardly more than those of the target move
    none, made = F.lit(0).cast("bigint"), []
    buckets = min(1 << 16, max(BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for part in range(parts):
        both = counts(rows.withColumn("target", F.lit(False)), part, parts, maybe, buckets).unionByName(counts(few, part, parts, buckets=buckets))  # each text once
        made.append(scratch.save(unpacked(both, least), f"counts-{part}"))
    kept = reduce(DataFrame.unionByName, made)
    row = kept.where(F.col("prev") == TOKENS).first()
    total = (row["t"], row["b"]) if row else (0, 0)
    words = kept.where(F.col("prev") == WORD).drop("prev")
    size, *seen = words.agg(F.count("*"), F.coalesce(F.sum("t"), none), F.coalesce(F.sum("b"), none)).first()
    whole = [n + add * (size + 1) for n in total]
    unknown = [-float(np.log((n - s + add) / w)) for n, s, w in zip(total, seen, whole)]
    for side, w in zip("tb", whole):
        words = words.withColumn(f"p{side}", (F.col(side) + add) / w)
    pairs = kept.where(F.col("prev") >= 0).join(words.select("word", "pt", "pb").hint("merge"), "word")
    held = {s: (F.greatest(F.col(s) - discount, F.lit(0.0)), F.greatest(F.sum((F.col(s) > 0).cast("int")), F.lit(1)).alias(f"m{s}"), F.sum(f"p{s}").alias(f"s{s}")) for s in "tb"}
    sums = pairs.groupBy("prev").agg(*(c for s in "tb" for c in (F.sum(held[s][0]).alias(f"g{s}"), *held[s][1:])))
    of = words.select(F.col("word").alias("prev"), F.col("t").alias("nt"), F.col("b").alias("nb"))
    contexts = sums.join(of.hint("merge"), "prev")
    for s in "tb":
        spent = F.when(F.col(f"n{s}") > 0, (F.col(f"g{s}") + discount * F.col(f"m{s}") * F.col(f"s{s}")) / F.col(f"n{s}")).otherwise(F.col(f"s{s}"))
        contexts = contexts.withColumn(f"a{s}", (1 - spent) / (1 - F.col(f"s{s}")))
    contexts = scratch.save(contexts, "contexts")
    pairs = pairs.join(contexts.select("prev", "nt", "nb", "mt", "mb", "at", "ab").hint("merge"), "prev")

    def extra(s):  # what a pair's loss is beyond those of its word and of its context
        p = F.when(F.col(f"n{s}") > 0, (held[s][0] + discount * F.col(f"m{s}") * F.col(f"p{s}")) / F.col(f"n{s}")).otherwise(F.col(f"p{s}"))
        return F.log(F.col(f"a{s}")) + F.log(F.col(f"p{s}")) - F.log(p)

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(batch.column(0).to_numpy(), batch.column(1).to_numpy())), *batch.columns[2:]], ["key", "b", "xt", "xb"])

    pairs = pairs.select("prev", "word", "b", extra("t").alias("xt"), extra("b").alias("xb")).mapInArrow(keyed, "key bigint, b bigint, xt double, xb double")
    after = contexts.select("prev", "at", "ab").hint("merge")
    words = words.join(after, F.col("word") == F.col("prev"), "left")
    words = words.select(F.col("word").alias("key"), "b", *(( -F.log(f"p{s}") - u).alias(f"x{s}") for s, u in zip("tb", unknown)), *((-F.log(F.coalesce(f"a{s}", F.lit(1.0)))).alias(f"a{s}") for s in "tb"))
    table = scratch.keep(scratch.save(words.unionByName(pairs.withColumns({"at": F.lit(0.0), "ab": F.lit(0.0)})), "table"))
    # the most frequent rows, from a histogram of some hundreds of levels at most
    level = F.floor(8 * F.log2("b"))
    from_level, left = 1 << 30, hot
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        from_level = r["level"]
    rows = table.where(level >= from_level).drop("b").toArrow()  # `hot` rows at most
    at = np.argsort(rows.column("key").to_numpy().view(np.uint64))
    sent = {c: rows.column(c).to_numpy()[at] for c in rows.column_names}
    return Models(table, Bitmap(table, F.col("key"), scratch), tuple(unknown), sent | {"first": spots(sent["key"])})


def spots(keys: np.ndarray) -> np.ndarray:
    """Where in ascending unsigned keys those of each value of their first bits begin; keys are hashes, so these are few."""
    bits = len(keys).bit_length() + 1
    return np.append(0, np.cumsum(np.bincount((keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))).astype(np.int32)


def place(hot: dict[str, np.ndarray], key: np.ndarray) -> np.ndarray:
    """The places of keys among the most frequent, -1 for others."""
    first, keys = hot["first"], hot["key"]
    spot = (key.view(np.uint64) >> np.uint64(64 - (len(first) - 1).bit_length() + 1)).astype(np.int64)
    at, end, out = first[spot], first[spot + 1], np.full(len(key), -1, np.int32)
    del spot
    todo = np.flatnonzero(at < end)
    at, end, key = at[todo], end[todo], key[todo]
    while len(todo):
        hit = keys[at] == key
        out[todo[hit]] = at[hit]
        at += 1
        more = ~hit & (at < end)
        todo, at, end, key = todo[more], at[more], end[more], key[more]
    return out


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, loss_target, loss_background, score) of every row."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    sent, known = spark.sparkContext.broadcast(models.hot), models.known
    names = ["id", "uid", "key", "n", "last", "lt", "lb"]

    def made(ids, uids, texts, words):
        """A row for each document with its tokens and what the frequent keys add, and one for each of its other n-grams that may be in the table."""
        hot, lens, keys = sent.value, np.array([len(w) for w in texts]), words.keys_held()
        word, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), lens)
        ends = np.zeros(len(word), np.int64)
        ends[np.cumsum(lens)[lens > 0] - 1] = 1
        # words are numbered anew, in the order of their keys: equal texts add up in the same order
        seen = np.flatnonzero(np.bincount(word)) if len(word) else word
        seen = seen[np.argsort(keys[seen])]
        number = np.empty(len(keys), np.int64)
        number[seen] = np.arange(len(seen))
        keys, word, bits = keys[seen], number[word], max(1, len(seen).bit_length())
        low, inside = (1 << bits) - 1, np.flatnonzero(ends == 0)
        single = np.sort((doc << (bits + 1)) | (word << 1) | ends)
        last, single = single & 1, single >> 1
        new = runs(single)
        pair = np.sort((doc[inside] << (2 * bits)) | (word[inside] << bits) | word[inside + 1])
        new2 = runs(pair)
        last = np.concatenate([np.add.reduceat(last, new) if len(new) else new, np.zeros(len(new2), np.int64)])
        n = np.concatenate([np.diff(np.append(new, len(single))), np.diff(np.append(new2, len(pair)))])
        single, pair = single[new], pair[new2]
        key = np.concatenate([keys[single & low], pair_key(keys[(pair >> bits) & low], keys[pair & low])])
        doc = np.concatenate([single >> bits, pair >> (2 * bits)])
        at = place(hot, key)
        done = at >= 0
        to, of, times, after = at[done], doc[done], n[done], n[done] - last[done]
        sums = [np.bincount(of, times * hot[x][to] + after * hot[a][to], len(lens)) for x, a in (("xt", "at"), ("xb", "ab"))]
        none = lambda n, t=pa.int64(): pa.nulls(n, t)
        yield pa.RecordBatch.from_arrays([ids, pa.array(uids), none(len(lens)), pa.array(lens), none(len(lens)), pa.array(sums[0].astype(float)), pa.array(sums[1].astype(float))], names)
        left = np.flatnonzero(~done)
        left = left[known.has(key[left])]
        for s in range(0, len(left), ROWS):
            i = left[s : s + ROWS]
            m = len(i)
            yield pa.RecordBatch.from_arrays([none(m, ids.type), pa.array(uids[doc[i]]), pa.array(key[i]), pa.array(n[i]), pa.array(last[i]), none(m, pa.float64()), none(m, pa.float64())], names)

    def run(batches):
        words = Words()
        for batch in batches:
            for s, e in slices(batch.column(1)):
                yield from made(batch.column(0).slice(s, e - s), batch.column(2).slice(s, e - s).to_numpy(), words.all(batch.column(1).slice(s, e - s)), words)
                words.clear()

    rows = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("uid")).mapInArrow(released(run), f"id {kind}, uid bigint, key bigint, n bigint, last bigint, lt double, lb double")
    # a document's own row has no key: it takes one of its own, so that these rows spread, and nothing of the table
    rows = rows.withColumns({"own": F.col("key").isNull(), "key": F.coalesce("key", F.xxhash64("uid"))})
    table = models.table.select(F.col("key").alias("qs_key"), "xt", "xb", "at", "ab")
    met = rows.join(table.hint("merge"), F.col("key") == F.col("qs_key"), "left")
    adds = lambda s: F.sum(F.when(F.col("own"), F.col(f"l{s}")).otherwise(F.coalesce(F.col("n") * F.col(f"x{s}") + (F.col("n") - F.col("last")) * F.col(f"a{s}"), F.lit(0.0))))
    sums = met.groupBy("uid").agg(F.max("id").alias("id"), F.max(F.when(F.col("own"), F.col("n"))).alias("n_tokens"), adds("t").alias("st"), adds("b").alias("sb"))
    mean = lambda s, u: F.when(F.col("n_tokens") > 0, F.col(f"s{s}") / F.col("n_tokens") + F.lit(u))
    out = sums.select(F.col("id").alias(id_col), "n_tokens", mean("t", models.unknown[0]).alias("loss_target"), mean("b", models.unknown[1]).alias("loss_background"))
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))

"""Benchmark decontamination by template windows.

Words become canonical tokens: punctuation at their ends and case go, and numbers,
number words, names (capitalised inside a sentence) and units become typed
placeholders. Windows of canonical tokens of a benchmark item are joined by hash
to the windows of every document. Hits of one item on one diagonal (document place minus
item place) count only if the slots are consistent: the same filler of the item always
meets the same filler of the document. An item is found in a document when its
consistent windows cover `cover` of all its windows; `exact` says whether all fillers
are the item's own.

Which windows of a document may be an item's is told by a bitmap of bounded size of the items' windows. Only those
windows move, with the slots and fillers of their words, and are joined to the items' windows by hash; frequent windows are
split as Spark splits skewed joins. The hits are then grouped by document, item and diagonal. Results meet the documents by
hashes of id and text; Spark sends them to the executors if they are small, as measured.

Windows count only if `literals` of their tokens (all, if they are shorter) are no placeholders. Items without
such a window are found by windows of their own words instead, so only as they stand, apart from case and punctuation at the ends of words.

Null and empty texts, on either side, match nothing. Items shorter than the window are one
window of their own length. Repeated rows of documents give repeated results; repeated rows of the benchmark count once, and of several
texts of one item the best found counts. Extra columns are kept, but qs_items, qs_k1 and qs_k2 are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, mix, released, windows

NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*%?$")
NUMBER_UNIT = re.compile(r"([+\-]?\d[\d.,]*)(kg|g|mg|km|m|cm|mm|mi|ft|lb|oz|l|ml|h|hr|s|ms|kb|mb|gb|°c|°f|eur|usd)$")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset("kg g mg km m cm mm mi ft lb lbs oz l ml kilograms grams kilometers kilometres meters metres centimeters miles feet inches pounds ounces liters litres gallons dollars cents euros pounds hours minutes seconds days weeks months years degrees percent".split())
NOT_NAMES = frozenset("i i'm i'll i've i'd the a an and or but if in on at of to for from by with it he she they we you this that is are was were".split())
STRIP = "\"'“”‘’`()[]{}<>.,;:!?¿¡*_#|-–—…"
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3


class Vocabulary(dict):
    """word -> number; per number: token hash, token hash inside a sentence, slot kinds, whether it ends a sentence."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.n = most, 0
        self._grow(1024)

    def _grow(self, size: int) -> None:
        old = getattr(self, "plain", None)
        for name, kind in (("plain", np.uint64), ("inner", np.uint64), ("slot", np.int8), ("inner_slot", np.int8), ("ends", bool), ("filler", np.uint64)):
            new = np.zeros(size, kind)
            if old is not None:
                new[: self.n] = getattr(self, name)[: self.n]
            setattr(self, name, new)

    def trim(self) -> None:
        """Forget all words once there are too many; called between texts, as numbers change."""
        if self.n > self.most:
            self.clear()
            self.n = 0

    def __missing__(self, word: bytes) -> int:
        i = self.n
        if i >= len(self.plain):
            self._grow(2 * len(self.plain))
        self.n += 1
        self[word] = i
        raw = word.decode("utf-8", "replace")
        core = raw.strip(STRIP)
        low = core.lower()
        if not low:
            token, slot = raw, PLAIN
        elif NUMBER.match(low) or low in NUMBER_WORDS:
            token, slot = "\0num", NUM
        elif NUMBER_UNIT.match(low):
            token, slot = "\0num-unit", NUM
        elif low in UNITS:
            token, slot = "\0unit", UNIT
        else:
            token, slot = low, PLAIN
        named = slot == PLAIN and core[:1].isupper() and core[1:2].islower() and low not in NOT_NAMES
        self.plain[i] = xxhash.xxh3_64_intdigest(token)
        self.inner[i] = xxhash.xxh3_64_intdigest("\0name") if named else self.plain[i]
        self.slot[i], self.inner_slot[i] = slot, NAME if named else slot
        self.ends[i] = raw.rstrip("\"'”’)]")[-1:] in (".", "!", "?", ":")
        self.filler[i] = xxhash.xxh3_64_intdigest(low)
        return i


def tokens(text: str | None, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, slot kinds and fillers of the canonical tokens."""
    vocabulary.trim()
    words = text.encode().split() if text else []
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    inside = np.concatenate([[False], ~vocabulary.ends[ids[:-1]]]) if len(ids) else np.zeros(0, bool)
    return np.where(inside, vocabulary.inner[ids], vocabulary.plain[ids]), np.where(inside, vocabulary.inner_slot[ids], vocabulary.slot[ids]), vocabulary.filler[ids]


def item_windows(text: str | None, width: int, literals: int, vocabulary: Vocabulary) -> tuple | None:
    """(kind, window hashes, their places, slots, fillers) of an item; the kind holds the windows' length and whether they are of its own words. None without words."""
    h, slot, filler = tokens(text, vocabulary)
    if not len(h):
        return None
    w = min(width, len(h))
    plain = np.concatenate([[0], np.cumsum(slot == PLAIN)])
    win, ok = windows(h, w), plain[w:] - plain[:-w] >= min(literals, w)
    raw = not ok.any()
    if raw:
        win, ok = windows(filler, w), np.ones(len(win), bool)
    at = np.flatnonzero(ok)
    return (w, raw), keys(win[at], w, raw), at, slot, filler


def keys(win: np.ndarray, w: int, raw: bool) -> np.ndarray:
    """Window hashes apart by kind."""
    return mix(win ^ np.uint64(2 * w + raw + 1))


def consistent(places: list[int], w: int, own_slot, own, met: dict[int, tuple[int, int]]) -> tuple[set[int], bool]:
    """The windows whose slots agree with one map from the item's fillers to the document's, and whether that is the identity. met: slot and filler of the document by place of the item. Of equally frequent fillers the greatest counts."""
    votes: dict[tuple[int, int], Counter] = defaultdict(Counter)
    spots = sorted({p + j for p in places for j in range(w) if own_slot[p + j] != PLAIN and own_slot[p + j] == met[p + j][0]})
    for q in spots:
        votes[int(own_slot[q]), int(own[q])][met[q][1]] += 1
    chosen = {k: max(v.items(), key=lambda x: (x[1], x[0]))[0] for k, v in votes.items()}
    bad = {q for q in spots if chosen[int(own_slot[q]), int(own[q])] != met[q][1]}
    kept = {p for p in places if not any(p + j in bad for j in range(w))}
    return kept, all(k[1] == v for k, v in chosen.items())


def _lists(arrays: list, kind) -> pa.Array:
    return pa.array([a.tolist() for a in arrays], pa.list_(kind))


def index_items(benchmark: DataFrame, item_col: str, text_col: str, width: int, literals: int) -> DataFrame:
    """(part, item, width, raw, keys, places, slots, fillers): each distinct pair of item and text that has words."""

    def run(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            made = [item_windows(t, width, literals, vocabulary) for t in batch.column(2).to_pylist()]
            rows = [i for i, m in enumerate(made) if m]
            made = [made[i] for i in rows]
            part, item = (batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1))
            signed = lambda k: _lists([m[k].view(np.int64) for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([part, item, pa.array([m[0][0] for m in made], pa.int32()), pa.array([m[0][1] for m in made], pa.bool_()), signed(1), _lists([m[2] for m in made], pa.int32()), _lists([m[3] for m in made], pa.int32()), signed(4)], ["part", "item", "width", "raw", "keys", "places", "slots", "fillers"])

    rows = benchmark.select(F.xxhash64(F.col(item_col).cast("string"), text_col).alias("part"), F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(released(run), "part bigint, item string, width int, raw boolean, keys array<bigint>, places array<int>, slots array<int>, fillers array<bigint>")


def hits(docs: DataFrame, kinds: list[tuple[int, bool]], known: Bitmap) -> DataFrame:
    """(k1, k2, key, place, slots, fillers) of the documents' windows that may be among the items', from (k1, k2, text); slots and fillers of the window's words."""
    names = ["k1", "k2", "key", "place", "slots", "fillers"]

    def run(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            made: list[list] = [[] for _ in names]
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                h, slot, filler = tokens(text, vocabulary)
                for w, raw in kinds:
                    if len(h) < w:
                        continue
                    key = keys(windows(filler if raw else h, w), w, raw)
                    near = np.flatnonzero(known.has(key))
                    if len(near):
                        of = near[:, None] + np.arange(w)
                        for column, values in zip(made, ([k1] * len(near), [k2] * len(near), key[near].view(np.int64).tolist(), near.tolist(), slot[of].tolist(), filler.view(np.int64)[of].tolist())):
                            column += values
                if len(made[0]) > 100_000:
                    yield _hits(made, names)
                    made = [[] for _ in names]
            if made[0]:
                yield _hits(made, names)

    return docs.mapInArrow(released(run), "k1 bigint, k2 bigint, key bigint, place int, slots array<int>, fillers array<bigint>")


def _hits(made: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds)], names)


def checked(met: DataFrame) -> DataFrame:
    """(k1, k2, part, kept, same) from (k1, k2, part, width, slots, fillers, windows): a row for each item on a diagonal of a document."""

    def run(batches):
        for batch in batches:
            kept, same = [], []
            for w, slot, own, rows in zip(*(batch.column(c).to_pylist() for c in range(3, 7))):
                found = {r["at"] + j: (r["slots"][j], r["fillers"][j]) for r in rows for j in range(w)}
                places, exact = consistent(sorted({r["at"] for r in rows}), w, slot, own, found)
                kept.append(sorted(places))
                same.append(exact)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(kept, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["k1", "k2", "part", "kept", "same"])

    return met.select("k1", "k2", "part", "width", "slots", "fillers", "windows").mapInArrow(released(run), "k1 bigint, k2 bigint, part bigint, kept array<int>, same boolean")


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, cover: float = 0.5, literals: int = 3) -> DataFrame:
    """All rows with qs_items: array of (item string, cover double, exact boolean), by item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.save(index_items(benchmark, item_col, item_text, width, literals), "items")
    kinds = [(r[0], r[1]) for r in items.select("width", "raw").distinct().collect()]  # 2 * width at most
    held = items.select("part", F.explode(F.arrays_zip("keys", "places")).alias("w")).select("part", F.col("w.keys").alias("key"), F.col("w.places").alias("at"))
    k1, k2 = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    seen = scratch.save(hits(rows, kinds, Bitmap(held.select("key").distinct(), F.col("key"), scratch)).distinct(), "hits")
    met = seen.join(held, "key").groupBy("k1", "k2", "part", (F.col("place") - F.col("at")).alias("shift")).agg(F.collect_list(F.struct("at", "slots", "fillers")).alias("windows"))
    met = met.join(items.select("part", "width", "slots", "fillers"), "part")
    sums = checked(met).groupBy("k1", "k2", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("n"), F.bool_and("same").alias("exact"))
    share = F.col("n") / F.col("total")
    sums = sums.join(items.select("part", "item", F.size("keys").alias("total")), "part").where(share >= cover)
    best = sums.groupBy("k1", "k2", "item").agg(F.max(share).alias("cover"), F.max("exact").alias("exact"))
    found = best.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("item", "cover", "exact"))).alias("qs_items"))
    found = scratch.save(found.withColumnsRenamed({"k1": "qs_k1", "k2": "qs_k2"}), "found")
    scratch.drop("hits")
    scratch.drop("items")
    docs = docs.drop("qs_items", "qs_k1", "qs_k2")
    out = docs.join(found, (k1 == F.col("qs_k1")) & (k2 == F.col("qs_k2")), "left")
    none = F.array().cast("array<struct<item:string,cover:double,exact:boolean>>")
    return scratch.keep(out.withColumn("qs_items", F.coalesce("qs_items", none)).drop("qs_k1", "qs_k2"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, contaminated, n_items, items, cover, exact) for every row."""
    items = F.col("qs_items")
    return found.select(
        id_col, (F.size(items) > 0).cast("int").alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(F.transform(items, lambda x: x["item"]), ",").alias("items"),
        F.coalesce(F.array_max(F.transform(items, lambda x: x["cover"])), F.lit(0.0)).alias("cover"), F.exists(items, lambda x: x["exact"]).cast("int").alias("exact"),
    )

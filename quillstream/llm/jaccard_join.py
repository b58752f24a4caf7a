"""Exact n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word n-grams (64-bit hashes); two link when
100 * |A & B| >= percent * |A | B|. Sizes are covered by overlapping windows, so that two
sets that may link share a window. In a window, linking sets differ in at most k
elements. The hash domain is cut into groups of 2 * errors + 1 ranges (partitions). k
differences leave at least 1 + slack of ceil((k + 1) / (errors + 1)) + slack groups with `errors`
differing partitions at most, so the signatures are all subsets of errors + 1 partitions of a group.
Subsets of empty partitions are signatures only for sets with more than `slack` groups that have some, which
keeps the guarantee. The default is errors = 0, groups of one partition: groups of three make 1.6
times as many signatures and hardly fewer candidates.

Equal sets are one set throughout, known by a digest of it. The signatures that more than one set has are found first, from
(signature, least, greatest digest) summed by task; only what may be among them (a bitmap of bounded
size tells) is moved again. Then, with no step that depends on the size of a group:

1. Every member of a signature is compared with the smallest id of it, the hub: sizes, then parity sketches
   (a lower bound of the difference in 4 to 8 bits an element), then the sets of those that are left.
2. Signatures whose other members are in different components are open. Equal lists of members are one; long ones are cut
   into blocks and the pairs of blocks dealt to tasks, which compare sketches and return the members, not the pairs,
   that may link with one of another component.
3. The sets of these are compared in the same way, and only links that join components are returned.

So every link between different components is tested exactly, and no list of pairs is ever made.

Null texts, empty texts and texts without words have empty sets and link with nothing.
Texts of fewer than n words are one shingle, their whole sequence. Repeated rows give
repeated results; rows of one id and different texts are one node. Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Hashes, Scratch, components, mix, released, windows

SALT = np.uint64(0x5851F42D4C957F2D)
#: Sets of a block, and their elements in all.
BLOCK_SETS, BLOCK_ELEMENTS = 1000, 1_000_000


def shingles(text: str | None, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(n, len(words))))


class Plan:
    """Windows of sizes for a similarity in percent: (first, last, k)."""

    def __init__(self, percent: int):
        self.percent = percent
        self.made = [self._window(1)]

    def _window(self, first: int) -> tuple[int, int, int, int]:
        p = self.percent
        upto = max(first + 1, -(-first * 10000 // (p * p)))
        last = (upto - 1) * 100 // p
        return first, upto, last, self.apart(upto - 1, last)

    def apart(self, x, y):
        """The most elements in which linking sets of these sizes differ."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(window, k) of a set."""
        while self.made[-1][1] <= size:
            self.made.append(self._window(self.made[-1][1]))
        out, i = [], len(self.made) - 1
        while i >= 0 and self.made[i][0] > size:
            i -= 1
        while i >= 0 and self.made[i][2] >= size:
            out.append((i, self.made[i][3]))
            i -= 1
        return out


@lru_cache(maxsize=4096)
def _ranges(n: int) -> np.ndarray:
    return np.array([i * 2**64 // n for i in range(n)], np.uint64)


@lru_cache(maxsize=4096)
def _tags(window: int, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(window << 32))


@lru_cache(maxsize=8)
def _subsets(errors: int) -> np.ndarray:
    return np.array(list(combinations(range(2 * errors + 1), errors + 1)))


def signatures(h: np.ndarray, plan: Plan, errors: int = 0) -> np.ndarray:
    """Signatures of a sorted set of hashes."""
    out, subsets = [], _subsets(errors)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ SALT))])
        for window, k in plan.of(len(h)):
            if k == 0:
                continue
            slack, width = 2 + k // 16, 2 * errors + 1
            n = (-(-(k + 1) // (errors + 1)) + slack) * width
            edge = np.append(np.searchsorted(h, _ranges(n)), len(h))
            parts = mix((sums[edge[1:]] - sums[edge[:-1]]) ^ _tags(window, n))
            made = parts.reshape(-1, width)[:, subsets].sum(axis=2, dtype=np.uint64)
            full = (edge[1:] > edge[:-1]).reshape(-1, width)[:, subsets].any(axis=2)
            out.append(mix(made[full] if int((~full).any(axis=1).sum()) <= slack else made.ravel()))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall in each of 4 to 8 cells an element, as words of 64 cells. Sets differ in at least as many elements as their sketches in cells."""
    cells = 1 << max(6, (4 * len(h) - 1).bit_length())
    at = (mix(h ^ ~SALT) >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).view(np.uint64)


def fold(s: np.ndarray, words: int) -> np.ndarray:
    """The same sketch in fewer cells: neighbours are halves of one."""
    while len(s) > words:
        bits = np.unpackbits(s.view(np.uint8))
        s = np.packbits(bits[0::2] ^ bits[1::2]).view(np.uint64)
    return s


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, without making Python numbers."""
    values, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _map(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, errors: int, whole: bool) -> DataFrame:
    """(id, n, d1, d2, sketch, list): d1 and d2 are digests of the set; the list holds its elements if `whole`, or else its signatures, with no sketch and only once for equal sets of a task."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n", "d1", "d2", "sketch", "list"]

    def run(batches):
        hashes, plan, seen = Hashes(seed=4), Plan(percent), set()
        none = np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, n, hashes) for t in part.column(1).to_pylist()]
                with np.errstate(over="ignore"):
                    d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    d2 = np.array([mix(s ^ SALT).sum(dtype=np.uint64) for s in sets], np.uint64)
                if whole:
                    sketches, held = [sketch(s) for s in sets], sets
                else:
                    sketches, held = [none] * len(sets), []
                    for key, s in zip(zip(d1.tolist(), d2.tolist()), sets):
                        held.append(none if key in seen else signatures(s, plan, errors))
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(key)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _lists(sketches), _lists(held)], names)

    return df.select(id_col, text_col).mapInArrow(released(run), f"id {kind}, n bigint, d1 bigint, d2 bigint, sketch array<bigint>, list array<bigint>")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = overlap(a, b)
    return both * 100 >= (len(a) + len(b) - both) * percent


def _near(rows: list[tuple], plan: Plan):
    """(x, others): for each row of (side, comp, n, sketch), the later ones of another component, and side if there are two, that its sketch does not exclude."""
    side, n = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    names = {c: i for i, c in enumerate(dict.fromkeys(r[1] for r in rows))}
    comp = np.array([names[r[1]] for r in rows])
    words = min(len(r[3]) for r in rows)
    held = np.stack([fold(r[3], words) for r in rows])
    across = bool(side.any()) and not bool(side.all())
    for x in range(len(rows) - 1):
        may = (comp[x + 1 :] != comp[x]) & (np.minimum(n[x + 1 :], n[x]) * 100 >= np.maximum(n[x + 1 :], n[x]) * plan.percent)
        if across:
            may &= side[x + 1 :] != side[x]
        ys = np.flatnonzero(may) + x + 1
        if len(ys):
            apart = np.bitwise_count(held[ys] ^ held[x]).sum(axis=1, dtype=np.int64)
            ys = ys[apart <= plan.apart(n[ys], n[x])]
            if len(ys):
                yield x, ys.tolist()


def _grouped(batches, keys: int):
    """The runs of rows with equal first `keys` columns; lists come as arrays."""
    key, held, kinds = None, [], None
    for batch in batches:
        kinds = batch.schema
        columns = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != key:
                if held:
                    yield kinds, held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield kinds, held


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, errors: int, sizes: tuple[int, int], scratch: Scratch):
        self.docs, self.id_col, self.text_col, self.scratch, self.percent, self.sizes = docs, id_col, text_col, scratch, percent, sizes
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.held = lambda df, whole: _map(df, id_col, text_col, n, percent, errors, whole)
        self.sets: DataFrame | None = None

    def shared(self, profile: DataFrame) -> DataFrame:
        """(sig, d1): all of the signatures that more than one set has, and few others."""
        digests = profile.select(F.explode("list").alias("sig"), "d1").groupBy("sig").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"))
        found = Bitmap(digests.where("lo <> hi"), F.col("sig"), self.scratch)

        def run(batches):
            for batch in batches:
                values, at = batch.column(0).values.to_numpy(zero_copy_only=False), batch.column(0).offsets.to_numpy()
                keep = np.flatnonzero(found.has(values[at[0] : at[-1]]))
                owner = np.repeat(batch.column(1).to_numpy(), np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(values[at[0] : at[-1]][keep]), pa.array(owner[keep])], ["sig", "d1"])

        return profile.select("list", "d1").mapInArrow(released(run), "sig bigint, d1 bigint")

    def members(self, rows: DataFrame, reps: DataFrame) -> DataFrame:
        """(sig, id, n, hub, nb) of the signatures that more than one set has; nb: the hub's n."""
        named = self.scratch.save(rows.join(reps.select("d1", F.col("rep").alias("id"), "n").hint("merge"), "d1").select("sig", "id", "n").distinct(), "named")
        hubs = named.groupBy("sig").agg(F.min(F.struct("id", "n")).alias("least"), F.max("id").alias("top")).where("least.id <> top")
        return self.scratch.save(named.join(hubs.select("sig", F.col("least.id").alias("hub"), F.col("least.n").alias("nb")).hint("merge"), "sig"), "members")

    def load(self, members: DataFrame) -> None:
        """The sets of all members, the only ones that are compared, with another pass over the texts."""
        ids = Bitmap(members.select("id").distinct(), F.xxhash64("id"), self.scratch)
        texts = ids.keep(self.docs.select(self.id_col, self.text_col), F.xxhash64(self.id_col))
        self.sets = self.scratch.save(self.held(texts, True).where("n > 0").select("id", "n", "sketch", "list"), "sets")

    def led(self, members: DataFrame) -> DataFrame:
        """Links between members and their hubs."""
        near = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * self.percent
        pairs = members.where((F.col("id") != F.col("hub")) & near).select("id", "hub").distinct()
        percent, kinds = self.percent, f"id {self.kind}, hub {self.kind}"

        def test(what):
            def run(batches):
                plan = Plan(percent)
                for batch in batches:
                    a, b = _arrays(batch.column(2)), _arrays(batch.column(3))
                    if what == "list":
                        ok = [linked(x, y, percent) for x, y in zip(a, b)]
                    else:
                        n, m = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                        ok = [int(np.bitwise_count(fold(x, len(y)) ^ fold(y, len(x))).sum()) <= plan.apart(i, j) for x, y, i, j in zip(a, b, n, m)]
                    yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

            mine = self.sets.select("id", F.col(what).alias("a"), F.col("n").alias("na"))
            other = self.sets.select(F.col("id").alias("hub"), F.col(what).alias("b"), F.col("n").alias("nb"))
            met = pairs.join(mine.hint("merge"), "id").join(other.hint("merge"), "hub").select("id", "hub", "a", "b", "na", "nb")
            return self.scratch.save(met.mapInArrow(released(run), kinds).distinct(), f"led-{what}")

        pairs = test("sketch")
        return test("list").select(F.col("id").alias("a"), F.col("hub").alias("b"))

    def open(self, members: DataFrame, known: DataFrame) -> DataFrame:
        """(key, i, j, side, id, comp): members, in blocks, of the signatures whose members are in different components, hubs aside."""
        at = known.select(F.col("node").alias("id"), "component")
        rows = members.where("id <> hub").join(at.hint("merge"), "id", "left").select("sig", "id", "n", F.coalesce("component", "id").alias("comp"))
        rows = self.scratch.save(rows, "components-of")
        most, elements = self.sizes
        lists = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("key"), F.count("*").alias("c"), F.sum("n").alias("w"))
        blocks = F.greatest(F.ceil(F.col("c") / most), F.ceil(F.col("w") / elements)).cast("int")
        lists = lists.where("lo <> hi").select("sig", "key", blocks.alias("blocks"))
        held = rows.join(lists.hint("merge"), "sig").select("key", "blocks", "id", "comp").distinct()
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        spread = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "comp")
        return self.scratch.save(spread, "open")

    def left(self, rows: DataFrame) -> DataFrame:
        """(key, side, id, comp): members that sketches let link with one of another component; lists of the same members have one key."""
        percent = self.percent

        def run(batches):
            plan = Plan(percent)
            for kinds, held in _grouped(batches, 3):
                found = set()
                for x, ys in _near([(r[3], r[5], r[6], r[7]) for r in held], plan):
                    found |= {x, *ys}
                if found:
                    mine = [held[x] for x in sorted(found)]
                    key = np.bitwise_xor.reduce(np.array([hash((r[8], r[3])) for r in mine], np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([int(key)] * len(mine), pa.int64()), pa.array([r[3] for r in mine], pa.int32()), pa.array([r[4] for r in mine], kinds.field("id").type), pa.array([r[5] for r in mine], kinds.field("id").type)], ["key", "side", "id", "comp"])

        ready = rows.join(self.sets.select("id", "n", "sketch").hint("merge"), "id").select("key", "i", "j", "side", "id", "comp", "n", "sketch", F.xxhash64("id").alias("mark"))
        grouped = ready.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
        return self.scratch.save(grouped.mapInArrow(released(run), f"key bigint, side int, id {self.kind}, comp {self.kind}").distinct(), "left")

    def settled(self, rows: DataFrame) -> DataFrame:
        """Links that join components, by comparing the sets."""
        percent = self.percent

        def run(batches):
            plan = Plan(percent)
            for kinds, held in _grouped(batches, 1):
                top, out = {}, []

                def find(c):
                    while top.get(c, c) != c:
                        c = top[c]
                    return c

                for x, ys in _near([(r[1], r[3], r[4], r[5]) for r in held], plan):
                    for y in ys:
                        a, b = find(held[x][3]), find(held[y][3])
                        if a != b and linked(held[x][6], held[y][6], percent):
                            top[a] = b
                            out.append((held[x][2], held[y][2]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], kinds.field("id").type), pa.array([b for _, b in out], kinds.field("id").type)], ["a", "b"])

        ready = rows.join(self.sets.hint("merge"), "id").select("key", "side", "id", "comp", "n", "sketch", "list")
        grouped = ready.repartition("key").sortWithinPartitions("key", "side", "id")
        return self.scratch.save(grouped.mapInArrow(released(run), f"a {self.kind}, b {self.kind}"), "settled")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, errors: int = 0, block_sets: int = BLOCK_SETS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    join = _Join(docs, id_col, text_col, n, percent, errors, (block_sets, block_elements), scratch)
    profile = scratch.save(join.held(docs, False).drop("sketch"), "profile")
    reps = profile.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n")).where("rep IS NOT NULL")
    reps = scratch.save(reps, "reps")
    small = scratch.save(profile.select("id", "n", "d1", "d2"), "small")
    members = join.members(join.shared(profile), reps)
    scratch.drop("profile")
    scratch.drop("named")
    join.load(members)
    links = join.led(members)
    known = components(links, scratch)
    more = join.settled(join.left(join.open(members, known)))
    for done in ("sets", "members", "led-sketch", "components-of", "open", "left"):
        scratch.drop(done)
    known = components(links.union(more), scratch).select(F.col("node").alias("rep"), "component")
    classes = reps.join(known.hint("merge"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    rows = small.join(classes.hint("merge"), ["d1", "d2"], "left")
    out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))
    return scratch.keep(out)

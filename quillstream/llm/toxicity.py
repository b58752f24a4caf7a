"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Features are all words and their beginnings (4 characters, so that inflected and
derived forms meet), known by 64-bit hashes. A feature weighs (1 + log tf) * idf, and the idf is raised by what the labels
say about it: 1 + `raise_by` * evidence, evidence being the log odds ratio of the feature in toxic and in clean
examples, less two standard errors, 0 at least. No feature is left out, and vectors have length 1 over the whole text.

The examples form an inverted index. The postings of rare features are cut at blocks of examples, and each block's
largest weight is kept; those of features in more than one of `DENSE` examples are rows of a matrix, multiplied for many texts at once.
Both together bound what a block of examples can reach; blocks of too small a bound are not read, so the
k nearest are exact (to six decimals of the cosine; ties by example order). Their labels vote by squared
similarity. Votes become probabilities by a monotone fit of leave-one-out votes on the
examples. Texts that share no feature with any example get the rate of such examples.

Examples of one text count once, as toxic if any is. The index holds at most `max_examples` labelled rows (the first by hash of their id);
that bounds what is collected and sent to executors. All rows are scored on
their whole texts. Null and empty texts score as texts without features. Without
labels all scores are 0. Rows are independent; repeated rows score alike. Columns qs_score and qs_evidence
of the documents are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, released

STRIP = "\"'“”‘’`()[]{}<>.,;:!?¿¡*_#|-–—…&%$@+=~^/\\"
PREFIXES = (4,)
BLOCK, DENSE, TEXTS = 64, 32, 64


def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(STRIP)
    return (f"={core}", *(f"^{core[:n]}" for n in PREFIXES if len(core) > n)) if core else ()


class Features(dict):
    """word -> hashes of its features, remembered up to a bound."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = tuple(map(xxhash.xxh3_64_intdigest, word_features(word)))
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, counts) of a text's features, by hash."""
        counts: dict[int, int] = {}
        for word, n in Counter((text or "").lower().split()).items():
            for h in self[word]:
                counts[h] = counts.get(h, 0) + n
        names = np.fromiter(counts.keys(), np.uint64, len(counts))
        order = np.argsort(names)
        return names[order], np.fromiter(counts.values(), float, len(counts))[order]


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, span of each) of the ranges start..end - 1, one after another."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner], owner


class Model:
    """Weights of features, examples and their index, calibration."""

    def __init__(self, examples: list[tuple[object, int, tuple[np.ndarray, np.ndarray]]], k: int = 15, raise_by: float = 2.0):
        """examples: id, label, (hashes, counts)."""
        self.k = k
        examples = sorted(examples, key=lambda e: (str(type(e[0])), e[0]))
        self.ids, self.labels = [e[0] for e in examples], np.array([e[1] for e in examples], float)
        n, sizes = len(examples), [len(e[2][0]) for e in examples]
        owner = np.repeat(np.arange(n), sizes)
        self.names, at = np.unique(np.concatenate([e[2][0] for e in examples]) if n else np.empty(0, np.uint64), return_inverse=True)
        df = np.bincount(at, minlength=len(self.names))
        toxic, bad = np.bincount(at, self.labels[owner], len(self.names)), self.labels.sum()
        clean = df - toxic
        odds = np.log((toxic + 0.5) / (bad - toxic + 0.5)) - np.log((clean + 0.5) / (n - bad - clean + 0.5))
        sure = np.maximum(0, np.abs(odds) - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))
        self.weight, self.new = np.log((n + 1) / np.maximum(df, 1)) * (1 + raise_by * sure), float(np.log(n + 1))
        tf = 1 + np.log(np.concatenate([e[2][1] for e in examples]) if n else np.empty(0))
        w = tf * self.weight[at]
        norm = np.sqrt(np.bincount(owner, w * w, n))
        w /= np.where(norm > 0, norm, 1)[owner]
        # frequent features: rows of a matrix; the others: postings by feature, with the largest weight of each block
        often = np.flatnonzero(df > max(1, n // DENSE))
        self.row = np.full(len(self.names), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), -(-n // BLOCK) * BLOCK), np.float32)
        common = self.row[at] >= 0
        self.dense[self.row[at[common]], owner[common]] = w[common]
        f, self.at, self.w = at[~common], owner[~common], w[~common]
        order = np.lexsort((self.at, f))
        f, self.at, self.w = f[order], self.at[order], self.w[order]
        first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (self.at[1:] // BLOCK != self.at[:-1] // BLOCK)]) if len(f) else np.empty(0, np.int64)
        self.block, self.start = self.at[first] // BLOCK, np.append(first, len(f))
        self.most = np.maximum.reduceat(self.w, first) if len(f) else np.empty(0)
        self.cut = np.searchsorted(f[first], np.arange(len(self.names) + 1))  # a feature's blocks
        self.curve, self.plain = ([0.0], [0.0]), 0.0
        near = []
        for s in range(0, n, TEXTS):
            near += self.nearest([e[2] for e in examples[s : s + TEXTS]], s)
        raw = [self.vote(x) for x in near]
        alone = [y for r, y in zip(raw, self.labels) if r is None]
        self.plain = (sum(alone) + bad / n) / (len(alone) + 1) if n else 0.0
        self.curve = monotone([(r, y) for r, y in zip(raw, self.labels) if r is not None])

    def vector(self, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of known features, weights): a text's vector, its length taken over all its features."""
        if not len(self.names) or not len(names):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[at] == names
        w = (1 + np.log(counts)) * np.where(known, self.weight[at], self.new)
        norm = np.sqrt(float(w @ w))
        return at[known], w[known] / (norm or 1.0)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], skip: int | None = None) -> list[list[tuple[int, float]]]:
        """For each text the k most similar examples, exact: (example, cosine) by falling cosine, then example. skip: the example that the first text is, and so on."""
        vectors = [self.vector(*t) for t in texts]
        asked = np.zeros((len(vectors), len(self.dense)), np.float32)
        for i, (f, w) in enumerate(vectors):
            row = self.row[f]
            asked[i, row[row >= 0]] = w[row >= 0]
        sums = (asked @ self.dense).astype(float)
        return [self._nearest(f[self.row[f] < 0], w[self.row[f] < 0], sums[i], -1 if skip is None else skip + i) for i, (f, w) in enumerate(vectors)]

    def _nearest(self, f: np.ndarray, w: np.ndarray, total: np.ndarray, skip: int) -> list[tuple[int, float]]:
        """f, w: rare features; total: what the frequent ones add to each example."""
        if not len(total):
            return []
        piece, owner = spans(self.cut[f], self.cut[f + 1])
        weight, block = w[owner], self.block[piece]
        bound = total.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, weight * self.most[piece], len(total) // BLOCK)
        ranked = np.argsort(-bound, kind="stable")
        found: list[tuple[float, int]] = []
        at, size = 0, 1 + 2 * self.k // BLOCK
        while at < len(ranked) and bound[ranked[at]] > 0 and (len(found) < self.k or bound[ranked[at]] >= -found[self.k - 1][0] - 2e-6):
            chosen = ranked[at : at + size]
            at, size = at + size, 4 * size
            mine = np.zeros(len(bound), bool)
            mine[chosen] = True
            use = np.flatnonzero(mine[block])
            place, of = spans(self.start[piece[use]], self.start[piece[use] + 1])
            score = np.where(np.repeat(mine, BLOCK), total, 0.0) + np.bincount(self.at[place], weight[use][of] * self.w[place], len(total))
            hit = np.flatnonzero(score > 1e-6)
            hit = hit[hit != skip]
            if len(hit) > self.k:  # all that tie with the last stay until they are sorted
                hit = hit[score[hit] >= np.partition(score[hit], -self.k)[-self.k] - 2e-6]
            found = sorted(found + [(-round(float(score[i]), 6), int(i)) for i in hit])[: self.k]
        return [(i, -s) for s, i in found]

    def vote(self, near: list[tuple[int, float]]) -> float | None:
        total = sum(s * s for _, s in near)
        return sum(s * s * self.labels[i] for i, s in near) / total if total else None

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[object, int, float]]]]:
        """(calibrated score, evidence: id, label, similarity) of each text."""
        out = []
        for near in self.nearest(texts):
            raw = self.vote(near)
            score = self.plain if raw is None else float(np.interp(raw, *self.curve))
            out.append((min(1.0, max(0.0, score)), [(self.ids[i], int(self.labels[i]), s) for i, s in near]))
        return out


def monotone(points: list[tuple[float, float]]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators fit of labels by votes, as points to interpolate between."""
    if not points:
        return [0.0, 1.0], [0.0, 1.0]
    pools: list[list[float]] = []
    for x, y in sorted(points):
        pools.append([x, x, y, 1.0])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs, ys = [], []
    for lo, hi, y, n in pools:
        for x in {lo, hi} if lo != hi else {lo}:
            xs.append(x)
            ys.append((y + 0.5) / (n + 1.0))
    order = np.argsort(xs, kind="stable")
    return [xs[i] for i in order], list(np.maximum.accumulate([ys[i] for i in order]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 2_500, k: int = 15) -> Model:
    """A model from the labelled rows where `learn` (over the label table's id) holds."""
    rows = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("qs_id")).agg((F.max(label_col) > 0).cast("int").alias("qs_y"))
    rows = F.broadcast(rows.orderBy(F.xxhash64("qs_id"), "qs_id").limit(max_examples))  # at most max_examples ids and labels
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(rows, F.col("id") == F.col("qs_id")).select("id", "qs_y", "text")
    once = Window.partitionBy(F.xxhash64("text"), "text").orderBy(F.desc("qs_y"), "id")  # copies would count as evidence of their own
    held = scratch.save(held.withColumn("qs_r", F.row_number().over(once)).where("qs_r = 1").drop("qs_r"), "examples")
    memo = Features()
    return Model([(r["id"], r["qs_y"], memo.of(r["text"])) for r in held.toLocalIterator()], k)  # at most max_examples rows


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", shown: int = 3) -> DataFrame:
    """All rows with their columns, and qs_score, qs_evidence (the `shown` nearest: example, toxic, similarity)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("qs_score", "qs_evidence")
    at, cols = docs.columns.index(text_col), docs.columns
    schema = docs.withColumns({"qs_score": F.lit(0.0), "qs_evidence": F.array().cast("array<struct<example string, toxic int, similarity double>>")}).schema
    kind = pa.list_(pa.struct([("example", pa.string()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches):
        model, memo = sent.value, Features()
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                made = model.score([memo.of(text) for text in batch.column(at).to_pylist()])
                evidence = [[{"example": str(i), "toxic": y, "similarity": s} for i, y, s in e[:shown]] for _, e in made]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in made], pa.float64()), pa.array(evidence, kind)], names=[*cols, "qs_score", "qs_evidence"])

    return docs.mapInArrow(released(run), schema)

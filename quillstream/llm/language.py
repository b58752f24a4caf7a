"""Language identification by a byte convolutional network trained in numpy.

Texts are cut into windows of a fixed number of bytes (ASCII letters in lower case, zero
filled). Filters of several widths run over the bytes, each filter's largest response in the window is
kept, and a softmax layer gives the window's probabilities. A text's are the mean
over all its windows, weighted by their bytes. Filters act on one-hot bytes, so
a filter bank is a table per place; for scoring, tables of neighbouring places are added
up to tables over byte pairs.

Training takes at most `per_lang` labelled texts of each language (the first by hash of
their id) and `per_text` windows of each; with the number of languages, this bounds what reaches the driver. Every
language of the labelled rows is learned. Every
whole text is scored; of equally likely languages the first by name is taken. Null texts and texts without a letter are `und` with score 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = re.compile(rb"[A-Za-z]")
WIDTHS = (2, 3, 4)


def cut(text: str, size: int, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes in each): the whole text, neighbouring windows sharing `overlap` bytes."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    step = size - overlap
    n = max(1, -(-(len(data) - overlap) // step))
    padded = np.zeros((n - 1) * step + size, np.uint8)
    padded[: len(data)] = data
    held = np.full(n, step)
    held[-1] = len(data) - (n - 1) * step
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step], np.maximum(held, 1)


class Net:
    """Tables W[w][place, byte, filter], biases, output layer."""

    def __init__(self, langs: list[str], window: int = 192, filters: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs, self.window, self.filters = langs, window, filters
        self.w = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(filters, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, at least 0, and where."""
        top, where = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            act = sum(self.w[w][j][x[:, j : j + span]] for j in range(w))
            at = act.argmax(axis=1)
            top.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0] + self.b[w])
            where.append(at)
        return np.concatenate(top, axis=1), np.concatenate(where, axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        n, f = len(x), self.filters
        for epoch in range(epochs):
            step = rate * 0.6**epoch
            for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
                xb, yb = x[rows], y[rows]
                top, at = self.pooled(xb)
                hid = np.maximum(top, 0)
                p = softmax(hid @ self.out + self.bias)
                p[np.arange(len(rows)), yb] -= 1
                back = (p @ self.out.T) * (top > 0)
                self.out -= step * (hid.T @ p) / len(rows) * 4
                self.bias -= step * p.mean(axis=0)
                for i, w in enumerate(WIDTHS):
                    g, spot = back[:, i * f : (i + 1) * f], at[:, i * f : (i + 1) * f]
                    self.b[w] -= step * g.mean(axis=0)
                    for j in range(w):
                        seen = np.take_along_axis(xb, spot + j, axis=1)
                        np.subtract.at(self.w[w][j], (seen, np.arange(f)[None, :]), step * g * 0.5)

    def ready(self) -> None:
        """Tables over byte pairs for scoring."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.fast = {w: [(j, pair(t[j], t[j + 1]) if j + 1 < w else t[j]) for j in range(0, w, 2)] for w, t in self.w.items()}

    def probabilities(self, x: np.ndarray, part: int = 48) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for s in range(0, len(x), part):
            xb = x[s : s + part].astype(np.int32)
            pairs = xb[:, :-1] * 256 + xb[:, 1:]
            top = []
            for w in WIDTHS:
                span, act = self.window - w + 1, None
                for j, t in self.fast[w]:
                    got = t.take((pairs if len(t) > 256 else xb)[:, j : j + span], axis=0)
                    act = got if act is None else np.add(act, got, out=act)
                top.append(act.max(axis=1) + self.b[w])
            out[s : s + part] = softmax(np.maximum(np.concatenate(top, axis=1), 0) @ self.out + self.bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text.encode()[:4096])) or any(map(str.isalpha, text))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1200, per_text: int = 4, window: int = 192) -> Net | None:
    """A net from labelled rows where `learn` holds; None without any."""
    size = F.length(text_col)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (size > 0)).withColumns({lang_col: F.col(lang_col).cast("string"), "qs_h": F.xxhash64(id_col)})
    held = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count("*")).collect()}  # a row for each language
    if not held:
        return None
    # A bound on the hash keeps somewhat more than per_lang rows of each language before any are moved.
    share = F.create_map(*[F.lit(x) for lang, n in held.items() for x in (lang, min(1.0, (1.5 * per_lang + 50) / n))])
    rows = rows.where(F.pmod("qs_h", F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20))
    order = Window.partitionBy(lang_col).orderBy(F.pmod("qs_h", F.lit(1 << 20)), "qs_h", id_col)
    spots = F.transform(F.sequence(F.lit(0), F.lit(per_text - 1)), lambda i: F.substring(F.col(text_col), (F.floor(i * F.greatest(size - window, F.lit(0)) / max(1, per_text - 1)) + 1).cast("int"), F.lit(window)))
    rows = rows.select(lang_col, id_col, "qs_h", F.array_distinct(spots).alias("parts"))  # whole texts are not moved
    got = rows.withColumn("qs_rank", F.row_number().over(order)).where(F.col("qs_rank") <= per_lang).select(lang_col, "qs_h", "parts").collect()
    langs = sorted(held)
    x, y = [], []
    for lang, _, parts in sorted(got, key=lambda r: (r[1], r[0])):
        for part in parts:
            if has_letter(part):
                x.append(cut(part, window)[0][0])
                y.append(langs.index(lang))
    net = Net(langs, window)
    if x:
        net.fit(np.stack(x), np.array(y))
    net.ready()
    return net


def identify(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        net = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                langs, scores = [], []
                for text in batch.column(1).to_pylist():
                    if net is None or not text or not has_letter(text):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    x, held = cut(text, net.window)
                    p = (net.probabilities(x) * held[:, None]).sum(axis=0) / held.sum()
                    langs.append(net.langs[int(p.argmax())])
                    scores.append(min(1.0, float(p.max())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)

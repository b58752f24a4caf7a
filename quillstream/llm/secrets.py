"""Secret scans by assignment-aware lexing.

Every text is first matched against three base patterns. Texts that hold a `:` or
`=` are then lexed, line by line, into name-literal pairs (`name = "x"`,
`name: x`, `"name" => 'x'`, `x["name"] = "y"`, `name: type = "x"`; literals of several lines and continued lines are not joined). String constants are propagated through later
right-hand sides, including concatenation with `+`; an unquoted value is one run of letters, digits
and `+/_.=~-` unless all its parts between `+` are known names. A value reaching a
sensitive name is scored by that name and by the value's length and entropy. All
literals that the value is made of are reported, wherever they stand.

Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results, any other column is ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of any length, kept from 32 on

TOKEN = re.compile(
    r"""(?P<str>"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*')"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|[:=+])"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*)"""
    r"""|(?P<bare>[A-Za-z0-9/_.~-][A-Za-z0-9+/_.=~-]*)"""
    r"""|(?P<space>[^\S\n]+)|(?P<other>.)"""
)
#: An unquoted value after an assignment.
RUN = re.compile(r"[A-Za-z0-9+/_.=~-]+")
#: Parts of a name that make it sensitive, and how much.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|<.*>|\$\{.*\}|%.*%|your.*|change.?me|example.*|dummy|none|null|true|false|todo|test)$")
#: Characters of a value that are kept to tell placeholders; longer values are none.
KEPT = 1000
SPLIT = re.compile(r"[_.$-]+|(?<=[a-z0-9])(?=[A-Z])")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64()), ("base", pa.bool_())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans: leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_score(name: str) -> float:
    """0 to 1: the parts of an identifier, joined by or."""
    left = 1.0
    for part in SPLIT.split(name):
        left *= 1 - SENSITIVE.get(part.lower(), 0.0)
    return 1 - left


class Value:
    """What a right-hand side is made of: its own literals' spans and the constants it refers to. Length and counts of characters are exact; the text itself is kept up to `KEPT` characters."""

    __slots__ = ("length", "counts", "text", "spans", "parts", "best")

    def __init__(self, text: str = "", spans: tuple = ()):
        self.length, self.counts, self.text = len(text), Counter(text), text if len(text) <= KEPT else None
        self.spans, self.parts, self.best = list(spans), [], (0.0, "")

    def add(self, other: Value, part: bool) -> None:
        self.length += other.length
        self.counts += other.counts
        self.text = self.text + other.text if self.text is not None and other.text is not None and self.length <= KEPT else None
        if part:
            self.parts.append(other)
        else:
            self.spans += other.spans

    def score(self) -> float:
        """0 to 1: longer and less even strings look more like secrets."""
        if self.length < 8 or self.text is not None and PLACEHOLDER.match(self.text) or any(c.isspace() for c in self.counts):
            return 0.0
        bits = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        return min(1.0, bits / 3.5) * min(self.length, 12) / 12

    def mark(self, score: float, name: str) -> None:
        """Every literal that the value is made of gets this score, unless it has a better one; what has been reached with a better one is not walked again."""
        todo = [self]
        while todo:
            value = todo.pop()
            if value.best < (score, name):
                value.best = (score, name)
                todo += value.parts


def literal_score(value: str) -> float:
    return Value(value).score()


def _target(toks: list, i: int) -> tuple[str, int] | None:
    """(name, place of its value) if the tokens from i on begin an assignment: `name = `, `"name": `, `name["key"] = ` (the key names it), `name: type = "literal"`."""
    kind, word = toks[i][:2]
    if kind not in ("name", "str") or i + 2 >= len(toks):
        return None
    at = i + 1
    if kind == "str" and toks[at][1] == "]" and i and toks[i - 1][1] == "[":
        at += 1
    if at + 1 >= len(toks) or toks[at][1] not in ("=", ":", ":=", "=>"):
        return None
    if toks[at][1] == ":":
        end = at + 1
        while end < len(toks) and (toks[end][0] == "name" or toks[end][1] in ("[", "]", ",", "|", "?")):
            end += 1
        if end > at + 1 and end + 1 < len(toks) and toks[end][1] == "=" and toks[end + 1][0] == "str":
            at = end
    return word.strip("\"'"), at + 1


def values(text: str) -> list[tuple[str, Value]]:
    """(name, value) of the assignments, constants propagated in reading order. Linear in the text: a constant is referred to, not copied."""
    known: dict[str, Value] = {}
    out, at = [], 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if ":" not in line and "=" not in line:
            continue
        toks = [(m.lastgroup, m.group(), begin + m.start(), begin + m.end()) for m in TOKEN.finditer(line) if m.lastgroup != "space"]
        i = 0
        while i + 2 < len(toks):
            target = _target(toks, i)
            if target is None:
                i += 1
                continue
            name, j = target
            first, whole, value = j, True, Value()
            run = RUN.match(line, toks[j][2] - begin)
            if run and run.end() > toks[j][3] - begin:  # longer than its first token
                after = next((n for n in range(j, len(toks)) if toks[n][2] - begin >= run.end()), len(toks))
                joined = line[run.end() : run.end() + 1] in ("'", '"') or after < len(toks) and toks[after][1] == "+"
                if not joined and not all(part in known for part in run.group().split("+")):
                    known[name] = Value(run.group(), [(begin + run.start(), begin + run.end())])
                    out.append((name, known[name]))
                    i = after
                    continue
            while j < len(toks):
                k, w, s, e = toks[j]
                if k == "str":
                    value.add(Value(w[1:-1], [(s + 1, e - 1)]), False)
                elif k == "name" and w in known:
                    value.add(known[w], True)
                elif k in ("bare", "name") and j == first and (j + 1 >= len(toks) or toks[j + 1][1] != "+"):
                    value = Value(w, [(s, e)])
                else:
                    whole = False
                j += 1
                if j < len(toks) and toks[j][1] == "+":
                    j += 1
                else:
                    break
            if whole and value.length:
                known[name] = value
                out.append((name, value))
            i = max(j, i + 2)
    return out


def scan_text(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, str, float, bool]]:
    """All spans of a text, base ones first class, ordered by start, then kind."""
    found = [(k, s, e, "", 1.0, True) for k, s, e in base_spans(text)]
    if ":" in text or "=" in text:
        best: dict[tuple[int, int], tuple[float, str]] = {}
        made = values(text)
        for name, value in made:
            score = name_score(name) * value.score()
            if score >= threshold:
                value.mark(score, name)
        for _, value in made:
            if value.best[0] >= threshold:
                for span in value.spans:
                    best[span] = max(best.get(span, (0.0, "")), value.best)
        found += [("literal", s, e, name, score, False) for (s, e), (score, name) in best.items() if e > s]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, spans array of kind, start, end, name, score, base) for every row. Offsets are code points, ends exclusive."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append([dict(zip(("kind", "start", "end", "name", "score", "base"), s)) for s in scan_text(text, threshold)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], ["id", "spans"])

    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, spans array<struct<kind string, start bigint, end bigint, name string, score double, base boolean>>")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

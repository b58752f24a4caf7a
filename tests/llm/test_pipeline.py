"""Registered queries of the operators, and the pipeline, at the smallest scale."""

import collections
import os
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillstream.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), queries.ORACLE[name], FOLDER)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], FOLDER)
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2]
    # brute force of the stages that leave texts alone
    from test_operators import brute

    rows = sorted(seen[2].select("doc_id", "text").collect())
    found = brute([r["text"] for r in rows], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert {r["doc_id"] for r in seen[3].collect()} == {rows[i]["doc_id"] for i, (n, c) in found.items() if c == i}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in seen[3].collect() if any(t in r["text"] for t in items)}
    assert not leaks & {r["doc_id"] for r in seen[4].collect()}


def lines_by_brute_force(rows):
    """Texts without repeated lines, in order of id; rows of distinct ids."""
    from test_operators import line_dedup, within_one

    first, out = {}, []
    for d, text in rows:
        for p, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(line_dedup.BLANK):
                first.setdefault(line, (d, p))
    far = [x for x in first if len(x) >= line_dedup.FUZZY_CHARS]
    halves = collections.defaultdict(list)
    for x in far:
        for n in (len(x), len(x) - 1):
            halves[n, 0, x[: n // 2]].append(x)
            halves[n, 1, x[len(x) - (n - n // 2) :]].append(x)
    gone = {x for near in halves.values() for x in near for y in near if first[y] < first[x] and within_one(x, y)}
    for d, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for p, x in enumerate(lines) if x not in first or (first[x] == (d, p) and x not in gone)]
        if text is None or len(kept) == len(lines) or "\n".join(kept).strip(" \n\t\r"):
            out.append((d, None if text is None else "\n".join(kept)))
    return out


def test_run_against_brute_force(spark):
    from test_operators import brute, items_by_brute_force, water

    from quillstream.llm import toxicity

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = collections.defaultdict(int)
    for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["toxic"] is not None:
            labels[r["doc_id"]] = max(labels[r["doc_id"]], int(r["toxic"] > 0))
    memo, once = toxicity.Features(), {}
    for i in sorted(labels, key=lambda i: (-labels[i], i)):
        if i in docs:
            once.setdefault(docs[i]["text"], (i, labels[i]))
    model = toxicity.Model([(i, y, memo.of(t)) for t, (i, y) in once.items()])
    rows = [(i, docs[i]["text"]) for i in sorted(docs) if model.score([memo.of(docs[i]["text"])])[0][0] < 0.5]
    assert 0 < len(docs) - len(rows) < len(docs) / 4
    rows = lines_by_brute_force(rows)
    found = brute([t for _, t in rows], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    rows = [row for k, row in enumerate(rows) if found[k][0] == 0 or found[k][1] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [row for row in rows if not items_by_brute_force(row[1], items)]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    whole = collections.Counter()
    for i in size:
        whole[docs[i]["source"]] += size[i]
    want = water(dict(whole))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in got} == {i: (n, whole[docs[i]["source"]]) for i, n in size.items()}
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[docs[r["doc_id"]]["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[docs[r["doc_id"]]["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 128 for s in want)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, extra columns with the names of the stages' own, no rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, qs_score string, qs_items int, n_lines string, id long, qs_id long"
    rows = [(1, "same words here and there again", "en", "s", 31, "x", 1, "l", 5, 6)] * 3 + [(None, None, None, None, None, None, None, None, None, None)] * 2 + [(2, "", "en", None, 0, "y", 2, "m", 7, 8), (3, " \n ", None, "s", 3, None, None, None, None, None), (None, "text without id", "en", "t", 15, "z", 3, "n", 9, 9)]
    docs = spark.createDataFrame(rows, names)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), FOLDER).count() == 0
        assert {r["qs_score"] for r in out.collect()} <= {"x", "y", "z", None} and out.count() >= 4
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert mixed.count() == len(rows) and corpus_pipeline.STAGES[4][1](spark, docs.limit(0), FOLDER).count() == 0

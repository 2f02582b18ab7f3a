from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from lodestar.llm import fingerprints, line_dedup
from tests.llm.helpers import DOCS, documents, rows_of

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_lines(rows):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and len(key(x)) >= 10:
                held[key(x)].add(r["doc_id"])
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        stays = lambda x: r["doc_id"] is None or len(key(x)) < 10 or min(held[key(x)]) == r["doc_id"]  # noqa: B023, E731
        kept = [x for x in lines if stays(x)]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup_matches_brute_force(spark, extra):
    docs = documents(spark, extra=extra)
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows_of(line_dedup.digests(docs))), key=str)
    assert found == brute_lines(rows_of(docs))


def test_line_dedup_long_document_and_hot_line(spark):
    hot = "this line is in every document"
    texts = ["\n".join(f"line number {i} of this text" for i in range(300)), *[f"{hot}\nown line number {i}" for i in range(100)]]
    docs = documents(spark, texts)
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows_of(line_dedup.digests(docs))), key=str)
    assert found == brute_lines(rows_of(docs))


@pytest.mark.parametrize("salts", [1, 7, 5000])
def test_line_dedup_by_slices(spark, salts):
    docs = documents(spark, [f"a shared line of text\nanother one, number {i % 9}" for i in range(80)])
    found = sorted((r["doc_id"], r["n_dropped"]) for r in rows_of(line_dedup.deduplicate(docs.filter("doc_id IS NOT NULL"), salts=salts)))
    assert found == [(d, n) for d, _, n, _ in sorted(x for x in brute_lines(rows_of(docs)) if x[0] is not None)]


def test_line_dedup_keeps_columns_and_empty_tables(spark):
    docs = documents(spark)
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.digests(spark.createDataFrame([], DOCS)).count() == 0


def brute_near(rows):
    texts = sorted(((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None), key=lambda p: (-p[0], p[1]))
    pairs = [(*x, texts[(i + 1) % len(texts)][1]) for i, x in enumerate(texts)] + [(None, r["text"] or "", "") for r in rows if r["doc_id"] is None]
    out = []
    for doc, text, following in pairs:
        half = len(text) // 2
        out.append((doc, len(text), sha(text[: len(text) - half] + following[:half])))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_fingerprints_of_edited_texts(spark, extra):
    docs = documents(spark, extra=extra)
    rows = rows_of(fingerprints.near_texts(docs))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == brute_near(rows_of(docs))
    by_text = defaultdict(set)
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(docs) if r["doc_id"] is not None}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]]].add(r["fingerprint"])
            if sha(texts[r["doc_id"]]) == r["edited_sha256"]:
                assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) == len({f for v in by_text.values() for f in v})


def test_differing_branches_locate_edits(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    pairs = spark.createDataFrame([(a, a), (a, a.replace("four", "4")), (a, a + "\nsix"), (a, ""), ("", ""), (a, "new\n\n" + a), (a, "zero\n" + a)], "l string, r string")
    got = [(r.left_root == r.right_root, r.likeness, [(d.side, d.section, d.paragraph) for d in r.differing]) for r in fingerprints.compare(pairs, "l", "r").collect()]
    assert got[0] == (True, 1.0, []) and got[4] == (True, 1.0, [])
    assert got[1][0] is False and got[1][2] == [("left", 1, 1), ("right", 1, 1)]
    assert got[2][2] == [("right", 2, 1)]
    assert got[3][2] == [("left", 0, 0), ("left", 0, 1), ("left", 1, 0), ("left", 1, 1), ("left", 2, 0), ("right", 0, 0)]
    assert got[5][2] == got[6][2] == [("right", 0, 0)]  # what was inserted marks nothing after it


def test_fingerprints_of_many_rows_without_id(spark):
    rows = [(None, f"text {i % 7} " * (i % 5), "en", "s", 1) for i in range(60)] + [(i, f"own text {i}", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    found = rows_of(fingerprints.near_texts(docs))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str) == brute_near(rows_of(docs))


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.near_texts(spark.createDataFrame([], DOCS)).count() == 0
    one = rows_of(fingerprints.near_texts(documents(spark, ["alone here"])))
    assert one[0]["edited_sha256"] == sha("alonealone"[:5] + "alone"[:5])

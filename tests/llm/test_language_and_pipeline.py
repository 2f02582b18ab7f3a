from __future__ import annotations

import random
import zlib

import zstandard

import corpus_pipeline
from lodestar.llm import language_id, near_dedup, packing
from tests.llm.helpers import DOCS, awkward_texts, documents, rows_of
from tests.llm.test_packing_and_near import brute_classes, brute_pack
from tests.llm.test_search_and_secrets import brute_hits

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or", "fr": "eau oux ère tion que ment lle aî ois ée", "de": "sch ung ein ich ge ver lich über heit ß"}


def spoken(spark, n=240):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 200)))
        rows.append((i, text, lang, "s", len(text)))
    return spark.createDataFrame(rows, DOCS)


def test_held_out_accuracy(spark):
    docs = spoken(spark)
    truth = {r["doc_id"]: r["lang"] for r in rows_of(docs)}
    rows = rows_of(language_id.identify(docs))
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(out) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spoken(spark)
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 'xx' ELSE lang END AS lang", "source", "n_chars")
    key = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in rows_of(language_id.identify(d)))
    assert key(docs) == key(changed)


def test_short_texts_are_told_apart(spark):
    models, rng, rows = language_id.fit(spoken(spark)), random.Random(3), []
    for i in range(300):
        lang, words = list(SYLLABLES)[i % 3], 1 + i // 3 % 5
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(3)) for _ in range(words)), lang, "s", words))
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in rows_of(language_id.classify(docs, models))}
    for words, kept, least in ((1, 0.9, 0.6), (2, 0.95, 0.9), (3, 0.95, 0.95), (4, 0.95, 0.95), (5, 0.95, 0.95)):
        of = [(r[2], found[r[0]]) for r in rows if r[4] == words]
        assert sum(f["accepted"] for _, f in of) / len(of) >= kept, words
        assert sum(f["lang_pred"] == lang for lang, f in of) / len(of) >= least, words


def test_every_labelled_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 400} " * 30, f"l{i % 400}", "s", 1) for i in range(4000)], DOCS)
    assert len(language_id.fit(docs)) == 400
    monkeypatch.setattr(language_id, "ALL_BYTES", 400 * 50)
    models = language_id.fit(docs)
    assert len(models) == 400 and max(map(len, models.values())) <= 50


def brute_language(text, models):
    """Sizes by a plain loop over whole texts of more than ``SHORT_BYTES``; whether the margin is wide."""
    if not any(c.isalpha() for c in text):
        return False
    data, sizes = text.encode(), []
    assert len(data) > language_id.SHORT_BYTES
    for body in models.values():
        packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **language_id.FRAME)
        sizes.append(sum(len(packer.compress(data[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(data), language_id.BLOCK_BYTES)))
    best, second = sorted(sizes)[:2]
    return (second - best) / best >= language_id.MIN_MARGIN


def brute_pipeline(rows, bench, models):
    """The five stages over plain rows (doc_id, text, lang, source); ids are unique here."""
    rows = [r for r in rows if brute_language(r[1] or "", models)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for doc, text, *_ in sorted(rows):
        for x in (text or "").split("\n"):
            held.setdefault(key(x), doc)
    rows = [(doc, "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or held[key(x)] == doc), lang, source) for doc, text, lang, source in rows]
    kept = {c for _, c in brute_classes([{"doc_id": r[0], "text": r[1]} for r in rows])}
    rows = [r for r in rows if r[0] in kept]
    dirty = {h[0] for h in brute_hits([{"doc_id": r[0], "text": r[1]} for r in rows], bench) if h[5]}
    rows = [r for r in rows if r[0] not in dirty]
    items = []
    for doc, text, _, source in rows:
        n = len(text.split())
        for piece in range(max(-(-n // packing.CAPACITY), 1)):
            items.append((-min(packing.CAPACITY, n - piece * packing.CAPACITY), doc, piece, source, " ".join(text.lower().split())))
    items.sort(key=lambda x: (*x[:3], x[4]))
    bins = brute_pack([(-n, source, cluster) for n, _, _, source, cluster in items], packing.CAPACITY)
    return sorted((doc, piece, -n, f"0-{b}") for (n, doc, piece, *_), b in zip(items, bins, strict=True))


def write(spark, folder, rows, bench, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [tuple(r) for r in spoken(spark, 120).collect()]
    line = "this very line is held by many a document of the table"
    rows = [(d, f"{t}\n{line}" if d % 9 == 0 else t, la, None if d % 17 == 0 else f"s{d % 4}", n) for d, t, la, _, n in rows]
    rows += [(500 + i, rows[i][1], rows[i][2], "t", 1) for i in range(4)]  # copies
    words = max((r[1] for r in rows[:120] if "\n" not in r[1]), key=len).split()
    rows += [(600 + i, " ".join(w if k != 7 * i + 3 else "changed" for k, w in enumerate(words)), "en", "t", 1) for i in range(3)]  # near copies
    bench = [(i, " ".join(rng.choice(rows[7][1].split()) for _ in range(30))) for i in range(3)]
    rows += [(700 + i, f"{rows[30 + i][1][::-1]} {b}", "en", "u", 1) for i, (_, b) in enumerate(bench)]
    rows += [(800, " ".join(rows[i][1] for i in range(60)), "en", "v", 1), (900, "12345 " * 40, "en", "v", 1)]
    folder = write(spark, tmp_path, rows, bench)
    models = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    want = brute_pipeline([r[:4] for r in rows], [{"item_id": i, "text": t} for i, t in bench], models)
    got = sorted((r["doc_id"], r["piece"], r["n_words"], r["bin_id"]) for r in rows_of(corpus_pipeline.run(spark, folder)))
    assert got == want
    assert {d for d, *_ in want} & {501, 502, 503, 600, 601, 602, 700, 701, 702, 900} == set() and {500, 800} <= {d for d, *_ in want}  # copies lost their lines: one blank text stays


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Nulls, repeated rows, rows without id, clashing columns and empty tables pass through all stages."""
    extra = documents(spark, extra=True)
    extra.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(None, "x x"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, f"{tmp_path}/a").cache()
        assert after.columns == extra.columns and 0 < after.count() <= docs.count()
        docs = after
    packed = rows_of(corpus_pipeline.run(spark, f"{tmp_path}/a"))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows_of(docs)}
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "b", [], [])).count() == 0
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", None, None, 0)]
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "c", rows, [(1, "a")])).count() == 0


def test_awkward_documents(spark):
    docs = documents(spark, extra=True)
    rows = rows_of(language_id.identify(docs))
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(awkward_texts()):
        assert (by[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty).count() == 0
    unlabelled = documents(spark).selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in rows_of(language_id.identify(unlabelled))} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(2)
    pages = spoken(spark, 150)
    rows = [tuple(r) for r in pages.collect()]
    rows += [(1000 + i, rows[i][1], rows[i][2], "t", rows[i][4]) for i in range(5)]  # copies
    bench = " ".join(rng.choice(rows[7][1].split()) for _ in range(30))
    rows.append((2000, rows[9][1] + " " + bench, rows[9][2], "u", 1))
    rows.append((3000, "12345 67890", "en", "u", 11))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"] for r in rows_of(docs)}
    assert 3000 not in seen["language_id"] and len(seen["language_id"]) >= len(rows) - 8
    assert seen["line_dedup"] == seen["language_id"]
    assert seen["near_dedup"] & set(range(1000, 1005)) == {1000}  # copies lost all their lines: one blank text stays
    assert 2000 not in seen["decontamination"] and seen["near_dedup"] - seen["decontamination"] == {2000}
    packed = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert {r["doc_id"] for r in packed} == seen["decontamination"]


def test_pipeline_near_stage_keeps_one_of_each(spark):
    docs = documents(spark)
    want = {c for _, c in brute_classes(rows_of(docs)) if c is not None}
    assert {r["doc_id"] for r in rows_of(near_dedup.one_of_each(docs))} == want

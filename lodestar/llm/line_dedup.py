"""Line deduplication across documents, in DataFrame functions alone.

Lines become 128-bit key hashes.  The hashes are dealt out by equal ranges of their leading bits,
sorted by hash, document and position, and streamed: the first document of a run of equal hashes
keeps its lines.  A hash is first judged within a slice of the documents, and only each slice's first
holders meet again.  There is a slice for every ``SLICE_DOCS`` documents, so a line that a third of all
documents hold makes no run that grows with the table.  What comes back to a document is not text but a sparse bitmap: 64-bit words of
dropped positions, with all-zero words left out.

Defined results: a null or empty text is one empty line.  Rows with equal doc_id are one document
as to who holds a key first; a very long text is split by the task that holds its row and is rows from
there on; bitmaps belong to a doc_id and a text, so differing texts under one id
stay apart.  A row without doc_id keeps all its lines and holds nothing.  Repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_lower

#: Stripped at both ends of a line: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
MIN_KEY_CHARS = 10
#: Slices of the documents at least, and documents of a slice beyond that.
SALTS, SLICE_DOCS = 32, 100_000
#: Leading bits of a hash that name its range.
RANGE_BITS = 12


def line_keys(text: Column) -> Column:
    """The key of each line."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def _signature(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _held(docs: DataFrame, min_key_chars: int) -> DataFrame:
    """A row for each line that takes part: range, two hashes, document, signature of its text, position."""
    keys = line_keys(F.col("text"))
    lines = F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"), (F.char_length(k) >= min_key_chars).alias("long")))
    long = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", _signature(F.col("text")).alias("sig"), F.explode(F.filter(lines, lambda x: x.long)).alias("x"))
    return long.select(F.shiftrightunsigned("x.h1", 64 - RANGE_BITS).cast("int").alias("range"), "x.h1", "x.h2", "doc_id", "sig", "x.pos")


def dropped_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS, salts: int | None = None) -> DataFrame:
    """(doc_id, sig, pos) of lines whose key a smaller doc_id holds."""
    salts = salts or max(SALTS, -(-docs.count() // SLICE_DOCS))
    rows = _held(docs, min_key_chars).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).repartition("range", "slice")
    in_slice = Window.partitionBy("range", "h1", "h2", "slice").orderBy("doc_id", "pos")
    judged = rows.withColumn("first", F.first("doc_id").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Only first holders of a slice meet again, in a run of at most ``salts`` documents' lines.  The
    # others, which have lost already, stay apart by slice, so that one pass serves both.
    contest = judged.select("range", "h1", "h2", "doc_id", "sig", "pos", (F.col("first") < F.col("doc_id")).alias("lost"), "slice")
    contest = contest.withColumn("ring", F.when(F.col("lost"), F.col("slice") + 1).otherwise(0))
    in_ring = Window.partitionBy("range", "h1", "h2", "ring").orderBy("doc_id", "pos")
    finals = contest.withColumn("winner", F.first("doc_id").over(in_ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return finals.filter(F.col("lost") | (F.col("winner") < F.col("doc_id"))).select("doc_id", "sig", "pos")


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, sig, words): for each text with dropped lines a map from word number to its 64 bits."""
    words = dropped.groupBy("doc_id", "sig", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc_id", "sig").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def deduplicate(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS, salts: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the documents with what is left of their texts."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _applied(base, min_key_chars, salts).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__kept").alias("kept"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; text is what is left of it and n_chars its length.  A null text stays null."""
    x = _applied(docs, MIN_KEY_CHARS, None)
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return x.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def _applied(docs: DataFrame, min_key_chars: int, salts: int | None) -> DataFrame:
    """``docs`` and __lines (how many), __dropped (how many), __kept (the text that is left)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    maps = drop_bitmaps(dropped_lines(base, min_key_chars, salts)).select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), F.col("words").alias("__words"))
    joined = docs.join(maps, (F.col("doc_id").cast("long") == F.col("__id")) & (_signature(F.col("text")) == F.col("__sig")), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    kept = F.expr("filter(__all, (x, i) -> (coalesce(element_at(__words, shiftright(i, 6)), 0L) & shiftleft(1L, i & 63)) = 0)")
    parts = joined.withColumn("__all", lines).withColumn("__left", F.when(F.col("__words").isNull(), F.col("__all")).otherwise(kept))
    return parts.withColumns({"__lines": F.size("__all").cast("long"), "__dropped": (F.size("__all") - F.size("__left")).cast("long"), "__kept": F.array_join("__left", "\n")})


def digests(docs: DataFrame) -> DataFrame:
    """The contract of the query."""
    return deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, u.line, u.pos,
    translate(regexp_replace(regexp_replace(u.line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents) AS u),
held AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM lines WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT l.doc_id, l.line, l.pos, coalesce(h.n >= 2 AND h.first <> l.doc_id, false) AS gone FROM lines AS l LEFT JOIN held AS h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

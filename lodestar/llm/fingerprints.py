"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in SQL functions alone.

A text falls into sections at blank lines, a section into paragraphs at line ends and a paragraph
into pieces of at most ``PIECE_CHARS`` code points.  A node's hash is the SHA-256 of its children's
hashes; so equal roots mean equal texts, and walking down differing branches locates an edit.  The
fingerprint is the root and, after it, the shortened hashes of the leaves, so the likeness of two
texts can be told from their fingerprints alone.

Defined results: a null text is an empty one, which has one empty section with one empty paragraph
without a piece.  A very long text is one row of one task; its tree and labels are in memory at once.
Rows keep their number; rows with equal doc_id are ordered by text.  Rows without a doc_id have no
place in the order: an empty text follows each, and they follow none.  An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import shuffle_partitions

PIECE_CHARS = 100
#: Hexadecimal digits kept of a leaf's hash in the fingerprint.
LABEL_DIGITS = 10


def _pieces(paragraph: Column, size: int) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def tree(text: Column, piece_chars: int = PIECE_CHARS) -> Column:
    """``array<array<array<string>>>``: leaf hashes by section, paragraph and piece."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(_pieces(p, piece_chars), lambda x: F.sha2(x, 256))))


def paragraph_hashes(nodes: Column) -> Column:
    """``array<array<string>>``: a hash for each paragraph of each section."""
    return F.transform(nodes, lambda s: F.transform(s, lambda p: F.sha2(F.concat_ws("", p), 256)))


def section_hashes(nodes: Column) -> Column:
    return F.transform(paragraph_hashes(nodes), lambda s: F.sha2(F.concat_ws("", s), 256))


def root(nodes: Column) -> Column:
    return F.sha2(F.concat_ws("", section_hashes(nodes)), 256)


def labels(nodes: Column) -> Column:
    return F.transform(F.flatten(F.flatten(nodes)), lambda h: F.substring(h, 1, LABEL_DIGITS))


def fingerprint(nodes: Column) -> Column:
    """The root, a colon, and the leaves' labels joined by points."""
    return F.concat(root(nodes), F.lit(":"), F.concat_ws(".", labels(nodes)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal roots, else the Dice coefficient of their distinct leaf labels."""
    left, right = (F.array_distinct(F.split(F.substring_index(x, ":", -1), r"\.")) for x in (a, b))
    shared = F.size(F.array_intersect(left, right))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(F.least(2.0 * shared / (F.size(left) + F.size(right)), F.lit(1.0)))


def differing(a: Column, b: Column) -> Column:
    """Where two trees of paragraph hashes differ: ``array<struct<side, section, paragraph>>``, counted from 0 on each side.

    Children are aligned by their hashes: a section that the other tree holds too is skipped whole,
    wherever it stands, and of the others only the paragraphs that no differing section of the other
    tree holds are edits.  So an inserted section marks none of those after it.
    """
    alone = lambda x, y: F.filter(F.transform(x, lambda s, i: F.struct(i.alias("section"), s.alias("held"))), lambda z: ~F.array_contains(F.transform(y, lambda s: F.array_join(s, ",")), F.array_join(z["held"], ",")))

    def edits(mine: Column, theirs: Column, side: str) -> Column:
        other = F.flatten(F.transform(theirs, lambda z: z["held"]))
        places = F.flatten(F.transform(mine, lambda z: F.transform(z["held"], lambda h, j: F.struct(z["section"].alias("section"), j.alias("paragraph"), h.alias("hash")))))
        return F.transform(F.filter(places, lambda x: ~F.array_contains(other, x["hash"])), lambda x: F.struct(F.lit(side).alias("side"), x["section"].alias("section"), x["paragraph"].alias("paragraph")))

    left, right = alone(a, b), alone(b, a)
    return F.concat(edits(left, right, "left"), edits(right, left, "right"))


def compare(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """For a table with two text columns: both roots, the likeness and the places that differ."""
    a, b = tree(F.col(left)), tree(F.col(right))
    x = pairs.select(a.alias("a"), b.alias("b"))
    return x.select(
        root(F.col("a")).alias("left_root"),
        root(F.col("b")).alias("right_root"),
        likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("likeness"),
        differing(paragraph_hashes(F.col("a")), paragraph_hashes(F.col("b"))).alias("differing"),
    )


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key: a two-level search, so its cost is a square root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    nested = F.array(*[F.array(*[F.lit(v).cast("long") for v in g]) for g in groups])
    coarse = F.size(F.filter(heads, lambda h: h <= key))
    fine = F.size(F.filter(F.get(nested, coarse - 1), lambda v: v <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + fine)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): every document and the next one's text by descending doc_id; the first follows the last.

    Ranges of ids with about equally many documents are dealt out; into each range goes, besides
    its own documents, a copy of the first one of the range that follows.  So every text crosses
    the network once and no task sees more than one range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = max(shuffle_partitions(spark) * 3, 1)
    cuts = [i / ranges for i in range(1, ranges)]
    ids = base.filter(F.col("doc_id").isNotNull())
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", cuts, 50 * ranges).alias("q")).first().q or [])) if cuts else []
    # Ascending bounds; range numbers fall with the id.  Rows without an id are dealt out by their text.
    number = F.lit(len(bounds)) - _bucket(F.col("doc_id"), bounds)
    alone = -1 - F.pmod(F.xxhash64("text"), F.lit(ranges))
    spread = base.withColumn("at", F.when(F.col("doc_id").isNull(), alone).otherwise(number).cast("int"))
    # One key for each range that has rows: its largest id.  As many rows as ranges.
    heads = {r["at"]: r["top"] for r in spread.filter("at >= 0").groupBy("at").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(heads)
    before = {at: used[i - 1] for i, at in enumerate(used)}  # the range before the first is the last
    listed = lambda found, kind: F.array(*[F.lit(found.get(k)).cast(kind) for k in range(len(bounds) + 1)])
    own = F.struct(F.col("at").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(listed(before, "int"), F.col("at")).alias("at"), F.lit(True).alias("guest"))
    # Among rows with the largest id of a range, the one that sorts first is its head.
    is_head = F.coalesce(F.col("doc_id") == F.get(listed(heads, "long"), F.col("at")), F.lit(False))
    dealt = spread.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.at", "to.guest")
    seen = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc(), F.col("text"))
    following = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.lead("text").over(seen))
    return dealt.withColumn("next", following).filter(~F.col("guest")).select("doc_id", "text", "next")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def near_texts(docs: DataFrame) -> DataFrame:
    """The contract of the query: fingerprints of every text and its edited text, and their likenesses."""
    x = with_next(docs)
    x = x.select("doc_id", "text", "next", edited(F.col("text"), F.col("next")).alias("edited"))
    x = x.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[tree(F.col(c)).alias(f"{c}_tree") for c in ("text", "edited", "next")])
    x = x.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("text_tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), fingerprint(F.col("next_tree")).alias("next_fingerprint"))
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM d WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, t, '' FROM d WHERE doc_id IS NULL),
e AS (SELECT *, substring(t, 1, length(t) - length(t) // 2) || substring(nxt, 1, length(t) // 2) AS edited FROM o),
l AS (SELECT doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, unnest(['t', 'e', 'n']) AS which, unnest([t, edited, nxt]) AS text FROM e),
k AS (SELECT doc_id, n_chars, edited_sha256, which, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,{PIECE_CHARS}}}'), lambda x: sha256(x)))) AS tree FROM l),
f AS (SELECT doc_id, n_chars, edited_sha256, which, sha256(array_to_string(list_transform(tree, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(coalesce(array_to_string(p, ''), ''))), ''))), '')) AS root,
  list_transform(flatten(flatten(tree)), lambda h: substring(h, 1, {LABEL_DIGITS})) AS labels FROM k),
g AS (SELECT *, root || ':' || coalesce(array_to_string(labels, '.'), '') AS fp, CASE WHEN len(labels) = 0 THEN [''] ELSE list_distinct(labels) END AS leaves FROM f),
j AS (SELECT a.doc_id, a.n_chars, a.edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0 ELSE 2.0 * len(list_intersect(a.leaves, b.leaves)) / (len(a.leaves) + len(b.leaves)) END::DOUBLE AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0 ELSE 2.0 * len(list_intersect(a.leaves, c.leaves)) / (len(a.leaves) + len(c.leaves)) END::DOUBLE AS near_next
  FROM g AS a JOIN g AS b ON a.doc_id = b.doc_id JOIN g AS c ON a.doc_id = c.doc_id WHERE a.which = 't' AND b.which = 'e' AND c.which = 'n')
SELECT * FROM j
"""

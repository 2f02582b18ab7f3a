"""Benchmark decontamination with a positional inverted index of the training text, in DataFrame functions alone.

1. The index is stored: postings (term, doc_id, sig, pos) of every training token that is a term of
   the benchmark, dealt out by term and sorted by term, document and position.  A frequent term's
   list is cut into slices of documents.  A document's length is a posting of the term ``LENGTH``.
2. A term's frequency is the length of its list.  The terms of each window of an item are ranked by
   it; a window with a term that has no posting can't occur.
3. The lists are intersected at their offsets, the rarest first.  A posting of a window's rarest term,
   less the term's place in the item, is the offset at which the item may lie in the document; it
   stays if the second rarest term's list has a posting at that offset too.  For the few offsets left
   the lists of all the item's terms are intersected; unbroken runs of places as long as a window are
   phrase matches.

Defined results: null text has no words; an item without words has no window; an item without id
can hit words but is not listed; items of equal words count each for itself.  A very long text is
split into words by the task that holds its row and is rows from there on.  Results belong to a doc_id
and a text, so differing texts under one id stay apart, and repeated rows stay repeated.  Empty tables
give empty or clean results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_lower, release, shuffle_partitions, stored

#: Runs of what isn't [\x00-\x2F\x3A-\x60\x7B-\x7F], said by what they hold: Java matches that ten times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW = 10
#: The term under which a document's number of words is posted.
LENGTH = 0
#: A term's list has a slice for so many partitions of the index.
PARTITIONS_A_SLICE = 8
#: Up to so many rows of the benchmark's terms and windows, of a few longs each, are broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _signature(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A table to be broadcast if the count of its rows, or of more than those, allows."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, terms) of the items that have words; equal word sequences share ``item``."""
    terms = F.transform(words(F.col("text").cast("string")), lambda w: F.xxhash64(w))
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), terms.alias("terms")).filter(F.size("terms") > 0).select("item_id", F.xxhash64("terms").alias("item"), "terms")


def places_of(items: DataFrame) -> DataFrame:
    """(item, size, place, term): each item's words, stored."""
    texts = items.dropDuplicates(["item"]).select("item", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
    return stored(texts, "places")


def build_index(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(term, doc_id, sig, pos): the postings of the terms in ``places`` and each document's length, in the shared folder."""
    spark = docs.sparkSession
    asked = places.select("term").distinct().unionByName(spark.range(1).select(F.lit(LENGTH).cast("long").alias("term")))
    asked = _bounded(asked, places.count())
    # The word after the last is null, and its position the document's length.
    every = F.array_append(words(F.col("text").cast("string")), F.lit(None).cast("string"))
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _signature(F.col("text")).alias("sig"), F.posexplode(every).alias("pos", "word"))
    tokens = tokens.select(F.when(F.col("word").isNull(), F.lit(LENGTH).cast("long")).otherwise(F.xxhash64("word")).alias("term"), "doc_id", "sig", "pos")
    document = F.xxhash64("doc_id", "sig")
    held = tokens.join(asked, "term", "left_semi").withColumn("slice", F.pmod(document, F.lit(-(-shuffle_partitions(spark) // PARTITIONS_A_SLICE))))
    held = held.withColumn("list", F.when(F.col("term") == LENGTH, document).otherwise(F.col("term")))
    dealt = held.repartition("list", "slice").sortWithinPartitions("term", "doc_id", "sig", "pos")
    return stored(dealt.select("term", "doc_id", "sig", "pos"), "postings")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, freq): the lengths of the lists."""
    return index.filter(F.col("term") != LENGTH).groupBy("term").agg(F.count("*").alias("freq"))


def ranked_windows(places: DataFrame, freq: DataFrame, window: int) -> DataFrame:
    """(item, term, place, term2, place2): the rarest and the second rarest term of each window whose terms all have postings."""
    last = F.greatest(F.col("size") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("place") - window + 1, F.lit(0)), F.least(F.col("place"), last))
    inside = places.join(freq, "term").select("item", "size", "place", "term", "freq", F.explode(starts).alias("start"))
    per = inside.groupBy("item", "size", "start").agg(F.array_sort(F.collect_list(F.struct("freq", "place", "term"))).alias("r")).filter(F.size("r") == F.least(F.col("size"), F.lit(window)))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return per.select("item", first["term"].alias("term"), first["place"].alias("place"), second["term"].alias("term2"), second["place"].alias("place2")).distinct()


#: The documents of two sides, of which the right one's columns are renamed by ``_right``.
_SAME = "doc_id <=> __doc_id AND sig = __sig"


def _right(df: DataFrame) -> DataFrame:
    """The right side of a join: all columns with two underscores before their names."""
    return df.select(*[F.col(c).alias(f"__{c}") for c in df.columns])


def _holding(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows (term, doc_id, sig, pos and more) that are postings."""
    return rows.join(_right(index), F.expr(f"term = __term AND pos = __pos AND {_SAME}"), "left_semi")


def alignments(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(item, doc_id, sig, offset): where an item may lie, by the lists of its windows' two rarest terms."""
    rows = windows.count()
    found = index.join(_bounded(windows, rows), "term")
    offset = F.col("pos") - F.col("place")
    found = found.select("item", "doc_id", "sig", offset.alias("offset"), F.col("term2").alias("term"), (offset + F.col("place2")).alias("pos")).distinct()
    found = stored(found, "rarest")
    # A list that several windows share is read once; only lists of second rarest terms take part.
    second = index.join(_bounded(windows.select(F.col("term2").alias("term")).filter("term IS NOT NULL").distinct(), rows), "term", "left_semi")
    both = _holding(found.filter("term IS NOT NULL"), second)
    # A window of a single word has no second term.
    return both.unionByName(found.filter("term IS NULL")).select("item", "doc_id", "sig", "offset").distinct()


def phrase_hits(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, sig, item, first, last): word ranges that windows of an item cover."""
    windows = stored(ranked_windows(places, frequencies(index), window), "windows")
    lying = stored(alignments(index, windows), "alignments")
    documents = lying.select("doc_id", "sig").distinct()
    mine = index.join(_right(_bounded(documents, lying.count())), F.expr(_SAME), "left_semi")
    wanted = lying.join(_bounded(places, places.count()), "item").withColumn("pos", F.col("offset") + F.col("place")).filter("pos >= 0")
    met = _holding(wanted, mine)
    one = ["item", "doc_id", "sig", "offset"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*one).orderBy("place"))
    runs = met.withColumn("run", run).groupBy(*one, "size", "run").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    long = runs.filter(F.col("b") - F.col("a") + 1 >= F.least(F.col("size"), F.lit(window)))
    return long.select("doc_id", "sig", "item", (F.col("offset") + F.col("a")).alias("first"), (F.col("offset") + F.col("b")).alias("last"))


def _hit_documents(index: DataFrame, items: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(doc_id, sig, n_hit, items) of the documents with hits, stored."""
    names = items.filter("item_id IS NOT NULL").select("item", "item_id").distinct()
    hits = phrase_hits(index, places, window).join(names, "item", "left")
    covered = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"]))))
    per = hits.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("first", "last")).alias("ranges"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return stored(per.select("doc_id", "sig", F.size(covered).cast("long").alias("n_hit"), "items"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, sig, n_words, n_hit, n_items, items, contaminated): a row for each document."""
    items = items_of(benchmark)
    places = places_of(items)
    index = build_index(docs, places)
    per = _hit_documents(index, items, places, window)
    hit = F.coalesce("__n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    lengths = index.filter(F.col("term") == LENGTH).join(_right(per), F.expr(_SAME), "left")
    return lengths.select("doc_id", "sig", F.col("pos").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (hit > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, phrases: DataFrame, within: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, pos): where all terms of a phrase stand at most ``within`` words from its rarest term, in any order.

    ``phrases`` has item_id and text.  The rarest term's list is intersected with the others', whose
    postings meet it through cells of ``within`` + 1 positions.  Repeated rows give one match.
    """
    items = items_of(phrases)
    places = places_of(items)
    index = build_index(docs, places)
    terms = places.select("item", "term").distinct().join(frequencies(index), "term", "left")
    per = terms.groupBy("item").agg(F.min(F.struct("freq", "term")).alias("r"), F.count("*").alias("n"), F.count("freq").alias("known"), F.collect_list("term").alias("all")).filter("n = known")
    per = stored(per.select("item", F.col("r.term").alias("term"), "n", "all"), "rarest")
    found = index.join(_bounded(per, per.count()), "term").select("item", "doc_id", "sig", "pos", "n", F.explode("all").alias("wanted")).distinct()
    cell = lambda pos: F.floor(pos / (within + 1))
    probes = found.select("*", F.explode(F.sequence(cell(F.col("pos") - within), cell(F.col("pos") + within))).alias("cell"))
    lists = _right(index.withColumn("cell", cell(F.col("pos"))))
    met = probes.join(lists, F.expr(f"wanted = __term AND cell = __cell AND {_SAME} AND abs(pos - __pos) <= {within}"), "left_semi")
    whole = met.groupBy("item", "doc_id", "sig", "pos", "n").agg(F.countDistinct("wanted").alias("have")).filter("have = n")
    return whole.join(items.select("item", "item_id").distinct(), "item").select("doc_id", "item_id", "pos").distinct()


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract of the query."""
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    items = items_of(benchmark)
    places = places_of(items)
    index = build_index(docs, places)
    per = _hit_documents(index, items, places, WINDOW)
    release(index, places)
    dirty = _bounded(per.select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig")), per.count())
    return docs.join(dirty, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (_signature(F.col("text")) == F.col("__sig")), "left_anti")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS k FROM bw),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n),
keyed AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM dw),
hits AS (SELECT keyed.doc_id, keyed.n, keyed.s, win.item_id FROM keyed JOIN win ON keyed.k = win.k AND keyed.n = win.n),
places AS (SELECT DISTINCT doc_id, s + unnest(range(n)) AS p FROM hits),
counted AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted ON d.doc_id = counted.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id
"""

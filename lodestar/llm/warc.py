"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing.  Pages with equal payloads of at least ``MIN_REVISIT_BYTES`` get one response record, that
of the smallest page_id; the others become revisit records that refer to it.

Reading.  Archives are split at any place, and a payload may itself contain the magic line.  Tasks
cut their splits at every magic line and emit for each piece a candidate: its offset and, from its
header, its successor's.  Offsets are made absolute by summing the lengths of a file's splits.
Unbroken stretches of candidates are contracted, and pointer jumping from the start of each file
over what is left (doubling the jumps each round) marks the records that can be reached.  Magic
lines inside payloads are not reached; their pieces are put back into the payload that holds them.

Defined results: a null payload is an empty one; a very long one is a row of its own, however many
magic lines it holds.  A page without id is always a response.  Repeated
rows give repeated records.  Line ends in a url are percent-encoded; a null url has no header.  A
record without a length, or with one that doesn't lead to another record or the end of the file,
ends its file's chain: nothing after it is returned.  Empty tables give empty archives and results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import scratch_path, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 100
#: A table of repeated payloads of up to so many rows (a digest and an id each) is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_GROUPS = 100_000
RECORD_URN = "urn:lodestar:page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): refers_to is null for responses."""
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    x = x.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    repeated = x.filter((F.col("size") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    repeated = stored(repeated.filter(F.col("first") < F.col("last")).select(F.col("digest").alias("same"), "first"), "repeated")
    if repeated.count() <= MAX_BROADCAST_GROUPS:
        repeated = F.broadcast(repeated)
    joined = x.join(repeated, (F.col("digest") == F.col("same")) & F.col("page_id").isNotNull(), "left")
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One archive file for each partition, written by Spark's text sink; its line end is a record's end."""
    x = plan_records(pages)
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    x.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value")).write.option("lineSep", END).text(path)


def parse_header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields (names lower-cased) and the length of a header that starts after the magic line."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = {}
    for line in piece[:cut].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return fields, cut + 4


PIECES = "file string, split long, idx long, local long, size long, head long, body long, type string, urn string, uri string, declared string, total long, refers string, digest string, raw binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def pieces(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """``PIECES`` rows: what lies between magic lines, in each split, with what its header says.

    ``local`` is the place after the magic line, counted from the split's first piece; ``body`` the
    declared block length; ``digest`` that of a block which lies whole in its piece.
    """
    sep = MAGIC.encode()
    names, kinds = zip(*(x.split() for x in PIECES.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, idx, local = None, 0, 0
        for batch in batches:
            rows = []
            for value, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, split) != key:
                    key, idx, local = (file, split), 0, 0
                got = parse_header(value)
                fields, head = got if got else ({}, 0)
                length = fields.get("content-length", "")
                body = int(length) if length.isascii() and length.isdigit() and len(length) < 16 else None
                whole = body is not None and head + body <= len(value)
                total = fields.get("x-payload-length", length)
                row = (file, split, idx, local, len(value), head, body, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), int(total) if total.isascii() and total.isdigit() and len(total) < 16 else None, fields.get("warc-refers-to"), hashlib.sha256(value[head : head + body]).hexdigest() if whole else None, value if raw else None)
                rows.append(row)
                idx, local = idx + 1, local + len(value) + len(sep)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("split")).mapInArrow(run, PIECES)


def candidates(found: DataFrame) -> DataFrame:
    """Pieces with absolute offsets: ``start`` of the magic line, ``next`` where the successor must start, ``file_size``.

    The first piece of a file, what stands before its first magic line, starts at -len(magic).
    """
    sums = found.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("file_size"))
    placed = found.join(bases, ["file", "split"]).withColumn("start", F.col("base") + F.col("local") - len(MAGIC))
    return placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("head") + F.col("body") + len(END))


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, start) of the records on the chain from each file's start.  ``nodes``: (file, start, next, file_size)."""
    real = nodes.filter(F.col("start") >= 0)
    inorder = Window.partitionBy("file").orderBy("start")
    x = real.withColumn("broken", ~F.coalesce(F.col("next") == F.coalesce(F.lead("start").over(inorder), F.col("file_size")), F.lit(False)))
    targets = x.filter(F.col("broken") & F.col("next").isNotNull()).select(F.col("file").alias("f"), F.col("next").alias("target")).distinct()
    x = x.join(targets, (F.col("file") == F.col("f")) & (F.col("start") == F.col("target")), "left").drop("f")
    opens = F.coalesce(F.lag("broken").over(inorder), F.lit(True)) | F.col("target").isNotNull()
    x = stored(x.select("file", "start", "next", opens.cast("int").alias("opens")).withColumn("stretch", F.sum("opens").over(inorder.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "candidates")
    # A stretch of candidates that follow each other is one node from here on.
    short = x.groupBy("file", "stretch").agg(F.min("start").alias("head"), F.max_by("next", "start").alias("exit"))
    heads = short.select(F.col("file").alias("f"), F.col("head").alias("h"), F.col("stretch").alias("to"))
    jumps = stored(short.join(heads, (F.col("file") == F.col("f")) & (F.col("exit") == F.col("h"))).select("file", "stretch", "to"), "jumps")
    reached = stored(short.filter(F.col("head") == 0).select("file", "stretch"), "reached")
    known = reached.count()
    while True:
        step = reached.join(jumps, ["file", "stretch"]).select("file", F.col("to").alias("stretch"))
        reached = stored(reached.unionByName(step).distinct(), "reached")
        if (now := reached.count()) == known:
            break
        known = now
        on = jumps.select("file", F.col("stretch").alias("to"), F.col("to").alias("far"))
        jumps = stored(jumps.join(on, ["file", "to"]).select("file", "stretch", F.col("far").alias("to")), "jumps")
    return x.join(reached, ["file", "stretch"], "left_semi").select("file", "start")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(urn, uri, type, size, digest, refers, payload): the verified records.  ``size`` and ``digest`` are the full payload's.

    ``payload`` is null for revisits, and for all records unless asked for.
    """
    nodes = stored(candidates(pieces(spark, path)).drop("raw"), "pieces")
    good = stored(reachable(nodes.select("file", "start", "next", "file_size")), "records")
    inside = nodes.filter(F.col("start") >= 0).join(good, ["file", "start"], "left_anti")
    records = nodes.join(good, ["file", "start"], "left_semi")
    columns = ["urn", "uri", "type", "size", "digest", "refers", "payload"]
    bare = F.regexp_replace("declared", "^sha256:", "")
    size = F.coalesce("total", "body").alias("size")
    whole = records.filter(F.col("digest").isNotNull())
    digest = F.when(F.col("type") == "revisit", bare).otherwise(F.col("digest")).alias("digest")
    if payloads:
        whole = whole.drop("raw").join(pieces(spark, path, True).select("file", "split", "idx", "raw"), ["file", "split", "idx"])
        block = F.when(F.col("type") != "revisit", F.expr("substring(raw, int(head) + 1, int(body))"))
    else:
        block = F.lit(None).cast("binary")
    out = whole.select("urn", "uri", "type", size, digest, "refers", block.alias("payload"))
    if inside.isEmpty():
        return out
    # Records whose payload has the magic line: their pieces follow them, up to the next record.
    holders = records.filter(F.col("digest").isNull())
    parts = holders.select("file", "split", "idx", "start", F.lit(True).alias("holds")).unionByName(inside.select("file", "split", "idx", "start", F.lit(False).alias("holds")))
    owner = F.last(F.when(F.col("holds"), F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    parts = parts.withColumn("owner", owner).join(pieces(spark, path, True).select("file", "split", "idx", "raw"), ["file", "split", "idx"])
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("p"))
    magic = MAGIC.encode().hex().upper()
    # Joined as hexadecimal text, in one go: appending piece by piece would copy what is there each time.
    text = F.unhex(F.concat(F.lit(magic), F.array_join(F.transform("p", lambda p: F.hex(p.raw)), magic)))
    full = joined.select(F.col("file").alias("f"), "owner", text.alias("bytes")).join(holders, (F.col("f") == holders["file"]) & (F.col("owner") == holders["start"]))
    block = F.expr(f"substring(bytes, int(head) + {len(MAGIC) + 1}, int(body))")
    rest = full.withColumn("block", block).select("urn", "uri", "type", size, F.sha2("block", 256).alias("digest"), "refers", F.col("block").alias("payload") if payloads else F.lit(None).cast("binary").alias("payload"))
    return out.select(*columns).unionByName(rest.select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract of the query: archives are written to the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, rf"^<{RECORD_URN}(-?\d+)>$", 1)
    x = read_archives(spark, path)
    as_long = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return x.select(as_long(F.col("urn")).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), as_long(F.col("refers")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""

"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Lengths are words.  A document longer than a bin is cut into pieces, all but the last full.  No bin
holds two pieces of one source or of one duplicate cluster.  Items are dealt by hash into blocks of
bounded size, longest first within a block.  A block's open bins stand ordered by residual room; the
search starts at the first bin with room enough and goes on to its successors until one is
compatible, so the tightest compatible bin is found.  Each bin carries a bitmap of the sources and
one of the duplicate clusters that it holds.

Only ids and lengths are shuffled, never text.  A hot source only adds bins, it makes no hot task:
blocks depend on the hash of the id, and equal rows are counted before they are dealt.

Defined results: a null or empty text is one piece of length 0.  All rows without a source are of one
further source.  The cluster of a document is the hash of its text with white space and letter case folded,
unless a column is named.  Repeated rows are packed as often as they occur, told apart by ``copy``.
Ties in length go by id, piece and copy; ties in room go to the older bin.  An empty table gives an
empty result; other columns are ignored, whatever their names.  A very long text is many pieces, which
count towards the number of blocks like any others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stored

CAPACITY = 2048
#: Items of a block, about; the only price of more blocks is one tail of half-filled bins for each.
BLOCK_ITEMS = 8192
SCHEMA = "doc_id long, piece int, copy long, n_words long, bin_id string, bin_words long, bin_items int"


class Bins:
    """Open bins ordered by residual room, with conflict bitmaps."""

    def __init__(self, sources: int, clusters: int, capacity: int, room: int = 1024):
        self.capacity, self.n = capacity, 0
        self.left = np.zeros(room, np.int64)
        self.bin = np.zeros(room, np.int64)
        # Bitmaps lie word by word, so that one word of all bins is contiguous.
        self.has_source = np.zeros((max(1, -(-sources // 64)), room), np.uint64)
        self.has_cluster = np.zeros((max(1, -(-clusters // 64)), room), np.uint64)

    def _grow(self) -> None:
        more = len(self.left)
        self.left, self.bin = np.resize(self.left, 2 * more), np.resize(self.bin, 2 * more)
        self.has_source, self.has_cluster = (np.concatenate([x, np.zeros_like(x)], 1) for x in (self.has_source, self.has_cluster))

    def add(self, size: int, source: int, cluster: int) -> int:
        """The bin for an item; cluster -1: the item's cluster has no other member here."""
        n = self.n
        at = int(np.searchsorted(self.left[:n], size, "left"))
        sw, sb = source >> 6, np.uint64(1 << (source & 63))
        cw, cb = max(cluster, 0) >> 6, np.uint64(1 << (cluster & 63)) if cluster >= 0 else np.uint64(0)
        step = 64
        while at < n:  # successors, in chunks that grow
            upto = min(n, at + step)
            free = (self.has_source[sw, at:upto] & sb) | (self.has_cluster[cw, at:upto] & cb) == 0
            hit = int(free.argmax())
            if free[hit]:
                return self._place(at + hit, size, sw, sb, cw, cb)
            at, step = upto, step * 4
        if n == len(self.left):
            self._grow()
        self.left[n], self.bin[n] = self.capacity, n
        self.has_source[:, n] = 0
        self.has_cluster[:, n] = 0
        self.n += 1
        return self._place(n, size, sw, sb, cw, cb)

    def _place(self, at: int, size: int, sw: int, sb, cw: int, cb) -> int:
        which, room = int(self.bin[at]), int(self.left[at]) - size
        self.has_source[sw, at] |= sb
        self.has_cluster[cw, at] |= cb
        # Move the bin down to its new place among those with less room.  Of bins with equal room the older stands first.
        to = int(np.searchsorted(self.left[:at], room, "left"))
        while to < at and self.left[to] == room and self.bin[to] < which:
            to += 1
        if to < at:
            for x in (self.left, self.bin):
                x[to + 1 : at + 1] = x[to:at].copy()
            for x in (self.has_source, self.has_cluster):
                held = x[:, at].copy()
                x[:, to + 1 : at + 1] = x[:, to:at].copy()
                x[:, to] = held
        self.left[to], self.bin[to] = room, which
        return which


def pack_block(block: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows with doc_id, piece, copy, n_words, source, cluster: bin numbers from 0, in column ``bin``."""
    rows = block.sort_values(["n_words", "doc_id", "piece", "copy", "cluster"], ascending=[False, True, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    many = rows["cluster"].duplicated(keep=False).to_numpy()
    clusters = np.full(len(rows), -1, np.int64)
    clusters[many] = pd.factorize(rows["cluster"][many])[0]
    bins = Bins(int(sources.max(initial=-1)) + 1, int(clusters.max(initial=-1)) + 1, capacity)
    rows["bin"] = [bins.add(int(s), int(a), int(c)) for s, a, c in zip(rows["n_words"], sources, clusters, strict=True)]
    return rows


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def _cluster(text: Column) -> Column:
    folded = F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.xxhash64(folded)


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``SCHEMA`` rows, one for each piece of a document.  A 64-bit cluster hash that met another one's would only keep two documents apart."""
    label = F.xxhash64(F.col(cluster).cast("string")) if cluster else _cluster(F.col("text").cast("string"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), label.alias("cluster"), word_count(F.col("text").cast("string")).cast("long").alias("total"))
    pieces = F.greatest(F.ceil(F.col("total") / capacity).cast("int"), F.lit(1))
    counted = sized.groupBy("doc_id", "source", "cluster", "total").agg(F.count("*").alias("copies")).withColumn("pieces", pieces)
    counted = stored(counted, "sizes")  # ids and lengths alone: counted first, then packed
    total_items = counted.agg(F.sum(F.col("pieces") * F.col("copies")).alias("n")).first().n or 0
    items = counted.select("doc_id", "source", "cluster", "total", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "pieces")
    items = items.select("doc_id", "source", "cluster", "copy", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("total"))
    size = F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity)
    items = items.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "cluster", "copy", "piece", size.alias("n_words"))
    blocks = max(1, -(-total_items // block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(blocks)).cast("int"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        number = int(block["block"].iloc[0])
        block["source"] = block["source"].where(~block["no_source"], None)
        rows = pack_block(block, capacity)
        rows["bin_id"] = f"{number}-" + rows["bin"].astype(str)
        groups = rows.groupby("bin")["n_words"]
        rows["bin_words"], rows["bin_items"] = groups.transform("sum"), groups.transform("size").astype("int32")
        return rows[["doc_id", "piece", "copy", "n_words", "bin_id", "bin_words", "bin_items"]]

    return items.groupBy("block").applyInPandas(run, SCHEMA)



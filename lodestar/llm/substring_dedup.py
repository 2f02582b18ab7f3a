"""Substring deduplication: words covered by a window that also starts earlier are removed.

Pass 1, a count-min prefilter.  Two equal windows have the same least inner gram (their minimizer),
so how often minimizers occur is never below how often their windows do.  Each task counts the
minimizers of its documents in count-min arrays: ``DEPTH`` rows with a cell for every ``CELL_TEXT``
bytes of text of the table.  The arrays, kept sparse and dealt out by ranges of cells, are summed cell
by cell; a merged cell overestimates what fell into it.  What goes back to a document is which of its
cells hold more than one; windows with a cell that holds one are set aside, and no repeated window is
lost with them.

Pass 2, exact grouping.  Only windows whose every cell holds more are hashed to 128 bits and grouped.
A task keeps just the first occurrence of a window that it sees several times, and knows the others
as removable at once; so a passage that a third of all documents hold sends one entry per task.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none, a text shorter than
a window loses none.  A very long text is one row of one task, in memory as a whole.  Rows with equal
doc_id count as one document as to what comes earlier; a row without doc_id comes after all others.
Results belong to a doc_id and a text, so repeated rows give repeated results.  Empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import shuffle_partitions

WINDOW = 20
#: Words of the grams whose least one stands for a window.
GRAM = 10
#: Bytes of text that a task works on at once.
CHUNK_BYTES = 6_000_000
#: Bytes of text for each shard of hashes and each block of documents.
SHARD_BYTES = 16_000_000
#: Rows of the count-min arrays, and bytes of text for each cell of a row.
DEPTH = 2
CELL_TEXT = 8
#: Minimizers that a task counts before it sends what its arrays hold.
SKETCH_ENTRIES = 1_000_000
NO_ID = 2**63 - 1

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))

REPLY = "block long, docs binary, owners binary, entries binary"
FOUND = "doc_id long, sig long, found binary"
SHIPPED = "shard long, docs binary, owners binary, entries binary, numbers binary"
#: Bytes of a window's exact hash that are shipped: 96 bits.
EXACT = 12


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(parent.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)
    return flat.filter(real), counts


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    coded = words.dictionary_encode()
    both = [xxhash.xxh3_128_intdigest(w.as_buffer()) for w in coded.dictionary]
    low, high = (np.array([v >> s & (2**64 - 1) for v in both], U) for s in (0, 64))
    at = coded.indices.to_numpy(zero_copy_only=False)
    return low[at], high[at]


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each n consecutive values."""
    if len(h) < n:
        return np.zeros(0, U)
    m = len(h) - n + 1
    out, power = np.zeros(m, U), U(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[j : j + m] * power
            power = power * base
    return out


def window_minimizers(low: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start its minimizer's hash and place; documents are not told apart here."""
    with np.errstate(over="ignore"):
        g = mixed(rolled(low, gram, BASES[0]))
    n, inner = len(low) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    least, place = g[:n].copy(), np.arange(n)
    for d in range(1, inner):
        now = g[d : d + n]
        less = now < least
        np.copyto(least, now, where=less)
        np.copyto(place, np.arange(d, d + n), where=less)
    return least, place


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes and at most so many rows; a longer text is a batch of its own."""
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if i > at and (total + n > size or i - at >= rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)


def _valid(counts: np.ndarray, window: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that lie within one document, and that document's number."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(total) + window <= ends)
    return starts, doc[starts]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, small or slowly growing, in few bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=values.dtype.type(0)).astype("<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4"), dtype=np.int64)


def cells_of(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each hash in a row of ``width`` cells."""
    return (mixed(hashes ^ BASES[row]) % U(width)).astype(np.int64)


def _narrow(values: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers as so many bytes each."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size])


def _wide(data: bytes | np.ndarray, size: int) -> np.ndarray:
    """Values of so many bytes as 64-bit integers."""
    raw = (np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel()


def _dealt(shard: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each shard that has entries: their places, by document."""
    order = np.lexsort((doc, shard))
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    if len(order):
        for part in np.split(order, cuts):
            yield int(shard[part[0]]), part


def _hashed(key: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(key) % U(shards)).astype(np.int64)


def _named(doc: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> tuple[bytes, bytes]:
    """Ids and signatures of the documents that entries name, and the entries' places among them (0: none)."""
    known = np.unique(doc[doc >= 0])
    return np.stack([ids[known], sigs[known]]).tobytes(), _packed(np.where(doc >= 0, np.searchsorted(known, doc) + 1, 0))


def _replies(owner: np.ndarray, entries: np.ndarray, ids: np.ndarray, sigs: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """What was found, in a row for each block of documents."""
    for block, at in _dealt(_hashed(ids[owner].view(U) ^ U(7), blocks), owner):
        yield block, *_named(owner[at], ids, sigs), entries[at].tobytes()


def _known(*found) -> Iterator[tuple]:
    """What a task knows by itself, in rows that the next step passes on: shard numbers below 0."""
    for block, docs, owners, entries in _replies(*found):
        yield -1 - block, docs, owners, entries, None


def _runs(owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts, ascending by owner, as runs: their owners, and each one's first start and its end."""
    if not len(starts):
        return owner, np.zeros((0, 2), "<i4")
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(owner) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(starts)] - 1
    return owner[first], np.stack([starts[first], starts[last] + 1], 1).astype("<i4")


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_SHIPPED = (["shard", "docs", "owners", "entries", "numbers"], [pa.int64(), *[pa.binary()] * 4])
_REPLY = (["block", "docs", "owners", "entries"], [pa.int64(), *[pa.binary()] * 3])


@dataclass(frozen=True)
class Sketch:
    """The shape of the count-min arrays: ``DEPTH`` rows, each dealt out in ``shards`` ranges of ``cells`` cells."""

    shards: int
    cells: int

    @property
    def width(self) -> int:
        return self.shards * self.cells

    @property
    def offset_bytes(self) -> int:
        return max(1, -(-(self.cells - 1).bit_length() // 8))

    @property
    def code_bytes(self) -> int:
        """Bytes of a cell's code, which is its number with the rows laid end to end."""
        return max(1, -(-(DEPTH * self.width - 1).bit_length() // 8))

    def codes(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [cells_of(hashes, row, self.width) + row * self.width for row in range(DEPTH)]


def _sketches(window: int, gram: int, sketch: Sketch, blocks: int):
    """Pass 1, map side: a task's count-min arrays by range of cells.  A cell that holds one names its document (else -1)."""

    def sent(least: np.ndarray, doc: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        rows = []
        for code in sketch.codes(least):
            cell, first, back, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            owner = np.where(count == 1, doc[first], -1)
            offset = _narrow(cell % sketch.cells, sketch.offset_bytes)
            rows += [(s, *_named(owner[at], ids, sigs), offset[at].tobytes(), _packed(count[at])) for s, at in _dealt(cell // sketch.cells, owner)]
            again = np.unique(doc * len(cell) + back, return_index=True)[1]
            again = again[count[back[again]] > 1]
            rows += _known(doc[again], _narrow(code[again], sketch.code_bytes), ids, sigs, blocks)
        return _batch(rows, *_SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, docs = [], 0, 0
        for batch in chunks(batches):
            words, counts = split_words(batch.column("text"))
            starts, doc = _valid(counts, window, len(words))
            if not len(starts):
                continue
            least, place = window_minimizers(word_hashes(words)[0], window, gram)
            least, place = least[starts], place[starts]
            new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
            parts.append((least[new], doc[new] + docs, batch.column("doc_id").to_numpy(), batch.column("sig").to_numpy()))
            held, docs = held + len(parts[-1][0]), docs + batch.num_rows
            if held >= SKETCH_ENTRIES:
                yield sent(*map(np.concatenate, zip(*parts, strict=True)))
                parts, held, docs = [], 0, 0
        if parts:
            yield sent(*map(np.concatenate, zip(*parts, strict=True)))

    return run


def _passed_on(table: pa.Table) -> pa.Table | None:
    """Rows that need no more than to be passed on, or None."""
    if table.num_rows and table.column("shard")[0].as_py() >= 0:
        return None
    return pa.table([pc.subtract(-1, table.column("shard")), *(table.column(c) for c in _REPLY[0][1:])], _REPLY[0])


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All documents of a shard's rows, and each entry's place among them (-1: none)."""
    docs = [np.frombuffer(b, np.int64).reshape(2, -1) for b in table.column("docs").to_pylist()]
    base = np.cumsum([0, *(d.shape[1] for d in docs)])
    owners = [_unpacked(b) - 1 for b in table.column("owners").to_pylist()]
    return np.concatenate(docs, 1), np.concatenate([np.where(o >= 0, o + b, -1) for o, b in zip(owners, base, strict=False)])


def _merge(table: pa.Table, sketch: Sketch, blocks: int) -> pa.Table:
    """Pass 1, merge side: a range of the tasks' arrays, summed cell by cell; the documents' cells that hold more than one."""
    done = _passed_on(table)
    if done is not None:
        return done
    every, owner = _gathered(table)
    cell = _wide(b"".join(table.column("entries").to_pylist()), sketch.offset_bytes).astype(np.int64)
    merged = np.zeros(sketch.cells, np.int64)
    np.add.at(merged, cell, np.concatenate([_unpacked(b) for b in table.column("numbers").to_pylist()]))
    keep = np.flatnonzero((merged[cell] > 1) & (owner >= 0))
    code = _narrow(cell[keep] + table.column("shard")[0].as_py() * sketch.cells, sketch.code_bytes)
    return pa.Table.from_batches([_batch(list(_replies(owner[keep], code, *every, blocks)), *_REPLY)])


def _earliest(h1: np.ndarray, h2: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by window, document and start, and, in that order, whether the same window comes earlier."""
    order = np.lexsort((start, doc_id, h2, h1))
    h1, h2, doc_id, start = h1[order], h2[order], doc_id[order], start[order]
    head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else order
    return order, (doc_id != doc_id[first]) | (start != start[first])


def _windows(window: int, gram: int, sketch: Sketch, blocks: int):
    """Pass 2, map side: exact hashes of the windows that are estimated to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, counts = split_words(batch.column("text"))
            if not len(words):
                continue
            ids, sigs = (batch.column(c).to_numpy() for c in ("doc_id", "sig"))
            low, high = word_hashes(words)
            least, _ = window_minimizers(low, window, gram)
            codes = sketch.codes(least)
            begin = np.r_[0, np.cumsum(counts)]
            marked = []
            for i, found in enumerate(batch.column("found").to_pylist()):
                n = counts[i] - window + 1
                if n > 0:
                    more = _wide(found, sketch.code_bytes)
                    marked.append(begin[i] + np.flatnonzero(np.logical_and.reduce([np.isin(c[begin[i] : begin[i] + n], more) for c in codes])))
            at = np.concatenate(marked) if marked else np.zeros(0, np.int64)
            if not len(at):
                continue
            doc = np.searchsorted(begin, at, "right") - 1
            start = at - begin[doc]
            h1, h2 = rolled(low, window, BASES[0])[at], rolled(high, window, BASES[1])[at]
            order, late = _earliest(h1, h2, ids[doc], start)
            gone, kept = np.sort(order[late]), np.sort(order[~late])
            # Windows that come first here are shipped; equal places (of repeated rows) stand for each other.
            exact = np.concatenate([h1[kept].view(np.uint8).reshape(-1, 8), h2[kept].view(np.uint8).reshape(-1, 8)[:, : EXACT - 8]], 1)
            rows = [(s, *_named(doc[kept[x]], ids, sigs), exact[x].tobytes(), _packed(start[kept[x]])) for s, x in _dealt(_hashed(h1[kept], sketch.shards), doc[kept])]
            rows += _known(*_runs(doc[gone], start[gone]), ids, sigs, blocks)
            yield _batch(rows, *_SHIPPED)

    return run


def _group(table: pa.Table, blocks: int) -> pa.Table:
    """Pass 2, merge side: runs of windows that also start earlier, by block of documents."""
    done = _passed_on(table)
    if done is not None:
        return done
    every, owner = _gathered(table)
    raw = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("entries").to_pylist()]).reshape(-1, EXACT)
    start = np.concatenate([_unpacked(b) for b in table.column("numbers").to_pylist()])
    order, late = _earliest(_wide(raw[:, :8], 8), _wide(raw[:, 8:], EXACT - 8), every[0][owner], start)
    gone = order[late]
    gone = gone[np.lexsort((start[gone], owner[gone]))]
    return pa.Table.from_batches([_batch(list(_replies(*_runs(owner[gone], start[gone]), *every, blocks)), *_REPLY)])


def _per_document(table: pa.Table, width: int, runs: bool) -> pa.Table:
    """One block's replies: a row for each document, with its entries joined; overlapping runs become one."""
    every, owner = _gathered(table)
    named, back = np.unique(np.ascontiguousarray(every.T).view([("id", "<i8"), ("sig", "<i8")]).ravel(), return_inverse=True)
    owner = back.ravel()[owner]
    entries = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("entries").to_pylist()]).reshape(-1, width)
    if runs:
        span = np.ascontiguousarray(entries).view("<i4").astype(np.int64) + (owner << 32)[:, None]
        span = span[np.argsort(span[:, 0], kind="stable")]
        reach = np.maximum.accumulate(span[:, 1])
        first = np.flatnonzero(np.r_[True, span[1:, 0] > reach[:-1]])
        owner = span[first, 0] >> 32
        entries = (np.stack([span[first, 0], reach[np.r_[first[1:], len(span)] - 1]], 1) & 0xFFFFFFFF).astype("<i4")
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    rows = [(int(named["id"][owner[x[0]]]), int(named["sig"][owner[x[0]]]), entries[x].tobytes()) for x in np.split(order, cuts)] if len(order) else []
    return pa.Table.from_batches([_batch(rows, ["doc_id", "sig", "found"], [pa.int64(), pa.int64(), pa.binary()])])


def _cut(window: int, digest: bool):
    """Removes the words that the found windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, counts = split_words(batch.column("text"))
            begin = np.r_[0, np.cumsum(counts)]
            change = np.zeros(len(words) + 1, np.int64)
            for i, found in enumerate(batch.column("found").to_pylist()):
                if found:
                    runs = begin[i] + np.frombuffer(found, "<i4").reshape(-1, 2).astype(np.int64)
                    np.add.at(change, runs[:, 0], 1)
                    np.add.at(change, runs[:, 1] + window - 1, -1)
            keep = np.cumsum(change)[:-1] == 0
            upto = np.r_[0, np.cumsum(keep)][begin]
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(keep))), " ")
            if digest:
                left = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in left], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(counts - np.diff(upto)), left], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _removable(base: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, sig, found): runs of removable windows as pairs of 32-bit integers."""
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = blocks = max(1, -(-size // SHARD_BYTES))
    sketch = Sketch(shards, max(1, SHARD_BYTES // CELL_TEXT))

    def answered(shipped: DataFrame, judge, width: int, runs: bool) -> DataFrame:
        """Shards answer in a row for each block of documents, blocks in a row for each document."""
        replies = _spread(shipped, "shard", DEPTH * shards).groupBy("shard").applyInArrow(judge, REPLY)
        return _spread(replies, "block", blocks).groupBy("block").applyInArrow(lambda t: _per_document(t, width, runs), FOUND)

    maybe = answered(base.mapInArrow(_sketches(window, gram, sketch, blocks), SHIPPED), lambda t: _merge(t, sketch, blocks), sketch.code_bytes, False)
    again = base.join(maybe, ["doc_id", "sig"]).select("doc_id", "sig", "text", "found")
    return answered(again.mapInArrow(_windows(window, gram, sketch, blocks), SHIPPED), lambda t: _group(t, blocks), 8, True)


def _spread(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows dealt out by a key; with more groups than partitions, as many partitions as groups."""
    return rows.repartition(groups, key) if groups > shuffle_partitions(rows.sparkSession) else rows


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the documents without repeated passages; with ``digest`` the SHA-256 of what is kept."""
    gram = gram or max(1, min(GRAM, window // 2))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("sig"), text.alias("text"))
    found = _removable(base, window, gram)
    # The same exchange of texts serves this join and the one before pass 2.
    left = base.join(found, ["doc_id", "sig"], "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "found")
    return left.mapInArrow(_cut(window, digest), "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """The contract of the query."""
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM w WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 20], ' ')) AS k FROM s),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS p FROM late),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),
kept AS (SELECT flat.doc_id, string_agg(word, ' ' ORDER BY flat.p) AS kept, count(*) AS n FROM flat LEFT JOIN gone ON flat.doc_id = gone.doc_id AND flat.p = gone.p WHERE gone.p IS NULL GROUP BY flat.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

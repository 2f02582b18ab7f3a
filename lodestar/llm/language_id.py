"""Language identification by compression.

Each language owns a zstandard raw-content dictionary cut from a bounded, documented sample of
labelled rows.  A text is compressed with every dictionary, block by block over its whole length;
the dictionary that leaves the fewest bytes names the language.  A narrow margin between the best
and the second best is a rejection.

A short text alone would be stored as it is under every dictionary.  It is sized within each of
``PARTS`` parts of a language's dictionary instead: in lower case, behind a piece of the sample,
which any compressor shortens, less the size of that piece alone; these sizes are added up.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0 and is
rejected.  Rows keep their number: repeated rows give repeated results, an empty table gives an
empty result.  A very long text is compressed block by block.  Ties go to the language that sorts first.  Other columns of the input are ignored,
whatever their names.  With a single learned language every lettered text gets it with score 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import bound_batches, stored

#: Bounds of the training sample: documents of each language, characters cut from each of them, bytes of
#: each dictionary, and bytes of all of them.  Every labelled language is learned; where there are so many
#: that the last bound binds, each gets an equal share of it, in documents as in bytes.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 600
DICTIONARY_BYTES = 240_000
ALL_BYTES = 64_000_000
#: Up to so many languages' shares are broadcast; more are joined by shuffle.
MAX_BROADCAST_LANGUAGES = 100_000
#: Bytes that are compressed on their own, so that all parts of a long text weigh alike.
BLOCK_BYTES = 1024
LEVEL = 9
#: Texts of up to so many bytes are sized within parts of the dictionaries.
SHORT_BYTES = 100
PARTS = 16
#: Bytes of a part and of the piece that comes before the text, whether the piece lies in the part or behind it, and the
#: logarithm of the window that holds all three.
#: The second row serves where the first leaves a tie: its longer piece is new to the part, so codes adapt to the language.
PIECED, FINER = (14_000, 64, True, 14), (7_000, 600, False, 13)
#: Between piece and text: a byte that no text holds, so no match goes across.
BREAK = b"\xff"
FRAME = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
#: Share of the best size by which the second best must be larger.
MIN_MARGIN = 0.005

UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double, margin double, accepted boolean"


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum is kept from training.  A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw dictionary content of each language, from text and lang of rows that are not held out.

    The sample is bounded by the three parameters and ``ALL_BYTES``, so what reaches the driver is too.  Which rows
    are drawn depends on a hash of the id; of a long text an excerpt at a hashed place is taken.
    Languages are counted first, and only rows whose hash is low enough for about twice the sample
    are ranked, so what is shuffled doesn't grow with the table.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("__lang"), "n"), "languages")
    languages = sizes.count()
    if not languages:
        return {}
    dictionary_bytes = max(8, min(dictionary_bytes, ALL_BYTES // languages))
    sample_docs = max(1, min(sample_docs, ALL_BYTES // (languages * sample_chars)))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    known = F.broadcast(sizes) if languages <= MAX_BROADCAST_LANGUAGES else sizes
    labelled = labelled.select("doc_id", "text", "lang").join(known, F.col("lang") == F.col("__lang")).filter(unit < (2 * sample_docs + 100) / F.col("n"))
    length = F.char_length("text")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(length - sample_chars + 1, F.lit(1))) + 1
    cut = labelled.select("lang", unit.alias("draw"), F.substring(F.col("text"), start.cast("int"), F.lit(sample_chars)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "piece"))
    rows = cut.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("pieces"))
    learned = {}
    for lang, pieces in rows.collect():
        body = "\n".join(p.piece for p in pieces).encode()[:dictionary_bytes]
        if len(body) >= 8:  # shorter raw content is no dictionary
            learned[lang] = body
    return learned


#: A function that compresses with a part of a dictionary, the piece that it meets first, and that piece's size.
Part = tuple[Callable[[bytes], bytes], bytes, int]


def parts(body: bytes, part_bytes: int, piece_bytes: int, inside: bool, window_log: int) -> list[Part]:
    """Compressors over evenly spread parts of a dictionary; those of a small one overlap."""
    size = max(8, min(part_bytes, len(body) - (0 if inside else piece_bytes)))
    parameters = zstandard.ZstdCompressionParameters(window_log=window_log, hash_log=13, chain_log=window_log, search_log=4, min_match=3, target_length=48, strategy=zstandard.STRATEGY_LAZY2, **FRAME)
    found = []
    for k in range(PARTS):
        start = max(0, len(body) - size - (0 if inside else piece_bytes)) * k // (PARTS - 1)
        at = start + (size // 2 if inside else size)
        content = zstandard.ZstdCompressionDict(body[start : start + size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=parameters)
        make = zstandard.ZstdCompressor(compression_params=parameters, dict_data=content).compress
        piece = body[at : at + piece_bytes] + BREAK
        found.append((make, piece, len(make(piece))))
    return found


def sizer(models: dict[str, bytes], level: int = LEVEL, block_bytes: int = BLOCK_BYTES) -> tuple[list[str], Callable[[bytes], list[int]]]:
    """The languages, and a function from a text's bytes to its compressed size under each of them."""
    names = sorted(models)
    makers = []
    for name in names:
        content = zstandard.ZstdCompressionDict(models[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        makers.append(zstandard.ZstdCompressor(level=level, dict_data=content, **FRAME).compress)
    parted = cache(lambda kind: [parts(models[name], *kind) for name in names])

    def pieced(said: bytes, kind: tuple[int, int, bool, int]) -> list[int]:
        return [max(1, sum(len(make(piece + said)) - alone for make, piece, alone in row)) for row in parted(kind)]

    def sizes(data: bytes) -> list[int]:
        if len(data) <= SHORT_BYTES:
            said = b" " + data.decode().lower().encode() + b" "
            found = pieced(said, PIECED)
            return pieced(said, FINER) if found.count(min(found)) > 1 else found
        blocks = [data[i : i + block_bytes] for i in range(0, len(data), block_bytes)]
        return [sum(len(make(b)) for b in blocks) for make in makers]

    return names, sizes


def judge(sizes: list[int], names: list[str], min_margin: float) -> tuple[str, float, float, bool]:
    best = min(range(len(names)), key=lambda i: (sizes[i], names[i]))
    if len(names) == 1:
        return names[0], 1.0, 1.0, True
    margin = (min(s for i, s in enumerate(sizes) if i != best) - sizes[best]) / sizes[best]
    weights = [2.0 ** (-60.0 * (s - sizes[best]) / sizes[best]) for s in sizes]
    return names[best], 1.0 / sum(weights), margin, margin >= min_margin


def classify(docs: DataFrame, models: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``SCHEMA`` rows, one for each document.  Only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = sizer(models)
        for batch in batches:
            out = []
            for text in batch.column(1):
                s = text.as_py()
                if not s or not names or not any(map(str.isalpha, s)):
                    out.append((UNDETERMINED, 0.0, 0.0, False))
                else:
                    out.append(judge(sizes(s.encode("utf-8", "replace")), names, min_margin))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "lang_pred", "score", "margin", "accepted"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out and classify all rows."""
    return classify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents, whole and with all their columns, whose language is told by a clear margin."""
    models = fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = sizer(models)
        at = names.index("text")
        for batch in batches:
            keep = []
            for text in batch.column(at):
                s = text.as_py()
                keep.append(bool(s) and bool(known) and any(map(str.isalpha, s)) and judge(sizes(s.encode("utf-8", "replace")), known, min_margin)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

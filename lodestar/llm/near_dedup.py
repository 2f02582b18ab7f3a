"""Near-duplicate detection: DartMinHash signatures, banded joining, exact verification.

A document is the weighted set of its five-word shingles (white space words, letter case folded), the
weight being how often a shingle occurs; the similarity of two documents is the weighted Jaccard
coefficient of their sets.  Every element throws the same darts in every document, into dyadic regions
of the plane of weight and rank: a hashed Poisson number of darts for each region, each with a hashed
weight, rank and coordinate.  A document takes the darts that lie under its element's weight and only
looks at regions up to a rank that falls with its total weight, so its darts number about k ln k however
long it is and whatever its weights are, and keeps the earliest dart of each coordinate.

Equal texts collapse first.  Bands of coordinates are joined by their keys.  In a band's bucket all
members are tied to its most central one (that which meets most others over all bands), never all
to all; ties are verified exactly on whole texts.  Buckets whose members are then still apart are
searched again by their signatures' agreement for pairs across components that have not been tested
yet, until no bucket has one.  Large buckets are split by further bands first; what these leave large
is dealt out to a grid of tasks, each of which compares two slices of the bucket, so no pair is lost and
no task holds more than ``BUCKET`` members, about.  Components come from alternating star contractions,
so neither links nor components are ever in one place; each round of search starts from the stars of
the one before.

Defined results: a text of one to four words is one shingle; null, empty and blank texts have none
and count as equal texts.  Texts are what is compared; an id is only their attribute, so different
texts that share an id, or have none, are judged apart.  A row without doc_id counts as the one with
the largest id; a class of such rows alone has a null class_id.  Repeated rows are copies of each
other.  A very long text is signed in one piece, by the task that holds its row.  An empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bound_batches, release, stored
from lodestar.llm.substring_dedup import BASES, NO_ID, U, chunks, mixed, rolled, split_words, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: The first region of the rank axis is [0, FIRST), that of the weight axis [0, UNIT); each further one doubles the end.
FIRST, UNIT = 2.0**-14, 1.0
#: Expected darts above which a region is cut into slabs along its weight axis.
SLAB_DARTS = 16
#: Coordinates of the finer signature that documents with a common band get, one byte of each.
FINE = 1024
#: Share of agreeing fine coordinates below which a pair isn't verified: four standard deviations under the threshold.
LEAST_AGREEMENT = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / FINE) ** 0.5
#: Members of a bucket that one task compares; larger ones are split by further bands.
BUCKET = 2048
SPLIT_BANDS, SPLIT_ROWS, SPLIT_ROUNDS = 24, 4, 3
#: Partners of a document that one search of a bucket may propose.  What is left over comes in the next round.
PROPOSALS = 32
CHUNK_BYTES = 1_000_000
#: Coordinates of all documents that a task signs at once.
CHUNK_COORDINATES = 120_000


def elements(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers (ascending), hashes and weights of all texts' elements."""
    words, counts = split_words(pc.utf8_lower(texts))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0)
    low, _ = word_hashes(words)
    size = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    with np.errstate(over="ignore"):
        full = mixed(rolled(np.r_[low, np.zeros(shingle - 1, U)], shingle, BASES[0]))
        x = full[at]
        for d in np.flatnonzero((counts > 0) & (counts < shingle)):  # a short text is one shingle of its own length
            part = low[begin[d] : begin[d] + counts[d]]
            x[np.searchsorted(doc, d)] = mixed(rolled(part, len(part), BASES[0]) + U(len(part)))[0]
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])])
    return doc[first], x[first], np.diff(np.r_[first, len(x)]).astype(np.float64)


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count with a mean of up to ``SLAB_DARTS``."""
    p, out, total, n = np.exp(-mean), [], 0.0, 0
    while total < 1 - 1e-15 and n < 200:
        total += p
        out.append(total)
        n += 1
        p *= mean / n
    return np.array(out)


def _unit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(11)).astype(np.float64) * 2.0**-53


def _region(k: int, nr: int, nw: int) -> tuple[float, float, float, float, int]:
    """Rank from and to, weight from, a slab's width along the weight axis and the number of slabs."""
    low, high = (0.0, FIRST) if not nr else (FIRST * 2.0 ** (nr - 1), FIRST * 2.0**nr)
    bottom, top = (0.0, UNIT) if not nw else (UNIT * 2.0 ** (nw - 1), UNIT * 2.0**nw)
    slabs = 1 << max(0, int(np.ceil(np.log2(k * (high - low) * (top - bottom) / SLAB_DARTS))))
    return low, high, bottom, (top - bottom) / slabs, slabs


def dart_signatures(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """(docs, k): for each document with weight the identity of each coordinate's earliest dart."""
    value = np.zeros(docs * k, U)
    total = np.bincount(doc, weights=weight, minlength=docs)
    todo = total > 0
    limit = (np.log(k) + 2) / np.where(todo, total, 1)
    steps: dict[float, np.ndarray] = {}
    with np.errstate(over="ignore"):
        while todo.any():
            pick = todo[doc] & (weight > 0)
            d, e, w = doc[pick], x[pick], weight[pick]
            best = np.full(docs * k, np.inf)
            nr = 0
            while len(e):
                heavy, nw = np.arange(len(e)), 0
                while len(heavy):
                    low, high, bottom, width, slabs = _region(k, nr, nw)
                    if slabs == 1:
                        of, slab = heavy, np.zeros(len(heavy), np.int64)
                    else:
                        under = np.clip(np.ceil((w[heavy] - bottom) / width), 1, slabs).astype(np.int64)
                        of = np.repeat(heavy, under)
                        slab = np.arange(len(of)) - np.repeat(np.cumsum(under) - under, under)
                    seed = mixed(e[of] ^ mixed(U(nr + 1) + (U(nw) << U(12)) + (slab.astype(U) << U(24))))
                    mean = k * (high - low) * width
                    cdf = steps.setdefault(mean, _poisson_steps(mean))
                    uniform = _unit(seed)
                    some = np.flatnonzero(uniform >= cdf[0])
                    count = np.minimum(np.searchsorted(cdf, uniform[some], "right"), len(cdf) - 1)
                    which = np.repeat(some, count)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    dart = mixed(seed[which] + (nth.astype(U) + U(1)) * BASES[0])
                    rank = low + _unit(dart) * (high - low)
                    near = rank < limit[d[of[which]]]
                    dart, rank, which = mixed(dart[near] + BASES[1]), rank[near], which[near]
                    owner = of[which]
                    if nw or (w[heavy] < UNIT).any():  # a lighter element takes only the darts below its weight
                        height = bottom + (slab[which] + _unit(mixed(dart ^ BASES[0]))) * width
                        lies = height < w[owner]
                        dart, rank, owner = dart[lies], rank[lies], owner[lies]
                    slot = d[owner] * k + (((dart >> U(32)) * U(k)) >> U(32)).astype(np.int64)
                    np.minimum.at(best, slot, rank)
                    won = rank == best[slot]
                    value[slot[won]] = dart[won]
                    heavy, nw = heavy[w[heavy] > bottom + width * slabs], nw + 1
                more = high < limit[d]
                d, e, w = d[more], e[more], w[more]
                nr += 1
            empty = np.isinf(best.reshape(docs, k)).any(1)
            todo &= empty
            limit[todo] *= 2  # some coordinate met no dart yet: look further
    return value.reshape(docs, k)


SIGNED = "doc_id long, h1 long, h2 long, bands array<long>"
#: Bytes of text of the pairs that are verified at once.
VERIFY_BYTES = 800_000


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, CHUNK_BYTES, CHUNK_COORDINATES // COORDINATES):
        doc, x, weight = elements(batch.column("text"))
        values = dart_signatures(doc, x, weight, batch.num_rows)
        has = np.bincount(doc, minlength=batch.num_rows) > 0
        with np.errstate(over="ignore"):
            keys = np.zeros((batch.num_rows, BANDS), U) + np.arange(BANDS, dtype=U)
            for r in range(ROWS):
                keys = mixed(keys * BASES[0] + values[:, r * BANDS : (r + 1) * BANDS])
        bands = [k.tolist() if h else [] for k, h in zip(keys.view(np.int64), has, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "bands"])


def _sign_finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, CHUNK_BYTES // 4, CHUNK_COORDINATES // FINE):
        doc, x, weight = elements(batch.column("text"))
        # The low byte: the high bits of a dart choose its coordinate.
        lanes = (dart_signatures(doc, mixed(x ^ BASES[1]), weight, batch.num_rows, FINE) & U(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array([v.tobytes() for v in lanes], pa.binary())], ["id", "text", "lanes"])


def _keys() -> tuple[Column, Column, Column]:
    """A row's id and the two hashes of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(told), F.xxhash64(F.lit(1), told)


def _base(docs: DataFrame) -> DataFrame:
    doc_id, h1, h2 = _keys()
    return docs.select(doc_id.alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


Weighed = tuple[np.ndarray, np.ndarray]


def similarity(a: Weighed, b: Weighed) -> float:
    """Weighted Jaccard coefficient of two sets of ascending hashes with their weights; 1 for two empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 1.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text, right): which pairs' texts reach the threshold.  Rows come by ``a``, so its set is kept."""
    last, left = None, None
    for whole in batches:
        for batch in chunks(iter([whole]), VERIFY_BYTES):
            doc, x, weight = elements(batch.column("right"))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            near = []
            for i, a in enumerate(batch.column("a").to_pylist()):
                if a != last:
                    last, left = a, elements(batch.column("text").slice(i, 1))[1:]
                part = slice(cut[i], cut[i + 1])
                near.append(similarity(left, (x[part], weight[part])) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, near): pairs of representatives, judged on their whole texts."""
    left = texts.select(F.col("id").alias("a"), "text")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text", "right")
    return stored(both.mapInArrow(_verify, "a long, b long, near boolean"), "verified")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the least id of each linked id's component, by alternating large and small stars.

    Stars that were found before may stand among the links: they are contracted already.
    """
    e = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        before, e = e, stored(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "stars")
        release(before)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            found = e.select(F.col("u").alias("id"), F.col("v").alias("class"))
            found._scratch = e._scratch
            return found
        seen = mark


def _agreeing(table: pa.Table) -> pa.Table:
    """One bucket's untested pairs across components whose signatures agree enough, a few for each member."""
    ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
    lanes = np.frombuffer(b"".join(table.column("lanes").to_pylist()), np.uint8).reshape(len(ids), -1)
    place = {int(v): i for i, v in enumerate(ids)}
    tested = [[place[t] for t in row or () if t in place] for row in table.column("tested").to_pylist()]
    out = []
    for i in range(len(ids)):
        agree = np.count_nonzero(lanes == lanes[i], axis=1) / lanes.shape[1]
        agree[comp == comp[i]] = 0
        agree[tested[i]] = 0
        top = np.argsort(-agree, kind="stable")[:PROPOSALS]
        out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in top if agree[j] >= LEAST_AGREEMENT]
    pairs = sorted(set(map(lambda p: (int(p[0]), int(p[1])), out)))
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _split_large(rows: DataFrame, turn: int) -> DataFrame:
    """(key, id, comp, lanes, tested): members of large buckets, dealt to more buckets by further bands of their signatures."""
    part = lambda band: F.substring("lanes", (turn * SPLIT_BANDS + band) * SPLIT_ROWS + 1, SPLIT_ROWS)
    keys = F.array(*[F.xxhash64("key", F.lit(b), part(b)) for b in range(SPLIT_BANDS)])
    return rows.select(F.explode(keys).alias("key"), "id", "comp", "lanes", "tested")


def _unsettled(rows: DataFrame) -> DataFrame:
    """Rows of the buckets whose members belong to several components, with the bucket's size."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key", "size")
    return rows.join(sizes, "key")


def _gridded(rows: DataFrame) -> DataFrame:
    """(key, id, comp, lanes, tested): members of buckets that are still large, once for each pair of slices that holds theirs."""
    slices = F.ceil(F.col("size") / (BUCKET // 2)).cast("int")
    x = rows.withColumn("n", slices).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return x.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "comp", "lanes", "tested")


def _search(members: DataFrame, comps: DataFrame, lanes: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs to test next, stored."""
    x = members.join(comps.select("id", F.col("class").alias("c")), "id", "left").select("key", "id", F.coalesce("c", "id").alias("comp"))
    x = _unsettled(x)
    both = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    past = both.groupBy("a").agg(F.collect_set("b").alias("tested")).withColumnRenamed("a", "id")
    rows = stored(x.join(lanes, "id").join(past, "id", "left"), "unsettled")
    spent = [rows]
    ready = rows.filter(F.col("size") <= BUCKET).drop("size")
    large = rows.filter(F.col("size") > BUCKET)
    for turn in range(SPLIT_ROUNDS):
        if large.isEmpty():
            break
        parts = stored(_unsettled(_split_large(large, turn)), "split")
        spent.append(parts)
        ready = ready.unionByName(parts.filter(F.col("size") <= BUCKET).drop("size"))
        large = parts.filter(F.col("size") > BUCKET)
    ready = ready.unionByName(_gridded(large))
    found = stored(ready.groupBy("key").applyInArrow(_agreeing, "a long, b long").distinct(), "proposed")
    release(*spent)
    return found


def signed(docs: DataFrame) -> DataFrame:
    """``SIGNED`` rows for every document, stored."""
    return stored(_base(docs).mapInArrow(_sign, SIGNED), "signed")


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (h1, h2, doc_id, first) of each text: its least id, and id and hashes of its class's least row."""
    bound_batches(docs.sparkSession)
    all_signed = signed(docs)
    reps = all_signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    # A text's own number, fixed as it is stored: ids of different texts may be equal.
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")
    banded = reps.select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(banded.join(sizes, "key").distinct(), "members")
    if members.isEmpty():
        links = None
    else:
        involved = reps.select("h1", "h2", "doc_id", "id").join(members.select("id").distinct(), "id")
        texts = _base(docs).join(involved, ["h1", "h2", "doc_id"]).dropDuplicates(["id"])
        texts = stored(texts.select("id", "text").mapInArrow(_sign_finely, "id long, text string, lanes binary"), "texts")
        lanes = texts.select("id", "lanes")
        central = members.groupBy("id").agg(F.sum("n").alias("score"))
        hubs = members.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"))
        pairs = members.join(hubs, "key").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        agreed = pairs.join(lanes.select(F.col("id").alias("a"), F.col("lanes").alias("la")), "a").join(lanes.select(F.col("id").alias("b"), F.col("lanes").alias("lb")), "b")
        tested = verified(agreed.mapInArrow(_likely, "a long, b long"), texts)
        links = components(tested.filter("near").select("a", "b"))
        while not (more := _search(members.select("key", "id"), links, lanes, tested)).isEmpty():
            judged, stars, past = verified(more, texts), links, tested
            links = components(stars.select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(judged.filter("near").select("a", "b")))
            tested = stored(past.unionByName(judged), "tested")
            release(more, judged, stars, past)
    own = F.struct("doc_id", "h1", "h2")
    if links is None:
        return all_signed, reps.select("h1", "h2", "doc_id", own.alias("first"))
    labels = links.unionByName(links.select(F.col("class").alias("id"), "class").distinct())
    least = labels.join(reps.select("id", own.alias("own")), "id").groupBy("class").agg(F.min("own").alias("least"))
    found = reps.select("id", "h1", "h2", "doc_id").join(labels.join(least, "class").select("id", "least"), "id", "left")
    return all_signed, found.select("h1", "h2", "doc_id", F.coalesce("least", own).alias("first"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, exact_id): for each document the least id of its near-duplicate class and of its equal texts."""
    all_signed, found = _classed(docs)
    joined = all_signed.select("doc_id", "h1", "h2").join(found.select("h1", "h2", F.col("doc_id").alias("exact"), F.col("first.doc_id").alias("class")), ["h1", "h2"])
    real = lambda c: F.when(c != NO_ID, c)
    return joined.select(real(F.col("doc_id")).alias("doc_id"), real(F.col("class")).alias("class_id"), real(F.col("exact")).alias("exact_id"))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree enough to be verified."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("la", "lb"))
            keep = pa.array((left == right).mean(1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: that of the least id, among equal ids that of the least hashes.

    Of rows with the same id and text any one stays; they can only differ in other columns.
    """
    keep = _classed(docs)[1].filter("h1 = first.h1 AND h2 = first.h2")
    names = ["__id", "__h1", "__h2"]
    keyed = docs.withColumns(dict(zip(names, _keys(), strict=True)))
    return keyed.join(keep.select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")), names, "left_semi").dropDuplicates(names).drop(*names)

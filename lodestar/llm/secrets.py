"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule's pattern is parsed into a Boolean query over trigrams: an OR of clauses, each an AND of
trigrams that any match must contain (case folded).  One pass over the texts lists their own trigrams,
as far as some query asks for them; the postings (trigram, doc_id, sig) are dealt out by trigram and
stored.  A clause's lists are intersected from the shortest on, and a rule's pattern runs only over
documents that satisfy one of its clauses.  A pattern without mandatory trigrams runs over all documents.

Defined results: a null text is an empty one and has no span.  A very long text is scanned whole, by the
task that holds its row, and places are summed up in blocks, so many spans cost little more than few.
Letters in either case are A-Z and a-z alone: no other character that folds to one counts.  Results
belong to a doc_id and a text, so differing texts under one id stay apart, and repeated rows stay
repeated.  Spans are in code points, the end exclusive; spans of equal start come in the rules' order.
An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import shuffle_partitions, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; matches whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base rules, and the ones that the method adds.
BASE = (
    Rule("assign", rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Matches of [0-9a-f]+ are whole runs, so asking for 24 at once drops just the short ones.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED
#: Alternatives a pattern may branch into before what is known so far is closed off.
MAX_CLAUSES = 64
#: A trigram's list has a slice for so many partitions of the index.
PARTITIONS_A_SLICE = 8
#: Up to so many candidates (two longs and the names of rules each) are broadcast; more are joined by shuffle.
MAX_BROADCAST_CANDIDATES = 500_000
#: Places that are summed up one after the other.
BLOCK = 256


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of a pattern; an empty list: it has no mandatory trigrams and must scan fully."""
    names = re._constants  # the parser's own opcodes

    def closed(alts: set) -> set:
        return {(need | _grams(run), "") for need, run in alts}

    def follow(items, alts: set) -> set:
        for op, arg in items:
            folded = {chr(x).lower() for o, x in arg if o is names.LITERAL} if op is names.IN else ()
            if len(folded) == 1 and all(o is names.LITERAL for o, _ in arg):  # one letter in either case
                op, arg = names.LITERAL, ord(folded.pop())
            if op is names.LITERAL:
                alts = {(need, run + chr(arg).lower()) for need, run in alts}
            elif op is names.SUBPATTERN:
                alts = follow(arg[3], alts)
            elif op is names.BRANCH:
                alts = set().union(*(follow(branch, alts) for branch in arg[1]))
            elif op in (names.MAX_REPEAT, names.MIN_REPEAT):
                low, high, body = arg
                if low == 0 and high == 1:
                    alts = alts | follow(body, alts)
                else:
                    for _ in range(min(low, 3)):
                        alts = follow(body, alts)
                    alts = closed(alts) if high != low or low > 3 else alts
            else:  # a class or any other item: whatever stood before it is complete
                alts = closed(alts)
            if len(alts) > MAX_CLAUSES:
                alts = closed(alts)
            if len(alts) > MAX_CLAUSES:
                alts = {(reduce(frozenset.__and__, (need for need, _ in alts)), "")}
        return alts

    clauses = {need for need, _ in closed(follow(re._parser.parse(pattern), {(frozenset(), "")}))}
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return [] if frozenset() in least else sorted(least, key=sorted)


def _pattern(grams: list[str]) -> str:
    """A pattern that finds each place of the trigrams, overlapping ones too, by their first two characters."""
    tails: dict[str, dict[str, list[str]]] = {}
    for a, b, c in grams:
        tails.setdefault(re.escape(a), {}).setdefault(re.escape(b), []).append(re.escape(c))
    heads = [f"{a}(?:{'|'.join(f'{b}(?:{"|".join(c)})' for b, c in rest.items())})" for a, rest in tails.items()]
    return f"(?=({'|'.join(heads)}))"


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(trigram, doc_id, sig): the posting lists of the trigrams that some rule asks for, in the shared folder."""
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_pattern(grams)), F.lit(1)))
    lists = docs.select("doc_id", "sig", F.explode(own).alias("trigram"))
    slices = -(-shuffle_partitions(docs.sparkSession) // PARTITIONS_A_SLICE)
    dealt = lists.withColumn("slice", F.pmod(F.xxhash64("doc_id", "sig"), F.lit(slices))).repartition("trigram", "slice")
    return stored(dealt.select("trigram", "doc_id", "sig"), "trigrams")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, sig, kinds): the rules that a document may satisfy, by intersecting lists; None: no rule has trigrams."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not asked:
        return None
    index = build_index(docs, sorted({g for q in asked.values() for c in q for g in c}))
    named = [(kind, i, gram, 1 << at, (1 << len(clause)) - 1) for kind, q in asked.items() for i, clause in enumerate(q) for at, gram in enumerate(sorted(clause))]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(g).alias("trigram"), F.lit(bit).cast("long").alias("bit"), F.lit(need).cast("long").alias("need")) for k, i, g, bit, need in named])
    members = docs.sparkSession.range(1).select(F.explode(rows).alias("x")).select("x.*")
    # A clause's shortest list leads; the others' postings count only where it has the document.
    lengths = index.groupBy("trigram").agg(F.count("*").alias("n"))
    ranked = members.join(lengths, "trigram")
    leads = ranked.groupBy("kind", "clause").agg(F.min_by("trigram", F.struct("n", "trigram")).alias("lead"))
    posted = stored(index.join(F.broadcast(members.join(F.broadcast(leads), ["kind", "clause"])), "trigram"), "clauses")
    first = posted.filter("trigram = lead").select(*[F.col(c).alias(f"__{c}") for c in ("kind", "clause", "doc_id", "sig")])
    led = posted.join(first, F.expr("kind = __kind AND clause = __clause AND doc_id <=> __doc_id AND sig = __sig"), "left_semi")
    met = led.groupBy("kind", "clause", "need", "doc_id", "sig").agg(F.bit_or("bit").alias("bits")).filter("bits = need")
    return stored(met.groupBy("doc_id", "sig").agg(F.collect_set("kind").alias("kinds")), "candidates")


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def running(sizes: Column, block: int = BLOCK) -> Column:
    """For each element the sum of those before it: within blocks, and over the blocks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    sums = lambda xs: F.aggregate(xs, start, lambda acc, x: F.struct((acc.at + x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")))
    cuts = F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(block))
    inner = F.transform(cuts, lambda at: sums(F.slice(sizes, at + 1, F.lit(block))))
    outer = sums(F.transform(inner, lambda b: b.at)).out
    return F.flatten(F.transform(F.arrays_zip(inner.alias("inner"), outer.alias("base")), lambda z: F.transform(z["inner"]["out"], lambda v: v + z["base"])))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans, leftmost and non-overlapping: places come from the lengths of what lies between matches."""
    lengths = lambda xs: F.transform(xs, lambda x: F.char_length(x))
    size = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    held = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else size
    gap = lengths(F.split(text, rule.pattern, -1))
    names = ("gap", "size", "held")
    parts = F.arrays_zip(*[x.alias(n) for x, n in zip((gap, size, held), names, strict=True)])
    before = running(F.transform(parts, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))))
    placed = F.filter(F.arrays_zip(parts.alias("x"), before.alias("at")), lambda z: z["x"]["held"] >= rule.least)
    begin = lambda z: z["at"] + z["x"]["gap"]
    return F.transform(placed, lambda z: F.struct(begin(z).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin(z) + z["x"]["size"]).alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): all spans of all rules in every document, by start and then by rule."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    able = candidates(base, rules)
    if able is None:
        x = base.withColumn("kinds", F.array().cast("array<string>"))
    else:
        count = able.count()
        able = able.select(F.col("doc_id").alias("id"), F.col("sig").alias("s"), "kinds")
        x = base.join(F.broadcast(able) if count <= MAX_BROADCAST_CANDIDATES else able, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("s")), "left")
    none = F.array().cast(SPANS)
    found = []
    for rank, rule in enumerate(rules):
        may = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        found.append(F.when(F.coalesce(may, F.lit(False)) & F.col("text").rlike(rule.pattern), spans_of(F.col("text"), rule, rank)).otherwise(none))
    return x.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The contract of the query."""
    x = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return x.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same scan without an index: every rule over every text."""
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, i, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(whole[i]) AS size, length(held[i]) AS held, {r.least} AS least "
            f"FROM (SELECT doc_id, gaps, whole, held, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{p}') AS gaps, regexp_extract_all(coalesce(text, ''), '{p}') AS whole, regexp_extract_all(coalesce(text, ''), '{p}', {r.group}) AS held FROM documents))"
        )
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || (start + size) AS span FROM found WHERE held >= least),
per AS (SELECT doc_id, {", ".join(f"sum(CASE WHEN kind = '{r.kind}' THEN 1 ELSE 0 END)::BIGINT AS n_{r.kind}" for r in BASE)},
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents AS d LEFT JOIN per ON d.doc_id = per.doc_id
"""


ORACLE_SQL = _oracle()

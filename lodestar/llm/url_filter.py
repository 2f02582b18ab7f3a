"""URL filter: a bit-parallel wildcard automaton.

Rules are globs over the canonical URL.  All rules are packed into one Shift-And machine of as
many 64-bit words as they need; one step of the machine moves every rule by one symbol, and NumPy
steps all URLs of a batch at once.  ``*`` becomes a self loop of its state, ``?`` a position that
any symbol fits.

The canonical URL is the lower-cased host with a dot before it, a boundary symbol that no byte
can equal, and the path; so a host rule can't match inside a path.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and the
default verdict.  A very long url is stepped through whole.  Of several fitting rules the longest wins; among equally long ones that with
the longer host, then the smaller text.  Repeated rows give repeated results, an empty table an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LOWER, UPPER

BOUNDARY = 256
SYMBOLS = 257


@dataclass(frozen=True)
class Rule:
    """``host``/``path`` is a literal prefix rule: the host and its subdomains, the path from its start."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    def glob(self) -> list[int | str]:
        """Any subdomain, the host, the boundary, the path, anything."""
        return ["*", *f".{self.host}".encode(), BOUNDARY, *self.path.encode(), "*"]


#: The rule set of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
DEFAULT_VERDICT = "allow"


class ShiftAnd:
    """Globs (lists of symbols, ``"*"`` and ``"?"``) as one multiword nondeterministic automaton.

    Each glob owns a run of state bits: bit j says that its first j symbols have been matched.
    """

    def __init__(self, globs: list[list[int | str]]):
        fits: list[tuple[int, int | str]] = []
        loops, starts, self.ends = [], [], []
        bit = 0
        for glob in globs:
            starts.append(bit)
            for token in glob:
                if token == "*":
                    loops.append(bit)
                else:
                    bit += 1
                    fits.append((bit, token))
            self.ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.mask = np.zeros((SYMBOLS, self.words), np.uint64)
        for at, token in fits:
            self.mask[slice(None) if token == "?" else token, at >> 6] |= np.uint64(1 << (at & 63))
        self.loop, self.start = self._bits(loops), self._bits(starts)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in places:
            out[p >> 6] |= np.uint64(1 << (p & 63))
        return out

    def run(self, texts: list[list[int] | np.ndarray]) -> np.ndarray:
        """A row for each text and a column for each glob: whether the whole text matches."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self.start[None, :], n, 0)
        if n:
            offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
            symbols = np.concatenate([np.asarray(t, np.int16) for t in texts]) if lengths.sum() else np.zeros(0, np.int16)
            alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="right")
            for step, m in enumerate(alive):
                now = state[:m]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:m] = (moved & self.mask[symbols[offsets[:m] + step]]) | (now & self.loop)
        out = np.zeros((n, len(self.ends)), bool)
        for j, end in enumerate(self.ends):
            out[order, j] = (state[:, end >> 6] >> np.uint64(end & 63)) & np.uint64(1) != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as the rules see them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest.split("?", 1)[0].split("#", 1)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), path


def canonical(host: str, path: str) -> np.ndarray:
    left, right = f".{host}".encode("utf-8", "replace"), path.encode("utf-8", "replace")
    return np.concatenate([np.frombuffer(left, np.uint8).astype(np.int16), np.array([BOUNDARY], np.int16), np.frombuffer(right, np.uint8).astype(np.int16)])


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT_VERDICT, block_rows: int = 4096) -> DataFrame:
    """``SCHEMA`` rows, one for each page.  The scan reads page_id and url alone."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd([r.glob() for r in ranked])
        names = np.array([r.text for r in ranked] + [None], object)
        verdicts = np.array([r.verdict for r in ranked] + [default], object)
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                batch = whole.slice(at, block_rows)
                parts = [split_url(u) for u in batch.column(1).to_pylist()]
                hits = machine.run([canonical(h, p) for h, p in parts])
                hits &= np.array([bool(h) for h, _ in parts], bool)[:, None]
                first = np.where(hits.any(1), hits.argmax(1), len(ranked)) if ranked else np.zeros(len(parts), int)
                cols = [[h for h, _ in parts], [p for _, p in parts], names[first].tolist(), verdicts[first].tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)


ORACLE_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS n FROM cut),
fit AS (SELECT n, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, rhost || rpath) AS k
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) AS f USING (n)
"""

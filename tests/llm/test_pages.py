from __future__ import annotations

import fnmatch
import hashlib
import itertools
import random
import re

import pytest

from lodestar.llm import url_filter, warc
from lodestar.llm.common import scratch_path
from tests.llm.helpers import rows_of

PAGES = "page_id long, url string, html string"
URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.ORG/x?y#z", "https://example.org/es/1", "https://sub.Example.org/en/12", "http://notexample.org/en/1",
    "http://evilexample.org/es/", "http://a.com/fr/x.example.org/es/", "http://x.com/de/?q=/fr/", "http://x.com#/de/", "ftp://x.com?/fr/", "http://münchen.com/de/ü", "a://b://c.org/d", "http://x.net/" + "a" * 5000,
]


def test_shift_and_agrees_with_globs():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randrange(0, 9))) for _ in range(40)] + ["a" * 70 + "*b", "*" + "ab" * 40]
    texts = ["".join(p) for n in range(6) for p in itertools.product("ab", repeat=n)] + ["a" * 70 + "xyz" + "b", "ab" * 50]
    machine = url_filter.ShiftAnd([[c if c in "*?" else ord(c) for c in g] for g in globs])
    assert machine.words > 1
    found = machine.run([list(t.encode()) for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert found[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


def brute_url(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filter_matches_brute_force(spark):
    pages = spark.createDataFrame([(i if i else None, u, "x", "clash") for i, u in enumerate(URLS + URLS[:3])], PAGES + ", rule string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(url_filter.filter_urls(pages))}
    assert got == {(i if i else None, *brute_url(u)) for i, u in enumerate(URLS + URLS[:3])}
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    assert url_filter.filter_urls(pages, (), "block").filter("verdict = 'block'").count() == pages.count()


NASTY = [
    None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 60, "é" * 60,
    "WARC/1.1\r\n", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nrest",
    "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3, "\r\n\r\n", "\r\n\r\n\r\n\r\n", "z" * 300_000, "long WARC/1.1\r\n" * 20_000, "\x00binary\x00",
]


@pytest.mark.parametrize("split", ["134217728", "4096"])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame([(i * 3, None if i == 1 else f"http://h/{i}\r\nX: y", t, "clash") for i, t in enumerate(NASTY)] + [(None, "u", "y" * 100, "c")], PAGES + ", digest string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = scratch_path(spark, "warc")
        warc.write_archives(pages.coalesce(2), path)
        got = {r["page_id"]: r for r in rows_of(warc.round_trip(pages.coalesce(2)))}
        back = {r["urn"]: r for r in rows_of(warc.read_archives(spark, path, payloads=True))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, t in enumerate(NASTY):
        data = (t or "").encode()
        first.setdefault(data, i * 3)
        repeat = len(data) >= 100 and first[data] != i * 3
        r = got[i * 3]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if repeat else "response", first[data] if repeat else None)
        assert repeat or bytes(back[f"<urn:lodestar:page:{i * 3}>"]["payload"]) == data
    assert got[None]["record_type"] == "response" and len(got) == len(NASTY) + 1


def test_payload_of_magic_lines_alone(spark):
    """Pieces of one payload are joined in one go, however many there are."""
    text = "WARC/1.1\r\n" * 60_000
    rows = rows_of(warc.round_trip(spark.createDataFrame([(1, "u", text), (2, "v", "w" * 200)], PAGES)))
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {1: hashlib.sha256(text.encode()).hexdigest(), 2: hashlib.sha256(b"w" * 200).hexdigest()}


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0

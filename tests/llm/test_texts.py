"""ARC conversion, URL filters, fingerprints, token counts."""

import gzip
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_fixtures import awkward, empty, frame, sentence

from loomtext.llm import arc, arrow_text, fingerprints, token_counts, url_filter

ABOUT = {1: b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n\n", 2: b"2 0 org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"}
PAGE = b"HTTP/1.0 404 Not Found\r\nA: b\r\n\r\n<p>\xc3\xa9\n\nhttp://x/ 1.2.3.4 not a header\n</p>"


def record(version, url, body, date=b"20010203040506", mime=b"text/html", length=None):
    n = str(len(body) if length is None else length).encode()
    fields = [url, b"1.2.3.4", date, mime, n] if version == 1 else [url, b"1.2.3.4", date, mime, b"404", b"abc", b"-", b"17", b"f.arc", n]
    return b" ".join(fields) + b"\n" + body + b"\n"


def archive(version, *records):
    head = b"filedesc://f.arc 0.0.0.0 20010101000000 text/plain " + (b"" if version == 1 else b"200 - - 0 f.arc ") + str(len(ABOUT[version])).encode() + b"\n"
    return head + ABOUT[version] + b"\n" + b"".join(records)


def table(found):
    return [dict(zip([n for n, _ in arc.FIELDS], r, strict=True)) for r in found]


@pytest.mark.parametrize("version", [1, 2])
def test_records_of_both_versions(version):
    data = archive(version, record(version, b"http://a.b/", PAGE), record(version, b"dns:a.b", b"a.b 1.2.3.4", mime=b"text/dns"), record(version, b"http://c.d/", b"", date=b"2001020304"))
    rows = table(arc.records("f.arc", data))
    assert [r["warc_type"] for r in rows] == ["warcinfo", "response", "resource", "resource"]
    assert [r["problem"] for r in rows] == [None] * 4
    assert [r["block"] for r in rows] == [ABOUT[version], PAGE, b"a.b 1.2.3.4", b""]
    assert rows[1]["http_status"] == 404 and rows[1]["warc_date"] == "2001-02-03T04:05:06Z" and rows[3]["warc_date"] == "2001-02-03T04:00:00Z"
    assert rows[2]["content_type"] == "text/dns" and rows[1]["arc_version"] == version
    assert rows[1]["payload_digest"] == arc.digest(PAGE.split(b"\r\n\r\n", 1)[1]) and rows[1]["block_digest"] == arc.digest(PAGE)
    assert all(data[r["offset"] :].startswith((b"filedesc", b"http", b"dns")) for r in rows)
    assert len({r["warc_record_id"] for r in rows}) == 4


def test_gzip_by_record_and_as_a_whole():
    parts = [archive(1), record(1, b"http://a.b/", PAGE), record(1, b"http://c.d/", b"x")]
    want = table(arc.records("f", b"".join(parts)))
    assert table(arc.records("f", b"".join(map(gzip.compress, parts)))) == want
    assert table(arc.records("f", gzip.compress(b"".join(parts)))) == want
    cut = b"".join(map(gzip.compress, parts))[:-9]
    assert len(table(arc.records("f", cut))) >= 2


def test_wrong_lengths_are_reported_and_reading_goes_on():
    good = record(1, b"http://c.d/", b"HTTP/1.1 200 OK\r\n\r\nfine")
    for length in (len(PAGE) - 7, len(PAGE) + 9, 10**6):
        rows = table(arc.records("f", archive(1, record(1, b"http://a.b/", PAGE, length=length), good)))
        assert [r["target_uri"] for r in rows] == [None, "http://a.b/", "http://c.d/"], length
        assert [r["problem"] for r in rows] == [None, "length", None] and rows[1]["block"] == PAGE
    rows = table(arc.records("f", archive(1, record(1, b"http://a.b/", PAGE, length=10**6))))
    assert rows[1]["problem"] == "truncated" and rows[1]["block"].startswith(PAGE)
    rows = table(arc.records("f", b"some garbage here\nand more\n" + archive(1, good)))
    assert [r["problem"] for r in rows] == ["no header", None, None] and rows[0]["block"] == b"some garbage here\nand more\n"
    rows = table(arc.records("f", archive(1, good, b"garbage\n", good)))
    assert [r["problem"] for r in rows] == [None, "length", None]
    rows = table(arc.records("f", archive(1, record(1, b"http://a.b/", PAGE, date=b"20019903040506"))))
    assert rows[1]["problem"] == "date" and rows[1]["warc_date"] == "2001-01-01T00:00:00Z"
    rows = table(arc.records("f", archive(1, record(1, b"http://a.b/", PAGE, mime=b"text/html; charset=utf-8"))))
    assert rows[1]["problem"] is None and rows[1]["block"] == PAGE


@pytest.mark.parametrize("seed", range(10))
def test_any_bytes_round_trip(seed):
    rng = random.Random(seed)
    bodies = [bytes(rng.choice(b"ab \n\r\x00\xff") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(0, 8))]
    version = rng.choice([1, 2])
    rows = table(arc.records("f", archive(version, *[record(version, b"http://a/%d" % i, b) for i, b in enumerate(bodies)])))
    assert [r["block"] for r in rows[1:]] == bodies
    for r in rows:
        head, _, rest = arc.warc_bytes(r).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\n") and rest == r["block"] + b"\r\n\r\n"
        assert b"Content-Length: %d" % len(r["block"]) in head


@pytest.mark.parametrize("damage", ["body", "trailer", "between", "same length"])
def test_records_after_a_damaged_member_are_kept(damage):
    rng = random.Random(4)
    page = PAGE + bytes(rng.choice(b"abcdefgh \n") for _ in range(60_000))
    parts = [archive(1), record(1, b"http://a.b/", page), record(1, b"http://c.d/", PAGE), record(1, b"http://e.f/", b"x" * 900)]
    want = table(arc.records("f", b"".join(parts)))
    zipped = [gzip.compress(x, mtime=0) for x in parts]
    if damage in ("body", "same length"):
        half = len(zipped[1]) // 2
        zipped[1] = zipped[1][:half] + b"\xff" * 40 + zipped[1][half + 40 :] if damage == "body" else zipped[1][:half]
    elif damage == "trailer":
        zipped[1] = zipped[1][:-8] + bytes(8)
    else:
        zipped[1] += b"not gzip"
    rows = table(arc.records("f", b"".join(zipped)))
    lost = [r for r in rows if r["problem"] == "gzip"]
    assert len(lost) == 1 and lost[0]["warc_type"] is None and lost[0]["content_length"] == len(lost[0]["block"])
    rows = [r for r in rows if r["problem"] != "gzip"]
    assert [r["target_uri"] for r in rows] == [r["target_uri"] for r in want]
    assert [(r["block"], r["problem"]) for r in rows[2:]] == [(r["block"], None) for r in want[2:]]
    whole = damage in ("trailer", "between")
    assert rows[1]["problem"] in ((None,) if whole else ("truncated", "length"))
    assert rows[1]["block"] == page if whole else rows[1]["block"][:1000] == page[:1000]


def test_dates_are_those_of_a_calendar():
    assert arc.iso_date("20000229") == "2000-02-29T00:00:00Z"
    assert [arc.iso_date(d) for d in ("20010229", "20010431", "2001013", "00000101", "²0010101", "20010101250000")] == [None] * 6


def test_odd_digits_are_no_length():
    odd = "http://a.b/ 1.2.3.4 20010203040506 text/html ²\n".encode()
    rows = table(arc.records("f", archive(1, odd, record(1, b"http://c.d/", b"x"))))
    assert [(r["target_uri"], r["problem"]) for r in rows] == [(None, None), (None, "no header"), ("http://c.d/", None)] or rows[0]["problem"] == "length" and rows[-1]["target_uri"] == "http://c.d/"


@pytest.mark.parametrize("seed", range(60))
def test_a_flipped_byte_costs_one_member_at_most(seed):
    """Whatever byte of whatever gzip member changes, all other records come out, and nothing raises."""
    rng = random.Random(seed)
    parts = [archive(rng.choice([1, 2]))]
    version = 1 if b" 200 - - 0 " not in parts[0] else 2
    parts += [record(version, b"http://a/%d" % i, PAGE + bytes(rng.choice(b"abcdefgh \n") for _ in range(rng.randint(0, 3000)))) for i in range(6)]
    want = {r["block"] for r in table(arc.records("f", b"".join(parts)))}
    zipped = [bytearray(gzip.compress(x, mtime=0)) for x in parts]
    hit = rng.randrange(1, len(zipped))
    at = rng.randrange(len(zipped[hit]))
    zipped[hit][at] ^= rng.randrange(1, 256)
    rows = table(arc.records("f", b"".join(map(bytes, zipped))))
    (lost,) = {r["block"] for r in table(arc.records("f", parts[0] + parts[hit])) if r["warc_type"] != "warcinfo"}
    assert want - {r["block"] for r in rows} <= {lost}


def test_convert_files(spark):
    data = archive(1, record(1, b"http://a.b/", PAGE))
    files = spark.createDataFrame([("a", data, 1), ("b", None, 2), ("c", b"", 3), (None, data, 4), ("a", data, 5), ("z", b"junk", None)], "path string, content binary, offset int")
    rows = arc.convert(files).collect()
    assert Counter(r.path for r in rows) == {"a": 4, None: 2, "z": 1}
    assert len({r.warc_record_id for r in rows if r.path == "a"}) == 2
    assert {r.block for r in arc.convert(files, blocks=False).collect()} == {None}
    assert arc.convert(files.where("false")).collect() == []


ENTRIES = [("example.com", "block"), ("a.example.com", "allow"), ("example.com/x/y", "allow"), ("A.example.com/z", "block"), ("both.org", "allow"), ("both.org", "block"), ("org", "allow"), ("http://deep.org/p", "block"), ("", "block"), ("bad", "maybe"), (None, "block")]
URLS = ["http://example.com", "HTTP://b.EXAMPLE.com/x/y/q?z", "http://a.example.com/x/y", "https://u:p@a.example.com:80/z/1#f", "http://a.example.com/zz", "http://both.org/", "http://deep.org/p", "http://deep.org/pp", "http://notexample.com", "http://example.com.", "http://x.example.com//x//y/", None, "", "nope", "/rel/x", "http://", "http://[::1]/x", "http://org"]


def keys(url):
    """What the columns of the operator say, for one URL."""
    found = re.match(url_filter.HOST, url or "")
    labels = [x for x in found[1].lower().split(".") if x] if found else []
    return labels[::-1], [x for x in re.match(url_filter.PATH, url)[1].split("/") if x] if labels else []


def brute(url, entries=ENTRIES):
    host, path = keys(url)
    best = None
    for entry, action in entries:
        if entry and action in ("allow", "block"):
            h, p = keys(entry if "://" in entry else f"http://{entry}")
            if h and host[: len(h)] == h and path[: len(p)] == p:
                key = (len(h), len(p), action == "block", [-ord(c) for c in entry])
                if best is None or key > best[0]:
                    best = (key, action, entry)
    return best[1:] if best else ("allow", None)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_most_specific_entry_decides_by_trie_and_by_join(spark, limit):
    long = "http://example.com/x/y/" + "z/" * 20_000
    pages = spark.createDataFrame([(i % 5, u, "x", "y", "q", "r") for i, u in enumerate([*URLS, URLS[0], long])], "page_id int, url string, action string, h string, __action string, `__url` string")
    pages = pages.selectExpr("*", "'x' AS `__entry`", "'x' AS `__found`", "'x' AS `__host`", "1 AS `a.b`")
    entries = spark.createDataFrame(ENTRIES, "entry string, action string")
    out = url_filter.judged(pages, entries, max_broadcast=limit)
    assert out.columns == [*[c for c in pages.columns if c != "action"], "action", "entry"]
    got = Counter((r.url, r.action, r.entry) for r in out.collect())
    assert got == Counter((u, *brute(u)) for u in [*URLS, URLS[0], long])
    assert url_filter.judged(pages.where("false"), entries, max_broadcast=limit).collect() == []
    assert {r.action for r in url_filter.judged(pages, entries.where("false"), default="block", max_broadcast=limit).collect()} == {"block"}


@pytest.mark.parametrize("seed", range(3))
def test_random_entries_and_urls(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abc")
    some = lambda n, sep: sep.join(word() for _ in range(n))
    entries = [(some(rng.randint(1, 3), ".") + "".join("/" + word() for _ in range(rng.randint(0, 2))), rng.choice(["allow", "block"])) for _ in range(25)]
    urls = [f"http://{some(rng.randint(1, 4), '.')}/{some(rng.randint(0, 4), '/')}" for _ in range(300)]
    pages, rules = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(entries, "entry string, action string")
    for limit in (10**6, 0):
        assert Counter(tuple(r) for r in url_filter.judged(pages, rules, max_broadcast=limit).collect()) == Counter((u, *brute(u, entries)) for u in urls)


def test_the_trie_takes_what_the_limit_reckons():
    rows = [(["com", f"host{i}"], ["en", str(i)], "block", f"host{i}.com/en/{i}") for i in range(20_000)]
    trie = url_filter.Trie(rows)
    assert trie.nbytes() <= sum(2 * len(r[3]) + 24 * (len(r[0]) + len(r[1])) for r in rows)


def prints(texts, level=fingerprints.LEVEL):
    return fingerprints.fingerprint_slice(*arrow_text.raw(arrow_text.strings(pa.array(texts))), level)


MASK = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x


def plain_toss(x):
    """Each symbol's lowest bit that differs from the symbol before, and its value; the first has a neighbour that differs in bit 0."""
    out = []
    for i, v in enumerate(x):
        other = v ^ 1 if i == 0 else x[i - 1]
        bit = next(b for b in range(64) if (v ^ other) >> b & 1)
        out.append(2 * bit + (v >> bit & 1))
    return out


def plain_parse(x):
    """One level of the parse of one text, symbol by symbol."""
    step = 0x9FB21C651E98DF25
    if len(x) == 1:
        return x
    flat = []
    for v, run in groupby(x):
        n = len(list(run))
        flat.append(v if n == 1 else plain_mix((v * step + n) & MASK))
    colour = plain_toss(flat)
    for _ in range(3):
        colour = plain_toss(colour)
    for high in (3, 4, 5):
        old = list(colour)
        for i, c in enumerate(old):
            if c == high:
                near = {old[i - 1] if i else None, old[i + 1] if i + 1 < len(old) else None}
                colour[i] = min({0, 1, 2} - near)
    last = len(flat) - 1
    starts = [0, *[i for i in range(2, last) if colour[i] > colour[i - 1] and colour[i] > colour[i + 1]]]
    names = []
    for a, b in zip(starts, [*starts[1:], len(flat)], strict=True):
        names.append(plain_mix((sum(plain_mix((v + k * step) & MASK) for k, v in enumerate(flat[a:b])) + b - a) & MASK))
    return names


def plain_prints(text, level=fingerprints.LEVEL):
    x, height, names = [b + 1 for b in text.encode()], 0, None
    while len(x) > 1:
        if height == level:
            names = x
        x, height = plain_parse(x), height + 1
    if height == level:
        names = x
    return sorted(set(x if names is None else names)), x[0] if x else 0, height


def test_fingerprints_against_brute_force(sf):
    rng = random.Random(17)
    docs = [r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).to_pylist()]
    texts = [t for t in docs if len(t) < 4000][:60]
    texts += [t or "" for _, t, *_ in awkward() if len(t or "") < 4000] + ["a", "aa", "ab", "aab", "abb", "a" * 500, "ab" * 300]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(100)]
    names, root, height = prints(texts)
    for i, t in enumerate(texts):
        assert (names[i].tolist(), int(root[i]), int(height[i])) == plain_prints(t), t[:50]


def test_fingerprints_of_very_long_texts():
    rng = random.Random(5)
    passage = sentence(rng, 80)
    long = sentence(rng, 250_000)
    names, _, height = prints([long + passage + long, "a" * 3_000_000])
    inside = set(prints([passage])[0][0].tolist())
    assert len(inside & set(names[0].tolist())) >= 0.8 * len(inside) and height[0] > 8 and height[1] == 1


def test_equal_passages_share_signatures_at_any_offset():
    rng = random.Random(1)
    passage = sentence(rng, 60)
    inside = set(prints([passage])[0][0].tolist())
    for k in range(30):
        other = sentence(rng, rng.randint(0, 40))[: rng.randint(0, 200)] + passage + sentence(rng, 20)
        assert len(inside & set(prints([other])[0][0].tolist())) >= 0.5 * len(inside)
    assert not inside & set(prints([sentence(rng, 300)])[0][0].tolist())


def test_texts_do_not_influence_each_other():
    texts = [t or "" for _, t, *_ in awkward()] + ["a", "aa", "ab", "a" * 1000, "ab" * 500]
    names, root, height = prints(texts)
    for i, t in enumerate(texts):
        n, r, h = prints([t])
        assert r[0] == root[i] and h[0] == height[i] and (n[0] == names[i]).all()
    by = {}
    for t, r in zip(texts, root, strict=True):
        assert by.setdefault(int(r), t) == t


def test_colours_differ_between_neighbours():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, 5000).astype(np.uint64)
    x = x[np.append(True, x[1:] != x[:-1])]
    first = np.array([0, 700, 701, 702, 2000])
    c = fingerprints.coin_toss(x, first)
    inner = np.ones(len(x), bool)
    inner[first] = False
    assert c.max() <= 2 and (c[1:] != c[:-1])[inner[1:]].all()


def test_fingerprints_of_awkward_documents(spark):
    out = fingerprints.fingerprints(frame(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in awkward())
    texts = {i: t for i, t, *_ in awkward() if i is not None}
    for r in out:
        if r.doc_id is not None and not texts[r.doc_id]:
            assert r.root is None and r.height == 0 and r.signatures == []
    assert len({r.root for r in out if r.doc_id in (0, 25, 26)}) == 1
    assert fingerprints.fingerprints(empty(spark)).collect() == []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 12), (200, 8), (32_768, 256)])
def test_counts_equal_whole_encoding(spark, chunk, overlap):
    rng = random.Random(chunk)
    marks = "abc éß漢字😀 \n\t'sl12.,!?  "
    texts = ["".join(rng.choice(marks) for _ in range(n)) for n in (0, 1, 50, 63, 64, 65, 76, 77, 100, 500, 3000)] + ["a" * 5000, " " * 3000, "it's we'll " * 300, "漢" * 700 + " x " + "y" * 900, "\n" * 900 + "x", "1" * 500]
    rows = [*awkward(), *[(100 + i, t, None, None, None) for i, t in enumerate(texts)], (100 + 10, texts[10], None, None, None)]
    encoder, _ = token_counts.encoding(open(token_counts.VOCABULARY, "rb").read())
    want = Counter((i, len(encoder.encode_ordinary(t or ""))) for i, t, *_ in rows)
    got = Counter(tuple(r) for r in token_counts.token_counts(frame(spark, rows), chunk=chunk, overlap=overlap).collect())
    assert got == want


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(empty(spark), chunk=8, overlap=9)

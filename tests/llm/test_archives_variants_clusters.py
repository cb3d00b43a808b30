"""WARC archives, spelling variants and centroid clusters against plain versions."""

import gzip
import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.llm import clusters, variants, warc
from pagetrail.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


def plain_pages(rows):
    """page_id, payload_bytes, payload_digest, record_type, refers_to by the rule itself."""
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = min(same, default=None)
        revisit = len(data) >= warc.LEAST_SHARED and first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    long = "wort für wort ✓ " * 40_000
    rows = [(3, "http://a/1", "x" * 100), (1, "http://a/2", "x" * 100), (2, None, "x" * 100), (4, "http://a/\r\nX: y z", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, "é", long), (9, "e", long), (None, "n", long), (None, "m", "alone" * 30), (1, "http://a/2", "x" * 100), (10, "r\x85", "WARC/1.1\r\n\r\n" * 20)]
    got = warc.round_trip(spark.createDataFrame([(*r, "z") for r in rows], PAGES + ", payload_digest string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_pages(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_files(spark):
    """Every record is a gzip member that other readers open; small archives roll over; payloads come back, also those of revisits."""
    rows = [(i, f"http://h/{i}", ("same text " * 20) if i % 3 else f"text {i} " * 30) for i in range(60)]
    folder = f"{shared_dir(spark)}/archives"
    index = warc.archive_pages(spark.createDataFrame(rows, PAGES).repartition(2), folder, roll=4000)
    files = sorted({r["file"] for r in index.collect()})
    assert len(files) > 3 and all(os.path.getsize(f.removeprefix("file://")) < 6000 for f in files)
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and f"<{r['record_id']}>".encode() in record and record.endswith(b"\r\n\r\n")
    records = warc.read_archives(index.select("file").distinct())
    assert records.where("record_type = 'warcinfo'").count() == len(files)
    whole = warc.with_revisited(records.where("record_type <> 'warcinfo'")).collect()
    assert {(r["record_id"], bytes(r["payload"]).decode()) for r in whole} == {(f"urn:page:{i}", h) for i, _, h in rows}
    assert all(r["block_ok"] and r["payload_ok"] is not False and r["error"] is None for r in whole)


def _member(block=b"body", **more):
    fields = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x>", "WARC-Payload-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"} | more
    return warc.member(list(fields.items()), block)


def test_warc_damage():
    read = lambda data: [(r["record_type"], r["payload"], r["payload_ok"], bool(r["error"])) for r in warc.read_archive(io.BytesIO(data))]
    good = ("resource", b"body", True, False)
    bad = (None, None, None, True)
    broken = bytearray(_member(os.urandom(500)))
    broken[60] ^= 255
    assert read(b"") == []
    assert read(_member() + _member()) == [good, good]
    assert read(_member() + bytes(broken) + _member())[0] == good
    found = read(_member() + bytes(broken) + _member())
    assert bad in found and found[-1] == good
    assert read(_member() + _member()[:-9]) == [good, bad]
    assert read(b"no gzip" + _member()) == [bad, good]
    assert read(_member(**{"WARC-Payload-Digest": "sha256:" + "0" * 64})) == [("resource", b"body", False, False)]
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nbody\r\n\r\n")
    more = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nbody\r\n\r\n")
    none = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nbody\r\n\r\n")
    for wrong in (short, more, none, gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")):
        assert read(wrong + _member()) == [bad, good]
    folded = gzip.compress(b"WARC/1.0\r\nwarc-type: resource\r\nX: a\r\n b\r\nCONTENT-LENGTH: 4\r\n\r\nbody\r\n\r\n")
    assert read(folded) == [("resource", b"body", None, False)]
    large = os.urandom(300_000) + bytes(3_000_000)
    assert read(_member(large) + _member()) == [("resource", large, True, False), good]


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(n):
    near = {w: [v for v in n if edit_one(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("block", [1024, 24])
def test_variant_groups(spark, block):
    """Random words over few letters, many one edit apart, with one very common front; small blocks cut keys into tiles."""
    pick = random.Random(7)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(6, 9))) for _ in range(150)}
    words |= {"common" + "".join(pick.choice("ab") for _ in range(pick.randint(1, 6))) for _ in range(120)}
    n = {w: pick.choice((5, 6, 30, 160, 900, 900, 6000)) for w in words}
    given = spark.createDataFrame([(w, k, "x") for w, k in n.items()] + [(None, 9, "y")], "word string, n long, form string")
    assert {tuple(r) for r in variants.variant_groups(given, block=block).collect()} == plain_groups(n)


def test_spelling_variants(spark):
    texts = [(i, "Über Überall colour COLOUR colours. color's straße naïveté ÿþðabc  x×y÷zzzz " * (i % 7 + 1) + f"word{i}tail recieve receive") for i in range(40)] + [(None, "colour colour"), (90, None), (91, ""), (91, "colour" * 5000), (5, "colour colour")]
    counts = {}
    for i, t in texts:
        for run in variants.re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, word string")
    assert {tuple(r) for r in variants.spelling_variants(docs, 3).collect()} == plain_groups(n)
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, of) if a == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    of = assign()
    distance = [far(v, centroids[a]) for (_, v), a in zip(kept, of)]
    return sorted(((i, a, d, sum(x for x, b in zip(distance, of) if b == a), sum(distance), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for (i, _), a, d in zip(kept, of, distance)), key=str)


def test_centroid_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 64) + (i % 5)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(7, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]
    rows += [(200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [1.0] * 63 + [float("nan")]), (204, [1.0] * 63 + [float("-inf")]), (205, [])]
    given = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    for width, together in ((2, 16384), (3, 10)):
        got = clusters.centroid_clusters(given, clusters=9, rounds=4, width=width, together=together)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, 9, 4)
    # fewer vectors than clusters, none at all, components that are too large
    assert clusters.centroid_clusters(given.where("vec_id < 3")).select(F.sum("distance")).first()[0] == 0
    assert clusters.centroid_clusters(given.where("vec_id = 200")).count() == 0
    assert clusters.centroid_clusters(spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")).count() == 0


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-5, 5, (500, 64)), rng.integers(-(1 << 27), 1 << 27, (50, 64)), np.zeros((3, 64), np.int64)):
        for width in (1, 2, 5, 64):
            dictionaries, codes = clusters.encode(x, width)
            assert (np.concatenate([d[c] for d, c in zip(dictionaries, codes)], axis=1) == x).all()
            assert all(len(np.unique(d, axis=0)) == len(d) for d in dictionaries)


@pytest.mark.parametrize("kind", ["mixed", "thirds", "few", "none"])
def test_configuration_program(kind):
    """The fractional packing covers every piece, its times are near the bound, and the rounded one holds exactly the pieces."""
    from pagetrail.llm import packing

    rng = np.random.default_rng(4)
    sizes = {"mixed": np.clip(rng.lognormal(4.5, 1.0, 900).astype(int), 1, 255), "thirds": np.array([100] * 500 + [75] * 400 + [56] * 300), "few": np.array([5, 250, 20, 235]), "none": np.zeros(0, int)}[kind]
    h = np.bincount(sizes - 1, minlength=256).astype(np.int64) if len(sizes) else np.zeros(256, np.int64)
    patterns, bound = packing.configurations(h, 256)
    for counts, _ in patterns:
        assert (counts * np.arange(1, 257)).sum() <= 256 and (counts <= h).all()
    covered = sum((c * t for c, t in patterns), np.zeros(256))
    assert (covered >= h * (1 - 1e-6)).all()
    assert sum(t for _, t in patterns) <= 1.03 * bound + 1e-9
    found = packing.plan(h, 256)
    assert (sum((c * t for c, t in found), np.zeros(256, np.int64)) == h).all()
    assert sum(t for _, t in found) <= sum(t for _, t in packing.best_fit(h, 256))
    assert not len(sizes) or sum(t for _, t in found) >= bound - 1e-9


def test_url_filter_learns_from_other_hosts(spark):
    """Sections that labelled hosts have shown to be bad are rejected on hosts without labels, a host's own labels weigh more, and few deep paths cost no levels."""
    from pagetrail.llm import urlfilter

    hosts = [f"h{i}.com" for i in range(8)]
    urls = [(h, f"http://{h}/{s}/{k}", s == "casino") for h in hosts for s in ("casino", "news", "blog") for k in range(12)]
    own = [("own.com", f"http://own.com/casino/{k}", False) for k in range(40)]  # here the same section is good
    deep = [("deep.com", "http://deep.com" + "/x" * 200 + f"/{k}", False) for k in range(2)]
    rows = [*urls, *own, *deep]
    pages = spark.createDataFrame([(k, u) for k, (_, u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(u, b) for h, u, b in rows if h in (*hosts[:5], "own.com")], "url string, bad boolean")
    got = {r.page_id: r for r in urlfilter.url_filter(pages, (), labels).collect()}
    for k, (h, u, b) in enumerate(rows):
        assert got[k].verdict == ("block" if b else "allow"), u
    assert got[len(rows) - 1].template == "/*" * 201

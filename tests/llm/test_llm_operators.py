"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from pagetrail.llm.common import LOWER
from pagetrail.llm import decontam, embedding, langid, license, lm, packing, quality, simhash, substring, urlfilter

DOCS = "doc_id long, text string, lang string, score double, rid long, h long"


def docs_of(spark, texts, langs=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), 0.5, 7, 9) for i, t in texts], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [(i, " ".join(words(rng, rng.choice((1, 3, 4, 40, 90))))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n "), (103, "Ünïcode … ÉÉ"), (104, " ".join(words(rng, 20000))), (None, "a null id here"), (5, out[5][1]), (105, out[5][1])]
    base = words(rng, 120)
    out += [(200 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 30, 5)]
    return out


def components_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, texts):
    def fp(text):
        parts = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        runs = [b" ".join(parts[k : k + 4]) for k in range(len(parts) - 3)] or ([b" ".join(parts)] if parts else [])
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, fp(t)) for i, t in texts]
    keys = list(range(len(prints)))
    comp = components_of(keys, [(a, b) for a, b in combinations(keys, 2) if (prints[a][1] ^ prints[b][1]).bit_count() <= 4])
    low = {}
    for k in keys:
        if prints[k][0] is not None:
            low[comp[k]] = min(low.get(comp[k], 10**9), prints[k][0])
    want = Counter((i, f"{p:016x}", low.get(comp[k])) for k, (i, p) in enumerate(prints))
    assert Counter(tuple(r) for r in simhash.simhash_components(docs_of(spark, texts)).collect()) == want
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_simhash_tiles(spark, monkeypatch):
    """Many small tiles give the same components as one."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.int64)
    fps = np.unique(np.concatenate([fps, fps[:40] ^ 3, fps[:20] ^ 31]))
    df = spark.createDataFrame([(k, [int(v)], int(v).bit_count()) for k, v in enumerate(fps)], "id long, fp array<long>, w int")
    got = simhash.near_links(df, 4, 4).collect()
    linked = [(a, b) for a, b in combinations(range(len(fps)), 2) if int(fps[a] ^ fps[b]).bit_count() <= 4]
    assert components_of(range(len(fps)), [tuple(sorted(r)) for r in got]) == components_of(range(len(fps)), linked)


def test_near_dedup(spark, texts):
    sets = {}
    for k, (i, t) in enumerate(texts):
        s = set(simhash.shingles((t or "").encode(), 5))
        if s:
            sets[k] = s
    comp = components_of(sets, [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    groups = {}
    for k in sets:
        groups.setdefault(comp[k], []).append(math.inf if texts[k][0] is None else texts[k][0])
    want = Counter([min(g) for g in groups.values()] + [math.inf if i is None else i for k, (i, _) in enumerate(texts) if k not in sets])
    out = simhash.near_dedup(docs_of(spark, texts))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(math.inf if r.doc_id is None else r.doc_id for r in out.collect()) == want


def test_near_dedup_equal_fingerprints(spark):
    """Different texts whose repeated line decides every bit both stay; copies among them still go."""
    rng = random.Random(11)
    line = " ".join(f"line{k}" for k in range(7))
    own = lambda n: " ".join(words(rng, n, 10**9))
    rows = [(k, " ".join([line] * 100 + [own(60)])) for k in range(4)] + [(10 + k, "again " * 600 + own(200)) for k in range(4)]
    rows += [(20, rows[1][1]), (21, rows[1][1] + " more")]
    out = simhash.near_dedup(docs_of(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 10, 11, 12, 13]


def test_near_dedup_other_repeats(spark):
    """Texts that differ in how often a line repeats are near copies, however often it does."""
    rng = random.Random(12)
    rows = []
    for k in range(6):
        base, line = " ".join(words(rng, 300, 10**9)), " ".join(words(rng, 8, 10**9))
        rows += [(10 * k, f"{base} {line}"), (10 * k + 1, base + f" {line}" * 60), (10 * k + 2, base + f" {line}" * 200)]
    assert sorted(r.doc_id for r in simhash.near_dedup(docs_of(spark, rows)).collect()) == [10 * k for k in range(6)]


@pytest.mark.parametrize("loose", [False, True])
def test_verified_links_of_large_groups(spark, monkeypatch, loose):
    """Chunks, heads and what is left over give the components of all pairs of a group, whether it holds one text's copies or many."""
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(4)
    rows = []
    for c in range(3):
        for base in range(6 if loose else 1):
            whole = list(range(1000 * base, 1000 * base + 60))
            for k in range(8 if loose else 40):
                gone = set(rng.sample(whole, rng.randrange(14)))
                rows.append((len(rows), c, sorted(set(whole) - gone)))
    edges = [(a, b) for (a, c, x), (b, d, y) in combinations(rows, 2) if c == d and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))]
    members = spark.createDataFrame(rows, "id long, c long, shingles array<long>").repartition(3)
    got = [(r.a, r.b) for r in simhash.verified_links(members, 0.8).collect()]
    ids = [r[0] for r in rows]
    assert components_of(ids, got) == components_of(ids, edges)


def test_substring(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(words(rng, 9, 5000)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(7))
    clean = {i: " ".join(sentence() for _ in range(8)) for i in range(20)}
    texts = dict(clean)
    for i in (3, 7, 12):
        texts[i] = f"{sentence()} {passage} {sentence()}"
    rows = [*texts.items(), (50, None), (51, ""), (None, texts[7]), (52, clean[1]), (1, clean[1]), (53, "One. Two. Three."), (54, "One. Two. Three.")]
    got = {}
    for r in substring.substring_dedup(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[3][0].text == texts[3] and passage in got[3][0].text
    for i in (7, 12):
        assert got[i][0].n_removed == 7 and not any(s in got[i][0].text for s in passage.split(". "))
    assert got[None][0].n_removed == 9 and got[None][0].text == ""
    assert all(got[i][0].text == t for i, t in clean.items() if i not in (3, 7, 12))
    assert len(got[1]) == 2 and got[52][0].text == "" and got[50][0].text is None
    assert got[53][0].text == got[54][0].text == "One. Two. Three."  # too few words for a run
    assert substring.substring_dedup(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block, ranges", [(None, None), (12, 9)])
def test_substring_brute_force(spark, monkeypatch, block, ranges):
    """Every run by its words, its first place by (doc_id, place), and the sentences that the other places cover, whatever the blocks."""
    if block:
        monkeypatch.setattr(substring, "BLOCK", block)
        monkeypatch.setattr(substring, "RANGE", ranges)
    rng = random.Random(11)
    stock = [" ".join(words(rng, rng.choice((3, 7, 11, 24)), 5000)).capitalize() + "." for _ in range(25)]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(12)))) for i in range(60)] + [(70, None), (71, "")]
    first, found = {}, []
    for i, t in rows:
        parts = [b" ".join(p) for p in substring.units((t or "").encode())[1]]
        n, spans = len(parts), set()
        enough = lambda a, b: b - a >= substring.SENTENCES and sum(len(p.split()) for p in parts[a:b]) >= substring.WORDS  # noqa: B023, E731
        for a in range(n):
            spans |= {(a, b) for b in range(a + 1, n + 1) if enough(a, b) and not enough(a, b - 1)}
            spans |= {(x, a + 1) for x in range(a + 1) if enough(x, a + 1) and not enough(x + 1, a + 1)}
        for a, b in sorted(spans):
            run = b" ".join(parts[a:b]), b - a
            first.setdefault(run, (i, a))
            found.append((run, i, a, b))
    gone = {}
    for run, i, a, b in found:
        if first[run] != (i, a):
            gone.setdefault(i, set()).update(range(a, b))
    assert len(gone) > 10
    for r in substring.substring_dedup(docs_of(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        assert r.n_removed == len(gone.get(r.doc_id, ()))
        assert r.text == (text if text is None else substring.cut(text.encode(), list(gone.get(r.doc_id, ()))).decode())


def test_substring_inside_sentences(spark):
    """Passages of over 50 words within longer sentences, after other lead-ins and before other tails."""
    rng = random.Random(7)
    some = lambda n: " ".join(words(rng, n, 10**6))
    rows, passages = [], {}
    for k in range(20):
        passage = some(51 + k)
        rows.append((k, f"{some(rng.randrange(40))} {passage} {some(rng.randrange(40))}."))
        for copy in (100 + k, 200 + k):
            passages[copy] = set(passage.split())
            rows.append((copy, f"{some(rng.randrange(40))} {passage} {some(rng.randrange(40))}."))
    texts, got = dict(rows), {r.doc_id: r for r in substring.substring_dedup(docs_of(spark, rows)).collect()}
    assert all(got[k].text == texts[k] for k in range(20))
    for k, passage in passages.items():
        left = set(got[k].text.rstrip(".").split())
        assert len(passage & left) <= 30 and got[k].removed_words >= 20
        assert set(texts[k].rstrip(".").split()) - left <= passage


def test_substring_units_cover_the_text():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab .!?\n\té") for _ in range(rng.randrange(120))).encode()
        ranges, parts = substring.units(t)
        assert b"".join(t[a:b] for a, b in ranges) == t and len(ranges) == len(parts)


def test_url_rules(spark):
    urls = ["http://a.b.net/x", "https://EXAMPLE.net/en/1", "http://x.example.com/de/1?q", "http://example.com/en", "http://z.org/fr/2", "http://z.org", "http://planet/", None, "no scheme", "http://net", "a://b://c/d", "http://notexample.com/de/"]
    got = {r.page_id: r for r in urlfilter.url_filter(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [got[i].rule for i in range(12)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None]
    assert [got[i].verdict for i in range(3)] == ["block", "allow", "block"] and got[1].host == "example.net"
    assert (got[7].host, got[7].path) == (got[8].host, got[8].path) == ("", "") and (got[10].host, got[10].path) == ("b:", "//c/d")
    assert urlfilter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_templates(spark):
    bad = [f"http://h.com/item/{k}/spam" for k in range(60)]
    good = [f"http://h.com/post/{k}" for k in range(60)] + [f"http://h.com/news/{k}" for k in range(60)]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    labels = spark.createDataFrame([(u, u in bad) for u in (bad + good)[::3]], "url string, bad boolean")
    got = {r.page_id: r for r in urlfilter.url_filter(pages, (), labels).collect()}
    assert all((got[k].verdict == "block") == (k < 60) for k in got)
    assert len({got[k].template for k in got if k >= 60}) == 1  # like branches have merged
    assert len({got[k].template for k in got}) == 2


def test_url_many_sections(spark):
    """A bad section among forty equal ones is a template of its own, as is a bad one below seven segments."""
    urls = [(f"http://h.com/section{a}/page{b}", a == 7) for a in range(40) for b in range(30)]
    urls += [(f"http://d.com/a/b/c/d/e/f/{x}/page{b}", x == "bad") for x in ("bad", "good", "fine", "well") for b in range(30)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame(urls[::2], "url string, bad boolean")
    got = {r.page_id: r for r in urlfilter.url_filter(pages, (), labels).collect()}
    assert all((got[k].verdict == "block") == bad for k, (_, bad) in enumerate(urls))


def test_url_like_branches_merge(spark):
    """Sections of two kinds, none like the node's mean, are judged with those of their kind; ids may be null, rows repeat, paths be deep."""
    urls = [(f"http://h.com/s{a}/page{b}", a < 6) for a in range(12) for b in range(16)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)] + [(None, urls[0][0]), (0, urls[0][0]), (999, "http://h.com" + "/deep" * 20)], "page_id long, url string")
    labels = spark.createDataFrame(urls, "url string, bad boolean")
    rows = urlfilter.url_filter(pages, (), labels).collect()
    assert len(rows) == len(urls) + 3
    assert {r.verdict for r in rows if r.page_id is None} == {"block"} and sum(r.page_id == 0 for r in rows) == 2
    got = {r.page_id: r for r in rows}
    assert all((got[k].verdict == "block") == bad for k, (_, bad) in enumerate(urls))
    assert len({got[k].template for k, (_, bad) in enumerate(urls) if bad}) == 1
    assert len({got[k].template for k, (_, bad) in enumerate(urls) if not bad}) == 1
    assert got[999].verdict == "allow"


def vectors():
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1):
        x = rng.normal(size=(60, 32))
        near = x[:20] + rng.normal(size=(20, 32)) * 0.05
        cluster = x[0] + rng.normal(size=(90, 32)) * 0.02
        for v in np.concatenate([x, near, cluster]).astype(np.float32):
            rows.append((k, v.tolist(), label))
            k += 1
    copies = [(k, rows[3][1], 0), (k + 1, rows[3][1], 0), (k + 2, rows[3][1], 1), (k + 3, rows[3][1], None), (k + 4, None, 0), (k + 5, [0.0] * 32, 0), (k + 6, [math.nan] * 32, 0), (k + 7, [None] * 32, 0), (k + 8, [], 0), (k + 9, [1.0, 2.0], 0), (k + 10, [2.0, 4.0], 0), (k + 11, [math.inf] * 32, 0)]
    return rows + copies


def test_embeddings(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(embedding, "TILE", 64)
    ok = {i: (np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in combinations(ok, 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / math.sqrt(ok[a][0] @ ok[a][0]) / math.sqrt(ok[b][0] @ ok[b][0]) >= 0.98]
    comp, n = components_of([r[0] for r in rows], links), Counter(x for pair in links for x in pair)
    want = {(i, n[i], comp[i], comp[i] == i) for i, _, _ in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1))
    got = {tuple(r) for r in embedding.embedding_components(df).collect()}
    assert got == want
    assert embedding.embedding_components(df.limit(0)).count() == 0


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*texts, (300, "x <|endoftext|> y  z "), (301, "it's 12 é\u00a0x\n\n y")]
    tokenizer = Tokenizer.from_file(path)
    got = packing.best_fit_packing(docs_of(spark, rows), path, with_ids=True).collect()
    for i, t in rows:
        if Counter(x for x, _ in rows)[i] > 1 or i is None:
            continue
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert all(r.length == 1024 for r in mine[1:]) and [r.start for r in mine] == [sum(m.length for m in mine[:k]) for k in range(len(mine))]
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in mine)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 1024) + 2
    assert packing.best_fit_packing(docs_of(spark, []), path).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(1, 1025, 20000) - 1, minlength=1024)
    patterns = packing.plan(h, 1024, 200)
    assert (sum(c * t for c, t in patterns) == h).all()
    assert all((c * np.arange(1, 1025)).sum() <= 1024 for c, _ in patterns)
    assert sum(t for _, t in patterns) <= math.ceil((h * np.arange(1, 1025)).sum() / 1024) * 1.02


def test_lm(spark, texts):
    got = lm.held_out_scores(docs_of(spark, texts)).collect()
    token = lambda t: [*((t or "").encode().translate(LOWER).split()), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in texts if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t)), 6)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert lm.held_out_scores(docs_of(spark, [])).count() == 0


def automaton(rows, held):
    """The backoff automaton by dictionaries: counts of all n-grams, and a step from (state, word) to (probability, state)."""
    token = lambda t: ["START", *(w.decode() for w in (t or "").encode().translate(LOWER).split()), "END"]
    c = Counter(tuple(x[k : k + n]) for i, t in rows if not held(i) for x in [token(t)] for n in (1, 2, 3) for k in range(len(x) - n + 1))
    vocabulary = sorted({g[0] for g in c if len(g) == 1} - {"START"})
    total = sum(c[(w,)] for w in vocabulary)

    def step(state, word):
        failed, weight = state, 1.0
        arcs = []
        while failed:
            if c[failed]:
                arcs.append((c[(*failed, word)], c[failed], lm.BACKOFF[len(failed)]))
            failed = failed[1:]
        p = (c[(word,)] + 0.1) / (total + 0.1 * (len(vocabulary) + 1))
        for n, at, weight in reversed(arcs):
            p = (n + weight * p) / (at + weight)
        return p, (*state, word)[-2:]

    def score(text):
        state, out = ("START",), 0.0
        for w in token(text)[1:]:
            p, state = step(state, w)
            out += math.log10(p)
        return out

    return c, vocabulary, step, score


def test_lm_sums_to_one():
    rng = random.Random(2)
    c, vocabulary, step, _ = automaton([(i, " ".join(words(rng, 30, 12))) for i in range(40)], lambda i: False)
    for state in [g for g in c if len(g) < 3 and g[-1] != "END"][:60]:
        assert abs(sum(step(state, w)[0] for w in [*vocabulary, "never seen"]) - 1) < 1e-9


@pytest.mark.parametrize("block, ranges", [(None, None), (900, 200)])
def test_lm_scores(spark, texts, monkeypatch, block, ranges):
    """Scores are those of a walk over all n-grams, however small the blocks and the ranges of keys are."""
    if ranges:
        monkeypatch.setattr(lm, "RANGE", ranges)
    rng = random.Random(5)
    rows = [*texts, *((1000 + i, " ".join(words(rng, rng.randrange(60), 60))) for i in range(60)), (2000, "never seen here w1 w2 w3"), (2001, "X" * 9000 + " w1 " + "x" * 9000)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    _, _, _, score = automaton(rows, held)
    want = sorted((str(i), round(score(t), 6)) for i, t in rows)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in lm.held_out_scores(docs_of(spark, rows), block).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 2e-5 for g, w in zip(got, want))


def test_word_hashes():
    from pagetrail.llm.tally import word_hashes

    rows = ["Ab c\tab", None, "", "  ", "x" * 10000 + " y " + "x" * 10001, "ab C", "\u00e9 e\x0bf", "ab", "abc", "ba"]
    hashes, counts = word_hashes(pa.chunked_array([pa.array(["q"]), pa.array(rows)]).slice(1))
    parts = [w for t in rows for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in rows]
    assert len(dict(zip(parts, hashes.tolist()))) == len(set(hashes.tolist())) == len(set(zip(parts, hashes.tolist())))


def test_tally(spark):
    from pagetrail.llm import tally

    rng = np.random.default_rng(0)
    blocks = {b: np.unique(rng.integers(0, 1 << 20, 300).astype(np.uint64)) for b in range(5)}
    counts = {b: rng.integers(0, 3, len(k)) for b, k in blocks.items()}
    rows = [r for b, k in blocks.items() for r in tally.ask(b, 1, k, counts[b], 20, 7)]
    got = tally.tally(spark.createDataFrame(rows, tally.ASKED)).toArrow()
    want = Counter()
    for b, k in blocks.items():
        want.update(dict(zip(k.tolist(), counts[b].tolist())))
    for b, k in blocks.items():
        own = got.filter(pa.compute.equal(got.column("block"), b))
        assert tally.totals_of(own, 1).tolist() == [want[x] for x in k.tolist()]
    assert sum(got.column("seen").to_pylist()) == sum(n > 0 for n in want.values())


def test_windows_against_plain_sets(monkeypatch):
    """Packed windows, in one block or with items cut into pieces, against sets of tuples; also where all windows have one hash."""
    rng = random.Random(11)
    items = [(f"i{k}", [w.encode() for w in words(rng, n, 6)]) for k, n in enumerate((0, 1, 2, 3, 3, 4, 9, 60, 60))]
    text = [w.encode() for w in words(rng, 3000, 7)]
    want, holders = np.zeros(len(text), bool), set()
    for item, ws in items:
        n = min(3, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            for at in (a for a in range(len(text) - n + 1) if text[a : a + n] == ws[k : k + n]):
                want[at : at + n] = True
                holders.add(item)
    pieces = [(i, ws[at : at + 5]) for i, ws in items for at in range(0, max(1, len(ws) - 2), 3)]
    for hashed in (decontam.Windows.roll, lambda columns: np.zeros(len(columns[0]), np.uint64)):
        monkeypatch.setattr(decontam.Windows, "roll", staticmethod(hashed))
        for given in (items, pieces):
            hit, found = decontam.Windows(given, 3).scan(text)
            assert (hit == want).all() and found == holders
            assert not decontam.Windows(given, 3).scan([])[0].size
    assert not decontam.Windows([], 3).scan(text)[0].any()


def test_decontamination(spark, texts):
    rng = random.Random(8)
    items = [(f"i{k}", " ".join(words(rng, n, 900))) for k, n in enumerate((5, 13, 14, 40))] + [("n", None), ("e", ""), (None, "w1 w2")]
    rows = [*texts, (400, "x " + items[0][1].upper() + "! y"), (401, " ".join(words(rng, 300)) + " " + items[3][1]), (402, " ".join(words(rng, 2000)) + " " + items[2][1]), (403, items[1][1].replace(" ", "-"))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    norm = lambda t: (t or "").encode().translate(decontam.ALNUM).split()
    win = {}
    for i, t in items:
        w = norm(t)
        if i is not None and w:
            for k in range(max(len(w) - 12, 1)):
                win.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = Counter()
    for i, t in rows:
        w, hit, found = norm(t), set(), set()
        for g, ids in win.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        want[(i, len(w), len(hit), len(found), decontam.items_digest(list(found)), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    for block in (decontam.BLOCK_WORDS, 20):
        got = decontam.contamination(docs_of(spark, rows), bench, block_words=block).drop("spans")
        assert Counter(tuple(r) for r in got.collect()) == want
    clean = Counter({i: n for i, n in Counter(k[0] for k, c in want.items() for _ in range(c) if not k[5]).items()})
    texts_left = []
    for block in (decontam.BLOCK_WORDS, 20):
        kept = decontam.remove(docs_of(spark, rows), bench, block_words=block)
        assert kept.columns == docs_of(spark, []).columns and Counter(r.doc_id for r in kept.collect()) == clean
        cut = {(r.doc_id, r.text) for r in decontam.remove(docs_of(spark, rows), bench, block_words=block, whole=False).collect()}
        texts_left.append(cut)
        assert (400, "x ! y") in cut and (403, "") in cut and (100, None) in cut
    assert texts_left[0] == texts_left[1]
    assert decontam.remove(docs_of(spark, []), bench, block_words=20, whole=False).count() == 0
    assert decontam.contamination(docs_of(spark, []), bench).count() == 0
    assert decontam.contamination(docs_of(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [10**6, 14])
def test_overlapping_items_are_cut_once(spark, block):
    """Windows of two items overlap: in one block or two, nothing of either is left."""
    w = [f"w{k}" for k in range(19)]
    bench = spark.createDataFrame([("a", " ".join(w[:13])), ("b", " ".join(w[6:]))], "item_id string, text string")
    docs = docs_of(spark, [(1, "before " + " ".join(w) + " after"), (2, " ".join(w[:12])), (None, None)])
    got = {r.doc_id: r.text for r in decontam.remove(docs, bench, block_words=block, whole=False).collect()}
    assert got == {1: "before  after", 2: " ".join(w[:12]), None: None}
    assert sorted(str(r.doc_id) for r in decontam.remove(docs, bench, block_words=block).collect()) == ["2", "None"]


def test_licenses(spark):
    rows = [(1, "CC BY-NC 4.0; cc by. All Rights-Reserved"), (2, None), (3, ""), (4, "Released under the MIT License."), (5, "the GNU General Public License, version 3"), (6, "general public"), (7, "éall rights reserved"), (8, "cc by cc by"), (None, "all rights reserved"), (4, "Released under the MIT License."), (9, "w " * 30000 + "cc by")]
    got = {}
    for r in license.license_scan(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    row = lambda i: got[i][0]
    assert (row(1).n_words, row(1).n_base, row(1).first_word, row(1).last_word, row(1).base_labels) == (10, 3, 0, 7, "cc-by,reserved")
    assert row(1).labels == "cc-by,cc-by-nc,reserved" and row(2).n_words == row(3).n_words == 0 and row(2).first_word is None
    assert row(4).labels == "mit" and row(4).score == 1.0 and len(got[4]) == 2
    assert row(5).base_labels == "gpl" and row(5).labels == "gpl,gpl-3"
    assert row(6).n_base == row(7).n_base == 0 and row(8).n_base == 2 and row(None).labels == "reserved" and row(9).first_word == 30000
    assert license.license_scan(docs_of(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 80)
        grade = i % 3
        if grade == 0:
            w[rng.randrange(80)] = "vile"
        if grade == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, int(grade != 1), int(grade == 0)))
    df = spark.createDataFrame([*labels, (None, 1, 1), (399, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, [*rows, (900, None), (901, "")]), df).collect()}
    late = [i for i in range(300, 399)]
    assert sum(got[i].keep == (i % 3 != 0) for i in late) >= 0.95 * len(late)
    assert all(0 <= r.p_good <= r.p_acceptable <= 1 and abs(r.p_good + r.p_acceptable - r.expected_grade) < 1e-9 for r in got.values())
    assert quality.quality(docs_of(spark, rows[:3]), df.limit(0)).where("NOT keep").count() == 0


def test_language_id(spark):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "and", "tion"], "de": ["der", "sch", "ung", "ein"], "fr": ["é", "eau", "le", "que"]}
    rows, langs = [], {}
    for i in range(150):
        lang = list(parts)[i % 3]
        langs[i] = lang if i % 7 else None
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30))))
    df = docs_of(spark, [*rows, (500, None), (501, ""), (502, "123 !!"), (None, "the and tion ing")], langs)
    got = {r.doc_id: r for r in langid.held_out_language_id(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(150))
    assert sum(got[i].lang_pred == list(parts)[i % 3] for i in range(150)) >= 145
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.held_out_language_id(df.limit(0)).count() == 0


def test_components(spark):
    from pagetrail.llm.components import components

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, 5000 + k) for k in range(1, 200)] + [(None, 1), (7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components_of({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

"""The substring join, ordered groups, stored tables, suffix rules and joins of pages with many subjects, against plain versions."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.functions import urls as U
from pagetrail.operators import extract, ordered, resolve, substrings
from pagetrail.plans.scan import scan
from pagetrail.schema import SUBJECTS
from pagetrail.session import shared_dir
from pagetrail.sources import tables
from pagetrail.sources.stored import Conflict, Stored

PAGES = "scan_id string, url string, html string, content_type string, from_search boolean"


def plain_snippet(text, needle, width=80):
    at = text.lower().find(needle)
    start, end = max(at - width, 0), min(at + len(needle) + width, len(text))
    return ("…" if start else "") + text[start:end].strip(" ") + ("…" if end < len(text) else "")


def test_holding(spark, monkeypatch):
    """Random texts over few letters hold many needles; every width, overlapping places, text borders and salted keys occur."""
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abcéß ") for _ in range(n))
    texts = [(str(i), word(pick.choice((0, 2, 5, 40, 300)))) for i in range(150)] + [("long", word(5000) + " Straße der Nadel " + word(5000)), ("null", None), ("end", "xx needle-at-end"), ("up", "ÉÉÉ NEEDLE-AT-END")]
    needles = {word(pick.choice((3, 4, 5, 7, 8, 9, 14))).lower() for _ in range(300)} | {"straße der nadel", "needle-at-end", "nee", "ab", "ééé"}
    want = {(k, n, t.lower().find(n), plain_snippet(t, n)) for k, t in texts if t for n in needles if len(n) >= 3 and n in t.lower()}
    monkeypatch.setattr(substrings, "HOT", 20)
    monkeypatch.setattr(substrings, "PIECE", 700)
    got = substrings.holding(spark.createDataFrame(texts, "source_id string, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "needle string")
    assert substrings.holding(spark.createDataFrame(texts, "source_id string, text string"), none).count() == 0
    assert substrings.holding(spark.createDataFrame([], "source_id string, text string"), none.union(spark.createDataFrame([("abc",)], "needle string"))).count() == 0


def test_anchors_are_rare(spark):
    """A needle's anchor avoids what all texts and needles share, so few places are looked at."""
    texts = spark.createDataFrame([(str(i), f"write to person{i}@mail.example.com now") for i in range(400)], "source_id string, text string")
    needles = spark.createDataFrame([(f"person{i}@mail.example.com",) for i in range(0, 400, 4)], "needle string")
    own = substrings._frequencies(needles, "needle")
    found = substrings.anchors(needles, substrings._frequencies(texts, "text"), own).collect()
    assert len({r["key"] for r in found}) > 90
    assert substrings.holding(texts, needles).count() == 100


@pytest.mark.parametrize("parts", [1, 7])
def test_before_and_first_rows(spark, parts):
    pick = random.Random(parts)
    rows = [(pick.choice(("hot", "hot", "hot", "a", "b", None)), pick.randrange(40), f"u{i}", pick.choice((None, 1, 5, 100))) for i in range(400)]
    df = spark.createDataFrame(rows, "scan_id string, position int, url string, n_bytes long").repartition(5)
    want = set()
    for g in {r[0] for r in rows}:
        n = total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want.add((*r, n, total))
            n, total = n + 1, total + (r[3] or 0)
    got = ordered.before(df, "scan_id", ["position", "url"], "n_bytes", parts)
    assert {tuple(r) for r in got.collect()} == want and got.count() == 400
    firsts = {tuple(r) for r in ordered.first_rows(df, "scan_id", ["position", "url"], 9, salts=4).collect()}
    assert firsts == {w[:4] for w in want if w[4] < 9}
    assert ordered.before(df.limit(0), "scan_id", ["position"], "n_bytes").count() == 0


def test_no_window_over_a_scan(spark, capsys):
    df = spark.range(100).selectExpr("'s' AS scan_id", "id AS position", "cast(id AS string) AS url", "id AS n_bytes")
    tables.within_budget(df).explain("formatted")
    assert "Window" not in capsys.readouterr().out


def _digests(folder):
    at = folder.removeprefix("file://")
    return {f"{d}/{n}": hashlib.sha256(open(f"{d}/{n}", "rb").read()).hexdigest() for d, _, names in os.walk(f"{at}/data") for n in names if n.endswith(".parquet")}


def test_stored_table(spark):
    path = f"{shared_dir(spark)}/stored"
    schema = spark.createDataFrame([], "k string, state string, v long").schema
    store = Stored(spark, path, ["k"], schema, buckets=8)
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([(f"k{i}", "NEW", i) for i in range(100)] + [("k1", "OLD", -1)], schema), "v")
    before = _digests(path)
    old = store.version()
    store.upsert(spark.createDataFrame([("k1", "LATER", 500), ("k2", "EARLIER", -5), ("x", "NEW", 0)], schema), "v")
    rows = {r.k: (r.state, r.v) for r in store.read().collect()}
    assert len(rows) == 101 and rows["k1"] == ("LATER", 500) and rows["k2"] == ("NEW", 2) and rows["x"] == ("NEW", 0)
    after, new = _digests(path), store.version()
    assert all(after[f] == h for f, h in before.items())  # nothing that was written changes
    touched = {b for b in new["folders"] if new["folders"][b] != old["folders"].get(b)}
    assert 0 < len(touched) <= 3
    # an update sets columns of rows that are there, and one under the same name counts once
    for _ in range(2):
        store.update(spark.createDataFrame([("k3", "DONE"), ("absent", "DONE"), ("k4", None)], "k string, state string"), ["state"], change="c1")
    assert store.version()["number"] == 3
    rows = {r.k: (r.state, r.v) for r in store.read().collect()}
    assert rows["k3"] == ("DONE", 3) and rows["k4"] == (None, 4) and "absent" not in rows
    store.replace(spark.createDataFrame([("k5",), ("none",)], "k string"), spark.createDataFrame([("k6", "A", 1), ("k6", "B", 2)], schema))
    got = sorted(tuple(r) for r in store.read().where("k IN ('k5', 'k6')").collect())
    assert got == [("k6", "A", 1), ("k6", "B", 2)]
    with pytest.raises(Conflict):  # somebody else published the next version meanwhile
        store._publish({}, store.version()["number"], None)
    count, files = store.read().count(), _digests(path)
    store.vacuum()
    assert store.read().count() == count and len(_digests(path)) == len(store.version()["folders"]) < len(files)


def test_suffix_rules(spark):
    hosts = {"a.b.example.co.uk": "example.co.uk", "www.ck": "www.ck", "x.www.ck": "www.ck", "b.a.foo.ck": "a.foo.ck", "foo.ck": "foo.ck", "ck": "ck", "a.city.kawasaki.jp": "city.kawasaki.jp", "y.x.kawasaki.jp": "y.x.kawasaki.jp", "z.y.x.kawasaki.jp": "y.x.kawasaki.jp", "localhost": "localhost", "1.2.3.4": "1.2.3.4", "com": "com", "u.github.io": "u.github.io", "v.u.github.io": "u.github.io", "": ""}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.d for r in df.select("h", U.registrable(F.col("h")).alias("d")).collect()} == hosts
    path = f"{shared_dir(spark)}/rules.txt"
    spark.createDataFrame([("// a comment",), ("",), ("com",), ("*.ck  // all of them",), ("!WWW.ck",)], "value string").coalesce(1).write.text(path)
    assert U.read_suffix_rules(spark, path) == ("!www.ck", "*.ck", "com")


def people(spark, rows):
    names = "subject_id", "names", "locations", "employers", "usernames", "emails", "phones", "personal_domains"
    full = [dict.fromkeys(names) | r for r in rows]
    return tables.clean_subjects(spark.createDataFrame([(r["subject_id"], [(n, True) for n in r["names"] or []], r["locations"] or [], [(e, None, True) for e in r["employers"] or []], r["usernames"] or [], r["emails"] or [], r["phones"] or [], r["personal_domains"] or [], None) for r in full], SUBJECTS))


def test_places_make_no_product(spark):
    """Rows of pages that name a country don't grow with those who live there; only pairs with a name meet it."""
    pages = spark.createDataFrame([("x", f"https://h.example.com/{i}", f"All about Germany and Acme Works. Person Number{i} was here." if i < 5 else "Germany, Acme Works", "text/plain", False) for i in range(60)], PAGES)
    found = []
    for n in (10, 200):
        subjects = people(spark, [{"subject_id": f"s{i}", "names": [f"Person Number{i}"], "locations": [("Bonn", "Germany")], "employers": ["Acme Works"]} for i in range(n)])
        s = scan(pages, subjects)
        found.append(s.observations.where("type IN ('LOCATION', 'EMPLOYER')").count())
        m = {r.subject_id: (r.state, r.n) for r in s.matches.select("subject_id", "state", F.size("supporting").alias("n")).collect()}
        assert m == {f"s{i}": ("HIGH_CONFIDENCE", 3) for i in range(5)}
        places = s.findings.where("category = 'PERSONAL_LOCATION'").select("subject_id").collect()
        assert sorted(r[0] for r in places) == [f"s{i}" for i in range(5)]
    assert found == [120, 120]


def test_own_places_alone_are_found(spark):
    """A place in the text goes to the subject that lives there, not to another one that the page names."""
    subjects = people(spark, [{"subject_id": "a", "names": ["Ada Byron"], "locations": [("Paris", None)]}, {"subject_id": "b", "names": ["Bob Stone"], "locations": [("Rome", None)]}])
    s = scan(spark.createDataFrame([("x", "https://h.example.com/1", "Ada Byron and Bob Stone met in Paris", "text/plain", False)], PAGES), subjects)
    assert {(r.subject_id, r.category) for r in s.findings.collect()} == {("a", "PERSONAL_LOCATION")}
    assert {r.subject_id: r.state for r in s.matches.collect()} == {"a": "POSSIBLE", "b": "POSSIBLE"}


@pytest.mark.parametrize("common", [64, 2])
def test_name_matches(spark, common):
    pick = random.Random(1)
    first, last = [f"f{i}" for i in range(4)] + ["john"] * 3, [f"l{i}" for i in range(6)]
    names = [(str(i), f"{pick.choice(first)} x {pick.choice(last)}") for i in range(40)]
    seen = [(str(i), None if i % 5 else "7", "NAME" if i % 2 else "PAGE_TITLE", " ".join(pick.choice(first + last) for _ in range(pick.randint(1, 5)))) for i in range(80)]
    obs = spark.createDataFrame(seen, "source_id string, subject_id string, type string, display_value string")
    terms = extract.subject_terms(people(spark, [{"subject_id": i, "names": [n]} for i, n in names]))
    want = {}
    for s, own, kind, shown in seen:
        t = shown.split()
        for i, n in names:
            if len(t) >= 2 and n.split()[0] in t and n.split()[-1] in t and own in (None, i):
                want[s, i] = want.get((s, i), False) or kind == "PAGE_TITLE"
    got = {(r.source_id, r.subject_id): r.in_title for r in resolve.name_matches(obs, terms, common).collect()}
    assert got == want and got


def test_snippets_equal_those_of_the_column(spark):
    rows = [("1", "x" * 200 + " The Needle here " + "y" * 200, "needle"), ("2", " the needle", "needle")]
    df = spark.createDataFrame(rows, "source_id string, text string, needle string")
    want = {r.source_id: r.s for r in df.select("source_id", T.snippet(F.col("text"), F.col("needle")).alias("s")).collect()}
    assert {r.source_id: r.snippet for r in substrings.holding(df.select("source_id", "text"), df.select("needle").distinct()).collect()} == want


def test_table_function_columns_are_checked(spark):
    @F.udtf(returnType="type string, value string, place int")
    class Wrong:
        def eval(self, text: str):
            yield "X", "y", 1

    parsed = spark.createDataFrame([("p", (None, "Ada lives in Cork. Bob is based in New Ross Town Hall.", {}, [], []))], "source_id string, parsed struct<title:string,text:string,meta:map<string,string>,jsonld:array<string>,links:array<string>>")
    with pytest.raises(ValueError, match="place"):
        extract.by_table_function(Wrong, "wrong")(parsed)
    rows = extract.residences(parsed).collect()
    assert {(r.type, r.value, r.display, r.pos) for r in rows} == {("LOCATION", "cork", "Cork", 4), ("LOCATION", "new ross town", "New Ross Town", 26)}


def test_bodies_reach_the_scan(spark):
    """Pages as bytes: UTF-8, Latin-1 where they aren't, and a PDF, whose bytes are no text."""
    rows = [("https://a.example.com/1", "Zoë Größe".encode(), "text/plain"), ("https://a.example.com/2", "Zoë Größe".encode("latin-1"), "text/plain"), ("https://a.example.com/3", b"%PDF Zo\xc3\xab Gr\xc3\xb6\xc3\x9fe", "application/pdf")]
    pages = spark.createDataFrame([("x", u, b, c, False) for u, b, c in rows], "scan_id string, url string, body binary, content_type string, from_search boolean")
    s = scan(pages, people(spark, [{"subject_id": "z", "names": ["Zoë Größe"]}]))
    found = s.matches.join(s.sources.select("source_id", "url"), "source_id").select("url").collect()
    assert sorted(r[0] for r in found) == ["https://a.example.com/1", "https://a.example.com/2"]


def test_reports_are_packed_and_found(spark):
    from pagetrail.operators import report

    path = f"{shared_dir(spark)}/reports"
    rows = spark.createDataFrame([(f"s{i:04d}", '{"n":%d}' % i) for i in range(500)] + [("none", None), (None, "{}")], "subject_id string, report string")
    index = report.write_reports(rows, path, file_bytes=1000)
    assert index.agg(F.sum("n")).first()[0] == 500 and index.count() >= 4
    bounds = sorted((r["first"], r["last"]) for r in index.collect())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert {(r.subject_id, r.report) for r in report.read_reports(spark, path, ["s0003", "s0499", "zzz"]).collect()} == {("s0003", '{"n":3}'), ("s0499", '{"n":499}')}
    assert report.read_reports(spark, path, ["a"]).count() == 0

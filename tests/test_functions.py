import datetime

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import html as H
from pagetrail.functions import sql
from pagetrail.functions import text as T
from pagetrail.functions import urls as U


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)] if not rows or not isinstance(rows[0].x, list) else [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_canonical_url(spark):
    cases = {
        "HTTP://Shop.Test:80/Cart/?utm_campaign=a&Item=7&gclid=9#top": "http://shop.test/Cart?Item=7",
        "https://shop.test:443": "https://shop.test/",
        "https://shop.test/?": "https://shop.test/",
        "http://shop.test:8443/a//b/": "http://shop.test:8443/a//b",
        "https://me:secret@Shop.test/x?b=2&a=1": "https://shop.test/x?b=2&a=1",
        "https://shop.test:port/": None,
    }
    assert run(spark, list(cases), U.canonical_url) == list(cases.values())


def test_registrable_domain(spark):
    df = spark.createDataFrame([("http://forum.garden.org.uk:8080/t/1",), ("a.b.c.museum-of-things.de",), ("intranet",), (None,)], "url string")
    got = {r.url: r.registrable_domain for r in U.with_registrable_domain(df, "url").collect()}
    assert got == {"http://forum.garden.org.uk:8080/t/1": "garden.org.uk", "a.b.c.museum-of-things.de": "museum-of-things.de", "intranet": "intranet", None: ""}


def test_masks(spark):
    masked = run(spark, ["q@z.test", "longer@mail.z.test", "none here", None], T.mask_email)
    assert masked[0].startswith("q") and masked[0].endswith("@z.test") and masked[1].startswith("l") and "onger" not in masked[1] and "none" not in masked[2]
    assert [m.endswith(d) and m.count("•") >= 3 for m, d in zip(run(spark, ["0123 456 789", "+1-555-0100-77"], T.mask_phone), ("89", "77"))] == [True, True]
    assert run(spark, ["write to q@z.test, ring +1 555 0100 77 2", None], T.redact) == ["write to [email], ring [phone]", ""]


@pytest.mark.parametrize("text,hits", [("Call +44 20 7946 0958 now", ["+442079460958"]), ("Telephone: 020 7946 0958", ["02079460958"]), ("on 2026-08-05 tel", []), ("phone 1702-1744", []), ("ISBN 978-3-16-148410-0", []), ("Intelligence 0207946095", [])])
def test_phones(spark, text, hits):
    from pagetrail.operators.extract import phone_hits

    assert [h.value for h in run(spark, [text], phone_hits)[0]] == hits


def test_found_equals_finditer(spark):
    import re

    texts = ["a@b.com x  cc@d.org", "", "no", "é a@b.co a@b.co", "x@y.zz"]
    got = run(spark, texts, lambda c: T.found(c, T.EMAIL))
    assert [[(h.hit, h.start, h.before) for h in hits] for hits in got] == [[(m[0], m.start(), t[max(0, m.start() - 40) : m.start()]) for m in re.finditer(T.EMAIL, t)] for t in texts]


def test_names(spark):
    names = F.array(F.lit("Jane Doe"), F.lit("Cher"))
    assert run(spark, ["Doe, Jane Q.", "Jane", "John Doe", "Cher Doe", None], lambda c: T.name_match(c, names)) == [True, False, False, False, False]
    assert run(spark, ["020 7946 0958", "12345", "+44 20 7946 0958"], lambda c: T.phone_match(c, F.array(F.lit("+442079460958")))) == [True, False, True]
    assert run(spark, ["Jane Doe - Home", "Jane Doe", "About Us", "Jane D0e", "A B C D E", None], T.page_topic_name) == ["Jane Doe", "Jane Doe", None, None, None, None]


def test_social(spark):
    got = run(spark, ["https://www.linkedin.com/in/maya-q", "https://x.com/@tarn", "https://t.me/lantern", "https://youtube.com/watch", "https://foo.com/x"], U.parse_social)
    assert [x and (x.platform, x.username) for x in got] == [("LinkedIn", "maya-q"), ("Twitter/X", "tarn"), ("Telegram", "lantern"), ("YouTube", None), None]


def test_url_policy(spark):
    urls = ["http://10.1.2.3/", "http://localhost/", "ftp://x", "foo", "https://8.8.8.8/", "", "http://[::1]/", "http:///x", "http://169.254.169.254/", "http://[fe80::1]/", "http://[2606:4700::1111]/x", "http://[2001:db8::1]/", "http://[2002:0a00:0001::]/", "http://[2002:0808:0808::1]/", "http://[::ffff:10.0.0.1]/"]
    want = ["blocked_ip_literal", "blocked_hostname", "rejected_scheme:ftp", "unsupported_scheme:none", "ok", "empty_url", "blocked_ip_literal", "missing_host", "blocked_hostname", "blocked_ip_literal", "ok", "blocked_ip_literal", "blocked_ip_literal", "ok", "blocked_ip_literal"]
    assert run(spark, urls, U.url_policy) == want


def test_links(spark):
    base = "http://wiki.test/docs/guide/page?x=1"
    links = {"next": "http://wiki.test/docs/guide/next", "../img/a.png": "http://wiki.test/docs/img/a.png", "/top": "http://wiki.test/top", "?y=2": "http://wiki.test/docs/guide/page?y=2", "//cdn.test/z": "http://cdn.test/z", "https://other.test/": "https://other.test/"}
    assert run(spark, list(links), lambda h: U.resolve_link(F.lit(base), h)) == list(links.values())


def test_html(spark):
    page = '<html><head><title>T &amp; x</title><meta property="og:title" content="OG"><meta name=a content=b><script type="application/ld+json">{"@graph":[{"@type":"Person","name":"Jane"},3]}</script><script type="application/ld+json">{bad</script></head><body><p>Hi <b>there</b></p><script>var x="</p>";</script><noscript>no</noscript><a href="/x?a=1&amp;b=2">l</a></body></html>'
    got = run(spark, [page], H.parse_html)[0]
    assert (got.title, got.text, got.meta, got.links, len(got.jsonld)) == ("T & x", "Hi\nthere\nl", {"og:title": "OG", "a": "b"}, ["/x?a=1&b=2"], 1)
    assert run(spark, ["<p>broken <b>x", ""], H.visible_text) == ["broken\nx", ""]


def test_severity(spark):
    assert run(spark, ["NONE", "HIGH", "CRITICAL", "other"], lambda c: T.severity_bump(c, 1)) == ["LOW", "CRITICAL", "CRITICAL", None]
    assert spark.range(1).select(T.severity_max(F.lit("HIGH"), F.lit("MODERATE"))).first()[0] == "HIGH"


def test_sql_functions(spark):
    assert "mask_email" in sql.register_functions(spark)
    got = spark.sql("SELECT mask_email('jane@x.com'), mask_phone('+44 20 7946'), redact('a@b.com'), name_match('Jane Q Doe', array('Jane Doe')), severity_bump('HIGH', 3), is_actionable('POSSIBLE')").first()
    assert tuple(got) == ("j•••@x.com", "+••••••46", "[email]", True, "CRITICAL", False)


def test_expiry(spark):
    d = datetime.date(2026, 1, 1)
    assert spark.range(1).select(T.registry_expired(F.lit(d), F.lit(10), F.lit(datetime.date(2026, 1, 12)))).first()[0]

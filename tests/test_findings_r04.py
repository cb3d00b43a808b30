from pyspark.sql import functions as F

from pagetrail.operators import extract
from pagetrail.plans.scan import scan


def test_names_of_one_token_are_not_sought_for_matches(spark, monkeypatch):
    """F1, F2, F8: a name of one token stands in pages of all kinds and points to nobody: no scan writes a row for each of them, but the observations, asked for, have them all."""
    sought = []
    real = extract.holding
    monkeypatch.setattr(extract, "holding", lambda texts, needles: (sought.append({r.needle for r in needles.collect()}), real(texts, needles))[1])
    pages = spark.createDataFrame([(f"http://a.example/{i}", f"a moment {i}, ada quill's", "text/plain", True, "s") for i in range(20)] + [("http://a.example/m", "mail ent23@x.example.com", "text/plain", True, "s")], "url string, html string, content_type string, from_search boolean, scan_id string")
    subjects = spark.createDataFrame([("e", [("Ment ", True), ("Ada Quill", False), ("Ent", False)], ["ent23"], ["ent23@x.example.com"])], "subject_id string, names array<struct<value:string,is_primary:boolean>>, usernames array<string>, emails array<string>")
    none = {"locations": "array<struct<city:string,country:string>>", "employers": "array<struct<name:string,domain:string,is_current:boolean>>", "phones": "array<string>", "personal_domains": "array<string>"}
    s = scan(pages, subjects.withColumns({c: F.array().cast(t) for c, t in none.items()}))
    assert s.matches.groupBy("state").count().count() == 2 and s.matches.count() == 21
    assert sorted(r.category for r in s.findings.collect()) == ["CONTACT_EMAIL", "USERNAME"]
    assert sought == [{"ada quill", "ent23"}]
    names = s.observations.where("type = 'NAME'").groupBy("value_normalized").count().collect()
    assert {tuple(r) for r in names} == {("ada quill", 20), ("ent", 21), ("ment ", 20)} and sought[1] == {"ment ", "ent"}
    assert s.observations is s.observations and s.observations.where("type <> 'NAME'").count() == s.telling.where("type <> 'NAME'").count()

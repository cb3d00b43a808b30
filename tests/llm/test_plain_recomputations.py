"""Language ID and quality scores recomputed plainly from the fitted weights, and cases that their docstrings name."""

import numpy as np

from pagetrail.llm import langid, quality


def docs_and_labels(spark):
    good, bad = "a clear and careful account of rivers and lakes number {}", "you stupid hateful fool number {} shut up idiot"
    rows = [(i, (good if i % 2 else bad).format(i), "en") for i in range(80)] + [(80 + i, f"der kleine hund läuft über die straße nummer {i} und bellt", "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", "en"), (None, "the careful account of lakes", "en"), (1, rows[1][1], "en"), (502, "12 34", None)]
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, lang string, score double, keep string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(80)] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality_recomputed(spark):
    rows, docs, labels = docs_and_labels(spark)
    model = quality.fit(docs.select("doc_id", "text"), quality.graded(labels), 3)
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        tails = model.tails(quality.hashed((texts[r.doc_id] or "").encode()))
        assert abs(r.p_acceptable - tails[0]) < 1e-9 and abs(r.p_good - tails[1]) < 1e-9 and abs(r.expected_grade - sum(tails)) < 1e-9
        assert tails[0] >= tails[1] and r.keep == (tails[0] >= quality.KEEP)
    same = [r for r in got if r.doc_id in (500, 501)]
    assert same[0].expected_grade == same[1].expected_grade
    assert quality.quality(docs.limit(0), labels).count() == 0
    none = quality.quality(docs, labels.limit(0)).collect()
    assert all(r.expected_grade is None and r.keep for r in none) and len(none) == len(rows)


def test_language_id_recomputed(spark):
    rows, docs, _ = docs_and_labels(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "keep", "lang_pred", "score"]
    for r in got.collect():
        lang, score = model.predict(r.text)
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9))
        if r.text and any(c.isalpha() for c in r.text):
            assert 0 < r.score <= 1 and r.lang_pred in ("en", "de")
        else:
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0.0)
    held = langid.held_out_language_id(docs).collect()
    assert len(held) == len(rows)
    assert np.mean([r.lang_pred == "de" for r in held if r.doc_id is not None and 80 <= r.doc_id < 120]) > 0.9
    assert langid.held_out_language_id(docs.limit(0)).count() == 0

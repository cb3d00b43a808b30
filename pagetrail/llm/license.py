"""License scans by a positional rare-token index: highest-IDF licence words, template postings intersected by relative position, key phrases verified. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates: (label, a licence's typical wording, its mandatory key phrase), in normalised words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
)
#: A phrase is indexed under so many of its words of the highest IDF.
ANCHORS = 2


def plain(text: Column) -> Column:
    """A-Z to a-z; ASCII bytes that are no letter or digit to spaces, one for each run."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_of(norm: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of docs(text) each word of the vocabulary occurs; at most as many numbers as the vocabulary has words."""
    each = docs.select(F.explode(F.array_intersect(words_of(plain(F.col("text"))), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return {r["w"]: r["n"] for r in each.groupBy("w").agg(F.count("*").alias("n")).collect()}


def positional_index(phrases: list[list[str]], df: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """word -> postings (phrase, place of the word in it, rank): each phrase stands under its ANCHORS words of the highest IDF, rank 0 the highest; a phrase of one word has it in every rank."""
    index: dict[str, list[tuple[int, int, int]]] = {}
    for k, phrase in enumerate(phrases):
        rare = sorted(range(len(phrase)), key=lambda at: (df.get(phrase[at], 0), -len(phrase[at]), at))[:ANCHORS]
        for rank in range(ANCHORS):
            at = rare[min(rank, len(rare) - 1)]
            index.setdefault(phrase[at], []).append((k, at, rank))
    return index


def _lists(values: list[list[str]]) -> Column:
    return F.array(*(F.array(*map(F.lit, v)) for v in values))


def look_up(words: Column, index: dict[str, list[tuple[int, int, int]]]) -> Column:
    """array<struct<k, at, rank>>: for each word that the index has, its postings, at being where their phrase would start. One look-up a word, however many phrases there are."""
    of = F.create_map(*(x for w, found in index.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"), F.lit(rank).alias("rank")) for k, at, rank in found)))))

    def postings(w: Column, i: Column) -> Column:
        return F.when(w.isin(*index), F.transform(of[w], lambda p: F.struct(p["k"].alias("k"), (i - p["at"]).alias("at"), p["rank"].alias("rank"))))

    return F.flatten(F.array_compact(F.transform(words, postings)))


def places(posted: Column, words: Column, phrases: list[list[str]]) -> Column:
    """array<struct<k, at>>: where phrases stand. The postings of all ranks are intersected by phrase and start, then the whole phrase is verified."""
    found = None
    for rank in range(ANCHORS):
        here = F.transform(F.filter(posted, lambda p: (p["rank"] == rank) & (p["at"] >= 0)), lambda p: F.struct(p["k"].alias("k"), p["at"].alias("at")))  # noqa: B023
        found = here if found is None else F.array_intersect(found, here)
    whole = _lists(phrases)
    return F.filter(found, lambda x: F.slice(words, x["at"] + 1, F.size(whole[x["k"]])) == whole[x["k"]])


def _share(wordings: Column, shifts: Column, words: str):
    """The share of a wording's words that stand in the text around a place of its key phrase."""

    def share(x: Column) -> Column:
        wording, start = wordings[x["k"]], x["at"] - shifts[x["k"]]
        same = F.transform(wording, lambda v, j: F.when((start + j >= 0) & (F.get(words, start + j) == v), 1.0).otherwise(0.0))
        return F.aggregate(same, F.lit(0.0), lambda total, v: total + v) / F.size(wording)

    return share


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per input row.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest start (null if
    none). labels adds those of the templates whose key phrase stands in the text; score is the largest share of such a
    template's wording, or half of 1 for a phrase alone, 0 without either. Null text is empty; repeated rows each stay;
    extra columns are ignored. Frequencies are counted over all rows; nothing is joined or shuffled but those counts.
    """
    docs = docs.select("doc_id", "text")
    keys = [p.split() for p, _ in phrases] + [key.split() for _, _, key in templates]
    labels = [label for _, label in phrases] + [label for label, _, _ in templates]
    wordings = [p.split() for p, _ in phrases] + [wording.split() for _, wording, _ in templates]
    shifts = [max(at for at in range(len(w)) if w[at : at + len(k)] == k) for w, k in zip(wordings, keys)]
    df = document_frequencies(docs, sorted({w for k in keys for w in k}))
    # the arrays are made once per row: what follows reads them by name
    rows = docs.select("doc_id", words_of(plain(F.col("text"))).alias("w"))
    posted = rows.select("doc_id", "w", look_up(F.col("w"), positional_index(keys, df)).alias("posted"))
    found = posted.select("doc_id", "w", places(F.col("posted"), F.col("w"), keys).alias("found"))
    of_base = lambda x: x["k"] < len(phrases)
    share = _share(_lists(wordings), F.array(*map(F.lit, shifts)), "w")
    split = found.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), "found", F.transform(F.filter("found", of_base), lambda x: x["at"]).alias("base"),
        F.array_max(F.transform(F.filter("found", lambda x: ~of_base(x)), share)).alias("share"),
    )

    def named(items: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda x: F.array(*map(F.lit, labels))[x["k"]]))), ",")

    score = F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce("share", F.lit(0.0)))
    return split.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"),
        named(F.filter("found", of_base)).alias("base_labels"), named(F.col("found")).alias("labels"), score.alias("score"),
    )

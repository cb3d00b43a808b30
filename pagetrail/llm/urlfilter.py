"""URL filters from a path-template tree: variable segments become wildcards, similar branches merge, impure templates are rejected. DataFrame functions only."""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import discard, durable, if_few

#: Rules of the query: (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A segment is a branch of its own with at least so many urls; the others are one wildcard.
SUPPORT = 3
#: Branches whose profile differs from their siblings' by less than so many standard errors merge.
SIGMAS = 3.0
#: Branches unlike their node are compared with those whose profile falls in the same cell: shares on the arcsine scale, in so many steps from 0 to 1.
STEPS = 4
PRIOR = 2.0
EVIDENCE = 5
REJECT = 0.8


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and its verdict. A rule is for its host and all subdomains, and paths that start with its own."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _kind(segment: Column) -> Column:
    """What a segment looks like: end, number, word, or mixed."""
    return F.when(segment.isNull(), "end").when(segment.rlike(r"^[0-9]+$"), "number").when(segment.rlike(r"^[^0-9]+$"), "word").otherwise("mixed")


def _unlike(measures: tuple[str, ...], whole: str) -> Column:
    """Whether a share of the branch's n urls lies more than SIGMAS standard errors from that of the whole it is part of (columns whole, whole_<measure>)."""
    odd = F.lit(False)
    for k in measures:
        p, q = F.col(k) / F.col("n"), F.col(f"{whole}_{k}") / F.col(whole)
        error = F.sqrt(F.greatest(q * (1 - q), F.lit(0.0)) / F.col("n") + F.lit(1e-9))
        odd = odd | (F.abs(p - q) > SIGMAS * error)
    return odd


def _step(share: Column) -> Column:
    """The share's step on the arcsine scale, where its error depends on the number of urls alone."""
    return F.round(F.asin(F.sqrt(share)) * (2 * STEPS / math.pi)).cast("int").cast("string")


def templates(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """urls(host, path, bad boolean or null) to (paths, templates).

    paths(host, path, template): each distinct url's template. templates(host, template, n, n_bad, n_good).
    Level by level, below every node (host, template so far): segments of SUPPORT urls or more are branches, the rest one
    wildcard
    "*"; then the branches whose shares of bad and of good urls, and of next segments of each kind, lie within SIGMAS standard
    errors of their node's merge as "~"; of the others, those within SIGMAS standard errors of the mean of their cell
    of like profiles (_step) merge as "~" and the cell, so groups of branches that differ from each other are found
    too; one alone in its cell stays itself. Every step is an aggregate with partial sums, and a join of the paths
    with the node's branches. A level reads only paths that have a segment there and whose node has SUPPORT urls; below
    other nodes no segment can be a branch, so all that follow are wildcards at once, and few deep paths cost no levels.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    paths = durable(paths.withColumn("segments", segments).withColumn("template", F.lit("")))
    done, d = [], 0
    while True:
        # the sums are broadcast if they are few by count, so that paths of a hot node stay where they are
        sums = durable(paths.groupBy("host", "template").agg(F.sum("n").alias("_all")))
        reached = paths.join(if_few(sums), ["host", "template"])
        thin, short = F.col("_all") < SUPPORT, F.size("segments") <= d
        rest = F.greatest(F.size("segments") - d, F.lit(0))
        ended = F.when(thin, F.concat("template", F.repeat(F.lit("/*"), rest))).otherwise(F.col("template"))
        over = durable(reached.where(thin | short).withColumn("template", ended).select(*paths.columns))
        here = durable(reached.where(~thin & ~short).select(*paths.columns))
        done.append(over)
        discard(paths, sums)
        if not here.limit(1).count():
            break
        segment, after = F.try_element_at("segments", F.lit(d + 1)), F.try_element_at("segments", F.lit(d + 2))
        of_kind = [F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(k) for k in ("end", "number", "word", "mixed")]
        branches = durable(here.withColumn("s", segment).withColumn("next", _kind(after)).groupBy("host", "template", "s").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"), *of_kind))
        measures = ("n_bad", "n_good", "end", "number", "word", "mixed")
        nodes = branches.groupBy("host", "template").agg(F.sum("n").alias("all"), *(F.sum(k).alias(f"all_{k}") for k in measures))
        frequent = branches.where(F.col("n") >= SUPPORT).join(nodes, ["host", "template"])
        tested = durable(frequent.select("host", "template", "s", "n", *measures, _unlike(measures, "all").alias("odd")))
        # of those unlike their node, the ones like each other merge too: cell by cell, tested against the cell's mean
        odd = tested.where("odd").withColumn("cell", F.concat(*(_step(F.col(k) / F.col("n")) for k in measures)))
        cells = odd.groupBy("host", "template", "cell").agg(F.sum("n").alias("in_cell"), F.count("*").alias("branches"), *(F.sum(k).alias(f"in_cell_{k}") for k in measures))
        apart = odd.join(cells, ["host", "template", "cell"])
        alone = _unlike(measures, "in_cell") | (F.col("branches") == 1)
        labels = apart.select("host", "template", "s", F.when(alone, F.col("s")).otherwise(F.concat(F.lit("~"), "cell")).alias("label"))
        kept = durable(tested.where("NOT odd").select("host", "template", "s", F.lit("~").alias("label")).unionByName(labels))
        joined = here.withColumn("s", segment).join(if_few(kept), ["host", "template", "s"], "left")
        paths = durable(joined.select("host", "path", "n", "n_bad", "n_good", "segments", F.concat("template", F.lit("/"), F.coalesce("label", F.lit("*"))).alias("template")))
        discard(here, branches, tested, kept)
        d += 1
    every = reduce(DataFrame.unionByName, done)
    return every.select("host", "path", "template"), every.groupBy("host", "template").agg(*(F.sum(k).alias(k) for k in ("n", "n_bad", "n_good")))


def url_filter(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, reject: float = REJECT) -> DataFrame:
    """pages(page_id, url) to page_id, host, path, rule, verdict, template, purity, one row per input row.

    The rule's verdict stands where one fits. For the rest, a template is rejected if its smoothed share of bad urls
    among the labelled is at least `reject` on EVIDENCE labelled urls or more. Shares are smoothed twice: a second tree
    is built over the paths of all hosts together, whose templates' shares are (bad + PRIOR * base) / (bad + good +
    PRIOR), base being that of all labelled urls; and a host's template starts from the share of its path's template
    there, (bad + PRIOR * pooled) / (bad + good + PRIOR), so hosts without labels are judged by what like paths are
    elsewhere. labels(url, bad) are the labelled urls; without them the urls that rules decide serve as such. A null url, or one without "://", has empty host and path and is a url like others.
    Repeated rows each stay and count; of several labels of a url, bad wins; extra columns are ignored.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), decided.alias("decided"))
    if labels is None:
        rows = rows.withColumn("bad", F.col("decided") == "block")
    else:
        rows = rows.join(labels.where("url IS NOT NULL AND bad IS NOT NULL").groupBy("url").agg(F.max("bad").alias("bad")), "url", "left")
    judged = rows.select("host", "path", "bad")
    paths, found = templates(judged)
    everywhere, pooled = templates(judged.withColumn("host", F.lit("")))
    pooled = durable(pooled)
    bad, good = pooled.agg(F.coalesce(F.sum("n_bad"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    base = bad / (bad + good) if bad + good else 0.0
    labelled = F.col("n_bad") + F.col("n_good")
    shares = pooled.select(F.col("template").alias("shape"), ((F.col("n_bad") + PRIOR * base) / (labelled + PRIOR)).alias("share"), labelled.alias("n_pooled"))
    shape_of = everywhere.select("path", F.col("template").alias("shape")).join(if_few(durable(shares)), "shape")
    purity = (F.col("n_bad") + PRIOR * F.col("share")) / (labelled + PRIOR)
    found = if_few(durable(found.select("host", "template", "n_bad", "n_good")))
    known = paths.join(found, ["host", "template"]).join(shape_of, "path")
    known = durable(known.select("host", "path", "template", purity.alias("purity"), ((purity >= reject) & (labelled + F.col("n_pooled") >= EVIDENCE)).alias("rejected")))
    out = rows.drop("url", "bad").join(known, ["host", "path"], "left")
    verdict = F.coalesce("decided", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")

"""Registered queries of what people read and decide: cards, details, packets, drafts, boards; and their DuckDB SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import html as H
from pagetrail.functions import text as T
from pagetrail.operators import assess, discover, extract, remediate, report, resolve
from pagetrail.plans.oracles import EVENTS, FOLD, among, mapping, pick, strings
from pagetrail.plans.queries import STATES, case_events, customers, read
from pagetrail.schema import ACTIONABLE, SEVERITIES, TRANSITIONS
from pagetrail.session import shared_dir
from pagetrail.sources import tables

MATCH_STATES = ("CONFIRMED", "HIGH_CONFIDENCE", "POSSIBLE", "AMBIGUOUS", "REJECTED")
CATEGORIES = tuple(sorted(assess.WHAT))


def chosen(values, by) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


# Inputs that Spark derives from the given tables, and the same in SQL.


def presented(spark, sf_dir) -> DataFrame:
    """A finding per order, with two observations and a date."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("k"), k.cast("string").alias("finding_id"), F.col("o_custkey").cast("string").alias("subject_id"), F.concat(F.lit("src"), (k % 1000).cast("string")).alias("source_id"), chosen(CATEGORIES, k).alias("category"),
        chosen(MATCH_STATES, F.floor(k / 8)).alias("match_state"), ((k % 100) / 100).alias("identity_confidence"), chosen(SEVERITIES, F.floor(k / 3)).alias("overall_priority"), F.array(F.lit("A"), F.concat(F.lit("B"), (k % 3).cast("string"))).alias("explanation_codes"),
        F.array(F.concat(F.lit("o"), k.cast("string")), F.concat(F.lit("o"), (k + 32).cast("string"))).alias("observation_ids"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def cited(spark, sf_dir) -> DataFrame:
    s = F.col("s")
    t = s.cast("string")
    return read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("s")).distinct().select(
        F.concat(F.lit("src"), t).alias("source_id"), F.concat(F.lit("https://h"), (s % 7).cast("string"), F.lit(".example.com/p/"), t).alias("url"), F.lit("example.com").alias("registrable_domain"),
        F.concat(F.lit("Page  "), t, F.lit(" <|x|> ``` end")).alias("title"), F.when(s % 5 == 0, "TIMEOUT").otherwise("RETRIEVED").alias("status"),
    )


def noted(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    t = k.cast("string")
    return read(spark, sf_dir, "orders").where(k % 4 != 3).select(
        F.concat(F.lit("o"), t).alias("obs_id"), F.concat(F.lit("src"), (k % 1000).cast("string")).alias("source_id"), chosen(("EMAIL", "PHONE", "NAME"), k).alias("type"), F.concat(F.lit("v"), (k % 40).cast("string")).alias("display_value"),
        F.concat(F.lit(" seen\n at  "), t, F.lit(" |> ")).alias("evidence_snippet"), (k % 3 == 0).alias("is_sensitive"), (k % 11).cast("int").alias("seen_at"),
    )


_K = "CAST(o_orderkey AS VARCHAR)"
PRESENTED = f"""f AS (SELECT o_orderkey AS k, {_K} AS finding_id, CAST(o_custkey AS VARCHAR) AS subject_id, 'src' || o_orderkey % 1000 AS source_id, {pick(CATEGORIES, 'o_orderkey')} AS category,
  {pick(MATCH_STATES, 'o_orderkey // 8')} AS match_state, CAST((o_orderkey % 100) AS DOUBLE) / 100 AS identity_confidence, {pick(SEVERITIES, 'o_orderkey // 3')} AS overall_priority, (o_orderkey // 3) % 5 AS rank,
  'A + B' || o_orderkey % 3 AS codes, ['o' || o_orderkey, 'o' || (o_orderkey + 32)] AS observation_ids, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"""
CITED = "s AS (SELECT DISTINCT o_orderkey % 1000 AS n, 'src' || n AS source_id, 'https://h' || n % 7 || '.example.com/p/' || n AS url, 'example.com' AS registrable_domain, n % 5 <> 0 AS got FROM orders)"
NOTED = f"o AS (SELECT 'o' || o_orderkey AS obs_id, 'src' || o_orderkey % 1000 AS source_id, {pick(('EMAIL', 'PHONE', 'NAME'), 'o_orderkey')} AS type, 'v' || o_orderkey % 40 AS display_value, o_orderkey AS n, o_orderkey % 3 = 0 AS is_sensitive, o_orderkey % 11 AS seen_at FROM orders WHERE o_orderkey % 4 <> 3)"
SEEN = "lpad(CAST(seen_at AS VARCHAR), 3, '0') || obs_id"
SURE = f"match_state IN {among(ACTIONABLE)}"
EACH = "e AS (SELECT f.finding_id, f.subject_id, f.source_id, f.category, o.* EXCLUDE (source_id) FROM (SELECT *, UNNEST(observation_ids) AS obs_id FROM f) f JOIN o USING (obs_id))"

ORACLES: dict[str, str] = {}


# Queries.


def f7_page_cards(spark, sf_dir):
    cards = report.page_cards(presented(spark, sf_dir), cited(spark, sf_dir), noted(spark, sf_dir))
    items = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<struct<category:string,value:string,sensitive:boolean>>")), lambda x: F.concat(x["category"], F.lit(":"), x["value"])), ";")
    return cards.select("subject_id", "source_id", "url", "priority", "identity_state", "identity_confidence", "needs_review", "n_findings", items.alias("items"), F.col("work_order").cast("long").alias("work_order"))


ORACLES["f7_page_cards"] = f"""WITH {PRESENTED}, {CITED}, {NOTED}, {EACH},
first AS (SELECT subject_id, source_id, category, display_value, is_sensitive, MIN({SEEN}) AS seen FROM e GROUP BY ALL),
items AS (SELECT subject_id, source_id, string_agg(category || ':' || display_value, ';' ORDER BY seen, category, display_value, is_sensitive) AS items FROM first GROUP BY ALL),
c AS (SELECT subject_id, source_id, MAX(rank) AS r, arg_max(match_state, CAST(created_at AS VARCHAR) || finding_id) AS identity_state, arg_max(identity_confidence, CAST(created_at AS VARCHAR) || finding_id) AS identity_confidence, COUNT(*) AS n_findings FROM f GROUP BY ALL)
SELECT subject_id, source_id, url, {strings(SEVERITIES)}[r + 1] AS priority, identity_state, identity_confidence, identity_state NOT IN {among(ACTIONABLE)} AS needs_review, n_findings, COALESCE(items, '') AS items,
  CASE WHEN identity_state IN {among(ACTIONABLE)} THEN 10 ELSE 0 END + 4 - r AS work_order FROM c JOIN s USING (source_id) LEFT JOIN items USING (subject_id, source_id)"""


def d12_observation_counts(spark, sf_dir):
    return report.observation_counts(cited(spark, sf_dir), noted(spark, sf_dir))


ORACLES["d12_observation_counts"] = f"WITH {CITED}, {NOTED} SELECT s.source_id, COUNT(o.obs_id) AS n_observations FROM s LEFT JOIN o USING (source_id) GROUP BY 1"


def e6_scan_quality(spark, sf_dir):
    return report.scan_quality(presented(spark, sf_dir), cited(spark, sf_dir), noted(spark, sf_dir))


ORACLES["e6_scan_quality"] = f"""WITH {PRESENTED}, {CITED}, {NOTED}, c AS (SELECT s.source_id, got, COUNT(o.obs_id) AS n FROM s LEFT JOIN o USING (source_id) GROUP BY ALL)
SELECT (SELECT COUNT(*) FROM f) AS total_findings, (SELECT COUNT(*) FROM f WHERE NOT ({SURE})) AS needs_review, (SELECT COUNT(DISTINCT source_id) FROM f) AS sources_with_findings,
  COUNT(*) FILTER (got AND n <= 1) AS unreadable_pages, COUNT(*) FILTER (NOT got) AS unfetchable_pages FROM c"""


def d6_finding_details(spark, sf_dir):
    f = presented(spark, sf_dir)
    one = F.array(F.struct(F.lit("name_match").alias("name")), F.struct(F.concat(F.lit("s"), F.col("source_id")).alias("name")))
    matches = f.where("k % 2 = 0").select("source_id", "subject_id").distinct().select("*", one.alias("supporting"), F.array().cast("array<struct<name:string>>").alias("contradicting"))
    d = report.finding_details(f, cited(spark, sf_dir), matches, noted(spark, sf_dir))
    seen = F.array_join(F.transform("observations", lambda o: F.concat(o["type"], F.lit("="), o["display_value"])), ";")
    return d.select("finding_id", "url", "registrable_domain", "status", seen.alias("observations"), F.size("supporting").alias("n_supporting"))


ORACLES["d6_finding_details"] = f"""WITH {PRESENTED}, {CITED}, {NOTED}, {EACH}, m AS (SELECT DISTINCT source_id, subject_id, TRUE AS held FROM f WHERE k % 2 = 0),
seen AS (SELECT finding_id, string_agg(type || '=' || display_value, ';' ORDER BY type, display_value, n::VARCHAR) AS observations FROM e GROUP BY 1)
SELECT f.finding_id, url, registrable_domain, CASE WHEN got THEN 'RETRIEVED' ELSE 'TIMEOUT' END AS status, observations, CASE WHEN held THEN 2 END AS n_supporting
FROM f LEFT JOIN s USING (source_id) LEFT JOIN m USING (source_id, subject_id) LEFT JOIN seen USING (finding_id)"""


def i9_explanations(spark, sf_dir):
    f = presented(spark, sf_dir)
    signals = F.array(F.struct(F.lit("name_match").alias("name")), F.struct(F.lit("email_match").alias("name")))
    matches = f.where("k % 2 = 0").select("source_id", "subject_id").distinct().withColumn("supporting", signals)
    return assess.explain(f, matches)


ORACLES["i9_explanations"] = f"""WITH {PRESENTED}, m AS (SELECT DISTINCT source_id, subject_id, TRUE AS held FROM f WHERE k % 2 = 0)
SELECT finding_id, {mapping(assess.WHAT, 'category')} AS what, {mapping(assess.WHY, 'category')} AS why, COALESCE({mapping(assess.IDENTITY, 'match_state')}, '') || CASE WHEN held THEN ' Signals: name_match, email_match.' ELSE '' END AS identity,
  'PRIORITY_' || overall_priority || ' because: ' || codes AS priority FROM f LEFT JOIN m USING (source_id, subject_id)"""


def i21_packets(spark, sf_dir):
    return report.packets(presented(spark, sf_dir), cited(spark, sf_dir), noted(spark, sf_dir))


ORACLES["i21_packets"] = f"""WITH {PRESENTED}, {CITED}, {NOTED}, {EACH},
p AS (SELECT finding_id, list(obs ORDER BY seen) AS l FROM (SELECT finding_id, {SEEN} AS seen, {{'t': type, 'v': display_value, 'n': n, 'h': is_sensitive}} AS obs FROM e) GROUP BY 1)
SELECT f.finding_id, CAST(to_json({{'page_title': 'Page ' || s.n || '  x    end', 'finding_category': category,
  'relevant_snippets': list_transform(list_filter(COALESCE(l, []), lambda x: NOT x.h)[1:6], lambda x: 'seen at ' || x.n || '  '), 'observations': list_transform(COALESCE(l, [])[1:20], lambda x: {{'type': x.t, 'display_value': x.v}})}}) AS VARCHAR) AS packet
FROM f LEFT JOIN s USING (source_id) LEFT JOIN p USING (finding_id)"""


def i19_e10_board(spark, sf_dir):
    return report.board_counts(remediate.cleanup_board(remediate.fold_case_events(case_events(spark, sf_dir))))


_LANES = mapping({s: v[0] for s, v in remediate.STAGES.items()}, "state")
_CASES = "c AS (SELECT case_id, z.s AS state FROM f)"
ORACLES["i19_e10_board"] = f"WITH {FOLD}, {_CASES} SELECT lane, COUNT(*) AS n_cases FROM (SELECT COALESCE({_LANES}, 'to_do') AS lane FROM c) GROUP BY ROLLUP (lane)"


def i19_next_steps(spark, sf_dir):
    return remediate.cleanup_board(remediate.fold_case_events(case_events(spark, sf_dir))).select("case_id", "lane", "next_label", "next_state")


_NEXT = {s: v[2] for s, v in remediate.STAGES.items() if v[2] and v[2] in TRANSITIONS.get(s, ())}
ORACLES["i19_next_steps"] = f"WITH {FOLD}, {_CASES} SELECT case_id, COALESCE({_LANES}, 'to_do') AS lane, COALESCE({mapping({s: v[1] for s, v in remediate.STAGES.items()}, 'state')}, 'Review this') AS next_label, {mapping(_NEXT, 'state')} AS next_state FROM c"


def e11_evaluate(spark, sf_dir):
    """Matches and labels from orders: every eighth order's pair is no match."""
    f = presented(spark, sf_dir)
    labels = f.select("subject_id", F.col("finding_id").alias("key"), (F.col("k") % 8 != 1).alias("is_match"), chosen(("plain", "namesake", "passing"), F.col("k")).alias("tag"))
    out = report.evaluate(f.where("k % 5 <> 0").select("subject_id", F.col("finding_id").alias("key"), F.col("match_state").alias("state")), labels)
    return out.withColumn("offenders", F.array_join("offenders", ";"))


ORACLES["e11_evaluate"] = f"""WITH {PRESENTED}, r AS (SELECT {pick(('plain', 'namesake', 'passing'), 'k')} AS tag, k % 8 <> 1 AS y, k % 5 <> 0 AND {SURE} AS sure, subject_id || '|' || finding_id AS pair FROM f),
g AS (SELECT tag, COUNT(*) FILTER (sure AND y) AS tp, COUNT(*) FILTER (sure AND NOT y) AS fp, COUNT(*) FILTER (NOT sure AND y) AS fn, array_to_string(list_sort(list(pair) FILTER (sure AND NOT y))[1:100], ';') AS o FROM r GROUP BY ROLLUP (tag))
SELECT tag, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, COALESCE(o, '') AS offenders FROM g"""


def e12_state_distribution(spark, sf_dir):
    return report.state_distribution(presented(spark, sf_dir).select(F.col("match_state").alias("state")))


ORACLES["e12_state_distribution"] = f"WITH {PRESENTED} SELECT match_state AS state, COUNT(*) AS n_matches FROM f GROUP BY 1"


def f6_supersede(spark, sf_dir):
    f = presented(spark, sf_dir).select("finding_id", "subject_id", F.concat(F.lit("u"), (F.col("k") % 5).cast("string")).alias("canonical_url"), F.date_trunc("month", "created_at").alias("scan_at"))
    return assess.supersede(f).select("finding_id", "subject_id", "canonical_url")


ORACLES["f6_supersede"] = f"WITH {PRESENTED}, t AS (SELECT finding_id, subject_id, 'u' || k % 5 AS canonical_url, date_trunc('month', created_at) AS scan_at FROM f) SELECT finding_id, subject_id, canonical_url FROM t QUALIFY rank() OVER (PARTITION BY subject_id, canonical_url ORDER BY scan_at DESC) = 1"


def f9_newest_findings(spark, sf_dir):
    """A newest-first listing, whole, with each row's place."""
    return report.newest_first(presented(spark, sf_dir), "created_at", "finding_id").select("finding_id", "category", "place")


ORACLES["f9_newest_findings"] = f"WITH {PRESENTED} SELECT finding_id, category, row_number() OVER (ORDER BY created_at DESC, finding_id) AS place FROM f"


def i7_d9_decisions(spark, sf_dir):
    f = presented(spark, sf_dir)
    rows = f.select("finding_id", "subject_id", "source_id", F.col("match_state").alias("state"), F.col("identity_confidence").alias("confidence"))
    decisions = f.where("k % 6 <> 0").select("subject_id", "source_id", chosen(("me", "not_me", "unsure"), F.col("k")).alias("decision"), F.col("k").alias("decided_at"))
    return resolve.apply_decisions(rows, decisions, ["subject_id", "source_id"]).select("finding_id", "state", "confidence", "user_overridden")


ORACLES["i7_d9_decisions"] = f"""WITH {PRESENTED}, d AS (SELECT subject_id, source_id, arg_max({pick(('me', 'not_me', 'unsure'), 'k')}, k) AS decision FROM f WHERE k % 6 <> 0 GROUP BY ALL)
SELECT finding_id, COALESCE(CASE decision WHEN 'me' THEN 'CONFIRMED' WHEN 'not_me' THEN 'REJECTED' WHEN 'unsure' THEN 'AMBIGUOUS' END, match_state) AS state, CASE decision WHEN 'me' THEN 1.0::DOUBLE WHEN 'not_me' THEN 0.0::DOUBLE ELSE identity_confidence END AS confidence, decision IS NOT NULL AS user_overridden
FROM f LEFT JOIN d USING (subject_id, source_id)"""


def f4_top_results(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.lit("s1").alias("scan_id"), (F.col("page_id") % 13).cast("string").alias("query"), (F.col("page_id") % 29).alias("rank"), "url", "page_id")
    return discover.top_results(p).select("query", "rank", "url", "page_id").groupBy("query", "rank", "url").agg(F.count("*").alias("n"))


ORACLES["f4_top_results"] = "WITH p AS (SELECT CAST(page_id % 13 AS VARCHAR) AS query, page_id % 29 AS rank, url FROM pages) SELECT query, rank, url, COUNT(*) AS n FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, url) <= 10) GROUP BY ALL"


def i20_new_cases(spark, sf_dir):
    ids = [r[0] for r in remediate.DEFAULT_REGISTRY]
    f = presented(spark, sf_dir)
    wanted = F.when(F.col("k") % 9 == 0, F.lit(None).cast("string")).when(F.col("k") % 9 == 1, "no such route").otherwise(chosen(ids, F.col("k")))
    cases, rejected = remediate.new_cases(f.select("finding_id", F.lit("CONTACT_PUBLISHER").alias("route"), wanted.alias("registry_route_id"), F.col("created_at").alias("opened_at")), remediate.default_registry(spark))
    return cases.select("finding_id", "route", "state").unionByName(rejected.select("finding_id", F.lit("rejected").alias("route"), F.lit(None).cast("string").alias("state")))


_ROUTES = {r[0]: r[2] for r in remediate.DEFAULT_REGISTRY}
ORACLES["i20_new_cases"] = f"WITH {PRESENTED} SELECT finding_id, CASE k % 9 WHEN 0 THEN 'CONTACT_PUBLISHER' WHEN 1 THEN 'rejected' ELSE {mapping(_ROUTES, pick(tuple(_ROUTES), 'k'))} END AS route, CASE WHEN k % 9 <> 1 THEN 'ACTION_SELECTED' END AS state FROM f"


def a12_scan_log(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scan_id"), F.col("event_id"), F.col("ts").cast("timestamp").alias("at"))
    ends = e.where("event_id % 3 = 1").select("scan_id", "at", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>")).alias("errors"), F.when(F.col("event_id") % 5 == 0, "lost").alias("failure"))
    return tables.scan_log(e.where("event_id % 3 = 0").select("scan_id", F.lit("p").alias("subject_id"), "at"), ends).select("scan_id", "status", "error", F.col("started_at").cast("string").alias("started_at"))


ORACLES["a12_scan_log"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS scan_id, event_id, CAST(ts AS TIMESTAMP) AS t FROM events), a AS (SELECT scan_id, MAX(t) AS started FROM e WHERE event_id % 3 = 0 GROUP BY 1),
b AS (SELECT scan_id, arg_max(event_id, t) AS n FROM e WHERE event_id % 3 = 1 GROUP BY 1)
SELECT scan_id, CASE WHEN n IS NULL THEN 'RUNNING' WHEN n % 5 = 0 THEN 'ERROR' WHEN n % 2 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status, CASE WHEN n % 5 = 0 THEN 'lost' END AS error, regexp_replace(CAST(started AS VARCHAR), '\\.?0+$', '') AS started_at FROM a LEFT JOIN b USING (scan_id)"""


def a9_a11_append_and_lookup(spark, sf_dir):
    """Two appends to a table by scan, then the rows of one scan."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    f = presented(spark, sf_dir).select("finding_id", "category", (F.col("k") % 7).alias("scan_id"))
    tables.append(f.where("finding_id like '%1'"), path)
    tables.append(f.where("finding_id not like '%1'"), path)
    return tables.lookup(spark, path, ["finding_id", "category"], scan_id=3)


ORACLES["a9_a11_append_and_lookup"] = f"WITH {PRESENTED} SELECT finding_id, category FROM f WHERE k % 7 = 3"


def a8_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tables.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


ORACLES["a8_upsert"] = "SELECT user_id, MAX(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"


def b13_snippets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", T.snippet(F.col("text"), F.lit("the "), 20).alias("snippet"))


_AT = "instr(lower(text), 'the ') - 1"
ORACLES["b13_snippets"] = f"""WITH d AS (SELECT doc_id, text, {_AT} AS p FROM documents WHERE text IS NOT NULL), e AS (SELECT *, greatest(p - 20, 0) AS a, least(p + 24, length(text)) AS b FROM d)
SELECT doc_id, CASE WHEN p < 0 THEN 'the ' ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || trim(substring(text, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN b < length(text) THEN '…' ELSE '' END END AS snippet FROM e"""


def b16_b18_phones(spark, sf_dir):
    c = customers(spark, sf_dir)
    k = F.col("subject_id").cast("long")
    said = F.when(k % 3 == 0, F.replace(F.col("phones")[0], F.lit(" "), F.lit("-"))).when(k % 3 == 1, F.concat(F.lit("0"), F.right(T.digits(F.col("phones")[0]), F.lit(9)))).otherwise(F.concat(F.lit("12 "), k.cast("string")))
    return c.select("subject_id", T.phone_match(said, F.col("phones")).alias("same"), T.phone_plausible(said).alias("plausible"))


_NUMBER = "lpad(CAST(c_custkey AS VARCHAR), 9, '7')"
ORACLES["b16_b18_phones"] = f"""WITH c AS (SELECT c_custkey AS k, '4420' || {_NUMBER} AS own, CASE k % 3 WHEN 0 THEN '4420' || {_NUMBER} WHEN 1 THEN '0' || {_NUMBER} ELSE '12' || k END AS d FROM customer)
SELECT CAST(k AS VARCHAR) AS subject_id, length(d) >= 7 AND (d = own OR (length(d) >= 9 AND right(d, 9) = right(own, 9))) AS same, length(d) BETWEEN 7 AND 15 AS plausible FROM c"""


def b25_neutralize(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.neutralize(F.concat(F.lit(" <|user|>\t"), F.col("text"), F.lit("``` "))).alias("said"))


_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
ORACLES["b25_neutralize"] = rf"SELECT conv_id, turn, replace(replace(replace(trim(regexp_replace(COALESCE(' <|user|>' || chr(9) || text || '``` ', ''), '{_SPACE}', ' ', 'g')), '```', ' '), '<|', ' '), '|>', ' ') AS said FROM conversations"


_NAMES = ("Jane Roe", "Jane R0e", "Terms of Service", "jane roe", "Ada (B.) Lovelace", "Cher", "Ana Luz De La Cruz", "Élodie  Ünal")


def b17_page_topics(spark, sf_dir):
    """Titles from a customer's segment and number: names and other heads before every separator."""
    k = F.col("c_custkey")
    title = F.concat(F.lit(" "), chosen(_NAMES, k), chosen((*T.SEPARATORS, "/"), F.floor(k / 8)), F.initcap("c_mktsegment"), F.lit(" | Site"))
    return read(spark, sf_dir, "customer").select("c_custkey", T.page_topic_name(title).alias("topic"))


_HEAD = "CASE " + " ".join(f"WHEN contains(t, '{x}') THEN trim(split_part(t, '{x}', 1))" for x in T.SEPARATORS) + " ELSE t END"
ORACLES["b17_page_topics"] = rf"""WITH c AS (SELECT c_custkey, trim({pick(_NAMES, 'c_custkey')} || {pick((*T.SEPARATORS, '/'), 'c_custkey // 8')} || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' | Site') AS t FROM customer),
h AS (SELECT c_custkey, {_HEAD} AS head FROM c), w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(head, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[.,''()]+|[.,''()]+$', '', 'g')) AS w FROM h)
SELECT c_custkey, CASE WHEN len(w) BETWEEN 2 AND 4 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\p{{Lu}}') OR regexp_matches(x, '\p{{Nd}}') OR lower(x) IN {among(T.NO_PERSON)})) = 0 THEN head END AS topic FROM w"""


def i14_validate_registry(spark, sf_dir):
    """A registry entry per supplier, with faults by number."""
    s = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    rows = read(spark, sf_dir, "supplier").select(
        F.when(s % 7 == 0, "twice").when(s % 7 == 1, "").otherwise(s.cast("string")).alias("id"), F.when(s % 5 == 0, "http://127.0.0.1/x").when(s % 5 == 1, "http://[fe80::1]/").otherwise("https://example.com/").alias("official_url"), F.lit("").alias("portal_url"),
        F.when(s % 11 == 0, none).otherwise(F.array(F.lit("https://example.org/a"))).alias("sources"), F.when(s % 13 == 0, none).otherwise(F.array(F.lit("eu"))).alias("jurisdictions"), F.when(s % 3 == 0, none).otherwise(F.array(F.lit("USERNAME"))).alias("applies_to"), s.alias("s_suppkey"),
    )
    valid, rejected = remediate.validate_registry(rows)
    return valid.select("s_suppkey", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("s_suppkey", "reason"))


ORACLES["i14_validate_registry"] = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 1 THEN 'missing_id' WHEN s_suppkey % 7 = 0 AND (SELECT COUNT(*) FROM supplier WHERE s_suppkey % 7 = 0) > 1 THEN 'duplicate_id' WHEN s_suppkey % 11 = 0 THEN 'no_provenance' WHEN s_suppkey % 5 < 2 THEN 'unsafe_url'
  WHEN s_suppkey % 13 = 0 THEN 'no_jurisdiction' WHEN s_suppkey % 3 = 0 THEN 'no_category' END AS reason FROM supplier"""


def i13_drafts(spark, sf_dir):
    f = presented(spark, sf_dir)
    ids = [r[0] for r in remediate.DEFAULT_REGISTRY] + ["none"]
    cases = f.select(F.concat(F.lit("c"), "finding_id").alias("case_id"), "finding_id", chosen(ids, F.col("k")).alias("registry_route_id"))
    people = f.select("subject_id").distinct().withColumn("names", F.array(F.struct(F.concat(F.lit("Person "), "subject_id").alias("value"), F.lit(True).alias("is_primary"))))
    d = remediate.drafts(cases, f, cited(spark, sf_dir), people, remediate.default_registry(spark))
    return d.select("case_id", "route", "subject_line", "body", "disclaimer")


def _drafts_sql() -> str:
    said = {"url": "url", "domain": "registrable_domain", "name": "'Person ' || subject_id", "detail": "lower(replace(category, '_', ' '))", "to": "dest"}
    told = lambda wording, values: "printf('" + wording.replace("'", "''").replace("\n", "' || chr(10) || '") + "', " + ", ".join(said[v] for v in values) + ")"
    body = "CASE route " + " ".join(f"WHEN '{k}' THEN {told(*v)}" for k, v in remediate.BODIES.items()) + " END"
    routes, where = tuple(_ROUTES) + ("none",), {r[0]: r[4] for r in remediate.DEFAULT_REGISTRY}
    return f"""WITH {PRESENTED}, {CITED}, d AS (SELECT *, COALESCE({mapping(_ROUTES, pick(routes, 'k'))}, 'NO_ACTION_AVAILABLE') AS route, COALESCE({mapping(where, pick(routes, 'k'))}, '') AS dest FROM f JOIN s USING (source_id))
SELECT 'c' || finding_id AS case_id, route, {mapping(remediate.LINES, 'route')} AS subject_line, {body} AS body, '{remediate.DISCLAIMER.replace("'", "''")}' AS disclaimer FROM d"""


ORACLES["i13_drafts"] = _drafts_sql()


def b27_script_shells(spark, sf_dir):
    pages = cited(spark, sf_dir).withColumn("content_type", F.when(F.col("status") == "RETRIEVED", "text/html").otherwise("text/plain"))
    return extract.script_shells(pages, noted(spark, sf_dir), 40)


ORACLES["b27_script_shells"] = f"""WITH {CITED}, {NOTED}, n AS (SELECT source_id, SUM(length(' seen  at  ' || n || ' |> ')) + COUNT(*) - 1 AS m FROM o GROUP BY 1)
SELECT source_id, CAST(COALESCE(m, 0) AS BIGINT) AS evidence_chars FROM s LEFT JOIN n USING (source_id) WHERE got AND COALESCE(m, 0) < 40"""


def a5_decode_body(spark, sf_dir):
    """Names as bytes: every third in Latin-1."""
    said = F.concat(F.lit("é ü "), F.col("c_name"))
    body = F.when(F.col("c_custkey") % 3 == 0, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8"))
    return read(spark, sf_dir, "customer").select("c_custkey", H.decode_body(body).alias("decoded"))


ORACLES["a5_decode_body"] = "SELECT c_custkey, 'é ü ' || c_name AS decoded FROM customer"


_OWN = {"chosen", "presented", "cited", "noted"}
QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _OWN}

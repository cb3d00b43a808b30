"""The registered queries in DuckDB's SQL, for comparison."""

from __future__ import annotations

from pagetrail.functions.html import ENTITIES
from pagetrail.functions.text import DATE_SHAPED, NO_PHONE_BEFORE, PHONE_CUE
from pagetrail.functions.urls import BLOCKED_V4, METADATA_HOSTS, TRACKING
from pagetrail.operators.assess import WHAT
from pagetrail.operators.remediate import DEFAULT_REGISTRY, DELIST, NONE, OWN, PUBLIC, PUBLISHER
from pagetrail.schema import BASE_RANKS, GONE, RECHECKABLE, SEVERITIES, TRANSITIONS, VERSIONS

STATES = tuple(TRANSITIONS)


def _q(s: str) -> str:
    return s.replace("'", "''")


def strings(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def among(values) -> str:
    return "(" + strings(values)[1:-1] + ")"


def canonical(u: str) -> str:
    path = rf"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    pairs = rf"list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {among(TRACKING)} AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_'))"
    return rf"lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)) || CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END"


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
WORD = r"\p{L}\p{M}\p{N}\p{Pc}"


def redacted(t: str) -> str:
    # no look-around here: the character before and after is matched and put back
    out = rf"regexp_replace(COALESCE({t}, ''), '{EMAIL}', '[email]', 'g')"
    out = rf"regexp_replace({out}, '(^|[^{WORD}+]|[^{WORD}])(\+?[0-9][0-9\s().\-]{{6,}}[0-9])($|[^{WORD}])', '\1[phone]\3', 'g')"
    return rf"regexp_replace({out}, '(^|[^{WORD}])[0-9]{{7,}}($|[^{WORD}])', '\1[digits]\2', 'g')"


def unescaped(t: str) -> str:
    for name, char in ENTITIES:
        t = f"replace({t}, '{name}', '{_q(char)}')"
    return t


HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
VISIBLE = rf"""array_to_string(list_filter(list_transform(string_split({unescaped(rf"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(10), 'g'), '(?is)^.*?<body\b[^>]*>', ''), '(?s)<[!/A-Za-z?][^>]*>', chr(10), 'g')")}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> ''), chr(10))"""


def pick(values, by: str) -> str:
    return f"{strings(values)}[CAST({by} AS BIGINT) % {len(values)} + 1]"


def mapping(of: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{_q(k)}' THEN '{_q(v)}'" for k, v in of.items()) + " END"


def severity(rank: str) -> str:
    return f"{strings(SEVERITIES)}[CAST({rank} AS INT) + 1]"



CUSTOMERS = """
SELECT CAST(c_custkey AS VARCHAR) AS k, c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, replace(c_name, '#', '') AS cust,
  upper(n_name[1]) || lower(n_name[2:]) AS country, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
NUMBER = "'+44 20 ' || lpad(k, 9, '7')[1:4] || ' ' || lpad(k, 9, '7')[5:9]"
DOTS = "repeat('•', {n})"
MASKED_MAIL = f"'c' || {DOTS.format(n='CAST(GREATEST(length(k), 3) AS INT)')} || '@Mail.Example.com'"
MASKED_PHONE = f"'+' || {DOTS.format(n=11)} || right(lpad(k, 9, '7'), 2)"

_V4 = " OR ".join(f"n BETWEEN {(lo := sum(int(x) << (24 - 8 * i) for i, x in enumerate(b.split('/')[0].split('.'))))} AND {lo + (1 << (32 - int(b.split('/')[1]))) - 1}" for b in BLOCKED_V4)

RATED = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, CAST(o_custkey AS VARCHAR) AS subject_id, {pick(sorted(WHAT), "o_orderkey")} AS category, o_orderkey % 3 = 0 AS from_search,
  {pick(("example.com", "agency.gov", "github.com", "data.europa.eu", "shop.example.org"), "o_orderkey // 4")} AS domain, {pick(("CONFIRMED", "HIGH_CONFIDENCE", "POSSIBLE", "AMBIGUOUS", "REJECTED"), "o_orderkey // 8")} AS match_state, o_orderkey % 2 = 0 AS phone
FROM orders
"""
_BASE = ", ".join(f"('{c}', {s}, {d}, {m}, {p})" for c, (s, d, m, p) in BASE_RANKS.items())
ASSESSED = f"""
r AS ({RATED}), base(category, s, d0, m0, p) AS (VALUES {_BASE}),
x AS (SELECT *, LEAST(d0 + CAST(from_search AS INT), 4) AS d, LEAST(m0 + CAST(category = 'HOME_ADDRESS' AND phone AS INT), 4) AS m, match_state IN ('CONFIRMED', 'HIGH_CONFIDENCE') AS sure, domain LIKE '%.gov' OR domain LIKE '%europa.eu' AS gov FROM r JOIN base USING (category)),
y AS (SELECT *, d >= 3 AND GREATEST(s, m) < 4 AS raised FROM x),
z AS (SELECT *, LEAST(GREATEST(s, m) + CAST(raised AS INT), CASE WHEN category = 'OUTDATED_INFORMATION' THEN 1 WHEN category = 'PROFESSIONAL_PROFILE' OR NOT sure THEN 2 ELSE 4 END) AS priority FROM y)
"""
_CODES = "array_to_string(list_filter(['BASE_' || category, CASE WHEN from_search THEN 'SEARCH_INDEXED' END, CASE WHEN category = 'HOME_ADDRESS' AND phone THEN 'DIRECT_PHONE_PRESENT' END, CASE WHEN gov THEN 'GOVERNMENT_SOURCE' END, CASE WHEN domain = 'github.com' THEN 'USER_CONTROLLED' END, CASE WHEN raised THEN 'HIGH_DISCOVERABILITY' END, CASE WHEN category = 'OUTDATED_INFORMATION' THEN 'OUTDATED_CAP' END, CASE WHEN NOT sure THEN 'IDENTITY_UNCERTAIN' END], lambda e: e IS NOT NULL), ';')"

EVENTS = f"SELECT CAST(user_id AS VARCHAR) AS case_id, ts AS tm, event_id, CASE WHEN event_type = 'purchase' THEN 'REQUEST_PREPARED' ELSE {pick(STATES, 'event_id')} END AS target FROM events"
MOVES = strings(f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets)
FOLD = f"""
e AS ({EVENTS}), l AS (SELECT case_id, list(target ORDER BY tm, event_id) AS targets FROM e GROUP BY case_id),
f AS (SELECT case_id, list_reduce(list_transform(targets, lambda t: {{'s': t, 'a': 0::BIGINT, 'r': 0::BIGINT}}), lambda acc, x: CASE WHEN list_contains({MOVES}, acc.s || '>' || x.s) THEN {{'s': x.s, 'a': acc.a + 1, 'r': acc.r}} ELSE {{'s': acc.s, 'a': acc.a, 'r': acc.r + 1}} END, {{'s': 'ACTION_SELECTED', 'a': 0::BIGINT, 'r': 0::BIGINT}}) AS z FROM l)
"""
_VERIFY = f"""
p AS (SELECT page_id AS n FROM pages),
v AS (SELECT n, CASE WHEN n % 13 = 0 THEN 'UNKNOWN' WHEN n % 11 = 0 THEN 'ACCESS_BLOCKED' WHEN n % 11 = 1 THEN 'UNKNOWN' WHEN n % 11 IN (2, 3) THEN 'URL_GONE' WHEN n % 7 = 0 AND n % 4 <> 0 THEN 'CONTENT_REMOVED' WHEN n % 2 = 0 AND n % 4 <> 0 THEN 'PERSONAL_DATA_REMOVED' WHEN n % 5 <> 0 THEN 'UNCHANGED' ELSE 'CONTENT_CHANGED' END AS source_status FROM p),
c AS (SELECT n AS case_id, {pick(STATES, "n")} AS before, source_status, source_status IN {among(GONE)} AS gone FROM v),
a AS (SELECT case_id, before, CASE WHEN before = 'VERIFIED' THEN CASE WHEN gone THEN 'VERIFIED' ELSE 'REAPPEARED' END WHEN before IN ('USER_MARKED_SUBMITTED', 'AWAITING_RESPONSE', 'VERIFICATION_PENDING') THEN CASE WHEN gone THEN 'VERIFIED' ELSE 'VERIFICATION_PENDING' END ELSE before END AS state, source_status,
  CASE WHEN before = 'VERIFIED' AND NOT gone THEN CASE WHEN source_status IN ('UNKNOWN', 'ACCESS_BLOCKED') THEN 'unreachable' ELSE 'seen' END END AS reappeared_reason FROM c WHERE before IN {among(RECHECKABLE)})
"""
_APPLIES = ", ".join(f"('{r[0]}', '{r[2]}', '{r[1].replace(chr(39), chr(39) * 2)}', '{c}')" for r in DEFAULT_REGISTRY for c in r[3])

#: The scan: every email in documents enrols its owner; a page is theirs if it shows the email, or holds the local part.
SCAN = rf"""
crawl AS (SELECT {canonical("url")} AS canonical_url, {VISIBLE} AS text, page_id % 2 = 0 AS from_search FROM pages
  UNION ALL SELECT 'https://docs.example.net/d/' || doc_id, text, doc_id % 2 = 0 FROM documents),
subj AS (SELECT DISTINCT lower(e) AS email FROM (SELECT UNNEST(regexp_extract_all(text, '{EMAIL}')) AS e FROM documents)),
seen AS (SELECT DISTINCT canonical_url, lower(e) AS email FROM (SELECT canonical_url, UNNEST(regexp_extract_all(text, '{EMAIL}')) AS e FROM crawl)),
pairs AS (SELECT sha256(s.email) AS subject_id, c.canonical_url, c.from_search, length(split_part(s.email, '@', 1)) >= 4 AS named, seen.email IS NOT NULL AS strong
  FROM crawl c JOIN subj s ON length(split_part(s.email, '@', 1)) >= 3 AND contains(lower(c.text), split_part(s.email, '@', 1)) LEFT JOIN seen ON seen.canonical_url = c.canonical_url AND seen.email = s.email),
matched AS (SELECT *, CASE WHEN strong THEN 'HIGH_CONFIDENCE' ELSE 'POSSIBLE' END AS state, CASE WHEN strong AND named THEN 0.989 WHEN strong THEN 0.97 ELSE 0.62 END AS confidence FROM pairs WHERE strong OR named)
"""

# Each number is put between two marks; what stands before a mark, other marks aside, is its context.
_PHONES = rf"""
t AS (SELECT page_id, {VISIBLE} AS text FROM pages UNION ALL SELECT -1 - doc_id, text FROM documents),
m AS (SELECT page_id, string_split(regexp_replace(text, '(^|[^{WORD}+]|[^{WORD}])(\+?[0-9][0-9\s().\-]{{6,}}[0-9])($|[^{WORD}])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS parts FROM t),
h AS (SELECT page_id, split_part(parts[i], chr(2), 1) AS hit, right(replace(array_to_string(parts[1:i - 1], ''), chr(2), ''), 40) AS before FROM (SELECT page_id, parts, UNNEST(range(2, len(parts) + 1)) AS i FROM m)),
d AS (SELECT *, length(regexp_replace(hit, '[^0-9]', '', 'g')) AS n FROM h),
kept AS (SELECT page_id, hit, n FROM d WHERE n BETWEEN 7 AND 15 AND length(regexp_replace(hit, '[^ .()\-]', '', 'g')) <= n AND NOT regexp_matches(hit, '{DATE_SHAPED.removeprefix("(?U)")}')
  AND NOT regexp_matches(before, '{NO_PHONE_BEFORE.replace("(?iU)", "(?i)")}') AND (hit LIKE '+%' OR regexp_matches(before, '{PHONE_CUE.replace("(?iU)", "(?i)")}')))
"""

_PROFILE_FACTS = f"""
f AS (SELECT UNNEST([{{'t': 'PAGE_TITLE', 'v': seg || ' ' || cust || ' | Directory'}}, {{'t': 'NAME', 'v': seg || ' ' || cust}}, {{'t': 'JOB_TITLE', 'v': 'Clerk'}}, {{'t': 'EMPLOYER', 'v': seg || ' Works'}}, {{'t': 'EMAIL', 'v': 'c' || k || '@mail.example.com'}},
  {{'t': 'DATE_OF_BIRTH', 'v': '1980-05-03'}}, {{'t': 'DATE_OF_BIRTH', 'v': '3 May 1980'}}, {{'t': 'POSTAL_ADDRESS', 'v': k || ' Oak Street, ' || n_name}}, {{'t': 'POSTAL_ADDRESS', 'v': k || ' Elm Tree Road'}}, {{'t': 'PHONE', 'v': '0207946' || lpad(k, 6, '0')}},
  {{'t': 'PHONE', 'v': '+4420' || lpad(k, 8, '7')}}, {{'t': 'SOCIAL_LINK', 'v': 'https://github.com/user' || k}}, {{'t': 'SOCIAL_LINK', 'v': 'https://www.linkedin.com/in/user' || k}}, {{'t': 'USERNAME', 'v': 'user' || k}}], recursive := true) FROM ({CUSTOMERS}))
"""


def _json(**fields: str) -> str:
    """The text of a JSON object of strings, from SQL for the values."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in fields.items()) + " || '}'"


_BLOCK = " || ".join((
    "'{\"finding_id\":\"' || finding_id || '\",\"category\":\"' || category || '\",\"priority\":\"' || priority || '\",\"dimensions\":'",
    _json(sensitivity=severity("worst"), discoverability=severity("2 + CAST(from_search AS INT)"), misuse_potential=severity("worst"), persistence="'MODERATE'"),
    "',\"identity\":{\"state\":\"' || state || '\",\"confidence\":' || CAST(confidence AS VARCHAR) || '},\"explanation_codes\":[\"BASE_' || category || '\"'",
    "CASE WHEN from_search THEN ',\"SEARCH_INDEXED\",\"HIGH_DISCOVERABILITY\"' ELSE '' END || CASE WHEN strong THEN '' ELSE ',\"IDENTITY_UNCERTAIN\"' END || '],\"summary\":\"'",
    mapping({k: WHAT[k] for k in ("CONTACT_EMAIL", "USERNAME")}, "category"),
    "'\",\"source\":{\"url\":\"' || url || '\",\"domain\":\"' || domain || '\"' || COALESCE(',\"title\":' || to_json(title), '') || '}}'",
))
_COUNTS = "{" + ",".join(f'"{k}":\' || COUNT(*) FILTER ({w}) || \'' for k, w in (("critical", "strong AND rank = 4"), ("high", "strong AND rank = 3"), ("moderate", "strong AND rank = 2"), ("low", "strong AND rank = 1"), ("none", "strong AND rank = 0"), ("needs_review", "NOT strong"))) + "}"
_REPORTS = rf"""
cited AS (SELECT {canonical("url")} AS canonical_url, url, NULLIF(trim({unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') AS title FROM pages UNION ALL SELECT 'https://docs.example.net/d/' || doc_id, 'https://docs.example.net/d/' || doc_id, NULL FROM documents),
c AS (SELECT *, 'CONTACT_EMAIL' AS category, 2 AS worst FROM matched WHERE strong UNION ALL SELECT *, 'USERNAME', 1 FROM matched),
f AS (SELECT *, sha256(subject_id || '|' || sha256('s1|' || canonical_url) || '|' || category) AS finding_id, LEAST(worst + CAST(from_search AS INT), CASE WHEN strong THEN 4 ELSE 2 END) AS rank, regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) AS domain FROM c JOIN cited USING (canonical_url)),
b AS (SELECT *, {severity("rank")} AS priority FROM f),
r AS (SELECT subject_id, list({_BLOCK} ORDER BY finding_id) AS blocks, list('{{"case_id":"' || sha256(finding_id) || '","finding_id":"' || finding_id || '","route":"SEARCH_DELIST","state":"VERIFIED"}}' ORDER BY sha256(finding_id)) AS cases, '{_COUNTS}' AS counts FROM b GROUP BY subject_id)
"""
_NONE_COUNTED = "{" + ",".join(f'"{k}":0' for k in ("critical", "high", "moderate", "low", "none", "needs_review")) + "}"
_VERSIONS = "{" + ",".join(f'"{k}":"{v}"' for k, v in VERSIONS.items()) + "}"
_NAME = "array_to_string(list_transform(string_split(regexp_replace(split_part(email, '@', 1), '[._0-9]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

ORACLES = {
    "b1_canonical_url": f"SELECT page_id, {canonical('url')} AS canonical_url FROM pages",
    "b2_registrable_domain": r"SELECT page_id, regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) AS registrable_domain FROM pages",
    "b3_resolved_links": """WITH l AS (SELECT page_id, UNNEST(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, COUNT(*) AS n_links, COUNT(DISTINCT href) AS n_distinct FROM l GROUP BY page_id""",
    "b4_url_policy": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN CASE WHEN url LIKE 'https%' THEN 'unsupported_scheme:ftps' ELSE 'rejected_scheme:ftp' END WHEN 1 THEN 'blocked_hostname' WHEN 2 THEN 'blocked_ip_literal' WHEN 3 THEN 'empty_url' ELSE 'ok' END AS policy FROM pages",
    "b5_blocked_addresses": f"WITH e AS (SELECT event_id, event_id % 256 AS a, (event_id // 256 * 7) % 256 AS b, (event_id // 64 * 11) % 256 AS c, (event_id * 5) % 256 AS d FROM events), f AS (SELECT event_id, ((a * 256 + b) * 256 + c) * 256 + d AS n, a || '.' || b || '.' || c || '.' || d AS ip FROM e) SELECT event_id, ({_V4}) OR ip IN {among(METADATA_HOSTS)} AS blocked FROM f",
    "b6_b7_masks": f"WITH c AS ({CUSTOMERS}) SELECT k AS subject_id, {MASKED_MAIL} AS email, {MASKED_PHONE} AS phone FROM c",
    "b8_redact": f"SELECT conv_id, turn, sha256({redacted('text')}) AS redacted FROM conversations",
    "b8_redact_documents": f"SELECT doc_id, {redacted('text')} AS redacted FROM documents",
    "b9_redact_map": f"SELECT conv_id, turn, {redacted('role')} AS role, sha256({redacted('text')} || ' [email] [phone]') AS redacted FROM conversations",
    "b10_parse_html": f"""SELECT page_id, NULLIF(trim({unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') AS title, length({VISIBLE}) AS n_text, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS n_links, 0 AS n_meta FROM pages""",
    "b14_tokens": rf"WITH t AS (SELECT item_id, trim(regexp_replace(lower(text), '[^{WORD}]+', ' ', 'g')) AS norm FROM benchmark) SELECT item_id, norm, len(string_split(norm, ' ')) AS n_tokens FROM t",
    "b15_name_match": f"WITH c AS ({CUSTOMERS}) SELECT k AS subject_id, TRUE AS self, seg = 'Building' AND cust = 'Customer000000001' AS first FROM c",
    "b20_severities": f"WITH t AS (SELECT l_linenumber % 5 AS i, l_orderkey % 5 AS j, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) SELECT {severity('i')} AS a, {severity('j')} AS b, n, {severity('LEAST(i + 2, 4)')} AS bumped, {severity('GREATEST(i, j)')} AS highest, {severity('LEAST(i, j)')} AS lowest FROM t",
    "a2_search_results": "WITH t AS (SELECT page_id % 17 AS q, CASE WHEN page_id % 5 <> 0 THEN url END AS url, 't' || page_id AS title FROM pages), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY url NULLS FIRST, title) AS rank FROM t) SELECT CAST(q AS VARCHAR) AS query, rank, url, title FROM r WHERE url IS NOT NULL",
    "a3_admit_pages": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/plain' ELSE '' END AS content_type, CAST(strlen(html) AS BIGINT) AS n_bytes, sha256(html) AS content_hash, CASE WHEN page_id % 4 = 0 THEN 'UNSUPPORTED_TYPE' WHEN strlen(html) > 4000 THEN 'TOO_LARGE' ELSE 'RETRIEVED' END AS status FROM pages",
    "a4_classify_fetch": f"SELECT event_id, {pick(('RETRIEVED', 'TIMEOUT', 'TOO_LARGE', 'RETRIEVAL_BLOCKED', 'UNSUPPORTED_TYPE', 'ERROR'), 'event_id')} AS status FROM events",
    "a6_clean_subjects": f"WITH c AS ({CUSTOMERS}) SELECT k AS subject_id, seg || ' ' || cust AS name, 1 AS n_places, 'c' || k || '.example.org' AS domain FROM c",
    "a1_f2_candidates": f"WITH t AS (SELECT page_id % 3 AS s, {canonical('url')} AS canonical_url, TRUE AS from_search, page_id AS position, url FROM pages UNION ALL SELECT page_id % 3, {canonical('url')}, FALSE, page_id, url || '#again' FROM pages WHERE page_id % 2 = 0), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s, canonical_url ORDER BY from_search DESC, position, url) AS n FROM t), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s ORDER BY from_search DESC, position, url) AS m FROM a WHERE n = 1) SELECT CAST(s AS VARCHAR) AS scan_id, canonical_url, from_search, position FROM b WHERE m <= 100",
    "f5_within_budget": "WITH t AS (SELECT page_id, page_id % 5 AS scan_id, CAST(strlen(html) AS BIGINT) AS n_bytes, url FROM pages), w AS (SELECT *, COALESCE(SUM(n_bytes) OVER (PARTITION BY scan_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, ROW_NUMBER() OVER (PARTITION BY scan_id ORDER BY page_id) AS n FROM t) SELECT page_id, scan_id, n_bytes FROM w WHERE b < 60000 AND n <= 100",
    "a8_f6_newest": "SELECT user_id, MAX(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "a13_search_outcomes": "WITH t AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'web_timeout' WHEN event_id % 5 = 1 THEN 'web_unauthorized' WHEN event_id % 5 IN (2, 4) THEN 'web_rate_limited' WHEN event_id % 5 = 3 THEN 'web_http_500' ELSE 'ok' END AS outcome FROM events) SELECT outcome, COUNT(*) AS n FROM t GROUP BY outcome",
    "i25_identifiers": f"WITH c AS ({CUSTOMERS}), i AS (SELECT k, 'EMAIL' AS kind, 'c' || k || '@Mail.Example.com' AS value, {MASKED_MAIL} AS display FROM c UNION ALL SELECT k, 'PHONE', {NUMBER}, {MASKED_PHONE} FROM c) SELECT k AS subject_id, kind, value, sha256('pepper' || lower(value)) AS value_hash, display FROM i",
    "i24_subjects_public": f"WITH c AS ({CUSTOMERS}) SELECT k AS subject_id, seg || ' ' || cust AS primary_name, seg || ' ' || cust AS names, 'Springfield, ' || country AS locations, 'user' || k AS usernames, {MASKED_MAIL} AS emails, {MASKED_PHONE} AS phones, 'c' || k || '.example.org' AS personal_domains FROM c",
    "d13_erase": "SELECT CAST(o_orderkey AS VARCHAR) AS finding_id, CAST(o_custkey AS VARCHAR) AS subject_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
    "c4_emails": f"WITH t AS (SELECT doc_id, UNNEST(regexp_extract_all(text, '{EMAIL}')) AS e FROM documents) SELECT doc_id, lower(e) AS value, e[1] || repeat('•', CAST(GREATEST(length(split_part(e, '@', 1)) - 1, 3) AS INT)) || '@' || split_part(e, '@', 2) AS display, COUNT(*) AS n FROM t GROUP BY 1, 2, 3",
    "c2_jsonld_people": f"WITH c AS (SELECT *, 'https://people.example.org/c/' || k AS source_id FROM ({CUSTOMERS})) SELECT source_id, type, lower(v) AS value, CASE WHEN type = 'EMAIL' THEN 'c' || repeat('•', CAST(GREATEST(length(k), 3) AS INT)) || '@mail.example.com' WHEN type = 'SOCIAL_LINK' THEN 'GitHub: user' || k ELSE v END AS display, type IN ('EMAIL', 'DATE_OF_BIRTH', 'POSTAL_ADDRESS') AS sensitive FROM (SELECT source_id, k, UNNEST([{{'type': 'NAME', 'v': seg || ' ' || cust}}, {{'type': 'JOB_TITLE', 'v': 'Clerk'}}, {{'type': 'EMPLOYER', 'v': seg || ' Works'}}, {{'type': 'EMAIL', 'v': 'c' || k || '@mail.example.com'}}, {{'type': 'DATE_OF_BIRTH', 'v': '1980-05-03'}}, {{'type': 'POSTAL_ADDRESS', 'v': k || ' Oak Street, ' || n_name}}, {{'type': 'SOCIAL_LINK', 'v': 'https://github.com/user' || k}}], recursive := true) FROM c)",
    "c10_d1_subject_terms": f"WITH s AS (SELECT DISTINCT lower(e) AS value FROM (SELECT UNNEST(regexp_extract_all(text, '{EMAIL}')) AS e FROM documents)) SELECT CAST(doc_id AS VARCHAR) AS source_id, value FROM documents JOIN s ON contains(lower(text), value)",
    "scan_findings": f"WITH {SCAN}, c AS (SELECT *, 'CONTACT_EMAIL' AS category, 2 AS worst FROM matched WHERE strong UNION ALL SELECT *, 'USERNAME', 1 FROM matched) SELECT subject_id, canonical_url, category, {severity('LEAST(worst + CAST(from_search AS INT), CASE WHEN strong THEN 4 ELSE 2 END)')} AS overall_priority, state AS match_state, confidence AS identity_confidence, 'BASE_' || category || CASE WHEN from_search THEN ';SEARCH_INDEXED;HIGH_DISCOVERABILITY' ELSE '' END || CASE WHEN strong THEN '' ELSE ';IDENTITY_UNCERTAIN' END AS explanation_codes FROM c",
    "d2_i5_matches": f"WITH {SCAN} SELECT subject_id, canonical_url, state, confidence, CAST(strong AS INT) + CAST(named AS INT) AS n_supporting, 0 AS n_contradicting FROM matched",
    "i8_assess": f"WITH {ASSESSED} SELECT finding_id, {severity('s')} AS sensitivity, {severity('d')} AS discoverability, {severity('m')} AS misuse_potential, {severity('p')} AS persistence, {severity('priority')} AS overall_priority, {_CODES} AS explanation_codes FROM z",
    "e4_dashboard": f"WITH {ASSESSED} SELECT subject_id, COUNT(*) AS total, COUNT(*) FILTER (sure AND priority >= 3) AS high, COUNT(*) FILTER (sure AND priority = 2) AS moderate, COUNT(*) FILTER (sure AND priority < 2) AS low, COUNT(*) FILTER (NOT sure) AS needs_review FROM z GROUP BY subject_id",
    "e5_report_summary": f"WITH {ASSESSED} SELECT subject_id, COUNT(*) FILTER (sure AND priority = 4) AS critical, COUNT(*) FILTER (sure AND priority = 3) AS high, COUNT(*) FILTER (sure AND priority = 2) AS moderate, COUNT(*) FILTER (sure AND priority = 1) AS low, COUNT(*) FILTER (sure AND priority = 0) AS none, COUNT(*) FILTER (NOT sure) AS needs_review FROM z GROUP BY subject_id",
    "e13_quality_metrics": f"WITH {ASSESSED}, a AS (SELECT COUNT(*) FILTER (NOT sure) / COUNT(*) AS ambiguous_rate, COUNT(*) AS n FROM z), b AS (SELECT COUNT(*) FILTER (page_id % 3 <> 0) / COUNT(*) AS retrieval_success, 1 - COUNT(DISTINCT {canonical('url')}) / COUNT(*) AS duplicate_rate, CAST(COALESCE(SUM(strlen(html)) FILTER (page_id % 3 <> 0), 0) AS BIGINT) AS bytes_used FROM pages), c AS (SELECT COUNT(*) AS w FROM orders WHERE o_orderkey % 2 = 0), d AS (SELECT COUNT(*) FILTER (event_id % 10 <> 0) AS queries_used FROM events) SELECT ambiguous_rate, retrieval_success, duplicate_rate, w / n AS remediation_coverage, bytes_used, queries_used FROM a, b, c, d",
    "i12_routes": f"WITH r AS ({RATED}), live(registry_id, route, provider, category) AS (VALUES {_APPLIES}), f AS (SELECT *, domain = 'github.com' AS own, domain LIKE '%.gov' OR domain LIKE '%europa.eu' AS gov FROM r JOIN customer ON subject_id = CAST(c_custkey AS VARCHAR)), o AS (SELECT finding_id, CASE registry_id WHEN 'user_controlled_remove' THEN 1 WHEN 'google_personal_info' THEN 5 ELSE 6 END AS rank, registry_id, route, provider, registry_id = 'user_controlled_remove' AS recommended, CASE registry_id WHEN 'user_controlled_remove' THEN '{_q(OWN)}' WHEN 'google_personal_info' THEN '{_q(DELIST)}' ELSE '{_q(PUBLISHER)}' END AS reason, registry_id = 'user_controlled_remove' AS jurisdiction_relevant FROM f JOIN live USING (category) WHERE registry_id IN ('google_personal_info', 'generic_publisher_contact') OR (registry_id = 'user_controlled_remove' AND own)) SELECT * FROM o UNION ALL SELECT finding_id, 7, NULL, 'NO_ACTION_AVAILABLE', '(none)', gov, CASE WHEN gov THEN '{_q(PUBLIC)}' ELSE '{_q(NONE)}' END, FALSE FROM f WHERE gov OR finding_id NOT IN (SELECT finding_id FROM o)",
    "i15_transitions": f"WITH e AS ({EVENTS}), s AS (SELECT event_id, {pick(STATES, 'event_id % 13')} AS state, target FROM e) SELECT * FROM s WHERE list_contains({MOVES}, state || '>' || target)",
    "i16_case_fold": f"WITH {FOLD} SELECT case_id, z.s AS state, z.a AS n_applied, z.r AS n_rejected FROM f",
    "k3_case_stream": f"WITH {FOLD} SELECT case_id, z.s AS state, z.a AS n_applied, z.r AS n_rejected FROM f",
    "f10_timelines": f"WITH e AS ({EVENTS}) SELECT case_id, COUNT(*) AS n_events, arg_min(CAST(event_id AS VARCHAR), (tm, target, CAST(event_id AS VARCHAR))) AS first, arg_max(CAST(event_id AS VARCHAR), (tm, target, CAST(event_id AS VARCHAR))) AS last FROM e GROUP BY case_id",
    "i17_i18_verify": f"WITH {_VERIFY} SELECT * FROM a",
    "e9_recheck_summary": f"WITH {_VERIFY} SELECT COUNT(*) AS checked, COUNT(*) FILTER (before <> state) AS changed, COUNT(*) FILTER (before <> state AND state = 'VERIFIED') AS resolved, COUNT(*) FILTER (before <> state AND state = 'REAPPEARED') AS reappeared FROM a",
    "d11_search_presence": f"WITH p AS (SELECT page_id, {canonical('url')} AS u, page_id % 20 AS q FROM pages), s AS (SELECT DISTINCT q, u FROM p WHERE page_id % 3 = 0) SELECT page_id AS key, CASE WHEN p.q = 7 OR s.u IS NOT NULL THEN 'SEARCH_RESULT_PRESENT' ELSE 'SEARCH_RESULT_NOT_OBSERVED' END AS search_status, 'UNKNOWN' AS source_status, CASE WHEN p.q = 7 THEN 'search_failed:Timeout' WHEN s.u IS NOT NULL THEN 'observed in the tested search' ELSE 'not observed in the tested search (does not prove universal delisting)' END AS note FROM p LEFT JOIN s ON s.q = p.q AND s.u = p.u",
    "g1_page_diff": f"WITH p AS (SELECT page_id, {canonical('url')} AS canonical_url FROM pages), a AS (SELECT DISTINCT canonical_url FROM p WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT canonical_url FROM p WHERE page_id % 3 <> 1) SELECT canonical_url, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT canonical_url, 'gone' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "i10_plan_queries": f"""WITH c AS (SELECT *, '"' || seg || ' ' || cust || '"' AS q FROM ({CUSTOMERS})), t AS (SELECT k AS subject_id, UNNEST([{{'position': 0, 'text': q, 'rationale': 'name'}}, {{'position': 1, 'text': q || ' Springfield', 'rationale': 'name+location'}}, {{'position': 2, 'text': q || ' ' || country, 'rationale': 'name+location'}}, {{'position': 3, 'text': q || ' ' || seg || ' Works', 'rationale': 'name+employer'}}, {{'position': 4, 'text': q, 'rationale': 'name+pdf'}}, {{'position': 5, 'text': '"user' || k || '"', 'rationale': 'username'}}, {{'position': 6, 'text': 'site:c' || k || '.example.org', 'rationale': 'owned-domain'}}, {{'position': 7, 'text': '"c' || k || '@Mail.Example.com"', 'rationale': 'email'}}], recursive := true) FROM c) SELECT subject_id, position, text, rationale = 'email' AS sensitive, rationale, CASE WHEN rationale = 'owned-domain' THEN text[6:] END AS site, CASE WHEN rationale = 'name+pdf' THEN 'pdf' END AS filetype, text || CASE WHEN rationale = 'name+pdf' THEN ' filetype:pdf' ELSE '' END AS rendered FROM t""",
    "i11_runnable": "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, 8 - c_custkey % 2 AS n_queries, 1 - c_custkey % 2 AS n_sensitive FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "e7_scan_stats": "WITH e AS (SELECT *, user_id % 40 AS s FROM events), g AS (SELECT s, COUNT(*) AS queries_planned, COUNT(*) FILTER (event_id % 10 <> 0) AS queries_run, COUNT(*) FILTER (event_id % 10 = 0) AS sensitive_skipped, COUNT(*) AS candidates, COUNT(*) FILTER (event_id % 3 = 0) AS retrieved, COUNT(*) FILTER (event_id % 3 = 1) AS blocked, COUNT(*) FILTER (event_id % 3 = 2) AS failed, CAST(COALESCE(SUM(event_id) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS bytes_downloaded, COUNT(*) FILTER (event_id % 4 = 0) AS findings FROM e GROUP BY s) SELECT CAST(s AS VARCHAR) AS scan_id, * EXCLUDE (s), CASE WHEN s < 5 THEN 'web_timeout' ELSE '' END AS provider_errors, CASE WHEN s < 5 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status, 99 AS progress FROM g",
    "l1_sql_functions": f"SELECT doc_id, {redacted('text')} AS redacted, {severity('LEAST(1 + doc_id % 5, 4)')} AS bumped, 'u' || repeat('•', CAST(length('user' || doc_id) - 1 AS INT)) || '@example.com' AS masked FROM documents",
    "k2_scan_progress_stream": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, 's1' AS scan_id, COUNT(*) AS candidates, COUNT(*) FILTER (event_id % 3 = 0) AS retrieved, COUNT(*) FILTER (event_id % 3 <> 0) AS blocked, CAST(COALESCE(SUM(event_id) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS bytes_downloaded FROM events GROUP BY 1",
    "c5_phones": f"WITH {_PHONES} SELECT page_id, regexp_replace(hit, '[^0-9+]', '', 'g') AS value, CASE WHEN hit LIKE '+%' THEN '+' ELSE '' END || {DOTS.format(n='CAST(n - 2 AS INT)')} || right(regexp_replace(hit, '[^0-9]', '', 'g'), 2) AS display, COUNT(*) AS n FROM kept GROUP BY 1, 2, 3",
    "c1_c9_profile_facts": f"WITH {_PROFILE_FACTS} SELECT t AS type, COUNT(*) AS n, COUNT(DISTINCT lower(v)) AS n_values, MIN(lower(v)) AS least FROM f GROUP BY t",
    "i23_reports": f"""WITH {SCAN}, {_REPORTS} SELECT sha256(email) AS subject_id, '{{"subject_id":"' || sha256(email) || '","primary_name":"' || {_NAME} || '","provenance":{_VERSIONS},"summary":' || COALESCE(counts, '{_NONE_COUNTED}') || COALESCE(',"findings":[' || array_to_string(blocks, ',') || '],"cases":[' || array_to_string(cases, ',') || ']', '') || '}}' AS report FROM subj LEFT JOIN r ON r.subject_id = sha256(email)""",
    "e11_evaluation": f"""WITH c AS (SELECT c_custkey, 'c' || k || '@mail.example.com' AS on_page, lower('c' || k || '@Mail.Example.com') AS own FROM ({CUSTOMERS})), l AS (SELECT own, c_custkey AS key, 'own' AS tag FROM c UNION ALL SELECT own, c_custkey + 1, 'other' FROM c), r AS (SELECT tag, tag = 'own' AS y, COALESCE(on_page = l.own, FALSE) AS sure FROM l LEFT JOIN c ON key = c_custkey),
g AS (SELECT tag, COUNT(*) FILTER (sure AND y) AS tp, COUNT(*) FILTER (sure AND NOT y) AS fp, COUNT(*) FILTER (NOT sure AND y) AS fn FROM r GROUP BY ROLLUP (tag)) SELECT tag, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, '' AS offenders FROM g""",
    "k4_first_sights_stream": f"SELECT DISTINCT {canonical('url')} AS canonical_url FROM pages",
}

"""Temporary SQL functions; each is an expression that Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "redact(v STRING)": r"""regexp_replace(regexp_replace(regexp_replace(coalesce(v, ''), r'[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[email]'), r'(?U)(?<!\w)\+?\d[\d\s().\-]{6,}\d(?!\w)', '[phone]'), r'(?U)\b\d{7,}\b', '[digits]')""",
    "mask_email(v STRING)": "CASE WHEN instr(trim(v), '@') = 0 THEN repeat('•', greatest(length(trim(v)), 3)) WHEN instr(trim(v), '@') = 1 THEN concat('•••@', substring(trim(v), 2)) ELSE concat(left(trim(v), 1), repeat('•', greatest(instr(trim(v), '@') - 2, 3)), substring(trim(v), instr(trim(v), '@'))) END",
    "mask_phone(v STRING)": r"CASE WHEN length(regexp_replace(v, r'(?U)\D', '')) <= 2 THEN repeat('•', greatest(length(v), 3)) ELSE concat(CASE WHEN ltrim(v) LIKE '+%' THEN '+' ELSE '' END, repeat('•', length(regexp_replace(v, r'(?U)\D', '')) - 2), right(regexp_replace(v, r'(?U)\D', ''), 2)) END",
    "name_tokens(v STRING)": r"filter(split(regexp_replace(lower(coalesce(v, '')), r'(?U)[^\w]+', ' '), ' '), t -> t <> '')",
    "name_match(candidate STRING, names ARRAY<STRING>)": r"size(name_tokens(candidate)) >= 2 AND exists(names, n -> size(filter(split(regexp_replace(lower(n), r'(?U)[^\w]+', ' '), ' '), t -> t <> '')) >= 2 AND array_contains(name_tokens(candidate), filter(split(regexp_replace(lower(n), r'(?U)[^\w]+', ' '), ' '), t -> t <> '')[0]) AND array_contains(name_tokens(candidate), element_at(filter(split(regexp_replace(lower(n), r'(?U)[^\w]+', ' '), ' '), t -> t <> ''), -1)))",
    "severity_rank(s STRING)": "nullif(array_position(array('NONE', 'LOW', 'MODERATE', 'HIGH', 'CRITICAL'), s), 0) - 1",
    "severity_bump(s STRING, steps INT)": "CASE WHEN severity_rank(s) IS NOT NULL THEN array('NONE', 'LOW', 'MODERATE', 'HIGH', 'CRITICAL')[CAST(greatest(least(severity_rank(s) + steps, 4), 0) AS INT)] END",
    "is_actionable(state STRING)": "state IN ('CONFIRMED', 'HIGH_CONFIDENCE')",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    names = []
    for head, body in DEFINITIONS.items():
        name = head.partition("(")[0]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(name)
    return names

"""Search plans for enrolled subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions.text import primary_name

QUERY = "struct<step:int,text:string,sensitive:boolean,rationale:string,site:string,filetype:string>"


def plan_queries(subjects: DataFrame, most: int = 15) -> DataFrame:
    """At most so many queries a subject, in order: name, name and places, name and employers, name in PDFs, usernames, own domains, emails last and marked sensitive. Never a phone.

    (subject_id, position, text, sensitive, rationale, site, filetype, rendered)
    """
    name = F.nullif(primary_name(F.col("names")), F.lit(""))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    null = F.lit(None).cast("string")
    q = lambda step, text, why, sensitive=False, site=null, kind=null: F.struct(F.lit(step).alias("step"), text.alias("text"), F.lit(sensitive).alias("sensitive"), F.lit(why).alias("rationale"), site.alias("site"), kind.alias("filetype")).cast(QUERY)
    each = lambda c, make: F.coalesce(F.transform(c, make), F.array().cast(f"array<{QUERY}>"))
    places = F.flatten(F.transform("locations", lambda x: F.array_compact(F.array(F.nullif(x["city"], F.lit("")), F.nullif(x["country"], F.lit(""))))))
    queries = F.concat(
        F.array(q(0, quoted, "name")), each(places, lambda p: q(1, F.concat(quoted, F.lit(" "), p), "name+location")), each("employers", lambda e: q(2, F.concat(quoted, F.lit(" "), e["name"]), "name+employer")),
        F.array(q(3, quoted, "name+pdf", kind=F.lit("pdf"))), each("usernames", lambda u: q(4, F.concat(F.lit('"'), u, F.lit('"')), "username")), each("personal_domains", lambda d: q(5, F.concat(F.lit("site:"), d), "owned-domain", site=d)),
        each("emails", lambda e: q(6, F.concat(F.lit('"'), e, F.lit('"')), "email", True)),
    )
    kept = F.filter(queries, lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) != "")
    rows = subjects.select("subject_id", F.posexplode(F.slice(kept, 1, most)).alias("position", "q")).select("subject_id", "position", "q.*").drop("step")
    return rows.withColumn("rendered", F.concat_ws(" filetype:", "text", "filetype"))


def runnable(plan: DataFrame, opted_in: DataFrame) -> DataFrame:
    """The plan without sensitive queries of subjects that haven't opted in (opted_in: subject_id)."""
    yes = opted_in.select("subject_id").distinct().withColumn("_yes", F.lit(True))
    return plan.join(yes, "subject_id", "left").where("NOT sensitive OR _yes").drop("_yes")


def sensitive_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("subject_id").agg(F.count("*").alias("n_queries"), F.count_if("sensitive").alias("n_sensitive"))


def top_results(results: DataFrame, most: int = 10) -> DataFrame:
    """The first results of each query, by rank, then url."""
    order = Window.partitionBy("scan_id", "query").orderBy("rank", "url")
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")

"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """Host of a URL: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.

    Empty for a null URL and for one without ``://``.
    """
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """Path of a URL: what follows the host up to ``?``, ``#`` or the end; empty like the host."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(host, path, verdict)`` as a DataFrame for :func:`judge_urls`."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_hex: int = 8,
) -> DataFrame:
    """Judge every URL by the longest rule that fits it.

    A rule ``(host, path, verdict)`` fits its host and all subdomains where the URL's path starts
    with the rule's path. Each URL is expanded into expressions, host suffix times path prefix, in
    the shapes (number of labels, path length) that the rules have, so that no other expression
    could fit any rule. Expressions meet rules in an equi-join on the first ``prefix_hex`` hex
    digits of their SHA-256 digests; the full digest then confirms, and the longest rule wins
    (then the longer host, then ``block``). URLs of any length are read whole, but expanded only in the
    shapes of the rules.

    Spark picks the join by the size of the rule table: lists under its broadcast threshold travel
    to the pages, longer ones are shuffled by hash prefix.

    Returns one row per input row: id, host, path, rule (``host`` + ``path``, null if none fits),
    verdict (the rule's, else ``default``). Null URLs and ids, empty hosts, repeated rows and extra
    columns are fine; an empty table or an empty rule list gives no rows or only defaults.
    """
    listed = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _UPPER.lower()).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).filter(F.col("r_host") != "")
    shapes = listed.select(
        F.sort_array(
            F.collect_set(F.struct(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")))
        )
    ).scalar()
    digested = listed.select(
        F.concat("r_host", "r_path").alias("r_rule"),
        F.length("r_host").alias("r_host_len"),
        "r_verdict",
        F.sha2(F.concat("r_host", "r_path"), 256).alias("r_digest"),
    ).withColumn("r_prefix", F.substring("r_digest", 1, prefix_hex))

    urls = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .groupBy("id", "url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("labels", F.size(F.split("host", r"\.")))
    )
    expressions = (
        urls.withColumn("shapes", shapes)
        .withColumn(
            "expression",
            F.explode_outer(
                F.expr(
                    "transform(filter(shapes, s -> s.labels <= labels and s.chars <= length(path)),"
                    " s -> concat(substring_index(host, '.', -s.labels), substring(path, 1, s.chars)))"
                )
            ),
        )
        .drop("shapes", "labels")
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, prefix_hex))
    )
    found = expressions.join(digested, F.col("prefix") == F.col("r_prefix"), "left")
    hit = F.when(
        F.col("digest") == F.col("r_digest"),
        F.struct(
            F.length("r_rule").alias("length"),
            "r_host_len",
            (F.col("r_verdict") == "block").alias("blocks"),
            F.col("r_rule").alias("rule"),
            F.col("r_verdict").alias("verdict"),
        ),
    )
    judged = found.groupBy("id", "url", "host", "path").agg(F.max(hit).alias("hit"), F.max("copies").alias("copies"))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


#: (host, path, verdict): fixed by the contract of the query.
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every URL of ``pages`` by the five rules of the contract."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, QUERY_RULES))


OP2_SQL = """
WITH rules(r_host, r_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
    SELECT row_number() OVER () AS row_id, page_id,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), urls AS (
    SELECT row_id, page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), fits AS (
    SELECT u.row_id, r.r_host || r.r_path AS rule, r.verdict,
           row_number() OVER (PARTITION BY u.row_id ORDER BY length(r.r_host || r.r_path) DESC) AS nth
    FROM urls u JOIN rules r
      ON (u.host = r.r_host OR ends_with(u.host, '.' || r.r_host)) AND starts_with(u.path, r.r_path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.row_id = u.row_id AND f.nth = 1
"""

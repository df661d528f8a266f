"""URL filter rules by hashed host-suffix / path-prefix expressions.

Each URL is expanded into the expressions "k last host labels + first n
path characters" for the (k, n) shapes that occur in the rules, so the expansion is
exact and bounded by the rule shapes, not by the URL.  Expressions meet rules by an
equi-join on a short SHA-256 prefix; the full digest is compared afterwards and the
longest fitting rule wins (longer text first, then longer host, then block).  A row keeps
a number of its own from the scan on, so all that is shuffled is one row per URL and fitting rule.

Everything is DataFrame functions.  Rules are joined without a hint: Spark
broadcasts them only when their size is below its threshold.

Defined cases: a null URL, or one without ``://``, has empty host and path and gets the
default verdict; repeated rows and repeated ids are judged row by row; null ids stay;
columns other than id and URL are ignored, whatever their names; an empty table gives
an empty result; no rules means the default for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHAPES = 10_000
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) triples as a DataFrame."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict."""
    compiled = (
        rules.select(
            F.lower("host").alias("r_host"),
            F.col("path").alias("r_path"),
            F.col("action").alias("r_action"),
        )
        .where("r_host IS NOT NULL AND r_path IS NOT NULL")
        .groupBy("r_host", "r_path")
        .agg(F.max("r_action").alias("r_action"))  # block over allow for the same expression
        .withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))
    )
    shapes = (
        compiled.select(F.size(F.split("r_host", r"\.")).alias("k"), F.length("r_path").alias("n"))
        .distinct()
        .limit(MAX_SHAPES + 1)
        .collect()
    )
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} rule shapes (host labels x path length)")

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    labels = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.size(labels) >= s.k) & (F.length("path") >= s.n),
            F.concat(
                F.substring_index(F.col("host"), ".", -s.k), F.lit("\n"), F.substring(F.col("path"), 1, s.n)
            ),
        )
        for s in shapes
    ] or [F.lit(None).cast("string")]
    expanded = rows.select(
        "page_id", "row", "host", "path",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_compact(F.array(*expressions)))).alias("e"),
    ).withColumn("digest", F.sha2("e", 256))
    joined = expanded.join(compiled, F.substring("digest", 1, PREFIX_HEX) == F.col("r_prefix"), "left")
    fits = F.col("digest") == F.col("r_digest")
    best = joined.groupBy("row", "page_id", "host", "path").agg(
        F.max(
            F.when(
                fits,
                F.struct(
                    (F.length("r_host") + F.length("r_path")).alias("size"),
                    F.length("r_host").alias("host_size"),
                    F.col("r_action").alias("action"),
                    F.concat("r_host", "r_path").alias("rule"),
                ),
            )
        ).alias("best")
    )
    return best.select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )

"""Log patterns, catalog search and Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

#: Patterns of one regular expression; all of them are tested, in as many expressions as it takes.
ALTERNATIVES = 256
#: Whole words in a row by which patterns and texts meet.
WORDS = 3


def pattern_match(df: DataFrame, patterns: list[str], text: str = "text", matched: str = "matched") -> DataFrame:
    """Adds whether the text contains any pattern; a null text is not matched.  All patterns are tested in the JVM."""
    patterns = sorted({p for p in patterns if p})
    if not patterns:
        return df.withColumn(matched, F.lit(False))
    hits = [F.col(text).rlike("|".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in patterns[i : i + ALTERNATIVES])) for i in range(0, len(patterns), ALTERNATIVES)]
    hit = hits[0]
    for h in hits[1:]:
        hit = hit | h
    return df.withColumn(matched, F.coalesce(hit, F.lit(False)))


def pattern_stats(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    d = pattern_match(df, patterns, text)
    return d.agg(F.lit(len(set(patterns))).alias("patterns"), F.count_if("matched").alias("hits"), F.count_if(~F.col("matched")).alias("misses"))


def pattern_add(known: DataFrame, new: DataFrame) -> DataFrame:
    return known.select("pattern").unionByName(new.select("pattern")).where("pattern <> ''").distinct()


def pattern_persist(known: DataFrame, path: str) -> None:
    """The patterns as a table to start from next time; ``read_patterns`` returns them."""
    materialize(known.select("pattern"), "patterns").write.mode("overwrite").parquet(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pattern string").parquet(path)


def _grams(text: str, n: int) -> Column:
    """The distinct n-grams of a text, in time linear in the text."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _inner(text: str, words: int, cut: int) -> Column:
    """Distinct hashes of so many words in a row, between single spaces; without the ``cut`` outermost words at both ends, which may be parts of words."""
    w = F.split(F.col(text), " ", -1)
    n = F.greatest(F.size(w) - 2 * cut - words + 1, F.lit(0))
    runs = F.arrays_zip(*[F.slice(w, F.lit(cut + 1 + i), n).alias(f"w{i}") for i in range(words)])
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(words)])))


def _with_rare_gram(rows: DataFrame, patterns: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(row, pattern) where the row holds the pattern's rarest gram; patterns with a gram that no text holds are nowhere.

    Grams are runs of ``WORDS`` whole words where a pattern has such inside it, else ``n`` characters.
    """
    worded = F.size(F.split("pattern", " ", -1)) >= WORDS + 2
    p = materialize(patterns.select("pattern", worded.alias("worded")).distinct(), "patterns")
    kinds = {r[0] for r in p.select("worded").distinct().collect()}
    out = None
    for kind in sorted(kinds):
        of_pattern, of_text = (_inner("pattern", WORDS, 1), _inner(text, WORDS, 0)) if kind else (_grams("pattern", n), _grams(text, n))
        of = materialize(p.where(F.col("worded") == kind).select("pattern", F.explode(of_pattern).alias("g")), "pattern-grams")
        held = rows.select(id_col, F.explode(of_text).alias("g"))
        counts = held.select("g").join(of.select("g").distinct(), "g").groupBy("g").agg(F.count(F.lit(1)).alias("texts"))
        rarest = of.join(counts, "g", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "g")).alias("x"))
        rarest = materialize(rarest.where("x.texts > 0").select("pattern", "x.g"), "rare-grams")
        found = held.join(rarest, "g").select(id_col, "pattern")
        out = found if out is None else out.unionByName(found)
    return rows.select(id_col).join(p.select("pattern"), F.lit(True)).limit(0) if out is None else out


def pattern_hits(df: DataFrame, patterns: DataFrame, id_col: str, text: str = "text", n: int = 8) -> DataFrame:
    """One row per (row, contained pattern).

    Patterns of at least ``n`` characters meet texts by an equi-join on that gram of theirs (words in a row, or ``n`` characters) which the fewest
    texts hold (a common opening brings nobody together); shorter ones by the same join on the n-grams of their own length.
    """
    p = patterns.select("pattern").where("pattern <> ''").distinct()
    rows = df.select(F.col(id_col), F.col(text)).where(F.col(text).isNotNull())
    maybe = _with_rare_gram(rows, p.where(F.length("pattern") >= n), id_col, text, n).distinct()
    found = rows.join(maybe, id_col).where(F.col(text).contains(F.col("pattern"))).select(id_col, "pattern")
    short = p.where(F.length("pattern") < n)
    lengths = [r[0] for r in short.select(F.length("pattern")).distinct().collect()]  # below n
    if not lengths:
        return found.distinct()
    parts = [_grams(text, i) for i in lengths]
    few = rows.select(id_col, F.explode(F.concat(*parts)).alias("pattern")).join(short, "pattern").select(id_col, "pattern")
    return found.unionByName(few).distinct()


def catalog_insert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Appends (record_id, key, meta) rows; an existing key, or a later row of the same key, is rejected."""
    first = new.groupBy("key").agg(F.min_by(F.struct("record_id", "meta"), "record_id").alias("x")).select("x.record_id", "key", "x.meta")
    return catalog.unionByName(first.join(catalog, "key", "left_anti").select(*catalog.columns))


def catalog_search(catalog: DataFrame, pattern: str, depth: int, offset: int = 0, limit: int = 100) -> DataFrame:
    """Keys that contain the pattern and have at most depth + 1 characters, in order; an empty pattern finds nothing."""
    hit = F.col("key").contains(pattern) & (F.length("key") <= depth + 1) & F.lit(bool(pattern))
    return catalog.where(hit).dropDuplicates(["key"]).orderBy("key").offset(offset).limit(limit)


def catalog_prefix(catalog: DataFrame, prefix: str) -> DataFrame:
    return catalog.where(F.col("key").startswith(prefix) & F.lit(bool(prefix)))


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """Bits (a power of two, at least 64) and hashes for ``n`` keys."""
    bits = max(64, 1 << math.ceil(math.log2(max(1.0, -n * math.log(fpr) / math.log(2) ** 2))))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def _spots(col: Column, bits: int, hashes: int) -> Column:
    a, b = F.pmod(F.xxhash64(col), F.lit(bits)), F.pmod(F.xxhash64(col, F.lit("second")), F.lit(bits))
    return F.array(*[F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)])


def bloom_build(df: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The filter as rows (word, mask) of 64-bit words."""
    d = df.where(F.col(key).isNotNull()).select(F.explode(_spots(F.col(key), bits, hashes)).alias("s"))
    return d.selectExpr("s div 64 AS word", "shiftleft(1L, cast(s % 64 AS int)) AS m").groupBy("word").agg(F.bit_or("m").alias("mask"))


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_fpr(bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    return bloom.agg(F.pow(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)) / bits, F.lit(hashes)).alias("fpr"))


def bloom_contains(df: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows of distinct keys with ``maybe``: never false for a key that was added."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    d = keys.select(key, F.explode(_spots(F.col(key), bits, hashes)).alias("s")).selectExpr(key, "s div 64 AS word", "cast(s % 64 AS int) AS bit")
    d = d.join(bloom, "word", "left").selectExpr(key, "coalesce((shiftrightunsigned(mask, bit) & 1) = 1, false) AS hit")
    return d.groupBy(key).agg(F.bool_and("hit").alias("maybe"))

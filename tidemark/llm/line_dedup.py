"""Removal of lines that several documents share, by built-in functions only.

Each line long enough becomes a row of hashes, document and position: texts aren't moved to find repeats.
Rows are dealt by ranges of the hash and sorted inside by (hash, document, position), so that a window streams
over them: the first document it meets keeps the line (the one of the largest id), rows of later ones are marked.

A very frequent line would be one long run in one range.  A sketch of bounded size finds the hashes that
hold more than a part of a range; their documents are dealt to several ranges, and one small row
per range says how many documents it saw and which came first.  The sketch only steers how rows are dealt: with any other choice
the result is the same.

The result is, for each document that loses lines, its bitmap of kept lines as runs - not its text.
Lines are taken as equal if 96 bits of two hashes are equal.

Defined cases: a null or empty text is one empty line; rows with a null id count together as one document below all others;
rows of the same id count as one document, each with its own bitmap; lines shorter than ``min_chars`` code points always stay;
very long texts are handled whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that lower() changes in A-Z only: ASCII, Latin small letters and signs, punctuation, and unicase scripts.
SAFE_TO_LOWER = r"\A[\x00-\x7F\xA0-\xBF\xDF-\xFF‐-⁄　-鿿가-힣]*\z"
#: Size of the sketch of frequent lines, and how many of them it may name: both bound what the driver holds.
TRACKED, NAMED = 100_000, 10_000


def lowered(key: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(key.rlike(SAFE_TO_LOWER), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _version(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.hash(F.coalesce(text.cast("string"), F.lit("")))


def _hashed_lines(documents: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.col(text_col)
    lines = documents.select(F.col(id_col).cast("long").alias("doc_id"), _version(text).alias("version"), split_lines(text).alias("lines"))
    lines = lines.select("doc_id", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keys = lines.withColumn("key", F.trim("line", F.lit(WHITE))).where(F.length("key") >= min_chars).withColumn("key", lowered(F.col("key")))
    return keys.select(
        F.xxhash64("key").alias("h1"), F.hash(F.lit(1), "key").alias("h2"), "doc_id", "version", "pos", "n_lines",
    )


def _frequent(lines: DataFrame, ranges: int) -> DataFrame:
    """(h1, salts): hashes that hold more than a fourth of an even range, and among how many ranges to deal their documents."""
    found = lines.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(h1, {NAMED}, {TRACKED})").alias("top"))
    share = F.greatest(F.lit(1000), F.ceil(F.col("rows") / (4 * ranges)))
    named = found.select(share.alias("share"), F.explode("top").alias("t")).where("t.count > share")
    rows = named.select(F.col("t.item").alias("h1"), F.ceil(F.col("t.count") / F.col("share")).cast("int").alias("salts"))
    return materialize(rows, "frequent-lines")


def keep_bitmaps(
    documents: DataFrame, *, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, version, n_lines, n_dropped, keep of each document that loses lines; all others keep all of theirs.

    ``keep`` is the bitmap of kept lines as runs: array of (first, lines), from line 0.  ``version`` is a hash of the text (`_version`): it
    tells rows of one id apart.  A line found in ``min_docs`` documents stays in the one of the largest id only.
    """
    ranges = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _hashed_lines(documents, id_col, text_col, min_chars)
    frequent = _frequent(lines, ranges).withColumnRenamed("h1", "hot")
    dealt = lines.join(F.broadcast(frequent), F.col("h1") == F.col("hot"), "left")  # at most NAMED rows
    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")
    rows = dealt.select("h1", salt.alias("salt"), "h2", "doc_id", "version", "pos", "n_lines").repartitionByRange("h1", "salt")
    same = Window.partitionBy("h1", "salt", "h2")
    stream = same.orderBy(F.col("doc_id").desc_nulls_last(), "version", "pos")
    fresh = (F.row_number().over(stream) == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    seen = rows.withColumns({"fresh": fresh.cast("int"), "top": F.first("doc_id").over(stream)}).withColumn("docs", F.sum("fresh").over(same))
    open_ = F.col("salt").isNotNull()
    later = ~F.col("doc_id").eqNullSafe(F.col("top"))
    marked = seen.where(open_ | ((F.col("docs") >= min_docs) & later))
    marked = materialize(marked.select("h1", "salt", "h2", "doc_id", "version", "pos", "n_lines", "docs", "top"), "line-marks")

    # Ranges of one frequent line meet by one row each.
    each = marked.where(open_).groupBy("h1", "h2", "salt").agg(F.max("docs").alias("docs"), F.max("top").alias("top"))
    whole = each.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("top").alias("first")).where(F.col("all_docs") >= min_docs)
    row = ["doc_id", "version", "pos", "n_lines"]
    hot = marked.where(open_).join(F.broadcast(whole), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select(*row)
    drops = marked.where(~open_).select(*row).unionByName(hot).distinct()
    runs = drops.groupBy("doc_id", "version", "n_lines").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    keep = F.expr("""
        filter(transform(sequence(0, size(p)), i -> struct(
          if(i = 0, 0, get(p, i - 1) + 1) AS first,
          if(i = size(p), n_lines, get(p, i)) - if(i = 0, 0, get(p, i - 1) + 1) AS lines)), r -> r.lines > 0)""")
    return runs.select("doc_id", "version", "n_lines", F.size("p").cast("long").alias("n_dropped"), keep.alias("keep"))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept lines as ``text``, for every row of ``documents``."""
    text = F.col(text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), _version(text).alias("version"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("version").alias("b_version"), "n_dropped", "keep")
    met = rows.join(b.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("version") == F.col("b_version")), "left")
    lines = split_lines(F.col("text"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(F.col("lines"), r["first"] + 1, r["lines"]))), "\n")
    met = met.withColumn("lines", lines)
    return met.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


def digests(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and SHA-256 of the kept lines of every document."""
    return apply_bitmaps(documents, bitmaps).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

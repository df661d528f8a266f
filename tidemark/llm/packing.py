"""Optimal length buckets and token-budget batches.

Texts longer than ``max_len`` tokens are cut into pieces, so the global histogram of
piece lengths has at most ``max_len + 1`` bins.  Dynamic programming over it chooses the bucket
boundaries with the least padding.  Inside each bucket, rows are dealt to shards of
bounded size (their number follows the bucket's count), and batches of ``budget // boundary``
rows are numbered within each shard: no bucket is ever ranked by one task.

Lengths are words, or the numbers of ``length_col`` where the caller has token counts (those of an encoder's ids, say);
every row names the range of its text's tokens that it holds.

Defined cases: null lengths count as 0, negative ones too; null texts and texts without tokens are one piece of length 0; null ids and
repeated rows are packed like others; ties in a shard are broken by id and piece; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 16_384
SHARD_BATCHES = 64
SHARD_ROWS = 4_096


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (lengths that occur) of at most ``buckets`` buckets with the least total padding."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths)[order], np.asarray(counts, np.float64)[order]
    n = len(lengths)
    if n <= buckets:
        return lengths.tolist()
    rows = np.concatenate(([0.0], np.cumsum(counts)))
    total = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choice = np.zeros((buckets, n + 1), np.int64)
    starts = np.arange(n)
    for k in range(buckets):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (total[j] - total[:j])
            choice[k, j] = starts[:j][np.argmin(cost)]
            new[j] = cost[choice[k, j]]
        best = np.minimum(new, np.inf)
    bounds, j = [], n
    for k in range(buckets - 1, -1, -1):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(choice[k, j])
    return bounds[::-1]


def pieces(documents: DataFrame, *, id_col: str, text_col: str, max_len: int, length_col: str | None = None) -> DataFrame:
    """doc_id, piece, n_tokens, row (null but for null ids): tokens of each text, cut every ``max_len``."""
    counted = F.col(length_col) if length_col else F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    n = F.greatest(F.coalesce(counted.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)) - 1
    # Rows without an id are told apart by their place, so that they don't meet in one shard.
    rows = rows.select("doc_id", "n", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"))
    return rows.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * max_len).alias("n_tokens"), "row"
    )


def pack(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    length_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bucket (from 0), bucket_len, batch_id, token_start, token_end (exclusive)."""
    if budget < max_len:
        raise ValueError("the budget must hold the longest piece")
    spark = documents.sparkSession
    rows = materialize(pieces(documents, id_col=id_col, text_col=text_col, max_len=max_len, length_col=length_col), "pieces")
    hist = rows.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    lengths = np.array([r["n_tokens"] for r in hist], np.int64)
    counts = np.array([r["count"] for r in hist], np.int64)
    bounds = bucket_bounds(lengths, counts, buckets)
    table = []
    place = np.searchsorted(bounds, lengths)
    for b, bound in enumerate(bounds):
        size = int(counts[place == b].sum())
        per = max(1, budget // max(1, bound))
        table.append((b, bound, per, -(-size // max(SHARD_ROWS, SHARD_BATCHES * per)) or 1))
    plan = {int(x): table[int(b)] for x, b in zip(lengths, place, strict=True)}
    shape = spark.createDataFrame(
        [(x, *row) for x, row in plan.items()] or [(0, 0, 0, 1, 1)],
        "n_tokens long, bucket int, bucket_len long, per long, shards long",
    )
    dealt = rows.join(F.broadcast(shape), "n_tokens").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.col("shards")))
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "row", "piece")
    place_in = F.floor((F.row_number().over(order) - 1) / F.col("per"))
    return dealt.select(
        "doc_id", "piece", "n_tokens", "bucket", "bucket_len", F.concat_ws("-", "bucket", "shard", place_in).alias("batch_id"),
        (F.col("piece") * max_len).alias("token_start"), (F.col("piece") * max_len + F.col("n_tokens")).alias("token_end"),
    )

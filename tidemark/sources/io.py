"""Sources and sinks: CSV, JSON and block-lake readers, station tables, alerts, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.timeseries import dedup_exact
from tidemark.schema import OBS_SCHEMA
from tidemark.sources.scratch import materialize

_OBS = "struct<ts bigint, metric_id string, kind string, signal string, value double, labels map<string,string>, severity string>"
FIELDS = ("o", "h", "l", "c", "v")


def _ohlcv_rows(df: DataFrame, symbol: str, resolution: str) -> DataFrame:
    """(ts, o, h, l, c, v) rows as five observations each; rows with a missing cell are dropped."""
    d = df.dropna(subset=["ts", *FIELDS])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(f).alias("value")) for i, f in enumerate(FIELDS)])
    d = d.select("ts", F.explode(cells).alias("x"))
    labels = F.create_map(F.lit("field"), F.col("x.field"), F.lit("resolution"), F.lit(resolution))
    return d.select(
        "ts", F.lit(symbol).alias("metric_id"), F.lit("metric").alias("kind"), F.lit("raw").alias("signal"), F.col("x.value").alias("value"),
        labels.alias("labels"), F.lit(None).cast("string").alias("severity"), F.col("x.i").cast("bigint").alias("seq"),
    )


def read_ohlcv_csv(spark: SparkSession, path: str, *, columns: tuple[int, ...] = (0, 1, 2, 3, 4, 5), has_header: bool = True, unit_ms: int = 1000, symbol: str = "", resolution: str = "") -> DataFrame:
    """Six columns by index (t, o, h, l, c, v); ragged rows are fine, rows with a cell that is no number are dropped."""
    width = max(columns) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.csv(path, schema=schema, header=has_header, enforceSchema=True, mode="PERMISSIVE")
    names = ("t", *FIELDS)
    d = raw.select(*[F.trim(f"c{i}").try_cast("double").alias(n) for n, i in zip(names, columns, strict=True)])
    return _ohlcv_rows(d.withColumn("ts", F.floor(F.col("t") * unit_ms / 1000).cast("bigint")), symbol, resolution)


def parse_observation_envelope(c: Column) -> Column:
    """Observations of a message: an array, one object, or either below ``data`` or ``observations`` at any depth; else none.

    What is still to be looked at is a stack of JSON texts: an envelope is replaced by its ``data`` and then its ``observations``; the first that
    holds observations decides.  There are at most as many looks as the text has such names.
    """
    def direct(x: Column) -> Column:
        return F.when(F.ltrim(x).startswith("["), F.from_json(x, f"array<{_OBS}>")).when(
            F.get_json_object(x, "$.metric_id").isNotNull(), F.array(F.from_json(x, _OBS))
        )

    none = F.array().cast(f"array<{_OBS}>")

    def look(state: Column, _: Column) -> Column:
        top = F.get(state["todo"], F.lit(0))
        found = F.when(F.size(state["found"]) > 0, state["found"]).otherwise(F.coalesce(direct(top), none))
        inner = F.array_compact(F.array(F.get_json_object(top, "$.data"), F.get_json_object(top, "$.observations")))
        rest = F.concat(inner, F.slice(state["todo"], 2, F.greatest(F.lit(0), F.size(state["todo"]) - 1)))
        return F.struct(F.when(F.size(found) > 0, F.array().cast("array<string>")).otherwise(rest).alias("todo"), found.alias("found"))

    looks = F.coalesce(2 * (F.regexp_count(c, F.lit("\"(data|observations)\""))), F.lit(0))
    start = F.struct(F.array_compact(F.array(c)).alias("todo"), none.alias("found"))
    deep = F.aggregate(F.sequence(F.lit(0), looks), start, look, lambda s: s["found"])
    return F.coalesce(F.when(looks == 0, direct(c)).otherwise(deep), none)


def read_observation_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observations of JSON files (whole-file bodies), and the items that lack ts, metric or value."""
    d = spark.read.text(path, wholetext=True).select(F.explode(parse_observation_envelope(F.col("value"))).alias("o")).select("o.*")
    ok = F.col("ts").isNotNull() & F.col("metric_id").isNotNull() & F.col("value").isNotNull()
    return d.where(ok), d.where(~ok)


def parse_candle_json(df: DataFrame, column: str, mapping: dict[str, str], *, unit_ms: int = 1000, symbol: str = "", resolution: str = "") -> DataFrame:
    """Six JSON paths (t, o, h, l, c, v) read column-wise and zipped; numbers may be text; incomplete rows are dropped."""
    from tidemark.functions.scalar import json_path

    names = ("t", *FIELDS)
    d = df.select(F.arrays_zip(*[json_path(F.col(column), mapping[n]).alias(n) for n in names]).alias("z")).select(F.explode("z").alias("z"))
    d = d.select(*[F.regexp_replace(F.col(f"z.{n}"), '"', "").try_cast("double").alias(n) for n in names])
    return _ohlcv_rows(d.withColumn("ts", F.floor(F.col("t") * unit_ms / 1000).cast("bigint")), symbol, resolution)


_PROM = "struct<status string, data struct<resultType string, result array<struct<metric map<string,string>, value array<string>, values array<array<string>>>>>>"


def parse_prometheus(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Samples of API responses (vector or matrix; ``__name__`` is the metric), and the responses that aren't a success."""
    r = df.select(F.col(column).alias("body"), F.from_json(column, _PROM).alias("r"))
    good = F.coalesce(F.col("r.status") == "success", F.lit(False))
    errors = r.where(~good).select(F.coalesce("r.status", F.lit("unreadable")).alias("status"), "body")
    d = r.where(good).select(F.explode("r.data.result").alias("s"))
    d = d.select("s.metric", F.explode(F.coalesce("s.values", F.array("s.value"))).alias("p"))
    samples = d.select(
        F.floor(F.col("p")[0].try_cast("double")).cast("bigint").alias("ts"), F.coalesce(F.col("metric")["__name__"], F.lit("unknown")).alias("metric_id"),
        F.col("p")[1].try_cast("double").alias("value"), F.map_filter("metric", lambda k, _: k != "__name__").alias("labels"),
    ).where("ts IS NOT NULL AND value IS NOT NULL")
    return samples, errors


def read_block_lake(spark: SparkSession, path: str, block_secs: int, lo: int, hi: int, metric: str | None = None) -> DataFrame:
    """Rows lo < ts <= hi of a lake of JSON blocks (``ts/blk=<id>``); blocks are pruned by partition."""
    if hi // block_secs - lo // block_secs > 10_000:
        raise ValueError("more than 10 000 blocks")
    d = spark.read.option("basePath", path).parquet(path).where(F.col("blk").between(lo // block_secs, hi // block_secs))
    items = F.from_json(F.get_json_object("value", "$.items"), f"array<{_OBS}>")
    d = d.select(F.explode(items).alias("o")).select("o.*").where((F.col("ts") > lo) & (F.col("ts") <= hi))
    return (d if metric is None else d.where(F.col("metric_id") == metric)).orderBy("ts")


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_blocks(df: DataFrame, station: str, block_secs: int) -> DataFrame:
    return df.withColumn("station", F.lit(station)).withColumn("blk", F.floor(F.col("ts") / block_secs).cast("bigint"))


def _key() -> Column:
    """What makes two observations the same row."""
    return F.to_json(F.struct("ts", "metric_id", "kind", "signal", "value", F.array_sort(F.map_entries("labels")).alias("labels"), "severity"))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def write_station(df: DataFrame, path: str, station: str, block_secs: int, *, allowed: set[str] | None = None, mode: str = "append") -> None:
    """Rows partitioned by station and block, exact copies removed: those of the batch and, when appending, those already stored in the touched blocks.

    Mode ``overwrite`` replaces the touched blocks only.  Blocks are written by as many tasks as their size asks for.
    Appending compares with what is stored when it starts: a block must have one writer at a time.
    """
    if allowed is not None and station not in allowed:
        raise ValueError(f"station {station!r} may not be written")
    spark, d = df.sparkSession, with_blocks(dedup_exact(df), station, block_secs)
    if mode == "append" and _exists(spark, f"{path}/station={station}"):
        stored = read_station(spark, path, station).join(d.select("blk").distinct(), "blk", "left_semi")
        d = d.withColumn("__key", _key()).join(stored.select(_key().alias("__key"), "blk"), ["__key", "blk"], "left_anti").drop("__key")
        d = materialize(d, "new-rows")
    d.hint("rebalance", "blk").write.partitionBy("station", "blk").option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def read_station(spark: SparkSession, path: str, station: str) -> DataFrame:
    return spark.read.schema(f"{OBS_SCHEMA}, station string, blk bigint").parquet(path).where(F.col("station") == station)


def retained(df: DataFrame, keep_after_ts: int, block_secs: int) -> DataFrame:
    """Whole blocks before the cutoff's block go; the boundary block stays whole."""
    return df.where(F.col("blk") >= keep_after_ts // block_secs)


def _drop_blocks(spark: SparkSession, path: str, gone) -> list[tuple[str, int]]:
    """Deletes the block folders (station, blk) that ``gone`` names; only folder names are listed, not rows."""
    files, at = _folder(spark, path)
    out = []
    for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "station=*/blk=*")) or []:
        folder = found.getPath()
        station, blk = folder.getParent().getName().removeprefix("station="), int(folder.getName().removeprefix("blk="))
        if gone(station, blk):
            files.delete(folder, True)
            out.append((station, blk))
    return sorted(out)


def retain(spark: SparkSession, path: str, keep_after_ts: int, block_secs: int) -> list[tuple[str, int]]:
    """Deletes stored blocks before the cutoff's block; the boundary block stays whole.  Returns what went."""
    return _drop_blocks(spark, path, lambda _, blk: blk < keep_after_ts // block_secs)


def invalidate_station(spark: SparkSession, path: str, station: str, from_ts: int, block_secs: int) -> None:
    """Deletes a station's stored rows from ``from_ts`` on: of the boundary block its later rows, then later blocks whole."""
    first = from_ts // block_secs
    edge = read_station(spark, path, station).where((F.col("blk") == first) & (F.col("ts") < from_ts))
    kept = materialize(edge, "boundary-block")
    # What has to stay is in its place before anything goes: a job that dies leaves rows too many, and may be run again.
    if kept.isEmpty():
        _drop_blocks(spark, path, lambda s, blk: s == station and blk == first)
    else:
        kept.write.partitionBy("station", "blk").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    _drop_blocks(spark, path, lambda s, blk: s == station and blk > first)


def clear_station(spark: SparkSession, path: str, station: str) -> str:
    """Deletes a station's rows; its folder (the registry) stays.  Returns the kinds that it held."""
    kinds = read_station(spark, path, station).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("k")).first()["k"]
    _drop_blocks(spark, path, lambda s, _: s == station)
    return kinds


def clear_all_stations(spark: SparkSession, path: str) -> list[str]:
    """Deletes the rows of all stations and returns their names."""
    return sorted({s for s, _ in _drop_blocks(spark, path, lambda *_: True)})


def merge_hot_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Both tiers with exact copies removed."""
    return dedup_exact(hot.unionByName(cold, allowMissingColumns=True))


def file_sink(df: DataFrame, path: str) -> None:
    """One JSON line for each row, appended."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def null_sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def print_sink(df: DataFrame) -> None:
    """Rows on the console; a stream until all that is available is there."""
    if df.isStreaming:
        df.writeStream.format("console").trigger(availableNow=True).start().awaitTermination()
    else:
        df.show(truncate=False)


def capture_sink(df: DataFrame, name: str, max_messages: int = 1000) -> DataFrame:
    """The first messages of a stream, kept in memory as table ``name``: a look at a stream, bounded by ``max_messages``."""
    if max_messages < 1:
        raise ValueError("the capacity must be at least 1")
    df.limit(max_messages).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def alert_payloads(df: DataFrame, limit: int = 4096) -> DataFrame:
    """Event JSON for a notifier; payloads above ``limit`` UTF-16 units are rejected, never cut."""
    d = df.withColumn("payload", F.to_json(F.struct("*")))
    units = (F.octet_length(F.encode("payload", "UTF-16LE")) / 2).cast("long")
    return d.withColumn("units", units).withColumn("accepted", F.col("units") <= limit)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def export_arrow(df: DataFrame, path: str, *, max_rows: int = 1_000_000) -> int:
    """A result as one Arrow file on the driver; larger ones are refused (see `export_arrow_parts`).  Returns the rows written."""
    found = df.limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} rows: export as Parquet")
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, found.schema) as out:
        out.write_table(found)
    return found.num_rows


def export_arrow_parts(df: DataFrame, path: str) -> None:
    """A result of any size as a table of whole Arrow files (column ``arrow``; ``rows`` in each), written by the tasks that hold the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows", "arrow"])

    df.mapInArrow(run, "rows long, arrow binary").write.option("parquet.block.size", 16 << 20).parquet(path)


def read_arrow_parts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of `export_arrow_parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                with pa.ipc.open_file(file.as_buffer()) as f:
                    yield from (f.get_batch(i) for i in range(f.num_record_batches))

    return spark.read.parquet(path).select("arrow").mapInArrow(run, schema)

"""Sharding: contiguous shards of near-equal bytes by global prefix sums.

The rows are range-partitioned by doc_id.  Each partition's total is summed, the totals become
offsets, and each row's global byte offset is its partition's offset plus the running sum inside
it.  The shard of a row is where the middle of its byte range falls among equal cuts, so shards are
contiguous in doc_id order and their sizes differ from the target by less than one row.

Only a digest (id, size, checksum) is shuffled, never the texts.  Two numbers a partition and one a
shard reach the driver; they grow with partitions and not with rows.

Edge cases: null ids come first; a null text is empty; rows that agree in doc_id, size and checksum
are interchangeable and may swap slots; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

#: Bytes that each row costs besides its text.
ROW_BYTES = 16


def _digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def byte_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard)."""
    spark = prepare(docs.sparkSession)
    # A last key that differs between equal rows lets the range split a group of them.
    digest = _digest(docs).withColumn("tie", F.monotonically_increasing_id() % 8192)
    keys = ("doc_id", "size", "text_crc32", "tie")
    held = written(digest.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "shards")
    totals = held.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    offsets, bytes_before, rows_before = [], 0, 0
    for r in totals:
        offsets.append((r["part"], bytes_before, rows_before))
        bytes_before += r["bytes"]
        rows_before += r["rows"]
    at = spark.createDataFrame(offsets, "part int, bytes_before bigint, rows_before bigint")
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumn("end", F.sum("size").over(inside)).withColumn("row", F.count("*").over(inside))
    middle = F.expr("bytes_before + end - (size + 1) div 2")
    placed = run.join(F.broadcast(at), "part").select(  # a row for each partition
        "doc_id",
        "size",
        "text_crc32",
        F.call_function("div", middle * shards, F.lit(max(bytes_before, 1)).cast("long")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row") - 1).alias("row"),
    )
    placed = written(placed, "shards")
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    first, seen = [], 0
    for s in range(shards):
        first.append(seen)
        seen += counts.get(s, 0)
    begin = F.element_at(F.array(*[F.lit(n).cast("long") for n in first]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - begin).alias("slot"))


def oracle(shards: int = 40) -> str:
    """DuckDB SQL for the rows of byte_shards with law and grown_shard, by sorting; CRC-32 a byte at a time."""
    return f"""
    WITH RECURSIVE
    bits AS (
      SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL
      SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    codes AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    plain AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    digest AS (
      SELECT doc_id, (len(h) // 2 + {ROW_BYTES})::BIGINT AS size,
             xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda b: ('0x' || h[2 * b + 1 : 2 * b + 2])::BIGINT)),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
      FROM plain, codes),
    run AS (
      SELECT *, sum(size) OVER w - (size + 1) // 2 AS middle, sum(size) OVER () AS total, row_number() OVER w AS place
      FROM digest WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
    placed AS (SELECT *, (middle * {shards} // total)::INTEGER AS shard FROM run)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard
    FROM placed"""

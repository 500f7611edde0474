"""Difference of two snapshots of a table, with rows found again under another key.

A full outer sort-merge join on the key pairs the rows that kept theirs.  Of the rows left unpaired on
either side, those with equal content pair by rank: the i-th smallest earlier key with the i-th largest
later key, joined null-safely on content and rank.  What is left then was inserted or deleted.

Texts are not moved.  A row is shuffled as its key, the SHA-256 of each long column and the other compared
columns.  Ranks come from the two-pass scan (``operators.scan``), so neither a key nor a content that many
rows share meets in one task: the rows of a group are dealt over ranges, and joins are on (group, rank),
which is unique on each side.  One row a range is broadcast and goes through one task.

Edge cases: nulls equal only nulls, in keys as in columns.  Keys that repeat pair one to one, the i-th row of
the earlier snapshot with the i-th of the later, both in order of content; the rest stays unpaired.  Rows that
agree in everything are interchangeable.  Texts of any length are hashed whole.  An empty snapshot makes all
rows of the other inserts or deletes.  Columns other than the key and the compared ones are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import prepare, written

#: Compared columns, and those of them that are compared by SHA-256 of their text.
COMPARED, HASHED = ("text", "lang", "source"), ("text",)


def row_digest(compared: Sequence[str] = COMPARED) -> Column:
    """SHA-256 of the columns as text, null as ``~``, joined by line feeds."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in compared]), 256)


def content_id(compared: Sequence[str] = COMPARED) -> Column:
    """128 bits of SHA-256 of the columns as text, each with its length, in hexadecimal digits."""
    held = [F.coalesce(F.concat(F.octet_length(s := F.col(c).cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for c in compared]
    return F.substring(F.sha2(F.concat_ws("", *held), 256), 1, 32)


def _digest(rows: DataFrame, key: str, compared: Sequence[str], hashed: Sequence[str], *more: Column) -> DataFrame:
    columns = [F.unhex(F.sha2(F.col(c).cast("string"), 256)) if c in hashed else F.col(c) for c in compared]
    # What is ranked is ordered by this short identity, so that the samples of Spark's range partitioner stay short.
    own = F.unhex(content_id(compared)).alias("content")
    return rows.select(F.col(key).alias("key"), own, *[c.alias(f"c{i}") for i, c in enumerate(columns)], *more)


def _named(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns])


def _outer(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Both sides' rows, paired where the columns and the rank are null-safely equal."""
    same = F.col("old_rank") == F.col("new_rank")
    for c in on:
        same &= F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return _named(old, "old").hint("merge").join(_named(new, "new"), same, "full_outer")


def _ranks(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return running(rows, order, {"rank": F.lit(1).cast("long")}, by)


def changes(earlier: DataFrame, later: DataFrame, key: str = "doc_id", compared: Sequence[str] = COMPARED, hashed: Sequence[str] = HASHED) -> DataFrame:
    """key, old_key, op (same, update, rekey, insert, delete), changed, row_sha256: a row for each pair or unpaired row.

    key is the later row's, for a delete the earlier's; old_key is null for an insert.  changed names the columns
    in which an updated pair differs; row_sha256 is row_digest() of the later row.
    """
    prepare(earlier.sparkSession)
    content = [f"c{i}" for i in range(len(compared))]
    old = _digest(earlier, key, compared, hashed)
    new = _digest(later, key, compared, hashed, F.unhex(row_digest(compared)).alias("row"))
    old, new = (_ranks(rows, ("key",), [F.col("content")]) for rows in (old, new))
    joined = written(_outer(old, new, ("key",)), "snapshot-pairs")
    row = F.lower(F.hex("new_row")).alias("row_sha256")
    here, there = F.col("old_rank").isNotNull(), F.col("new_rank").isNotNull()
    differs = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(name)) for c, name in zip(content, compared)]
    changed = F.concat_ws(",", *differs)
    pairs = joined.filter(here & there).select(
        F.col("new_key").alias("key"),
        F.col("old_key"),
        F.when(changed == "", "same").otherwise("update").alias("op"),
        changed.alias("changed"),
        row,
    )
    gone = joined.filter(~there).select(*[F.col(f"old_{c}").alias(c) for c in ("key", "content", *content)])
    come = joined.filter(~here).select(*[F.col(f"new_{c}").alias(c) for c in ("key", "content", *content, "row")])
    rekeyed = _outer(_ranks(gone, ("content",), [F.asc("key")]), _ranks(come, ("content",), [F.desc("key")]), content)
    rest = rekeyed.select(
        F.when(there, F.col("new_key")).otherwise(F.col("old_key")).alias("key"),
        F.col("old_key"),
        F.when(here & there, "rekey").when(there, "insert").otherwise("delete").alias("op"),
        F.lit("").alias("changed"),
        row,
    )
    return pairs.unionByName(rest)


def later_documents(docs: DataFrame) -> DataFrame:
    """The later snapshot that the query compares: what happens to a row follows from CRC-32 of its doc_id, modulo 10.

    0 drops it; 1 appends ``+`` to the text; 2 swaps lang and source; 3 changes the key to -1 - key; 4 does so and
    sets source null; 5 adds a copy under that key.  A null doc_id leaves the row as it is.
    """
    kind = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10, F.lit(9))
    held = docs.select("doc_id", "text", "lang", "source", kind.alias("kind")).filter("kind <> 0")
    moved = -1 - F.col("doc_id")
    keys = F.when(F.col("kind").isin(3, 4), F.array(moved)).when(F.col("kind") == 5, F.array(F.col("doc_id"), moved)).otherwise(F.array("doc_id"))
    swapped = F.col("kind") == 2
    return held.select(
        F.explode(keys).alias("doc_id"),
        F.when(F.col("kind") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swapped, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(swapped, F.col("lang")).when(F.col("kind") != 4, F.col("source")).alias("source"),
    )


def oracle() -> str:
    """DuckDB SQL for the rows of changes() between documents and later_documents(); CRC-32 a byte at a time."""
    own = "substr(sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in COMPARED) + "), 1, 32)"
    return f"""
    WITH RECURSIVE
    bits AS (
      SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL
      SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    codes AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    kinds AS (
      SELECT doc_id, text, lang, source, coalesce(xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(len(doc_id::VARCHAR)), lambda b: ascii(substr(doc_id::VARCHAR, b + 1, 1))::BIGINT)),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10, 9) AS kind
      FROM documents, codes),
    later AS (
      SELECT unnest(CASE WHEN kind IN (3, 4) THEN [-1 - doc_id] WHEN kind = 5 THEN [doc_id, -1 - doc_id] ELSE [doc_id] END) AS key,
             CASE WHEN kind = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
             CASE WHEN kind = 2 THEN source ELSE lang END AS lang,
             CASE WHEN kind = 2 THEN lang WHEN kind <> 4 THEN source END AS source
      FROM kinds WHERE kind <> 0),
    o AS (SELECT doc_id AS key, text, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY {own}) AS n FROM documents),
    w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {own}) AS n FROM later),
    p AS (
      SELECT o.key AS ok, o.text AS ot, o.lang AS ol, o.source AS os, o.n AS o_n, w.*, w.n AS w_n
      FROM o FULL OUTER JOIN w ON o.key IS NOT DISTINCT FROM w.key AND o.n = w.n),
    gone AS (SELECT ok, ot, ol, os, row_number() OVER (PARTITION BY ot, ol, os ORDER BY ok NULLS FIRST) AS r FROM p WHERE w_n IS NULL),
    come AS (SELECT key, text, lang, source, row_number() OVER (PARTITION BY text, lang, source ORDER BY key DESC NULLS LAST) AS r FROM p WHERE o_n IS NULL),
    q AS (
      SELECT gone.*, come.*, gone.r AS gone_r, come.r AS come_r FROM gone FULL OUTER JOIN come
      ON ot IS NOT DISTINCT FROM text AND ol IS NOT DISTINCT FROM lang AND os IS NOT DISTINCT FROM source AND gone.r = come.r),
    all_rows AS (
      SELECT key, ok AS old_key, text, lang, source,
             concat_ws(',', CASE WHEN ot IS DISTINCT FROM text THEN 'text' END, CASE WHEN ol IS DISTINCT FROM lang THEN 'lang' END, CASE WHEN os IS DISTINCT FROM source THEN 'source' END) AS changed,
             'pair' AS op FROM p WHERE o_n IS NOT NULL AND w_n IS NOT NULL
      UNION ALL
      SELECT CASE WHEN come_r IS NULL THEN ok ELSE key END, ok, text, lang, source, '',
             CASE WHEN come_r IS NULL THEN 'delete' WHEN gone_r IS NULL THEN 'insert' ELSE 'rekey' END FROM q)
    SELECT key, old_key, CASE WHEN op <> 'pair' THEN op WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
           CASE WHEN op <> 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
    FROM all_rows"""

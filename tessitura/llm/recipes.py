"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A normalised text (each run of white space made one space) is cut where its content says so: a chunk ends after a
word whose hash is 0 modulo ``WORDS_A_CHUNK``, so that equal passages give equal chunks wherever they stand, and what
is longer than ``MOST_BYTES`` is cut further.  Chunks end to end are the text again.  A chunk's identifier is an MD5 of
it, and the identifiers are verified: all distinct chunks are brought together, each once from a task that has it,
and if two of them share an identifier, all are made anew with another salt.  After that, texts are equal if and
only if their recipes, the ordered lists of identifiers, are equal, and long documents are compared, grouped and
joined by their recipes alone (32 characters a chunk).

A group of copies may hold a third of all rows.  It is counted by sums that each task makes first.  What a group
found is sent back to its rows by a join: groups with more than 1/256 of the rows, of which there are 255 at most,
are broadcast; the others join by a shuffle, in which no group is larger than that share.

Edge cases: a null text counts as empty, and all empty texts are one group; a text of white space is one space, and
not empty; of rows with the smallest doc_id of a group one stays, any of them if they are repeated; a null doc_id
stays only if the group has no other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, written

#: Mean number of words in a chunk, and bytes beyond which a chunk is cut further.
WORDS_A_CHUNK, MOST_BYTES = 256, 16384
#: Characters of an identifier, and the share of rows beyond which a group is broadcast (one part in so many).
WIDTH, HOT = 32, 256


def normalised() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def md5_id(chunk: Column, salt: int) -> Column:
    """32 hexadecimal digits; the salt comes first, so that chunks made to collide under one don't under the next."""
    return F.md5(F.concat(F.lit(f"{salt}:").cast("binary"), chunk))


def chunked(docs: DataFrame, words: int = WORDS_A_CHUNK, most: int = MOST_BYTES) -> DataFrame:
    """docs with whole, its normalised text, and chunks, an array of binaries that make it up."""
    held = docs.withColumn("whole", normalised())
    # A normalised text has no line feed, so one can mark where chunks end; a chunk begins with the space before its words.
    marked = F.array_join(F.transform(F.split("whole", " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(words)) == 0, F.concat(w, F.lit("\n"))).otherwise(w)), " ")
    cut = F.transform(F.split(marked, "\n"), lambda c: c.cast("binary"))

    def pieces(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.call_function("div", F.octet_length(c) - 1, F.lit(most)).cast("int"))
        return F.when(F.octet_length(c) <= most, F.array(c)).otherwise(F.transform(starts, lambda i: F.substring(c, i * most + 1, F.lit(most))))

    return held.withColumn("cut", cut).withColumn("chunks", F.filter(F.flatten(F.transform("cut", pieces)), lambda c: F.octet_length(c) > 0)).drop("cut")


def shared_ids(chunks: DataFrame) -> DataFrame:
    """Identifiers that two or more different chunks have; chunks: id, chunk."""
    # Chunks are equal when their bytes are: they are the key of the grouping, and each task sends a chunk once.
    return chunks.groupBy("id", "chunk").count().groupBy("id").count().filter("count > 1").select("id")


def recipes(docs: DataFrame, ids: Callable[[Column, int], Column] = md5_id, words: int = WORDS_A_CHUNK, most: int = MOST_BYTES, salts: int = 16) -> tuple[DataFrame, int]:
    """A table of row (unique), doc_id, recipe and text_sha256, and the salt under which all identifiers are verified."""
    cut = chunked(docs.select("doc_id", "text"), words, most)
    for salt in range(salts):
        every = cut.select(F.explode("chunks").alias("chunk")).select(ids(F.col("chunk"), salt).alias("id"), "chunk")
        if shared_ids(every).isEmpty():
            break
    else:
        raise ValueError(f"chunks share identifiers under each of {salts} salts")
    recipe = F.array_join(F.transform("chunks", lambda c: ids(c, salt)), "")
    rows = cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", recipe.alias("recipe"), F.sha2("whole", 256).alias("text_sha256"))
    return written(rows, "recipes"), salt


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs; options as for recipes()."""
    prepare(docs.sparkSession)
    rows, _ = recipes(docs, **options)
    groups = rows.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.count("*").alias("group_size"),
    )
    groups = written(groups, "recipe-groups")
    hot = F.col("group_size") * HOT > rows.count()
    large = F.broadcast(groups.filter(hot))  # fewer than HOT rows
    joined = rows.join(large, "recipe").unionByName(rows.join(large.select("recipe"), "recipe", "left_anti").join(groups.filter(~hot), "recipe"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def store(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Each distinct chunk once in folder/chunks, the ordered identifiers of each row in folder/recipes.

    Returns the recipes: row, doc_id, recipe.  restored() makes the normalised texts of them.
    """
    rows, salt = recipes(docs, **options)
    ids = options.pop("ids", md5_id)
    options.pop("salts", None)
    cut = chunked(docs.select("doc_id", "text"), **options)
    chunks = cut.select(F.explode("chunks").alias("chunk")).distinct().select(ids(F.col("chunk"), salt).alias("id"), "chunk")
    chunks.write.parquet(f"{folder}/chunks")
    rows.select("row", "doc_id", "recipe").write.parquet(f"{folder}/recipes")
    discard(rows)
    return docs.sparkSession.read.parquet(f"{folder}/recipes")


def restored(folder_recipes: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, doc_id, text: the normalised texts again, from recipes and chunks.

    A recipe is met whole in one row, as its text was.  Chunks that many recipes have are dealt by (row, place) after
    the join, and AQE splits the join where one identifier is hot.
    """
    n = F.call_function("div", F.length("recipe"), F.lit(width)).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("recipe", i * width + 1, F.lit(width)))
    each = folder_recipes.select("row", "doc_id", F.posexplode_outer(F.when(n > 0, ids)).alias("place", "id"))  # an empty text has no chunk
    chunk = F.coalesce(F.col("chunk").cast("string"), F.lit(""))
    texts = each.join(chunks, "id", "left").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", chunk.alias("chunk")))).alias("all"))
    return texts.select("row", "doc_id", F.array_join("all.chunk", "").alias("text"))


def oracle() -> str:
    """DuckDB SQL for the rows of exact_duplicates(): groups by the normalised text itself."""
    return """
    WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS whole FROM documents),
    placed AS (
      SELECT doc_id, whole, min(doc_id) OVER (PARTITION BY whole) AS keep_id, count(*) OVER (PARTITION BY whole) AS group_size,
             row_number() OVER (PARTITION BY whole ORDER BY doc_id NULLS LAST) = 1 AS kept
      FROM plain)
    SELECT doc_id, keep_id, group_size, kept, sha256(whole) AS text_sha256 FROM placed"""

"""Exact dedup by 128-bit content hash, with bytes compared inside groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import Scratch

#: Ids of rows whose hash recurs are broadcast up to this many, 16 MB of longs; beyond, they are joined by shuffle.
MOST_BROADCAST = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of white space as one blank. The pattern passes over lone blanks, which stay as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D][\x20\x09-\x0D]+|[\x09-\x0D]", " ")


def content_hash(norm: Column) -> Column:
    """128 bits of SHA-256, which is computed for the result anyway."""
    return F.left(F.sha2(norm, 256), F.lit(32))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed_by=content_hash) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256, a row for each input row.

    Texts are hashed once; ids and hashes go to a table, are grouped by hash, and only texts whose hash recurs are read again: their bytes are
    compared by grouping on hash and text, partially before the shuffle, so a text that a third of all rows share crosses it
    once a task. A hash whose group holds one text only tells its rows' class; for the others (collisions) rows find their class by the text itself. The hot keys of the
    join back are split by AQE.

    A null text is empty; empty texts are equal. A text of any length is one value, never cut. A null id never is the smallest unless all ids of its group are null
    (then keep_id is null and kept true). Rows that repeat an id and its text are kept or dropped together
    and count in group_size; one id on several texts has a row a text. An empty table gives an empty result; other columns are ignored.
    """
    store = Scratch(docs.sparkSession)
    rows, again, compared = _compared(docs, id_col, text_col, hashed_by, store, F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
    out = _verdicts(rows, compared.where("texts = 1"))
    collided = compared.where("texts > 1").select("h")
    if not collided.isEmpty():
        whole = again.join(collided, "h", "left_semi")
        by_bytes = whole.join(whole.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), ["h", "norm"])
        by_bytes = by_bytes.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
        out = _verdicts(rows.join(collided, "h", "left_anti"), compared.where("texts = 1")).union(by_bytes)
    return store.finish(out)


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed_by=content_hash) -> DataFrame:
    """The rows of ``docs``, one of each text: that with the smallest id, and one only where rows tie in it (repeated or all null ids). Cases as in ``exact_dedup``.

    Rows find their verdict by hash, or by the text itself where a hash has several texts; few recurring hashes are broadcast, so texts aren't moved.
    """
    store = Scratch(docs.sparkSession)
    rows, _, compared = _compared(docs, id_col, text_col, hashed_by, store)
    ties = rows.join(compared, "h").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.count(F.lit(1)).alias("lead"))
    known, n = Scratch(docs.sparkSession).counted(compared.join(ties, "h", "left").select(F.col("h").alias("known"), "texts", "keep_id", "lead"))
    store.drop()
    norm = normalised(F.col(text_col))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.unhex(hashed_by(norm)).alias("h"))
    found = whole.join(F.broadcast(known) if n <= MOST_BROADCAST // 4 else known, F.col("h") == F.col("known"), "left")
    leads = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = found.where(F.col("known").isNull() | ((F.col("texts") == 1) & leads & (F.col("lead") == 1))).select("row.*")
    if n and not known.where("texts = 1 AND lead > 1").isEmpty():
        out = out.union(found.where((F.col("texts") == 1) & leads & (F.col("lead") > 1)).dropDuplicates(["h"]).select("row.*"))
    if n and not known.where("texts > 1").isEmpty():
        collided = found.where("texts > 1").withColumn("norm", normalised(F.col(f"row.`{text_col}`"))).select("row", "doc_id", "h", "norm")
        least = collided.groupBy("h", "norm").agg(F.min("doc_id").alias("least"))
        out = out.union(collided.join(least, ["h", "norm"]).where(F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["h", "norm"]).select("row.*"))
    return out


def _compared(docs: DataFrame, id_col: str, text_col: str, hashed_by, store: Scratch, *more: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, h, more); texts whose id has a recurring hash (doc_id, norm, h); and of each recurring hash: how many texts it has, its smallest id, its number of rows."""
    norm = normalised(F.col(text_col))
    rows = store.keep(docs.select(F.col(id_col).alias("doc_id"), F.unhex(hashed_by(norm)).alias("h"), *more))
    groups = store.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    ids, n = store.counted(rows.join(groups, "h", "left_semi").select(F.col("doc_id").alias("again_id")).distinct())
    again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, F.col("doc_id").eqNullSafe(F.col("again_id")), "left_semi")
    again = again.select("doc_id", normalised(F.col("text")).alias("norm"))
    again = again.select("doc_id", "norm", F.unhex(hashed_by(F.col("norm"))).alias("h"))
    classes = again.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    compared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return rows, again, store.keep(compared.where("group_size > 1"))


def _verdicts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose hash is in no group are a class of their own."""
    found = rows.join(groups.select("h", "keep_id", "group_size"), "h", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

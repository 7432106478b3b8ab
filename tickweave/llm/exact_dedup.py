"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import table

#: ASCII white space, as Java's and DuckDB's regular expressions write it.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=F.md5) -> DataFrame:
    """One row per distinct normalised text that occurs more than once.

    Columns: group_key (128-bit hash), text_sha256, keep_id, group_size. Rows are grouped by hash and bytes together, so that texts
    whose hashes collide never share a group. The counts are pre-aggregated
    before the shuffle, so a text with very many copies costs one row per task.
    ``key`` can be replaced to test collisions.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    rows = rows.select("id", "body", key("body").alias("group_key"))
    groups = rows.groupBy("group_key", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.where("group_size > 1").select("group_key", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=F.md5, carry: list[str] | None = None) -> DataFrame:
    """Mark which of equal texts stays: the row with the smallest id.

    Returns the columns ``carry`` (all by default) as one struct ``row``, so that
    no column of the input clashes with the added ones: id, keep_id, group_size,
    kept, text_sha256.

    Nulls: a null text counts as empty; a null id can only be kept if all ids of
    its group are null. Ties: of several rows with the same smallest id and the
    same text, all are marked kept, as no column tells them apart. Empty tables
    give no rows. Whole texts are read, of any length.

    The join needs only hashes; a hot key is split by the adaptive skew join.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if carry is None else carry)])
    body = normalised(F.col(text_col))
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), key(body).alias("group_key"), F.sha2(body, 256).alias("text_sha256"))
    groups = content_groups(docs, id_col, text_col, key).withColumnRenamed("group_size", "n")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.join(groups, ["group_key", "text_sha256"], "left").select(
        "row", "id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), "text_sha256",
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: which copy stays."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry=["doc_id"]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM rows
"""

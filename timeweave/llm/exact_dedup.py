"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z only (which keeps a text's byte length).
Rows whose length nobody shares leave first, then rows whose (length, prefix hash) nobody shares;
only the rest is compared by the SHA-256 of the whole text.  Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import ascii_lower, materialise, small, temporary_tables

KEYS = ["__tw_len", "__tw_prefix"]


def full_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _prefix(text: Column, chars: int) -> Column:
    return F.xxhash64(ascii_lower(F.substring(text, 1, chars)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("__tw_id"),
        _length(text).alias("__tw_len"),
        _prefix(text, prefix_chars).alias("__tw_prefix"),
        text.alias("__tw_text"),
    )


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.sum("__tw_copies").alias("__tw_n")).where("__tw_n > 1").select(*keys)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and full_hash.

    The row with the largest id stays; of repeated rows with that id, exactly one.  Null ids rank
    below all others; a null text counts as empty.  An empty table gives no rows.

    ``full_hash`` is null for rows that earlier stages ruled out.  A caller who needs every row's
    digest asks for ``hash_all``: every text is then read and hashed in the first scan, so there is
    nothing left for the refinement to save, and length, prefix and full hash are compared in one
    grouping.

    Repeated rows are counted before anything is joined, and all grouping is by partial
    aggregation, so a third of all rows may be equal.
    """
    return _grouped(docs, id_col, text_col, prefix_chars, hash_all).select("id", "keep_id", "group_size", "kept", "full_hash")


def _grouped(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, hash_all: bool) -> DataFrame:
    """``exact_groups`` with the length and prefix hash of each row."""
    keyed = _keyed(docs, id_col, text_col, prefix_chars)
    if hash_all:
        keyed = keyed.withColumn("__tw_hash", full_hash(F.col("__tw_text")))
        every = materialise(keyed.groupBy("__tw_id", *KEYS, "__tw_hash").agg(F.count(F.lit(1)).alias("__tw_copies")), "dedup-hashes")
        groups = _sizes(every)
    else:
        rows = materialise(keyed.groupBy("__tw_id", *KEYS).agg(F.count(F.lit(1)).alias("__tw_copies")), "dedup-keys")
        same_length = rows.join(_shared(rows, KEYS[:1]), KEYS[:1], "left_semi")
        suspects = materialise(_shared(same_length, KEYS), "dedup-suspects")
        hashed = keyed.join(small(suspects, suspects.count()), KEYS, "left_semi").select("__tw_id", *KEYS, full_hash(F.col("__tw_text")).alias("__tw_hash"))
        hashed = materialise(hashed.groupBy("__tw_id", *KEYS, "__tw_hash").agg(F.count(F.lit(1)).alias("__tw_copies")), "dedup-hashes")
        groups = _sizes(hashed)
        alone = rows.join(suspects, KEYS, "left_anti").withColumn("__tw_hash", F.lit(None).cast("string"))
        every = hashed.unionByName(alone)
    joined = every.join(groups, [*KEYS, "__tw_hash"], "left")
    keep = F.when(F.col("__tw_size").isNull(), F.col("__tw_id")).otherwise(F.col("__tw_keep"))
    return joined.select(
        F.col("__tw_id").alias("id"),
        keep.alias("keep_id"),
        F.coalesce("__tw_size", F.lit(1)).alias("group_size"),
        F.col("__tw_id").eqNullSafe(keep).alias("__tw_stays"),
        F.col("__tw_hash").alias("full_hash"),
        *KEYS,
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tw_copies"))).alias("__tw_copy"),
    ).withColumn("kept", F.col("__tw_stays") & (F.col("__tw_copy") == 1))


def _sizes(hashed: DataFrame) -> DataFrame:
    """(length, prefix, hash, __tw_keep, __tw_size) of groups of several equal texts."""
    return hashed.groupBy(*KEYS, "__tw_hash").agg(F.max("__tw_id").alias("__tw_keep"), F.sum("__tw_copies").alias("__tw_size")).where("__tw_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept: that of the largest id.

    Whole texts are hashed only where length and prefix hash are shared, and again only in rows
    that share id, length and prefix hash with one that goes; texts are not shuffled as long as
    those that go are few enough to broadcast.  Of rows that are equal in id and in text up to
    case, the one whose text as it stands has the smallest hash stays (of equal ones, any).  Null
    texts count as empty, null ids rank below all others, an empty table gives no rows.
    """
    with temporary_tables(docs.sparkSession):
        gone = _grouped(docs, id_col, text_col, prefix_chars, False).where("NOT kept")
        gone = gone.groupBy("id", *KEYS, "full_hash").agg(F.max(F.col("id").eqNullSafe(F.col("keep_id"))).alias("__tw_again"))
        gone = materialise(gone.select(F.col("id").alias("__tw_id"), *[F.col(k).alias(f"{k}_g") for k in KEYS], F.col("full_hash").alias("__tw_hash"), "__tw_again"), "dedup-gone", keep=True)
    few = gone.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("__tw_len", _length(text)).withColumn("__tw_prefix", _prefix(text, prefix_chars))
    # the full hash is a range condition, not one of the join's keys: so it is taken of rows that share the keys only
    same = F.col(id_col).eqNullSafe(F.col("__tw_id")) & full_hash(F.col(text_col)).between(F.col("__tw_hash"), F.col("__tw_hash"))
    for k in KEYS:
        same = same & (F.col(k) == F.col(f"{k}_g"))
    rest = found.join(small(gone, few), same, "left_anti").select(*docs.columns)
    again = gone.where("__tw_again")
    if again.isEmpty():
        return rest
    repeated = found.join(small(again, few), same).withColumn("__tw_own", F.xxhash64(text))
    one = repeated.groupBy("__tw_id", *KEYS, "__tw_hash").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), "__tw_own").alias("__tw_row"))
    return rest.unionByName(one.select(*[F.col("__tw_row")[c].alias(c) for c in docs.columns]))

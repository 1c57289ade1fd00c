"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Ids are those of the byte-level BPE file that the caller names.  The fast path runs the same
vocabulary and merges as ranks; texts with characters beyond Latin letters, or with the file's
special strings, go through the ``tokenizers`` library itself, so that all ids are its ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.llm.common import bounded_batches, materialise, worker_cache


REPORT = frozenset("n_tokens docs tokens docs_at_least tokens_at_least quantile truncated_total dropped_tokens".split())


def make_encoder(json_path: str, rank_path: str | None = None) -> Callable[[str], Sequence[int]]:
    """text -> ids, special strings as ordinary text, none added.

    ``rank_path`` names the same vocabulary as ranks; without it every text takes the library's path.
    """
    cache = worker_cache()
    key = ("encoder", json_path, rank_path)
    if key not in cache:
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(json_path)
        full.encode_special_tokens = True

        def slow(text: str) -> Sequence[int]:
            return full.encode(text, add_special_tokens=False).ids

        encode = slow
        if rank_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(rank_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary
            odd = re.compile("[^\x00-ɏ]|<\\|")

            def encode(text: str) -> Sequence[int]:
                return slow(text) if odd.search(text) else fast(text)

        cache[key] = encode
    return cache[key]


def encoded_lengths(docs: DataFrame, json_path: str, rank_path: str | None = None, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``by`` columns and ``n_tokens`` (null and empty text: 0)."""
    narrow = docs.select(*by, F.col(text_col).alias("__tw_text"))
    schema = narrow.drop("__tw_text").schema.add("n_tokens", "long", False)
    names = list(by)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(json_path, rank_path)
        for batch in batches:
            texts = batch.column(len(names))
            lengths = np.fromiter((len(encode(t)) if (t := x.as_py()) else 0 for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lengths)], names=[*names, "n_tokens"])

    return bounded_batches(narrow).mapInArrow(count, schema)


def token_histogram(docs: DataFrame, json_path: str, rank_path: str | None = None, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_tokens, docs): how many documents have each encoded length.  Empty table: no rows."""
    return encoded_lengths(docs, json_path, rank_path, text_col, by).groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def length_report(histogram: DataFrame, by: Sequence[str] = (), block: int = 64) -> DataFrame:
    """What a context limit of each length in the histogram would mean.

    Per (by..., n_tokens): docs and tokens of exactly that length, docs and tokens at least that
    long (suffix sums), the share of documents no longer (quantile), the total when every
    document is truncated to that many tokens, and the tokens such truncation drops.

    The sums run over blocks of lengths first and then inside each block, so no task reads more
    than ``block`` lengths, or one row for each block.
    """
    keys = list(by)
    hist = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("__tw_block", F.floor(F.col("n_tokens") / block))
    blocks = hist.groupBy(*keys, "__tw_block").agg(F.sum("docs").alias("__tw_d"), F.sum("tokens").alias("__tw_t"))
    later = W.partitionBy(*keys).orderBy(F.col("__tw_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    blocks = blocks.select(
        *[F.col(k).alias(f"__tw_k{i}") for i, k in enumerate(keys)],
        F.col("__tw_block").alias("__tw_b"),
        F.coalesce(F.sum("__tw_d").over(later), F.lit(0)).alias("__tw_docs_later"),
        F.coalesce(F.sum("__tw_t").over(later), F.lit(0)).alias("__tw_tokens_later"),
        F.sum("__tw_d").over(whole).alias("__tw_docs_all"),
        F.sum("__tw_t").over(whole).alias("__tw_tokens_all"),
    )
    on = (F.col("__tw_block") == F.col("__tw_b")) & F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__tw_k{i}"))
    inside = W.partitionBy(*keys, "__tw_block").orderBy(F.col("n_tokens").desc())
    at_least = hist.withColumn("__tw_d", F.sum("docs").over(inside)).withColumn("__tw_t", F.sum("tokens").over(inside))
    joined = at_least.join(blocks, on)
    docs_ge, tokens_ge = F.col("__tw_d") + F.col("__tw_docs_later"), F.col("__tw_t") + F.col("__tw_tokens_later")
    kept = F.col("__tw_tokens_all") - tokens_ge + F.col("n_tokens") * docs_ge
    return joined.select(
        *keys,
        "n_tokens",
        "docs",
        "tokens",
        docs_ge.alias("docs_at_least"),
        tokens_ge.alias("tokens_at_least"),
        ((F.col("__tw_docs_all") - docs_ge + F.col("docs")) / F.col("__tw_docs_all")).alias("quantile"),
        kept.alias("truncated_total"),
        (F.col("__tw_tokens_all") - kept).alias("dropped_tokens"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For context limits of the caller's own: documents that fit, and the total after truncation."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    sums = [
        (F.sum(F.when(F.col("n_tokens") <= x, F.col("docs"))).alias(f"f{x}"), F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("docs")).alias(f"t{x}"))
        for x in limits
    ]
    row = histogram.agg(*[c for pair in sums for c in pair]).select(
        F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.coalesce(F.col(f"f{x}"), F.lit(0)).alias("docs_that_fit"), F.coalesce(F.col(f"t{x}"), F.lit(0)).alias("truncated_total")) for x in limits])).alias("r")
    )
    return wanted.join(row.select("r.*"), "context_limit", "left")


def token_counts(docs: DataFrame, json_path: str, rank_path: str | None = None, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """The length report of ``docs``, see ``length_report``; a row for each length that occurs.

    Texts are encoded once, whole; the histogram is written before its sums.  Null and empty texts
    have length 0; each of repeated rows counts; an empty table gives no rows.  ``by`` names
    columns of ``docs`` to report apart, null being a value of its own; one that has the name of
    one of the report's columns is an error.  Other columns are ignored, whatever their names.
    """
    clash = sorted(set(by) & REPORT)
    if clash:
        raise ValueError(f"rename the column first, the report has one of that name: {', '.join(clash)}")
    return length_report(materialise(token_histogram(docs, json_path, rank_path, text_col, by), "token-histogram"), by)

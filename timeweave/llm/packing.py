"""Packing by shortest-pack-first over the length histogram.

Documents are encoded once and cut at ``max_len``; each piece knows its rank among the pieces of
its length within its task.  The histogram of lengths (at most ``max_len`` rows) is packed on the
driver: longest lengths first, each into the emptiest packs that still have room, by whole counts
of equal packs.  The resulting patterns go back to the pieces by rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.common import bounded_batches, materialise
from timeweave.llm.tokens import make_encoder


def encode_pieces(docs: DataFrame, json_path: str, rank_path: str | None, max_len: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Each document's ids, then ``end_id``, cut every ``max_len``.

    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit),
    doc_tokens, task, local_rank (among the task's pieces of that length) and, with ``ids``, the
    ids themselves.  Null text counts as empty: one piece that holds ``end_id`` alone.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = narrow.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "task", "local_rank"):
        schema = schema.add(name, "long", False)
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()), False)
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = make_encoder(json_path, rank_path)
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        end = np.array([end_id], "<u4")
        for batch in batches:
            of, rows, parts = [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                full = np.concatenate([np.array(encode(text), "<u4"), end]) if text else end
                n = len(full)
                for start in range(0, n, max_len):
                    part = full[start : start + max_len]
                    length = len(part)
                    of.append(i)
                    rows.append((start, length, zlib.crc32(part.tobytes()), n, task, seen[length]))
                    seen[length] += 1
                    if ids:
                        parts.append(part.astype(np.int32))
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            arrays = [batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(np.ascontiguousarray(c)) for c in columns]]
            if ids:
                arrays.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return bounded_batches(narrow).mapInArrow(cut, schema)


def pack_histogram(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that hold every piece once, each pattern at most ``max_len`` long.

    Lengths come longest first.  The emptiest packs with room take one piece each, whole groups
    of equal packs at a time; what finds no room opens packs of as many as fit.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        for room in range(max_len, length - 1, -1):
            moved = []
            while left and open_packs[room]:
                count, pattern = open_packs[room].pop()
                fits = room // length
                if count * fits <= left:  # every pack of the group takes all it can
                    moved.append((room - fits * length, count, pattern + (length,) * fits))
                    left -= count * fits
                    continue
                full, rest = divmod(left, fits)
                if full:
                    moved.append((room - fits * length, full, pattern + (length,) * fits))
                if rest:
                    moved.append((room - rest * length, 1, pattern + (length,) * rest))
                if count > full + bool(rest):
                    moved.append((room, count - full - bool(rest), pattern))
                left = 0
            for to, count, pattern in moved:
                open_packs[to].append((count, pattern))
            if not left:
                break
        if left:
            fits = max_len // length
            full, rest = divmod(left, fits)
            if full:
                open_packs[max_len - fits * length].append((full, (length,) * fits))
            if rest:
                open_packs[max_len - rest * length].append((1, (length,) * rest))
    merged: Counter[tuple[int, ...]] = Counter()
    for groups in open_packs.values():
        for count, pattern in groups:
            merged[pattern] += count
    return [(n, p) for p, n in sorted(merged.items(), reverse=True)]


def slots_of(patterns: Sequence[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past last rank, first sequence, pieces of that length a pack, offset of the first)."""
    taken: Counter[int] = Counter()
    out, first = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            out.append((length, taken[length], taken[length] + count * each, first, each, offset))
            taken[length] += count * each
            offset += length * each
        first += count
    return out


def pack(pieces: DataFrame, max_len: int) -> DataFrame:
    """``pieces`` (of ``encode_pieces``, already written) with sequence_id and offset.

    The plan has one row per (pattern, length): the patterns are at most a few for each of the
    ``max_len`` lengths, whatever the corpus, so it may be broadcast.  Counts for each (task,
    length) shift the local ranks; they are joined as Spark sees fit.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("__tw_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__tw_n").alias("n")).collect()}  # max_len rows at most
    plan = slots_of(pack_histogram(histogram, max_len))
    plan_df = spark.createDataFrame(plan, "__tw_len long, __tw_lo long, __tw_hi long, __tw_seq long, __tw_each long, __tw_off long")
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("length").alias("__tw_l"), F.col("task").alias("__tw_task"), F.coalesce(F.sum("__tw_n").over(before), F.lit(0)).alias("__tw_shift")
    )
    ranked = pieces.join(shifts, (pieces["length"] == F.col("__tw_l")) & (pieces["task"] == F.col("__tw_task"))).withColumn("__tw_rank", F.col("local_rank") + F.col("__tw_shift"))
    placed = ranked.join(
        F.broadcast(plan_df),
        (F.col("length") == F.col("__tw_len")) & (F.col("__tw_rank") >= F.col("__tw_lo")) & (F.col("__tw_rank") < F.col("__tw_hi")),
    )
    j = F.col("__tw_rank") - F.col("__tw_lo")
    kept = [c for c in pieces.columns if c not in ("task", "local_rank")]
    return placed.select(
        *kept,
        (F.col("__tw_seq") + F.expr("(__tw_rank - __tw_lo) div __tw_each")).alias("sequence_id"),
        (F.col("__tw_off") + (j % F.col("__tw_each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, json_path: str, rank_path: str | None = None, max_len: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """All of ``docs`` as pieces with their place: see ``encode_pieces`` and ``pack``.

    Repeated rows are packed once each; an empty table gives no rows; a null id stays null.
    """
    return pack(materialise(encode_pieces(docs, json_path, rank_path, max_len, end_id, id_col, text_col, ids), "pieces"), max_len)

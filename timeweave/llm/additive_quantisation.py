"""Approximate nearest neighbours by additive quantisation.

A vector is coded as one word from each of ``books`` codebooks; the words have the vector's full
dimension and add up to its reconstruction.  Codebooks start as residual k-means of a bounded
sample; then each in turn is refitted by least squares to the sample's codes, given the others.  Every vector is encoded by
beam search and stored with its reconstruction's norm.  A query scores codes with one lookup table
per codebook, and those that may be among the nearest are ranked again by the exact measure.

Which may be is said by the sample alone: the k-th best product of a query with the sample bounds
that with all rows from below, and vectors that fitted no codebook say how far a score may be off.
So the answer does not depend on how the index is cut into files, tasks and batches.  The words of
the first codebook are the index's cells; one whose best possible score is below the bound is not
scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.common import bounded_batches, materialise


def usable(vector: Column) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """(k, dim) centres; an empty centre moves to the point that is worst served."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T) * -2 + (centres**2).sum(1)
        of = near.argmin(1)
        count = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        worst = np.argsort(near[np.arange(len(x)), of] + (x**2).sum(1))[::-1]
        empty = np.flatnonzero(count == 0)[: len(worst)]
        centres[empty] = x[worst[: len(empty)]]
    return centres


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """(n, books) uint8 codes whose words add up to near ``x``, keeping the ``beam`` best prefixes at each book."""
    m, k, dim = books.shape
    n = len(x)
    norms = (books**2).sum(axis=2)
    codes = np.zeros((n, 1, 0), np.uint8)
    left = x[:, None, :]
    error = np.zeros((n, 1), x.dtype)
    for level in range(m):
        width = min(beam, codes.shape[1] * k) if level < m - 1 else 1
        step = (left.reshape(-1, dim) @ (books[level].T * -2)).reshape(n, -1, k)
        step += norms[level]
        step += error[:, :, None]
        options = step.reshape(n, -1)
        best = np.argpartition(options, width - 1, axis=1)[:, :width] if width > 1 else options.argmin(1)[:, None]
        error = np.take_along_axis(options, best, 1)
        word = best % k
        left = np.take_along_axis(left, (best // k)[:, :, None], 1) - books[level][word]
        codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    return codes[:, 0]


def fit_codebooks(x: np.ndarray, books: int = 16, words: int = 256, beam: int = 4, rounds: int = 5, refits: int = 1, seed: int = 7) -> np.ndarray:
    """(books, words, dim) from a sample: residual k-means, then alternating encoding and least squares."""
    rng = np.random.default_rng(seed)
    left, out = x.copy(), []
    for _ in range(books):
        centres = kmeans(left, words, rounds, rng)
        of = ((left @ centres.T) * -2 + (centres**2).sum(1)).argmin(1)
        left = left - centres[of]
        out.append(centres)
    table = np.stack(out)
    for _ in range(refits):
        codes = beam_encode(x, table, beam)
        left = x - table[np.arange(books), codes].sum(axis=1)
        for j in range(books):  # the least-squares words of one book, given the others
            aim = left + table[j][codes[:, j]]
            count = np.bincount(codes[:, j], minlength=words)
            sums = np.zeros_like(table[j])
            np.add.at(sums, codes[:, j], aim)
            table[j] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], table[j])
            left = aim - table[j][codes[:, j]]
    return table.astype(x.dtype)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def build_index(vectors: DataFrame, dim: int, table: np.ndarray, beam: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, cell, codes, norm, vector) of every usable vector of ``dim`` components; ``cell`` is the first code."""
    rows = _usable_rows(vectors, id_col, vector_col).where(F.size("vector") == dim)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("norm", T.FloatType()), rows.schema["vector"]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch.column(1), dim).astype(np.float32)
                codes = beam_encode(x, table, beam)
                made = table[np.arange(len(table)), codes].sum(axis=1)
                norm = np.einsum("ij,ij->i", made, made).astype(np.float32)
                cell = pa.array(codes[:, 0].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), cell, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), batch.column(1)], names=schema.names)

    return bounded_batches(rows).mapInArrow(encode, schema)


def _usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())


def thresholds(queries: np.ndarray, sample: np.ndarray, seen: np.ndarray, coded: np.ndarray, k: int, margin: float) -> np.ndarray:
    """The least score by codes that makes a row a candidate of each query.

    The k-th best exact product with the sample bounds that with all rows from below.  What score
    by codes goes with such a product follows from vectors ``seen`` and what their codes make of
    them, ``coded``: codes fall short of a large product, so the score is regressed on it, and
    ``margin`` standard deviations of what that leaves open are taken off.  With fewer than k
    vectors in the sample every row is a candidate.
    """
    out = np.full(len(queries), -np.inf)
    if len(sample) < k:
        return out
    x, y = seen - seen.mean(0), coded - coded.mean(0)
    xx, xy, yy = (a.T @ b / len(x) for a, b in ((x, x), (x, y), (y, y)))
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        kth = np.partition(q @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k]
        var, both, other = (np.einsum("qi,ij,qj->q", q, c, q) for c in (xx, xy, yy))
        slope = np.clip(both / np.maximum(var, 1e-12), 0, 1)
        open_ = np.sqrt(np.maximum(other - 2 * slope * both + slope**2 * var, 0))
        out[at : at + 256] = q @ coded.mean(0) + slope * (kth - q @ seen.mean(0)) - margin * open_ - 1e-6 * np.abs(kth)
    return out


def _best(number: np.ndarray, vec: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query number: largest score, then smallest id."""
    order = np.lexsort((vec, -score, number))
    number, vec, score, own = number[order], vec[order], score[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, int)
    place = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
    keep = place < k
    return number[keep], vec[keep], score[keep], own[keep]


def _search(index: DataFrame, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, table: np.ndarray, k: int) -> DataFrame:
    """Each task's best k + 1 candidates of each of a block of queries: (query, query_id, vec_id, score, own).

    ``own`` marks rows that are equal to the query's in id and vector.
    """
    m, words, dim = table.shape
    sent = index.sparkSession.sparkContext.broadcast((numbers, ids, queries, least, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, wide, least, books = sent.value
        # (book, word, query): a row's score is a sum of whole table rows, for many queries at once
        lut = (books.reshape(-1, dim).astype(np.float32) @ wide.T.astype(np.float32)).reshape(m, words, len(ids))
        # no row of a cell scores more than the cell's word and the best word of each other book
        cells = lut[0].T + lut[1:].max(axis=1).sum(axis=0)[:, None] * np.float32(1 + 1e-5) >= least[:, None].astype(np.float32) - np.float32(1e-5)
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, bool))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vec = np.asarray(batch.column(0))
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, m)
                own = _matrix(batch.column(2), dim).astype(np.float64)
                asked = np.flatnonzero(cells[:, np.unique(codes[:, 0])].any(axis=1))
                found = [best]
                for q0 in range(0, len(asked), 128):
                    some = asked[q0 : q0 + 128]
                    score = np.take(lut[0][:, some], codes[:, 0], axis=0)
                    for j in range(1, m):
                        score += np.take(lut[j][:, some], codes[:, j], axis=0)
                    row, q = np.nonzero(score >= least[some])
                    q = some[q]
                    exact = np.concatenate([np.einsum("pd,pd->p", own[row[i : i + 32768]], wide[q[i : i + 32768]]) for i in range(0, len(q), 32768)] or [np.zeros(0)])
                    same = vec[row] == ids[q]
                    same[same] = (own[row[same]] == wide[q[same]]).all(axis=1)
                    found.append(_best(q, vec[row], exact, same, k + 1))
                best = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k + 1)
        q, vec, score, same = best
        yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(ids[q]), pa.array(vec), pa.array(score), pa.array(same)], names=["query", "query_id", "vec_id", "score", "own"])

    narrow = index.select("vec_id", "codes", "vector")
    return bounded_batches(narrow).mapInArrow(run, "query long, query_id long, vec_id long, score double, own boolean")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, books: int = 16, words: int = 256, beam: int = 4, margin: float = 2.0, sample_rows: int = 8192, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors`` by inner product.

    The ``sample_rows`` usable vectors whose hashed ids come first are the sample: three quarters
    of it fit the codebooks, the rest measures their error, and all of it gives each query's bound
    (see ``thresholds``).  Every vector is encoded.  A row is ranked by the exact product of the
    original vectors, in double precision, if its code's score is above the bound; ``margin`` is
    in standard deviations of that score's error.  Cells that can't hold such a row are left out,
    which saves most work on clustered vectors and little on vectors without structure.  Queries
    go in blocks of about ``query_block``, so what is broadcast and collected is bounded.

    Candidates are all rows but the query's own: of rows equal to it in id and vector, one is
    left out.  Ties go to the smaller id.  A row that is in ``queries`` several times is answered
    each time.  Vectors that are null, zero or hold null or non-finite components take no part,
    nor do those of another dimension than the sample's most common one, nor rows without an id.
    Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = _usable_rows(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vector")).limit(sample_rows).select("vector").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    dim = int(np.bincount([len(r[0]) for r in sample]).argmax())
    x = np.array([r[0] for r in sample if len(r[0]) == dim], np.float32)
    del sample
    fit, rest = (x, x) if len(x) < 64 else (x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :])
    table = fit_codebooks(fit, books, words, beam)
    coded = table[np.arange(books), beam_encode(rest, table, beam)].sum(axis=1).astype(np.float64)
    index = build_index(vectors, dim, table, beam, id_col, vector_col).sortWithinPartitions("cell")
    index = materialise(index, "aq-index")
    asked = _usable_rows(queries, id_col, vector_col).where(F.size("vector") == dim)
    blocks = max(1, -(-asked.count() // query_block))
    found, number = None, 0
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == b)
        own = sorted((r[0], r[1]) for r in part.collect())
        if not own:
            continue
        numbers = np.arange(number, number + len(own))
        number += len(own)
        wanted = np.array([v for _, v in own], np.float64)
        least = thresholds(wanted, x.astype(np.float64), rest.astype(np.float64), coded, k + 1, margin)
        hits = _search(index, numbers, np.array([i for i, _ in own], np.int64), wanted, least, table, k)
        if blocks > 1:
            hits = materialise(hits, "aq-hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return empty
    order = [F.col("score").desc(), F.col("vec_id")]
    one = F.row_number().over(W.partitionBy("query", "own").orderBy(*order))
    left = found.withColumn("__tw_n", one).where(~(F.col("own") & (F.col("__tw_n") == 1)))
    rank = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return left.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

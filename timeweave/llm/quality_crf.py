"""Document quality from a linear-chain conditional random field over lines.

Each line that is not blank is good or bad; its features describe the line and its neighbours.
The chain's weights are trained on a bounded sample of labelled documents, all of whose lines
take the document's label.  Forward-backward gives each line's probability of being good, and
the mean of these weighted by line length is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import bounded_batches, held_out
from timeweave.llm.toxicity import labelled_sample

STEPS = (0.02, 0.1, 0.3, 0.6)
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\n\x0b\x0c",
    "bar": b"|",
    "mark": b".,;:?'\"()-",
    "symbol": b"!#$%&*+/<=>@[\\]^_`{}~",
}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def line_features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, length, features) of every line that is not blank, in order."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    space = np.isin(data, np.frombuffer(KINDS["space"], np.uint8))
    kinds = {k: np.add.reduceat(np.isin(data, np.frombuffer(v, np.uint8)).astype(np.int32), start) for k, v in KINDS.items()}
    length = stop - start
    # words of a line: runs without white space, hashed by position in the run
    edge = np.flatnonzero(np.diff((~space).view(np.int8), prepend=np.int8(0)))
    first, last = edge[0::2], edge[1::2]
    of = np.searchsorted(stop, first, side="right")
    words = np.bincount(of, minlength=len(stop))
    if len(first):
        inside = np.arange(len(data)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
        value = _mix((data.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | inside.astype(np.uint64))
        value[space] = 0
        word = np.add.reduceat(value, first)
    else:
        word = np.zeros(0, np.uint64)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of, same, minlength=len(stop))
    key = np.sort(_mix(word) >> np.uint64(24) | of.astype(np.uint64) << np.uint64(40))
    distinct = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=len(stop)) if len(key) else words
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    line = np.zeros(len(stop), np.uint64)
    np.add.at(line, of, _mix(word + np.uint64(7)))
    _, earliest = np.unique(np.stack([doc.astype(np.uint64), line]), axis=1, return_index=True)
    repeat = np.ones(len(stop))
    repeat[earliest] = 0
    n, w = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(length - kinds["space"] + 1 - kinds["digit"] - kinds["mark"] - kinds["symbol"] - kinds["bar"], 1)
    shares = np.stack([kinds["upper"] / letters, kinds["symbol"] / n, kinds["bar"] / n, kinds["digit"] / n, kinds["mark"] / w, again / w, 1 - distinct / w, repeat], 1)
    own = np.concatenate([shares, *[(shares > s).astype(float) for s in STEPS], np.log1p(words)[:, None] / 5, np.log1p(length / w)[:, None] / 3], 1)
    keep = words > 0
    own, doc = own[keep], doc[keep]
    head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    tail = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else head
    before = np.where(head[:, None], 0, np.roll(own, 1, 0))
    after = np.where(tail[:, None], 0, np.roll(own, -1, 0))
    return doc, length[keep], np.concatenate([own, before, after, head[:, None], tail[:, None], np.ones((len(doc), 1))], 1)


def marginals(doc: np.ndarray, unary: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all documents at once, one line position at a time.

    ``unary`` is each line's score for good (bad: 0), ``step`` the 2 x 2 scores of one label after
    another.  Returns each line's probability of good, the expected label pairs, and log Z.
    """
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(begin, len(doc)))
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    score = np.stack([np.zeros(len(unary)), unary], 1)
    ahead, back = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    ahead[begin] = score[begin]
    longest = int(count[0])
    live = [int(np.searchsorted(-count, -t, side="left")) for t in range(longest + 1)]  # documents of more than t lines
    for t in range(1, longest):
        at = begin[: live[t]] + t
        from_ = ahead[at - 1][:, :, None] + step
        ahead[at] = score[at] + np.logaddexp(from_[:, 0], from_[:, 1])
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        to = step + (score[at + 1] + back[at + 1])[:, None, :]
        back[at] = np.logaddexp(to[:, :, 0], to[:, :, 1])
    whole = np.logaddexp(*(ahead + back).T)
    good = np.exp((ahead + back)[:, 1] - whole)
    inner = np.ones(len(doc), bool)
    inner[begin] = False
    here = np.flatnonzero(inner)
    pairs = np.exp(ahead[here - 1][:, :, None] + step + (score[here] + back[here])[:, None, :] - whole[here][:, None, None]).sum(0)
    return good, pairs, float(whole[begin].sum())


def _runs(texts: Sequence[str | None], limit: int) -> Iterator[tuple[int, Sequence[str | None]]]:
    """Runs of texts of about ``limit`` characters, with the place of the first."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


@dataclass
class Chain:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray

    def score(self, texts: Sequence[str | None], limit: int = 1 << 20) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, part in _runs(texts, limit):
            out[at : at + len(part)] = self._some(part)
        return out

    def _some(self, texts: Sequence[str | None]) -> np.ndarray:
        doc, length, x = line_features(texts)
        if not len(doc):
            return np.zeros(len(texts))
        good, _, _ = marginals(doc, ((x - self.centre) / self.scale) @ self.weights, self.step)
        total = np.bincount(doc, length, minlength=len(texts))
        return np.bincount(doc, length * good, minlength=len(texts)) / np.maximum(total, 1)


def train_chain(texts: Sequence[str | None], good: np.ndarray, share: float, rounds: int = 150, decay: float = 1.0) -> Chain:
    """Maximum likelihood with L2 decay by Adam over the whole sample; classes weigh as in all labels.

    Features are made of a megabyte of text at a time and kept in single precision: about half a
    kilobyte a line.
    """
    docs, parts = [], []
    for at, part in _runs(texts, 1 << 20):
        of, _, own = line_features(part)
        docs.append(of + at)
        parts.append(own.astype(np.float32))
    doc, x = np.concatenate(docs), np.concatenate(parts)
    del parts
    centre, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
    centre[-1], scale[-1] = 0, 1
    x -= centre.astype(np.float32)
    x /= scale.astype(np.float32)
    y = good[doc].astype(float)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    lines = len(y)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weights, step = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = marginals(doc, (x @ weights.astype(np.float32)).astype(np.float64), step)
        grad = np.concatenate([x.T @ (y - p).astype(np.float32), (seen - pairs).ravel()]) - decay * theta
        m, v = 0.9 * m + 0.1 * grad / lines, 0.99 * v + 0.01 * (grad / lines) ** 2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = theta[:-4].copy()
    in_sample = good.mean()
    weights[-1] += np.clip(np.log(share / (1 - share)) - np.log(in_sample / (1 - in_sample)), -3, 3) if 0 < share < 1 and 0 < in_sample < 1 else 0
    return Chain(centre, scale, weights, theta[-4:].reshape(2, 2))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, threshold: float = 0.3, per_class: int = 3000, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1: good).

    Labels come only from rows whose crc32(id as text) mod ``modulus`` is not ``remainder``; at
    most ``per_class`` of each class with ``most_bytes`` of text in all, first by hashed id, train
    the chain (see ``toxicity.labelled_sample``).  Texts without a line
    that is not blank, null ones too, score 0.  Without labels of both classes every other text
    scores 0.5.  Repeated rows are scored each; a null id is not held out; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    texts, good, share = labelled_sample(rows, marks, modulus, remainder, (per_class, per_class), most_bytes)
    held = held_out(F.col("doc_id"), modulus, remainder)
    some = [bool(t and t.strip()) for t in texts]
    texts, good = [t for t, s in zip(texts, some, strict=True) if s], good[np.array(some, bool)]
    if not good.any() or good.all():
        blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
        score = F.when(blank, 0.0).otherwise(0.5)
        return rows.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    chain = train_chain(texts, good, share)
    schema = rows.select("doc_id").schema.add("score", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chain.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = bounded_batches(rows).mapInArrow(run, schema)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

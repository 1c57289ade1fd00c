"""Near duplicates by BagMinHash: signatures of shingle multisets, banding, exact verification.

A document is the multiset of its five-word shingles.  Each shingle carries Poisson processes
over its weight axis: one over [0, 1) and one over each [2**(j-1), 2**j), the dyadic levels of the
discretised weights.  A point has a time, a component of the signature and a place on the weight
axis; a document sees it if the place is below its weight, and a component keeps its earliest
point.  Two documents agree on a component with the probability sum(min) / sum(max) of their
weights: weighted Jaccard, without bias.  A document needs only points up to the time by which
all components are surely filled, so the work for a signature hardly grows with its length.

Documents with equal multisets become one node.  Nodes that share a band are compared with a
centre of their bucket by exact multiset overlap.  Where that leaves a bucket's members in several
components, they meet again in buckets of an exact prefix filter, which get more centres until all
their members are connected or all were centres: no pair is skipped but those already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.common import bounded_batches, discard, materialise, small, temporary_tables, worker_cache

U = np.uint64
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # of the public splitmix64 generator
PRIME, PRIME_INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
SHINGLE_BITS = 50


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64 arrays."""
    x = (x ^ (x >> U(30))) * U(MIX1)
    x = (x ^ (x >> U(27))) * U(MIX2)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = cache["powers"] = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size, p, U))]) for p in (PRIME, PRIME_INVERSE))
    return have


def _word_bytes() -> np.ndarray:
    found = np.zeros(256, bool)
    found[128:] = True
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        found[c] = True
    return found


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of lower-cased UTF-8 texts, sorted by the first two.

    A word is a run of a-z, 0-9 and bytes beyond ASCII.  A text of fewer words than ``words`` has
    one shingle of all its words; one without words has none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    is_word = _word_bytes()[data]
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    power, inverse = _powers(len(data))
    running = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=running[1:])
    word = mix((running[end] - running[start]) * inverse[start] + (end - start).astype(U) * U(GOLDEN))
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    count = np.bincount(doc, minlength=len(texts))
    n = len(word)
    padded = np.concatenate([word, np.zeros(words, U)])
    factor = [U(pow(GOLDEN, 2 * j + 1, 1 << 64)) for j in range(words)]
    sh = np.zeros(n, U)
    for j in range(words):
        inside = (np.arange(n) + j - first[doc]) < count[doc]  # a short text has fewer words than the shingle
        sh += np.where(inside, padded[j : j + n], U(0)) * factor[j]
    place = np.arange(n) - first[doc]
    valid = place < np.maximum(count[doc] - words + 1, 1)
    key = (doc[valid].astype(U) << U(SHINGLE_BITS)) | (mix(sh[valid]) >> U(64 - SHINGLE_BITS))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(new, len(key)))
    return (key[new] >> U(SHINGLE_BITS)).astype(np.int64), key[new] & U((1 << SHINGLE_BITS) - 1), weight


def signatures(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, docs: int, m: int, slack: float = 4.0) -> np.ndarray:
    """(docs, m) uint32: for each component the identity of its earliest visible point; 0 where a document is empty.

    Points later than (ln m + slack) / total weight are left out.  A document with a component
    that no point reached is done again with twice the time, so the result is always exact.
    """
    total = np.bincount(doc, weights=weight, minlength=docs)
    best = np.full(docs * m, np.iinfo(np.uint64).max, U)
    todo = total > 0
    element = mix(sh * U(MIX1) + U(GOLDEN))
    time = np.full(docs, (np.log(m) + slack)) / np.maximum(total, 1)
    while todo.any():
        chosen = todo[doc]
        d, e, w = doc[chosen], element[chosen], weight[chosen]
        level = 0
        while len(d):
            low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            state = mix(e + U(GOLDEN * (level + 1) % (1 << 64)))
            at, dd, ww = np.zeros(len(d)), d, w
            while len(dd):
                state = mix(state + U(GOLDEN))
                gap = -np.log(((state >> U(11)).astype(np.float64) + 1.0) * (2.0**-53))
                at = at + gap / (m * size)
                going = at < time[dd]
                state, at, dd, ww = state[going], at[going], dd[going], ww[going]
                if not len(dd):
                    break
                more = mix(state ^ U(MIX2))
                component = ((more >> U(32)) * U(m)) >> U(32)
                if size == 1:
                    seen = slice(None)
                else:
                    seen = low + ((more & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64) < ww
                # time first, identity after: the smallest of these is the earliest point
                key = ((at[seen] / time[dd[seen]] * 2.0**32).astype(U) << U(32)) | (mix(more ^ U(GOLDEN))[seen] >> U(32)) | U(1)
                np.minimum.at(best, dd[seen] * m + component[seen].astype(np.int64), key)
            level += 1
            heavier = w > (1 << (level - 1))
            d, e, w = d[heavier], e[heavier], w[heavier]
        table = best.reshape(docs, m)
        todo = (table == np.iinfo(np.uint64).max).any(axis=1) & (total > 0)
        table[todo] = np.iinfo(np.uint64).max
        time[todo] *= 2
    out = (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(docs, m)
    out[total == 0] = 0
    return out


def multiset_hash(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """(docs, 2) uint64: equal for equal multisets."""
    out = np.zeros((docs, 2), U)
    for k in (0, 1):
        one = mix(mix(sh + U(GOLDEN * (k + 1) % (1 << 64))) ^ (weight.astype(U) * U(MIX2)))
        np.add.at(out[:, k], doc, one)
    return out


def _batches(texts: list[str | None], limit: int = 1 << 20, most: int = 4096) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of lower-cased texts of about ``limit`` bytes, with the place of the first."""
    at, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append((text or "").lower().encode("utf-8", "replace"))
        size += len(part[-1])
        if size >= limit or len(part) == most:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def sketch(docs: DataFrame, m: int, rows: int, words: int) -> DataFrame:
    """(doc_id, text_key, node, items, bands): ``text_key`` hashes the text, ``node`` names the multiset (16 bytes; null without words), ``items`` is its size, ``bands`` a 64-bit key for each band."""
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    schema = narrow.select("doc_id", "text_key").schema.add("node", "binary").add("items", "long").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(m // rows, dtype=U) * U(GOLDEN)
        factor = np.array([pow(MIX1, 2 * j + 1, 1 << 64) for j in range(rows)], U)
        for batch in batches:
            for at, part in _batches(batch.column(1).to_pylist()):
                n = len(part)
                doc, sh, weight = shingles(part, words)
                sig = signatures(doc, sh, weight, n, m).astype(U).reshape(n, m // rows, rows)
                keys = mix((mix(sig + U(GOLDEN)) * factor).sum(axis=2, dtype=U) + salt)
                name = multiset_hash(doc, sh, weight, n)
                items = np.bincount(doc, weight, minlength=n).astype(np.int64)
                nodes = pa.array([None if no else x.tobytes() for no, x in zip(items == 0, name, strict=True)], pa.binary())
                flat = pa.array(keys.astype(np.int64).reshape(-1))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (m // rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), nodes, pa.array(items), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "text_key", "node", "items", "bands"])

    return bounded_batches(narrow).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, items) of rows of (node, text): the multiset as a set, the k-th occurrence of a shingle being an item of its own.

    A row whose text is not the node's is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _batches(batch.column(1).to_pylist()):
                n = len(part)
                doc, sh, weight = shingles(part, words)
                which = np.repeat(np.arange(len(doc)), weight)
                k = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
                items = (sh[which] + k.astype(U) * U(GOLDEN)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[which], minlength=n))]).astype(np.int32)
                nodes = batch.column(0).slice(at, n)
                own = [x.as_py() == y.tobytes() for x, y in zip(nodes, multiset_hash(doc, sh, weight, n), strict=True)]
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))], names=["node", "items"]).filter(pa.array(own))

    return bounded_batches(docs).mapInArrow(run, "node binary, items array<long>")


def components(links: DataFrame, most: int) -> DataFrame:
    """(node, label): each linked node's smallest reachable node, by neighbour minima and pointer jumping.

    ``most``: a bound of the number of links.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges", 2 * most)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels", 2 * most)
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(around, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("far"))
        new = materialise(step.join(jump, F.col("mid") == F.col("j")).select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")), "near-labels", 2 * most)
        done = new.where("moved").isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            return new.select("node", "label")


def near_groups(docs: DataFrame, threshold: float = 0.8, words: int = 5, m: int = 140, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, links, texts.

    A class is a connected component of documents whose multisets of ``words``-word shingles have
    a weighted Jaccard similarity of ``threshold`` at least; ``class_id`` is its smallest doc_id.
    ``links`` counts the verified links of the document's text in the spanning comparison, and
    ``texts`` the class's different multisets.  With 28 bands of 5 rows a pair at 0.8 shares no
    band with a probability of 1.5e-5.

    Texts without words, empty and null ones are classes of their own.  A text of fewer words
    than a shingle is one shingle.  Repeated rows are in one class.  A null id counts in
    ``class_size``; a class of null ids only has a null class_id.  An empty table gives no rows.
    Texts are sketched whole, a megabyte of them at a time; a longer one by itself, with up to a
    hundred bytes of a worker's memory for each byte of it.
    """
    return _keyed_groups(docs, threshold, words, m, rows, id_col, text_col).drop("text_key", "label")


def _keyed_groups(docs: DataFrame, threshold: float = 0.8, words: int = 5, m: int = 140, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_groups`` with the hash of each row's text, ``text_key``, and the node that names its class, ``label``."""
    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialise(sketch(rows_in, m, rows, words), "near-sketch")
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("items").alias("items"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    n, bands = sketched.count(), m // rows
    nodes = materialise(nodes, "near-nodes", n)
    banded = nodes.select("node", "items", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    shared = materialise(shared, "near-shared", n * bands, 500_000)
    members = materialise(banded.join(small(shared, shared.count(), 1_000_000), "key"), "near-members", n * bands, 500_000)
    discard(shared)
    linked = verified_links(rows_in, sketched, members, threshold, words)
    if linked is None or linked[0] is None:
        linked = None
        grouped = sketched.select("doc_id", "text_key", F.col("node").alias("label"), F.lit(0).cast("long").alias("links"))
    else:
        links, labels = linked
        degree = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
        known = degree.join(labels, F.col("node") == F.col("a")).select(F.col("node").alias("__tw_n"), "label", "links")
        grouped = sketched.join(known, F.col("node") == F.col("__tw_n"), "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    if linked is None:
        of_nodes = nodes.select("n", "low", F.col("node").alias("label"))
    else:
        of_nodes = nodes.join(known, F.col("node") == F.col("__tw_n"), "left").select("n", "low", F.coalesce("label", "node").alias("label"))
    classes = of_nodes.groupBy(F.col("label").alias("__tw_l")).agg(F.sum("n").alias("class_size"), F.min("low").alias("class_id"), F.count(F.lit(1)).alias("texts")).where("class_size > 1")
    out = grouped.join(classes, F.col("label") == F.col("__tw_l"), "left")
    return out.select("doc_id", "text_key", "label", F.when(F.col("__tw_l").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "links", F.coalesce("texts", F.lit(1)).alias("texts"))


def _relabel(labels: DataFrame, found: DataFrame, members: int) -> DataFrame:
    """``labels`` (of every member) after new links: components of the graph of labels, which is small."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = found.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
    merged = components(between, found.count()).select(F.col("node").alias("__tw_old"), F.col("label").alias("__tw_new"))
    new = materialise(labels.join(merged, F.col("label") == F.col("__tw_old"), "left").select("node", F.coalesce("__tw_new", "label").alias("label")), "near-member-labels", members)
    discard(labels)
    return new


def _centres(named: DataFrame, turn: int, few: int) -> DataFrame:
    """(key, centre, its items and label) of unsettled buckets of ``named`` (key, node, items, place, met, label).

    In the first turn every bucket has one centre, the member that meets most others over all
    its buckets: what a group's members were copied from, rather than one of them.  Later,
    members outside their bucket's largest component are centres: about ``few`` of them by hash,
    four times as many each turn, or all if there are no more.  What is left after them has one label.
    """
    per_label = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("met")).alias("o"), "node", "items", "place")).alias("first"))
    per_key = per_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.min(F.struct("first", "label")).alias("first")).where("labels > 1")
    if turn == 0:
        return per_key.select("key", F.col("first.first.node").alias("centre"), F.col("first.first.items").alias("centre_items"), F.col("first.first.place").alias("centre_place"), F.col("first.label").alias("centre_label"))
    chance = F.lit(float(few << 2 * (turn - 1))) / (F.col("n") - F.col("top.n"))
    per_key = per_key.select("key", F.col("top.label").alias("__tw_top"), chance.alias("__tw_chance"))
    drawn = F.pmod(F.xxhash64("node", F.col("key"), F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return named.join(per_key, "key").where((F.col("label") != F.col("__tw_top")) & (drawn < F.col("__tw_chance"))).select("key", F.col("node").alias("centre"), F.col("items").alias("centre_items"), F.col("place").alias("centre_place"), F.col("label").alias("centre_label"))


def prefix_buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, node, items, place, met) of ``sets`` (node, items): an exact filter for similar pairs.

    A set's items in order of how rarely they are among ``sets``; two sets of similarity
    ``threshold`` share an item that is among the first n - ceil(t n) + 1 of both.  ``place`` is
    the item's place in that order, ``met`` how many sets share its items.  What common passages share comes late in it.  Items of one
    set only have a place, but are no buckets.
    """
    each = materialise(sets.select("node", F.size("items").cast("long").alias("n"), F.explode("items").alias("key")), "near-items")
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("of"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("of", "key"))
    ranked = each.join(often, "key").withColumn("place", rank.cast("long"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    ranked = ranked.where((F.col("place") <= first) & (F.col("of") > 1))
    return ranked.select("key", "node", F.col("n").alias("items"), "place", F.sum("of").over(W.partitionBy("node")).alias("met"))


class _Links:
    """The links verified so far, and the label of every member."""

    def __init__(self, sets: DataFrame, labels: DataFrame, threshold: float):
        self.sets, self.labels, self.threshold = sets, labels, threshold
        self.nodes = labels.count()
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None

    def turn(self, members: DataFrame, number: int, few: int) -> DataFrame | None:
        """Compare the centres of unsettled buckets with their other members; the members that are left, or None."""
        t = F.lit(self.threshold)
        rows = members.count()
        named = members.join(self.labels, "node")
        centres = materialise(_centres(named, number, few), "near-centres", rows)
        if centres.isEmpty():
            return None
        # no item before the first shared one is shared, so what may be is bounded by what comes after it
        after = F.least(F.col("items") - F.col("place"), F.col("centre_items") - F.col("centre_place")) + 1
        possible = after >= t / (t + 1.0) * (F.col("items") + F.col("centre_items")) - 1e-9
        met = named.join(centres, "key").where((F.col("label") != F.col("centre_label")) & possible)
        pairs = met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        left, right = self.sets.select(F.col("node").alias("a"), F.col("items").alias("x")), self.sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        near = (common >= t * (F.size("x") + F.size("y") - common) - 1e-9).alias("near")
        checked = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", near), "near-checked", rows, 20_000)
        found, seen = checked.where("near").select("a", "b"), checked.select("a", "b")
        self.tested = seen if self.tested is None else self.tested.union(seen)
        self.links = found if self.links is None else self.links.union(found)
        here = members.join(centres.select("key").distinct(), "key", "left_semi")
        here = materialise(here.join(centres.select("key", F.col("centre").alias("node")), ["key", "node"], "left_anti"), "near-members", rows)
        if not found.isEmpty():
            self.labels = _relabel(self.labels, found, self.nodes)
        return here

    def unsettled(self, members: DataFrame) -> DataFrame:
        """The nodes of buckets whose members have more than one label."""
        named = members.join(self.labels, "node")
        keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return named.join(keys, "key", "left_semi").select("node").distinct()


def verified_links(rows_in: DataFrame, sketched: DataFrame, members: DataFrame, threshold: float, words: int, few: int = 256) -> tuple[DataFrame, DataFrame] | None:
    """(links, labels of all members) over all buckets; None if no bucket has two members.

    First every band bucket compares its members with one centre, unless they are connected
    already.  The documents of buckets that are not settled by that - their members have more
    than one label - meet again in the buckets of an exact prefix filter, where turns go on, with
    more and more centres, until every bucket is settled; a centre leaves a bucket when it has
    met the others.  Pairs that were compared before, or whose sizes or places of the shared item
    rule the threshold out, are not compared.
    """
    labels = materialise(members.select("node").distinct().select("node", F.col("node").alias("label")), "near-member-labels", members.count())
    if labels.isEmpty():
        return None
    # one document of each node, of a null id only if it has no other
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("low")
    chosen = sketched.join(labels.select("node"), "node", "left_semi").groupBy("node").agg(low)
    chosen = chosen.select(F.col("node").alias("__tw_node"), F.col("low.doc_id").alias("__tw_id"), F.col("low.text_key").alias("__tw_key"))
    chosen = materialise(chosen, "near-chosen")
    own = (F.xxhash64("text") == F.col("__tw_key")) & F.col("doc_id").eqNullSafe(F.col("__tw_id"))
    # broadcast up to a size, so that only the texts wanted leave the scan
    texts = rows_in.join(small(chosen, chosen.count(), 1_000_000), own).select(F.col("__tw_node").alias("node"), "text")
    sets = materialise(shingle_sets(texts, words), "near-sets")
    # a row that is there several times would count each of the node's items as often
    if not sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sets = materialise(sets.dropDuplicates(["node"]), "near-sets")
    state = _Links(sets, labels, threshold)
    met = members.groupBy("node").agg(F.sum("met").alias("met"))
    members = members.drop("met").join(met, "node").withColumn("place", F.lit(1).cast("long"))
    left = state.turn(members, 0, few)
    if left is not None:
        left = materialise(prefix_buckets(sets.join(state.unsettled(left), "node", "left_semi"), threshold), "near-members")
        number = 0
        while left is not None:
            left = state.turn(left, number, few)
            number += 1
    return state.links, state.labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, all columns kept: that of the smallest id.

    Of rows of that id whose texts differ, the text with the smallest hash stays, of equal rows
    any; a null id comes after all others.  Texts without words are classes of their own and stay,
    each row of them.  Rows go by an anti-join on the id and the text's hash, for which the texts
    are shuffled only if those that go are too many to broadcast.  An empty table gives no rows.
    """
    mine = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")
    with temporary_tables(docs.sparkSession):
        classes = _keyed_groups(docs, id_col=id_col, text_col=text_col, **options).where("class_size > 1")
        rows = materialise(classes.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "near-classes")
        first = rows.groupBy(F.col("label").alias("__tw_l")).agg(F.min(mine).alias("__tw_first"))
        kept = F.col("__tw_first") == mine
        gone = rows.join(small(first, rows.count()), F.col("label") == F.col("__tw_l"))  # no more classes than rows.where(~kept | (F.col("n") > 1))
        gone = materialise(gone.select(F.col("doc_id").alias("__tw_id"), F.col("text_key").alias("__tw_key"), kept.alias("__tw_kept")), "near-gone", keep=True)
    few = gone.count()
    alike = F.col(id_col).eqNullSafe(F.col("__tw_id")) & (F.xxhash64(F.col(text_col)) == F.col("__tw_key"))
    rest = docs.join(small(gone, few), alike, "left_anti")
    again = gone.where("__tw_kept")
    if again.isEmpty():
        return rest
    return rest.unionByName(docs.join(small(again, few), alike).dropDuplicates(["__tw_id", "__tw_key"]).select(*docs.columns))

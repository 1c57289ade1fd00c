"""Toxicity by weak supervision.

Many voters (fixed lexicons, lexicons and stems mined from a bounded labelled sample, patterns)
vote on every document.  A generative model says how the votes come about: a document is toxic or
not, and each voter's vote depends on that and on at most one other voter's vote, along the forest
of the strongest dependencies.  EM over the counts of vote patterns of all documents estimates accuracies
and correlations together; the labelled sample joins in as rows whose class is seen.  What the
votes alone then say of a document, never its label, is what a linear classifier over words and
word stems is trained on, with labelled and unlabelled documents alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.common import bounded_batches, discard, held_out, materialise

#: Everyday insults, threats and hostile words.
INSULTS = "airhead bastard clown coward creep crybaby dimwit disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash ugly vermin weirdo worthless".split()
THREATS = "beat choke crush destroy die hang hate hurt kill murder punish rape shoot slap stab strangle torture".split()
ABROAD = (
    "abruti arschloch blödmann cabrón connard crétin depp dumm dummkopf débile estúpido gilipollas idiota idiotisch imbécil imbécile maldito miserable salaud schwachkopf stupide tonto versager".split()
)
WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)


@dataclass
class Voters:
    """Sets of features (a word, or a stem with a trailing *) and regular expressions; each votes yes or no."""

    lexicons: list[frozenset[str]]
    patterns: list[str] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.lexicons) + len(self.patterns)


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def features_of(words: Iterable[str]) -> set[str]:
    """The words themselves and their proper stems of 4 to 7 letters."""
    out = set(words)
    out.update(f"{w[:k]}*" for w in tuple(out) for k in STEMS if len(w) > k)
    return out


def _known(words: set[str], heads: frozenset[str], known: frozenset[str] | dict) -> set[str]:
    """The features of ``words`` that are in ``known``, whose first four letters are ``heads``."""
    return {f for f in features_of(w for w in words if w[:4] in heads) if f in known}


def _heads(features: Iterable[str]) -> frozenset[str]:
    return frozenset(f.rstrip("*")[:4] for f in features)


def mine(texts: Sequence[str | None], toxic: np.ndarray, least: float = 15.0, most: int = 4000) -> list[tuple[float, str]]:
    """(log-likelihood ratio, feature) of features that speak for the toxic class, strongest first; at least ``least``.

    Toxic texts are read twice: a table of counts by hash first, so that only features which may
    occur in two of them are ever held by name.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return []
    size = 1 << 22
    seen = np.zeros(size, np.uint16)
    for text in (t for t, y in zip(texts, toxic, strict=True) if y):
        slots = np.unique(np.fromiter((hash(f) % size for f in features_of(words_of(text))), np.int64))
        seen[slots] += 1
    in1: Counter[str] = Counter()
    for text in (t for t, y in zip(texts, toxic, strict=True) if y):
        in1.update(f for f in features_of(words_of(text)) if seen[hash(f) % size] > 1)
    in1 = Counter({f: n for f, n in in1.items() if n > 1})
    in0: Counter[str] = Counter()
    for text in (t for t, y in zip(texts, toxic, strict=True) if not y):
        in0.update(f for f in features_of(words_of(text)) if f in in1)
    found = []
    for f, a in in1.items():
        b = in0[f]
        if a / n1 <= 3 * b / n0:
            continue
        share = (a + b) / (n1 + n0)
        g = 2 * (a * np.log(a / (n1 * share)) + (b * np.log(b / (n0 * share)) if b else 0))
        if g >= least:
            found.append((g, f))
    return sorted(found, key=lambda x: (-x[0], x[1]))[:most]


def make_voters(mined: Sequence[tuple[float, str]], strong: float, least: float = 15.0) -> Voters:
    """Fixed lexicons, lexicons of mined words and of mined stems, and two patterns.

    Mined features of a ratio of ``strong`` at least are dealt to three voters each; those of a
    quarter of it at least, and the weak rest, have one voter each, so that chance finds do not
    speak with the voice of certain ones.
    """
    sets = [frozenset(x) for x in (INSULTS, THREATS, ABROAD)]
    middle, top = max(strong / 4, least), float("inf")
    for low, voters in ((strong, 3), (middle, 1), (least, 1)):
        for stems in (False, True):
            band = [f for g, f in mined if low <= g < top and f.endswith("*") == stems]
            sets += [frozenset(band[i::voters]) for i in range(voters) if band[i::voters]]
        top = low
    named = "|".join(INSULTS)
    hidden = "|".join(re.escape(w).replace("i", "[i1!*]").replace("o", "[o0*]").replace("e", "[e3*]").replace("u", "[u*]") for w in INSULTS if len(w) > 3)
    return Voters(sets, [rf"\b(?:you|your|ur)\b[^.!?\n]{{0,40}}\b(?:{named})\b", rf"\b(?=\w*[13!0*])(?:{hidden})\b"])


class Reader:
    """Finds the features of a list in texts, and what the voters make of them."""

    def __init__(self, voters: Voters, features: Sequence[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.heads = _heads(features)
        self.patterns = [re.compile(p) for p in voters.patterns]
        self.lexicons = len(voters.lexicons)
        self.bits = [sum(1 << j for j, lexicon in enumerate(voters.lexicons) if f in lexicon) for f in features]

    def read(self, text: str | None) -> tuple[int, list[int]]:
        """A bit for each voter, and the places of the text's features in order."""
        if not text:
            return 0, []
        low = text.lower()
        found = sorted(self.place[f] for f in _known(set(WORDS.findall(low)), self.heads, self.place))
        bits = 0
        for i in found:
            bits |= self.bits[i]
        for j, p in enumerate(self.patterns):
            # the first pattern needs a word of the first lexicon, the second one a disguised letter
            if (bits & 1 or j) and p.search(low):
                bits |= 1 << (self.lexicons + j)
        return bits, found


def _unpack(bits: np.ndarray, voters: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(voters) & 1).astype(float)


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(yes | class, vote of its parent in the forest)."""

    prior: float
    parent: np.ndarray  # -1 for voters that depend on the class alone
    given: np.ndarray  # (2 classes, 2 votes of the parent, voters); both rows alike without a parent

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """Of toxic, given the votes."""
        v = _unpack(bits, len(self.parent))
        above = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0).astype(int)
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for y, sign in ((1, 1), (0, -1)):
            yes = self.given[y][above, np.arange(len(self.parent))]
            z += sign * np.log(np.where(v > 0, yes, 1 - yes)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _forest(pairs: np.ndarray, single: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in the spanning forest of most mutual information given the class; -1 for roots.

    Pairs below ``least`` nats are taken as independent: what is that weak costs more in certainty
    about the classes than it explains.  ``pairs`` (2, voters, voters) counts both votes yes, ``single`` (2, voters) one, ``total`` (2,) rows.
    """
    voters = single.shape[1]
    info = np.zeros((voters, voters))
    for y in (0, 1):
        n = max(total[y], 1e-9)
        p = single[y] / n
        both = pairs[y] / n
        for cell, a, b in ((both, p[:, None], p), (p[:, None] - both, p[:, None], 1 - p), (p - both, 1 - p[:, None], p), (1 - p[:, None] - p + both, 1 - p[:, None], 1 - p)):
            cell = np.maximum(cell, 0)
            info += n / total.sum() * np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-300) / np.maximum(a * b, 1e-300)), 0)
    parent = np.full(voters, -1)
    inside, best, via = np.zeros(voters, bool), np.full(voters, -np.inf), np.full(voters, -1)
    at = 0
    for _ in range(voters):
        inside[at] = True
        parent[at] = via[at] if best[at] >= least else -1
        nearer = ~inside & (info[at] > best)
        best[nearer], via[nearer] = info[at][nearer], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
    return parent


def fit_label_model(bits: np.ndarray, counts: np.ndarray, anchors: np.ndarray, toxic: np.ndarray, voters: int, prior: float, rounds: int = 30, smooth: float = 2.0, least: float = 0.02) -> LabelModel:
    """EM over vote patterns and their counts; ``anchors`` are votes of sampled documents whose class is seen.

    It starts from independent voters as the anchors have them; each round draws the forest anew.
    """
    v, a = _unpack(bits, voters), _unpack(anchors, voters)
    known = np.stack([~toxic, toxic]).astype(float)
    none = np.full(voters, -1)
    if toxic.any() and (~toxic).any():
        start = (known @ a + 0.5) / (known.sum(1, keepdims=True) + 2.0)
    else:
        start = np.stack([np.full(voters, 0.02), np.full(voters, 0.4)])
    start = np.clip(start, 1e-4, 1 - 1e-4)
    model = LabelModel(float(np.clip(prior, 1e-3, 0.5)), none, np.stack([start, start], axis=1))
    votes = np.concatenate([v, a])
    for _ in range(rounds):
        q = model.posterior(bits)
        weight = np.stack([np.concatenate([(1 - q) * counts, known[0]]), np.concatenate([q * counts, known[1]])])
        total = weight.sum(1)
        single = weight @ votes
        pairs = np.stack([(votes * w[:, None]).T @ votes for w in weight])
        rate = np.clip((single + 0.5) / (total[:, None] + 2.0), 1e-4, 1 - 1e-4)
        parent = _forest(pairs, single, total, least)
        given = np.stack([rate, rate], axis=1)
        for j in np.flatnonzero(parent >= 0):
            up = parent[j]
            for y in (0, 1):
                for vote, yes, n in ((1, pairs[y, j, up], single[y, up]), (0, single[y, j] - pairs[y, j, up], total[y] - single[y, up])):
                    given[y, vote, j] = np.clip((max(yes, 0) + smooth * rate[y, j]) / (max(n, 0) + smooth), 1e-4, 1 - 1e-4)
        model = LabelModel(model.prior, parent, given)
    return model


@dataclass
class LinearModel:
    bias: float
    weights: dict[str, float]

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        reader = Reader(Voters([]), list(self.weights))
        w = np.array([*self.weights.values(), 0.0])
        z = np.array([self.bias + sum(w[i] for i in reader.read(t)[1]) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_linear(rows: Sequence[Sequence[int]], target: np.ndarray, importance: np.ndarray, features: Sequence[str], rounds: int = 400, decay: float = 0.02) -> LinearModel:
    """Logistic regression on soft labels, weights at or above zero, by AdaGrad; ``rows`` are the places of each document's features."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    w, bias = np.zeros(len(features)), -2.0
    past_w, past_b = np.full(len(features), 1e-8), 1e-8
    total = importance.sum()
    for _ in range(rounds):
        z = bias + np.bincount(row, w[col], minlength=len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * importance / total
        grad = np.bincount(col, r[row], minlength=len(features)) + decay / total * w
        past_w, past_b = past_w + grad**2, past_b + r.sum() ** 2
        w = np.maximum(w - 0.3 * grad / np.sqrt(past_w), 0)
        bias -= 0.3 * r.sum() / np.sqrt(past_b)
    return LinearModel(float(bias), {f: float(x) for f, x in zip(features, w, strict=True)})


def labelled_sample(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, most: tuple[int, int], most_bytes: int) -> tuple[list[str | None], np.ndarray, float]:
    """Texts and labels of a bounded sample, and the share of label 1 in all labels.

    Of rows whose crc32(doc_id as text) mod ``modulus`` is not ``remainder``, at most ``most`` of
    label 0 and of label 1, first by hashed id, with at most ``most_bytes`` of text in all, split
    as ``most`` is; a text that no longer fits is left out whole.  A row that is there several
    times counts once; contradicting labels count as 1.
    """
    usable = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), modulus, remainder))
    usable = usable.groupBy(F.col("doc_id").alias("__tw_id")).agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = lambda rows, y, *by: rows.where(F.col("label") == y).orderBy(*by).limit(most[y])
    chosen = first(usable, 0, F.xxhash64("__tw_id"), "__tw_id").union(first(usable, 1, F.xxhash64("__tw_id"), "__tw_id"))
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__tw_id")).select("doc_id", "label", "text", F.xxhash64("text").alias("key"))
    rows = materialise(rows.hint("rebalance"), "labelled")  # the corpus is read once for it
    sizes = rows.groupBy("label", "doc_id", "key").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    picked = []
    for y in (0, 1):
        room = most_bytes * most[y] // sum(most)
        for r in first(sizes, y, F.xxhash64("doc_id"), "doc_id", "key").collect():
            if r["bytes"] <= room:
                room -= r["bytes"]
                picked.append((r["doc_id"], r["key"]))
    known = sum(shares.get(y, 0) for y in (0, 1))
    share = shares.get(1, 0) / known if known else 0.05
    if not picked:
        discard(rows)
        return [], np.zeros(0, bool), share
    wanted = docs.sparkSession.createDataFrame(picked, docs.select(F.col("doc_id").alias("__tw_d")).schema.add("__tw_k", "long"))
    texts = rows.join(F.broadcast(wanted), (F.col("doc_id") == F.col("__tw_d")) & (F.col("key") == F.col("__tw_k"))).dropDuplicates(["doc_id", "key"])
    found = sorted(texts.select("doc_id", "key", "label", "text").collect(), key=lambda r: (r["doc_id"], r["key"]))
    discard(rows)
    return [r["text"] for r in found], np.array([r["label"] == 1 for r in found], bool), share


def cast_votes(rows: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, bits, features) of rows of (doc_id, text): each document's votes and features."""
    schema = rows.select("doc_id").schema.add("bits", "long", False).add("features", T.ArrayType(T.IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [reader.read(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in read], pa.int64()), pa.array([f for _, f in read], pa.list_(pa.int32()))], names=schema.names)

    return bounded_batches(rows).mapInArrow(run, schema)


def voted_sample(votes: DataFrame, most: int, cells: int) -> list[tuple[int, list[int], float]]:
    """(bits, features, weight) of a bounded sample of voted documents, labelled or not.

    Documents with equal votes and features are one row.  At most ``most`` rows with ``cells``
    features in all, first by hash, half of each for documents that got a vote and half for those
    without; each half is weighted to the number of documents it stands for.
    """
    alike = votes.groupBy("bits", "features").agg(F.count(F.lit(1)).alias("n")).withColumn("__tw_h", F.xxhash64("bits", "features"))
    alike = materialise(alike, "tox-alike")
    out = []
    for part in (alike.where("bits = 0"), alike.where("bits <> 0")):
        total = part.agg(F.sum("n").alias("n")).first()["n"] or 0
        first = part.orderBy("__tw_h", "bits", "features").limit(most // 2)
        so_far = F.sum(F.size("features")).over(W.orderBy("__tw_h", "bits", "features"))
        rows = first.withColumn("__tw_so_far", so_far).where(F.col("__tw_so_far") <= cells // 2).select("bits", "features", "n").collect()
        here = sum(r["n"] for r in rows)
        out += [(r["bits"], r["features"], r["n"] * total / here) for r in rows]
    discard(alike)
    return sorted(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, most: tuple[int, int] = (6000, 3000), most_bytes: int = 32 << 20, rows: int = 20_000, cells: int = 400_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[LinearModel, DataFrame | None]:
    """The trained classifier, and the votes of all documents (doc_id, bits, features) that it was trained with.

    Labels come only from rows whose crc32(id as text) mod ``modulus`` is not ``remainder``; a
    sample bounded by ``most`` (clean, toxic) and ``most_bytes`` mines the voters' words and joins
    the label model as rows of seen class.  Vote patterns are counted over all documents that are
    not held out; the classifier learns the votes' posteriors of at most ``rows`` rows of those
    with ``cells`` features in all (see ``voted_sample``).  With no labels at all the fixed insults
    make the model, and nothing votes.
    """
    texts_of = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    texts, toxic, share = labelled_sample(texts_of, marks, modulus, remainder, most, most_bytes)
    if not texts:
        return LinearModel(-3.0, dict.fromkeys(INSULTS, 4.0)), None
    mined = mine(texts, toxic)
    # what tells a fortieth of the toxic sample from a clean one is strong, whatever the sample's size
    voters = make_voters(mined, max(15.0, 0.075 * int(toxic.sum())))
    features = [f for _, f in mined]
    features += sorted(set(INSULTS + THREATS + ABROAD) - set(features))
    reader = Reader(voters, features)
    anchors = np.array([reader.read(t)[0] for t in texts], np.int64)
    votes = materialise(cast_votes(texts_of, reader), "tox-votes", keep=True)
    learned = votes.where(~held_out(F.col("doc_id"), modulus, remainder))
    # at most 2 ** (number of voters) patterns, whatever the corpus
    tally = sorted((r["bits"], r["n"]) for r in learned.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect())
    model = fit_label_model(np.array([b for b, _ in tally], np.int64), np.array([n for _, n in tally], float), anchors, toxic, len(voters), share)
    sample = voted_sample(learned, rows, cells)
    if not sample:
        return LinearModel(-3.0, dict.fromkeys(INSULTS, 4.0)), None
    target = model.posterior(np.array([b for b, _, _ in sample], np.int64))
    return train_linear([f for _, f, _ in sample], target, np.array([n for _, _, n in sample]), features), votes


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1: toxic).

    See ``fit_toxicity``; texts are read once, for votes and features, and scored from these.  Null
    and empty texts get the score of a text without any known feature.  Repeated rows are scored
    each; a null id is not held out; an empty table gives no rows.
    """
    linear, votes = fit_toxicity(docs, labels, modulus, remainder, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    if votes is None:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        votes = cast_votes(rows, Reader(Voters([]), list(linear.weights)))
    weights = F.lit(np.array(list(linear.weights.values()), np.float64))
    z = F.aggregate("features", F.lit(linear.bias), lambda so_far, i: so_far + F.get(weights, i))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    scored = votes.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept.

    Python sees the texts only and returns a number each; nothing is shuffled.  Nulls, repeated
    rows and empty tables are as in ``score_toxicity``: each row is judged by its own text, and a
    null text stays.
    """
    linear, votes = fit_toxicity(docs, labels, text_col=text_col, **options)
    if votes is not None:
        discard(votes)
    strong = LinearModel(linear.bias, {f: w for f, w in linear.weights.items() if w > 1e-6})

    score = F.arrow_udf(lambda texts: pa.array(strong.score(texts.to_pylist())), "double")
    return bounded_batches(docs).where(score(F.col(text_col)) < F.lit(threshold))

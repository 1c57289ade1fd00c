import random

import numpy as np
import pytest

from timeweave.llm import additive_quantisation as aq
from timeweave.llm import quality_crf, toxicity

# toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    bad = ["grubbax", "grubbeln", "grubbost", "idiot", "scum"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, docs):
    rows, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, "word " * 50000), (None, "you idiot"), (3, rows[3][1])]
    out = toxicity.score_toxicity(docs(rows + extra), label_table(spark, labels)).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and all(0 <= r["score"] <= 1 for r in out)
    wrong = sum(r["predicted"] != truth[r["doc_id"]] for r in held)
    assert wrong <= 2
    empty = {r["doc_id"]: r["predicted"] for r in out if r["doc_id"] in (9001, 9002, 9003)}
    assert set(empty.values()) == {0}


def test_held_out_labels_have_no_say(spark, docs):
    import zlib

    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    scores = lambda ls: sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs(rows), label_table(spark, ls)).collect())
    assert scores(labels) == scores(flipped)


def test_toxicity_without_labels_and_rows(spark, docs):
    none = label_table(spark, [])
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs([(1, "you are an idiot and scum"), (2, "a fine day")]), none).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.score_toxicity(docs([]), none).collect() == []


def test_reject_keeps_columns(spark, docs):
    rows, labels = corpus(300)
    df = docs(rows)
    out = toxicity.reject_toxic(df, label_table(spark, labels))
    assert out.columns == df.columns
    gone = {r[0] for r in rows} - {r["doc_id"] for r in out.collect()}
    truth = {i for i, _, t in labels if t}
    assert len(gone ^ truth) <= 5


def test_label_model_finds_rates_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    a = np.where(y, rng.random(20000) < 0.8, rng.random(20000) < 0.02)
    b = np.where(y, rng.random(20000) < 0.6, rng.random(20000) < 0.05)
    c = np.where(y, rng.random(20000) < 0.7, rng.random(20000) < 0.03)
    bits = a * 1 + b * 2 + c * 4 + c * 8  # the last voter repeats the third
    values, counts = np.unique(bits, return_counts=True)
    some = slice(0, 300)
    model = toxicity.fit_label_model(values, counts.astype(float), bits[some], y[some], 4, 0.2)
    assert abs(model.given[1][0][0] - 0.8) < 0.08 and abs(model.given[0][0][1] - 0.05) < 0.03
    assert (model.parent >= 0).sum() == 1 and (model.parent[2] == 3 or model.parent[3] == 2)
    below = int(np.flatnonzero(model.parent >= 0)[0])
    assert (model.given[:, 1, below] > 0.97).all() and (model.given[:, 0, below] < 0.02).all()
    # the repeated voter adds next to nothing to what the third says alone
    once = toxicity.fit_label_model(*(lambda u: (u[0], u[1].astype(float)))(np.unique(bits & 7, return_counts=True)), bits[some] & 7, y[some], 3, 0.2)
    assert np.abs(model.posterior(bits) - once.posterior(bits & 7)).max() < 0.1
    assert ((model.posterior(bits) > 0.5) == y).mean() > 0.95


# quality


def pages(n=300, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4, 30))).capitalize() + "."
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        if good:
            text = "\n".join(line() for _ in range(rng.randrange(1, 9)))
        else:
            kind = rng.randrange(3)
            text = "\n".join([" ".join(w + rng.choice(["###", "%%%"]) for w in line().split()), " ".join([rng.choice(words)] * 30) + " x", " | ".join(line().split())][kind] for _ in range(rng.randrange(1, 5)))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out(spark, docs):
    rows, labels = pages()
    extra = [(9001, None), (9002, ""), (9003, " \n\t\n"), (9004, "A fine line.\n" * 20000), (None, "ok then."), (5, rows[5][1])]
    out = quality_crf.score_quality(docs(rows + extra), label_table(spark, labels)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == len(rows) + len(extra) and len(held) > 40
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in held) <= 1
    assert {r["score"] for r in out if r["doc_id"] in (9001, 9002, 9003)} == {0.0}
    assert quality_crf.score_quality(docs([]), label_table(spark, labels)).collect() == []
    assert {r["score"] for r in quality_crf.score_quality(docs([(1, "x"), (2, "")]), label_table(spark, [])).collect()} == {0.5, 0.0}


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    doc = np.array([0, 0, 0, 1, 2, 2])
    unary, step = rng.normal(size=6), rng.normal(size=(2, 2))
    good, pairs, z = quality_crf.marginals(doc, unary, step)
    want, want_pairs, want_z = np.zeros(6), np.zeros((2, 2)), 0.0
    for d in (0, 1, 2):
        at = np.flatnonzero(doc == d)
        total, hit, seen = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for ys in product((0, 1), repeat=len(at)):
            w = np.exp(sum(unary[i] * y for i, y in zip(at, ys, strict=True)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += w
            hit += w * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                seen[a, b] += w
        want[at], want_z = hit / total, want_z + np.log(total)
        want_pairs += seen / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(z, want_z)


def test_batches_do_not_change_scores():
    rows, labels = pages(120)
    texts = [t for _, t in rows]
    chain = quality_crf.train_chain(texts, np.array([q == 1 for _, q, _ in labels]), 0.75)
    assert np.allclose(chain.score(texts), chain.score(texts, limit=200))


# nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, b"c", 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, codes binary, norm float")


def brute(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            found = sorted((-(x * y).sum(), i) for i, y in ok if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_search_small_is_exact_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 8), (140, [float("nan")] + [1.0] * 7), (160, [None] + [1.0] * 7), (180, [float("inf")] + [1.0] * 7), (200, []), (None, [1.0] * 8), (220, [1.0, 2.0])]
    rows += [(i, [3.0] * 8) for i in (301, 300, 302, 320)]  # ties
    df = vectors(spark, rows)
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 8], 20)
    got = {}
    for r in sorted(aq.search(df, df.where("vec_id % 20 = 0"), k=20, words=16).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_search_recall_and_few_candidates(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 32))
    x = centres[rng.integers(0, 10, 6000)] + 0.8 * rng.normal(size=(6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = vectors(spark, rows).coalesce(2)
    got = {}
    for r in aq.search(df, df.where("vec_id % 20 = 0"), k=20, query_block=200).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 6000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (300 * 20) >= 0.9
    few = vectors(spark, rows[:5])
    assert aq.search(few, few.where("vec_id = 0"), k=20, words=4).count() == 4
    none = vectors(spark, [])
    assert aq.search(none, none).collect() == [] and aq.search(none, few).collect() == []


def found_by(df, queries, **options):
    return sorted(map(tuple, aq.search(df, queries, **options).collect()))


def test_search_does_not_depend_on_the_layout_and_finds_unstructured_vectors(spark):
    x = np.random.default_rng(11).normal(size=(5000, 48)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = vectors(spark, rows)
    one, many = (found_by(d, d.where("vec_id % 20 = 0"), sample_rows=2048) for d in (df.coalesce(1), df.repartition(7)))
    assert one == many
    want = brute(rows, 20)
    hits = sum(v in {i for i, _ in want[q]} for q, _, v, _ in one)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_search_takes_every_row_but_the_query_itself(spark):
    a, b = [1.0, 2.0, 0.0], [0.0, 1.0, 1.0]
    rows = [(20, a), (20, a), (20, b), (21, a), (40, b)]
    df = vectors(spark, rows)
    got = found_by(df, df.where("vec_id = 20"), k=10, words=2, books=2)
    want = []
    for n, (_, q) in enumerate(rows[:3]):
        others = [(-sum(x * y for x, y in zip(q, v, strict=True)), i) for m, (i, v) in enumerate(rows) if m != n]
        want += [(20, r + 1, i, -s) for r, (s, i) in enumerate(sorted(others))]
    assert got == sorted(want)


def test_codes_get_better_with_beam_and_books():
    x = np.random.default_rng(5).normal(size=(1500, 16)).astype(np.float32)
    left = lambda t, b: ((x - t[np.arange(len(t)), aq.beam_encode(x, t, b)].sum(1)) ** 2).sum(1).mean()
    small, large = aq.fit_codebooks(x, 2, 32), aq.fit_codebooks(x, 6, 32)
    assert left(large, 4) < left(small, 4) and left(large, 8) <= left(large, 1) + 1e-6


@pytest.mark.parametrize("value", [[1.0, None], [float("nan"), 1.0], [0.0, 0.0], None, []])
def test_unusable(spark, value):
    df = spark.createDataFrame([(value,)], "v array<float>")
    assert df.select(aq.usable(df["v"])).first()[0] is False

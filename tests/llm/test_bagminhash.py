import random
import re
from collections import Counter

import numpy as np
import pytest

from timeweave.llm import bagminhash as bmh


def brute_classes(rows, threshold=0.8):
    bags = {}
    for k, (_, text) in enumerate(rows):
        words = re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
        bags[k] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            either = sum((bags[i] | bags[j]).values())
            if either and both / either >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(k)
    out = {}
    for ks in members.values():
        low = min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
        for k in ks:
            out[k] = (rows[k][0], low, len(ks))
    return sorted(out.values(), key=str)


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def make_rows(seed, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.05])))))
    passage = " ".join(word() for _ in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(word() for _ in range(rng.randrange(20, 80)))) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(docs, seed):
    rows = make_rows(seed)
    got = bmh.near_groups(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str) == brute_classes(rows)


def test_odd_texts(docs):
    long = " ".join(f"w{i % 1000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One  two!"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (None, "only null here ok yes"), (7, long), (8, long + " end"), (9, "x " * 30), (10, "x " * 33), (11, "x " * 60)]
    got = bmh.near_groups(docs(rows)).collect()
    want = brute_classes(rows)
    fixed = [(i, c, n) for i, c, n in want]
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str) == fixed
    assert bmh.near_groups(docs([])).collect() == []


def test_large_groups_and_common_passage(docs):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join(edited(rng, base, 0.015))) for i in range(200)]
    rows += [(3000 + i, " ".join(base[:55]) + " " + " ".join(f"u{i}_{k}" for k in range(40))) for i in range(150)]
    got = bmh.near_groups(docs(rows)).collect()
    unique = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str)
    assert unique == brute_classes(rows)


def test_near_dedup_keeps_the_smallest(docs):
    rows = make_rows(4, 5) + [(None, "no id at all here")]
    df = docs(rows)
    out = bmh.near_dedup(df)
    want = {c for i, c, _ in brute_classes(rows)}
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == want


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = dict(enumerate(rng.integers(1, 9, 200)))
    b = {k: v if rng.random() < 0.6 else int(rng.integers(0, 12)) for k, v in a.items()}
    b = {k: v for k, v in b.items() if v}
    true = sum(min(v, b.get(k, 0)) for k, v in a.items()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a)
    hits = []
    for run in range(30):
        name = lambda d: np.array([k * 1000003 + run for k in sorted(d)], np.uint64)
        doc = np.array([0] * len(a) + [1] * len(b))
        sig = bmh.signatures(doc, np.concatenate([name(a), name(b)]), np.array([a[k] for k in sorted(a)] + [b[k] for k in sorted(b)]), 2, 140)
        hits.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(hits) - true) < 4 * np.std(hits) / 30**0.5 + 0.005


def test_signature_does_not_depend_on_the_batch():
    texts = [b"a b c d e f g h", b"", b"x y z", b"a b c d e f g h"]
    together = bmh.signatures(*bmh.shingles(texts, 5), 4, 140)
    for i, t in enumerate(texts):
        assert (bmh.signatures(*bmh.shingles([t], 5), 1, 140)[0] == together[i]).all()
    assert (together[0] == together[3]).all() and not together[1].any()


def test_one_id_of_several_texts(docs):
    rng = random.Random(6)
    one, two = ([f"{c}{i}" for i in range(100)] for c in "ab")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (5, " ".join(one)), (6, " ".join(edited(rng, one, 0.01))), (7, " ".join(edited(rng, two, 0.01))), (8, "something else altogether, five words")]
    got = bmh.near_groups(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str) == brute_classes(rows)


def test_repeated_rows_in_a_bucket_of_several_components(spark):
    one = [f"a{i}" for i in range(104)]
    two = one[:97] + [f"b{i}" for i in range(7)]
    other = [[f"{c}{i}" for i in range(104)] for c in "cd"]
    rows = [(1, one)] * 3 + [(2, two)] * 3 + [(3, other[0]), (4, other[1])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    sketched = bmh.sketch(df, 140, 5, 5).cache()
    nodes = {r["doc_id"]: bytes(r["node"]) for r in sketched.collect()}
    met = [(1, i, 4) for i in nodes] + [(2, 3, 2), (2, 4, 2)]
    # 3 meets most others and is the first centre, so 1 and 2 are left to the prefix filter
    members = spark.createDataFrame([(k, bytearray(nodes[i]), 100, n + 9 * (i == 3)) for k, i, n in met], "key long, node binary, items long, met long")
    links, _ = bmh.verified_links(df, sketched, members, 0.8, 5)
    assert [{bytes(r["a"]), bytes(r["b"])} for r in links.collect()] == [{nodes[1], nodes[2]}]


def test_texts_of_null_and_reused_ids(docs):
    rng = random.Random(8)
    one, two = ([f"{c}{i}" for i in range(100)] for c in "ab")
    rows = [(1, " ".join(one)), (5, " ".join(one[:99]) + " end"), (5, "a unique text that no other row is like"), (None, " ".join(two)), (None, " ".join(edited(rng, two, 0.01)))]
    got = bmh.near_groups(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str) == brute_classes(rows)
    kept = {(r["doc_id"], r["text"]) for r in bmh.near_dedup(docs(rows)).collect()}
    assert kept == {rows[0], *rows[2:]}


def test_one_row_of_each_class_stays(docs):
    rng = random.Random(10)
    one, two, three = ([f"{c}{i}" for i in range(100)] for c in "abc")
    rows = [(1, " ".join(one)), (1, " ".join(one)), (4, " ".join(edited(rng, one, 0.01))), (None, " ".join(two)), (None, " ".join(edited(rng, two, 0.01))), (9, " ".join(three)), (9, " ".join(edited(rng, three, 0.01)))]
    out = bmh.near_dedup(docs(rows))
    got = [(r["doc_id"], r["text"].split()[0][0]) for r in out.collect()]
    assert out.columns == docs(rows).columns and sorted(got, key=str) == [(1, "a"), (9, "c"), (None, "b")]

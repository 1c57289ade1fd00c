import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timeweave.llm import chat, exact_dedup, licenses, mixing


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(autouse=True)
def native_stages(monkeypatch):
    """Every table that a native operator writes on its way is looked at too, not its last plan alone."""
    for module in (chat, exact_dedup):
        write = module.materialise

        def checked(df, *args, write=write, **options):
            no_python(df)
            return write(df, *args, **options)

        monkeypatch.setattr(module, "materialise", checked)


# licences


def brute_scan(rows, threshold=0.7):
    grams = {k: licenses.bigrams_of(v) for k, v in licenses.TEMPLATES.items()}
    out = set()
    for i, text in rows:
        if text is None:
            continue
        text = re.sub("\r\n?", "\n", text)
        lines, paras = text.split("\n"), re.split(r"\n[ \t]*\n", text)
        units = [("line", n, x) for n, x in enumerate(lines)]
        units += [("paragraph", n, x) for n, x in enumerate(paras) if len(paras) > 1 and "\n" in x]
        units += [("document", 0, text)] if len(lines) > 1 else []
        for kind, n, part in units:
            g = licenses.bigrams_of(part)
            best = max(((2 * len(g & t) / (len(g) + len(t)), [-ord(c) for c in k], k) for k, t in grams.items() if g | t), default=None)
            if g and best[0] >= threshold:
                top = min(k for k, t in grams.items() if 2 * len(g & t) / (len(g) + len(t)) == best[0])
                out.add((i, kind, n, top, round(best[0], 9)))
    return out


def test_license_scan_equals_brute_force(docs):
    mit, apache = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["apache-2.0-notice"]
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    rows = [
        (1, "Released under the MIT License."), (2, "text\nReleased under the MIT license!!\nmore"), (3, None), (4, ""), (5, "license"), (6, mit.upper()),
        (7, f"intro line\n\n{wrapped}\n \nend of it"), (8, wrapped), (9, apache + " And a few words more at the end."), (10, "word " * 40000 + "\nAll rights reserved.\r\nx"),
        (11, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."), (12, "licensed"), (13, "été Released under the MIT License é"), (1, "Released under the MIT License."),
        (14, " ".join(mit.split()[:70])), (15, "the license of the dog is under review by the public"),
    ]
    df = licenses.scan_licenses(docs(rows))
    no_python(df)
    got = df.collect()
    assert {(r.doc_id, r.unit, r.unit_no, r.license, round(r.dice, 9)) for r in got} == brute_scan(rows)
    assert sum(r.doc_id == 1 for r in got) == 2 and licenses.scan_licenses(docs([])).collect() == []


def test_whole_licences_are_named(docs):
    names = [n for n in licenses.TEMPLATES if n.endswith("-text")]
    rows = [(i, "Copyright (c) 2020 someone\n" + licenses.TEMPLATES[n].replace(". ", ".\n")) for i, n in enumerate(names)]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs(rows)).where("unit = 'document'").collect()}
    assert got == dict(enumerate(names)) and "bsd-3-clause-text" in names


def test_key_words_lose_no_match():
    keys = set(licenses.key_words(licenses.TEMPLATES, 0.7))
    for name, text in licenses.TEMPLATES.items():
        grams = licenses.bigrams_of(text)
        untouched = sum(not keys & set(g.split()) for g in grams)
        assert untouched < len(grams) * 0.7 / 1.3 + 1e-9, name


# mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, open_ = sum(sizes.values()), set(names)
    while True:
        rest = total - sum(3 * sizes[n] for n in names if n not in open_)
        level = rest / sum(w[n] for n in open_) if open_ else 0
        over = {n for n in open_ if w[n] * level > 3 * sizes[n] + 1e-12}
        if not over:
            return {n: w[n] * level if n in open_ else 3.0 * sizes[n] for n in names}
        open_ -= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(40)), rng.choice(["a", "b", "c", "d", None])) for i in range(200)]
    rows += [(i, "x y\tz q", "a") for i in range(200, 320)] + [(5, "twice here", "b"), (5, "twice here", "b"), (900, None, "e"), (901, "", "e")]
    df = mixing.mix(docs(rows))
    got = df.collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs(rows).repartition(7)).collect()
    assert sorted((r["doc_id"] or 0, r["cum"], r["taken"]) for r in got) == sorted((r["doc_id"] or 0, r["cum"], r["taken"]) for r in again)


def test_mixed_documents_repeat_and_keep_columns(docs):
    rows = [(i, "a b c", "big") for i in range(60)] + [(100 + i, "d e", "small") for i in range(5)] + [(7, "a b c", "big")]
    df = docs(rows)
    plan = {}
    for r in mixing.mix(df).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["times"]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counted = defaultdict(int)
    for r in out.collect():
        counted[r["doc_id"]] += 1
    assert dict(counted) == {k: v for k, v in plan.items() if v}


def test_mixed_documents_keep_texts_of_null_and_reused_ids(docs):
    rows = [(5, "a b c"), (5, "d e f"), (None, "g h i"), (None, "j k l")]
    out = mixing.mixed_documents(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(rows, key=str)


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).collect() == [] and mixing.mixed_documents(docs([])).collect() == []
    assert [r["taken"] for r in mixing.mix(docs([(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


# exact copies


COPIES = [(1, "Hello"), (2, "hELLO"), (3, "hello "), (4, None), (5, ""), (6, "Éa"), (7, "éa"), (8, "x" * 100_000), (9, "X" * 100_000), (9, "x" * 100_000), (10, "alone"), (10, "alone"), (None, "hello"), (None, "null id"), (11, "p" * 300 + "1"), (12, "p" * 300 + "2")]


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_groups(docs, hash_all):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in COPIES:
        groups[lower(t)].append(i)
    df = exact_dedup.exact_groups(docs(COPIES), hash_all=hash_all)
    no_python(df)
    got = df.collect()
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            first = i == keep and not kept
            kept |= first
            want.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    if hash_all:
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    else:
        assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((w[:4] for w in want), key=key)
        assert all(r["full_hash"] for r in got if r["group_size"] > 1) and any(r["full_hash"] is None for r in got)


def test_exact_dedup_keeps_one_of_each(docs):
    df = docs(COPIES)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    left = sorted(((r["doc_id"], (r["text"] or "")[:8]) for r in out.collect()), key=str)
    assert left == sorted([(2, "hELLO"), (3, "hello "), (5, ""), (6, "Éa"), (7, "éa"), (9, "x" * 8), (10, "alone"), (None, "null id"), (11, "p" * 8), (12, "p" * 8)], key=str) or left == sorted([(2, "hELLO"), (3, "hello "), (5, ""), (6, "Éa"), (7, "éa"), (9, "X" * 8), (10, "alone"), (None, "null id"), (11, "p" * 8), (12, "p" * 8)], key=str)
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def test_hot_group_of_copies(docs):
    rows = [(i, "the same text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(300)]
    got = exact_dedup.exact_groups(docs(rows)).where("kept").collect()
    assert len(got) == 301 and max(r["group_size"] for r in got) == 3000


# conversations


def talk(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "z") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, pos long, h1 string")


def brute_chat(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].add((t, r, x))
    key = lambda v: tuple((x is not None, x) for x in v)
    seqs = {c: [(r, x) for t, r, x in sorted(v, key=key)] for c, v in convs.items()}
    kept = {}
    for c, s in seqs.items():
        if any(o != c and p[: len(s)] == s and (len(p) > len(s) or o < c) for o, p in seqs.items()):
            continue
        kept[c] = "".join(f"<|im_start|>{r if r is not None else 'user'}\n{x or ''}<|im_end|>\n" for r, x in s)
    return kept


def test_chat_collapse(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    rows = []
    for c, n in ((1, 4), (2, 2), (3, 4), (4, 1)):
        rows += [(c, i, *base[i]) for i in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 10, "user", "hi"), (6, 20, "assistant", "other"), (6, 30, "user", None), (7, 0, None, ""), (8, 0, "user", None), (None, 0, "user", "lost")]
    rows += [(9, 0, "user", "dup"), (9, 0, "user", "dup"), (10, None, "system", "s"), (10, 1, "user", "u")]
    df = chat.format_chats(talk(spark, rows))
    no_python(df)
    got = {r["conv_id"]: r["rendered"] for r in df.collect()}
    assert got == brute_chat(rows)
    assert chat.format_chats(talk(spark, [])).collect() == []


def test_chat_random_and_long(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        rows += [(c, i, rng.choice("ua"), rng.choice("xy")) for i in range(rng.randrange(1, 6))]
    rows += [(500, i, "user", f"t{i}") for i in range(2500)] + [(501, i, "user", f"t{i}") for i in range(900)]
    out = chat.format_chats(talk(spark, rows), part_turns=1024).collect()
    got = defaultdict(str)
    for r in sorted(out, key=lambda r: (r["conv_id"], r["part"])):
        got[r["conv_id"]] += r["rendered"]
    assert dict(got) == brute_chat(rows)
    assert sorted(r["part"] for r in out if r["conv_id"] == 500) == [0, 1, 2]


def test_prefix_hashes_do_not_depend_on_blocks(spark):
    rows = [(1, i, "u", str(i % 7)) for i in range(50)]
    hashes = lambda b: sorted((r["pos"], r["h1"], r["h2"]) for r in chat.prefix_hashes(talk(spark, rows).select("conv_id", "turn", "role", "text"), b).collect())
    assert hashes(4) == hashes(1000)


def test_no_operator_limits_rows(spark, docs):
    rows = [(i, f"doc {i % 50}") for i in range(500)]
    assert exact_dedup.exact_groups(docs(rows)).agg(F.count(F.lit(1))).first()[0] == 500

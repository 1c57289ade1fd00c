import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timeweave.llm import packing, tokens

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "héé ß", "数据 mixed 数", "a" * 5000, "<|endoftext|> x", "🙂🙂", "it's we'll 123  4", " nb sp", "x\r\ny\tz", "!!!???", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_fast_path_gives_the_librarys_ids(library):
    encode = tokens.make_encoder(JSON, RANKS)
    for text in ODD:
        assert list(encode(text)) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=80))
def test_fast_path_on_any_latin_text(text):
    t = Tokenizer.from_file(JSON) if not hasattr(test_fast_path_on_any_latin_text, "t") else test_fast_path_on_any_latin_text.t
    test_fast_path_on_any_latin_text.t = t
    t.encode_special_tokens = True
    assert list(tokens.make_encoder(JSON, RANKS)(text)) == t.encode(text, add_special_tokens=False).ids


def test_length_report_against_brute_force(docs, library):
    rng = random.Random(3)
    texts = [None, *ODD, *["w " * rng.randrange(300) for _ in range(40)], "w w", "w w"]
    lengths = [len(library(t)) if t else 0 for t in texts]
    got = {r["n_tokens"]: r for r in tokens.token_counts(docs(list(enumerate(texts))), JSON, RANKS).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["docs"] == lengths.count(n) and r["tokens"] == n * lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["dropped_tokens"] == sum(max(x - n, 0) for x in lengths)
        assert abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12


def test_totals_for_other_limits_and_by_source(spark, docs, library):
    df = docs([(1, "a b c", "x"), (2, "a", None), (3, "a b", "x")])
    hist = tokens.token_histogram(df, JSON, RANKS)
    assert sorted(tuple(r) for r in tokens.truncated_totals(hist, [0, 2, 9]).collect()) == [(0, 0, 0), (2, 2, 5), (9, 3, 6)]
    by = tokens.token_counts(df, JSON, RANKS, by=["source"])
    assert sorted((r["source"], r["n_tokens"], r["docs_at_least"]) for r in by.collect() if r["source"]) == [("x", 2, 2), ("x", 3, 1)]
    assert [(r["n_tokens"], r["quantile"]) for r in by.collect() if r["source"] is None] == [(1, 1.0)]


def test_empty_table(docs):
    assert tokens.token_counts(docs([]), JSON, RANKS).collect() == []
    assert packing.pack_documents(docs([]), JSON, RANKS).collect() == []


def check_packs(patterns, histogram, limit):
    left = Counter()
    for n, p in patterns:
        assert n > 0 and 0 < sum(p) <= limit
        for x in p:
            left[x] += n
    assert left == Counter({k: v for k, v in histogram.items() if v})


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=40))
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    check_packs(patterns, histogram, 64)
    packs = sum(n for n, _ in patterns)
    need = sum(k * v for k, v in histogram.items())
    assert packs <= 2 * -(-need // 64)  # never worse than leaving half empty


def test_patterns_are_few_and_padding_is_small():
    rng = np.random.default_rng(1)
    histogram = Counter(np.minimum((rng.lognormal(6, 1, 300_000)).astype(int) + 1, 1024).tolist())
    patterns = packing.pack_histogram(histogram, 1024)
    check_packs(patterns, histogram, 1024)
    packs = sum(n for n, _ in patterns)
    assert len(patterns) < 5000 and 1 - sum(k * v for k, v in histogram.items()) / (packs * 1024) < 0.02


def test_pieces_round_trip(docs, library):
    rng = random.Random(5)
    texts = [None, "", *ODD, *["tok " * rng.randrange(2500) for _ in range(30)], "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "again"), (None, "no id")]
    got = packing.pack_documents(docs(rows), JSON, RANKS, max_len=1024, ids=True).collect()
    want = Counter((i, tuple((library(t) if t else []) + [0])) for i, t in rows)
    by_doc = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(r["ids"])))
    for (doc, n), parts in by_doc.items():
        whole = [x for _, ids in sorted(parts) for x in ids]
        assert len(whole) == n and want[(doc, tuple(whole))] >= 1
    packs = {}
    for r in got:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_a_column_named_like_the_reports_is_an_error(docs):
    df = docs([(1, "a b")])
    for name in ("docs", "tokens", "n_tokens"):
        with pytest.raises(ValueError, match=name):
            tokens.token_counts(df.withColumnRenamed("lang", name), JSON, RANKS, by=[name])
    assert tokens.token_counts(df.withColumnRenamed("key", "docs"), JSON, RANKS, by=["lang"]).count() == 1


def test_a_very_long_text_is_counted_and_packed_whole(docs, library):
    rng = random.Random(8)
    long = " ".join(rng.choice(["alpha", "beta", "x", "naïve", "9,5"]) + str(rng.randrange(50)) for _ in range(250_000))
    n = len(library(long))
    df = docs([(1, long), (2, "short")])
    assert max(r["n_tokens"] for r in tokens.token_counts(df, JSON, RANKS).collect()) == n
    pieces = [r for r in packing.pack_documents(df, JSON, RANKS, max_len=1024).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == n + 1 == pieces[0]["doc_tokens"] and sorted(r["start"] for r in pieces) == list(range(0, n + 1, 1024))

import collections
import os
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import packing as P
from heddle.llm import tokenizer as K

VOCAB = f"{K.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
needs_files = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def enc():
    return K.BytePairEncoder(VOCAB)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def ids(enc, text):
    out = array("i")
    enc.encode(text, out)
    return list(out)


def test_perfect_hash():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))): i for i in range(3000)}
    h = K.PerfectHash(keys)
    assert all(h.get(k) == v for k, v in keys.items())
    assert sorted(h.keys) == sorted(keys) and h.n == len(keys)
    assert all(h.get(bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, i])) == -1 for i in range(256))


@needs_files
@pytest.mark.parametrize("text", ["", " ", "Hello  world\n\n x", "<|endoftext|> a", "数据中心的算力", "データセンター", "กขค ดร.", "👩‍👩‍👧 😀", "a" * 3000, "ÀÉÎ don't we'll", "\x00\x01\t", "１２３ ４", "مرحبا", "हिन्दी।"])
def test_same_as_the_library(enc, public, text):
    assert ids(enc, text) == public.encode(text, add_special_tokens=False).ids


@needs_files
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    e, p = _pair()
    assert ids(e, text) == p.encode(text, add_special_tokens=False).ids


_cache: list = []


def _pair():
    if not _cache:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{K.TOKENIZER_DIR}/byte_bpe_50k.json")
        t.encode_special_tokens = True
        _cache.append((K.BytePairEncoder(VOCAB), t))
    return _cache[0]


@needs_files
def test_table(spark, public):
    rows = [(1, "Hello", "x"), (2, "", "x"), (3, None, "x"), (4, "Hello", "x")]
    got = {r.doc_id: r.ids for r in K.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect()}
    assert got == {1: public.encode("Hello").ids, 2: [], 3: None, 4: public.encode("Hello").ids}
    assert K.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


# ------------------------------------------------------------------ containers


def loads(runs, hist):
    by = collections.defaultdict(list)
    for r in sorted(runs):
        by[r[0]].append(r)
    out = collections.Counter()
    for s, n in hist.items():
        for k in range(n):
            r = [x for x in by[s] if x[1] <= k][-1]
            out[r[2] + (k - r[1]) // r[3]] += s
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 60), st.lists(st.integers(1, 60), max_size=120))
def test_plan_is_valid_and_near_the_bound(cap, sizes):
    h = collections.Counter(min(s, cap) for s in sizes)
    runs, n = P.plan(dict(h), cap)
    got = loads(runs, h)
    assert len(got) == n and all(0 < v <= cap for v in got.values()) and sum(got.values()) == sum(s * k for s, k in h.items())
    assert n <= 11 / 9 * max(-(-sum(s * k for s, k in h.items()) // cap), sum(k for s, k in h.items() if 2 * s > cap)) + 2


def best(sizes, cap):
    """Fewest containers, by search."""
    sizes = sorted(sizes, reverse=True)
    top = len(sizes)

    def go(i, bins):
        nonlocal top
        if len(bins) >= top:
            return
        if i == len(sizes):
            top = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return top


def test_dominating_sets_are_safe():
    """Fixing a dominating set never costs a container."""
    rng = random.Random(6)
    seen = 0
    for _ in range(300):
        cap = rng.randrange(8, 25)
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(2, 8))]
        h = collections.Counter(sizes)
        s = max(sizes)
        rest = h - collections.Counter([s])
        d = P.dominating(s, cap - s, sorted(rest), dict(rest))
        if d is None:
            continue
        seen += 1
        left = list((rest - collections.Counter(d)).elements())
        assert 1 + (best(left, cap) if left else 0) == best(sizes, cap)
    assert seen > 100


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 0, rng.randrange(1, 40), 100, 33, 230])) for i in range(400)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), 100).collect()
    per, load = collections.defaultdict(list), collections.Counter()
    for r in got:
        per[r.doc_id].append(r)
        load[r.container] += r.tokens
    assert set(per) == {i for i, _ in rows} and max(load.values()) <= 100
    for i, n in rows:
        p = sorted(per[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in p) == (n or 0) and (len(p) == 1 or n > 100)
        at = 0
        for r in p:
            assert r.first_token == at
            at += r.tokens
    total = sum(n or 0 for _, n in rows)
    assert len({r.container for r in got if r.tokens}) <= -(-total // 100) + 2
    assert P.pack(spark.createDataFrame([], "doc_id long, tokens long"), 10).count() == 0


@needs_files
def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "p"), (2, None, "p"), (3, "", "p"), (4, "x y", "p"), (5, "x y", "p")], "doc_id long, text string, container string")
    packs = spark.createDataFrame([(1, 4, "byte_bpe_50k"), (2, 50, "byte_bpe_50k")], "pack_no int, capacity long, tokenizer string")
    got = P.pack_documents(docs, packs).toPandas()
    assert sorted(got[got.pack_no == 2].doc_id) == [1, 2, 3, 4, 5] and len(got[(got.pack_no == 1) & (got.doc_id == 1)]) == 2
    rep = {r.pack_no: r for r in P.fill_report(spark.createDataFrame(got), packs).collect()}
    assert rep[1].containers == 3 and rep[1].fill == 1.0

import random
import unicodedata as ud

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm.forms import consistent_forms
from heddle.llm.look_alike import consistent, look_alike_pairs


@pytest.mark.parametrize(
    "text, form",
    [
        ("Ａｓｔｅｒ　９００", "Aster 900"), ("ｶﾞﾜｯﾄ", "ガワット"), ("Café x​y­", "Café xy"), ("Lоwеr Вrindlе", "Lower Brindle"), ("𝐚𝐫𝐞", "are"), ("ﬁgure", "figure"), ("存算⼀体", "存算一体"),
        ("a b c　d", "a b c d"), ("a\r\nb\nc", "a\nb\nc"), ("각", "각"), ("각", "각"), ("ȩ́", "ȩ́"), ("ȩ́", "ȩ́"), ("x²", "x²"), ("Straße", "Straße"), ("", ""), (None, None), ("​", ""),
    ],
)
def test_form(text, form):
    assert consistent_forms([text]) == [form]


def test_kept_apart():
    pairs = [("a", "A"), ("e", "é"), ("1", "2"), ("a.", "a"), ("o", "ö"), ("x2", "x²")]
    for a, b in pairs:
        x, y = consistent_forms([a, b])
        assert x != y


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=8))
def test_idempotent_and_like_the_standard(texts):
    once = consistent_forms(texts)
    assert consistent_forms(once) == once
    for t, f in zip(texts, once):
        assert t.count("\n") == f.count("\n")
        assert ud.normalize("NFC", f) == f


def test_long_text_equals_its_parts():
    rng = random.Random(1)
    bits = ["Ａ", "é", "x", "中", "ｶﾞ", "​", " ", "ﬁ"]
    text = "".join(rng.choice(bits) + "|" for _ in range(300_000))
    assert consistent_forms([text, "a", text])[2] == "|".join(consistent_forms(text.split("|")))


SCHEMA = "article_id long, title string, content string, field string, key string, id string"


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = ["Aster 900", "Café", "玉澄一体", None, "", "​", "x\ny"]
    odd = {"A": "Ａ", "é": "é", "一": "⼀", " ": " ", "e": "е", "\n": "\r\n"}
    mix = lambda t: t and "".join(odd.get(c, c) if rng.random() < 0.4 else c for c in t)
    rows = [(i, mix(rng.choice(base)), mix(rng.choice(base)), "f", "k", "i") for i in range(120)]
    got = {(r.field, r.article_a, r.article_b) for r in look_alike_pairs(spark.createDataFrame(rows, SCHEMA), "article_id", ["title", "content"]).collect()}
    want = set()
    for k, name in ((1, "title"), (2, "content")):
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[k] and b[k]:
                    x, y = a[k].replace("\r\n", "\n"), b[k].replace("\r\n", "\n")
                    if x != y and consistent_forms([x]) == consistent_forms([y]):
                        want.add((name, a[0], b[0]))
    assert got == want and want


def test_empty_table_and_nulls(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert look_alike_pairs(df, "article_id", ["title"]).count() == 0
    out = consistent(spark.createDataFrame([(1, None), (2, ""), (3, "Ａ")], "article_id long, title string"), "article_id", "title")
    assert {r["id"]: r["form"] for r in out.collect()} == {1: None, 2: "", 3: "A"}


def test_pairs_by_blocks_and_classes(spark):
    from heddle.llm import look_alike as L

    rows = [(i, ["ab c", "ab c", "a​b c", "other"][i % 4 if i < 40 else 3]) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, title string")
    text = dict(rows)
    pairs = sorted((r.article_a, r.article_b) for r in L.look_alike_pairs(df, "id", ["title"], block=4).collect())
    alike = [i for i in text if text[i] and "other" not in text[i]]
    assert pairs == sorted((a, b) for a in alike for b in alike if a < b and text[a] != text[b]) and pairs
    got = {r.article_id: (r.class_id, r.links) for r in L.look_alike_classes(df, "id", ["title"]).collect()}
    assert got == {i: (0, sum(text[j] != text[i] for j in alike)) for i in alike}
    assert L.look_alike_classes(df.limit(0), "id", ["title"]).count() == 0

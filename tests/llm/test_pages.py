"""Page furniture, repeated lines, cut texts."""

import collections
import random

import numpy as np
import pandas as pd
import pytest

from heddle.llm import boilerplate as B
from heddle.llm import repeated_lines as R
from heddle.llm import truncation as T
from heddle.llm.forms import consistent_forms
from heddle.llm.furniture import roles

SCHEMA = "article_id long, domain string, source string, content string, content_type string, host string, token string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, s, c, k, "h", "t", "x") for i, d, s, c, k in rows], SCHEMA)


def test_roles_of_a_page():
    page = ["首页 · 芯片 · 公司", "您的位置:首页 > 芯片 > 正文", "责任编辑:某某", "", "这是第一段,说明了很多事情。", "澜壑晶研:9天倒计时", "第二段也在这里。", "广告", "• 澜壑晶研出货量:4,351件", "后续如何,且看澜壑晶研的下一份公告......", "(完)",
            "延伸阅读", "1、别的标题,涉7亿元", "2、另一个标题", "免责声明:本文观点仅代表作者本人,不构成投资建议,据此操作风险自担。", "网备示例12号 增值业务许可(示例)12"]
    assert roles(page) == [1, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1]


def test_cue_words_within_a_story_stay():
    page = ["煦舷云枢法务部门称,新的隐私声明与Cookie设置将在5月26日随Fennel-8上线,版权所有者可书面申诉。", "有读者把这份名单分享到9个群组,泓川电子材料随后在首页更正了数据。"]
    assert roles(page) == [0, 0]


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(30):
        pages = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 6))]
        flat, page = np.array(sum(pages, [])), np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        order, lcp = B.suffix_runs(flat, page)
        suffix = lambda i: flat[i : np.flatnonzero(page == page[i])[-1] + 1].tolist()[: B.LEAST_RUN]
        s = [suffix(i) for i in order]
        assert sorted(order.tolist()) == list(range(len(flat)))
        groups = collections.Counter(map(tuple, s))
        for i in range(1, len(s)):
            common = 0
            while common < min(len(s[i]), len(s[i - 1])) and s[i][common] == s[i - 1][common]:
                common += 1
            assert lcp[i] == common
        assert sum(groups.values()) == len(flat)


def test_unknown_furniture_is_found_by_repetition(spark):
    rows = []
    for i in range(40):
        story = f"Story number {i} goes on for quite a while and says something new about item {i * 7}.\nItem {i} and the question of {i * 3}\nA second paragraph of story {i} follows here and ends well."
        rows.append((i, "a.example", "s", f"Zorb flim quux\n{story}\nFleebed by gromit", "fulltext"))
    rows += [(100 + i, "b.example", "s", f"Zorb flim quux\nOne more story {i} on another host, and it ends here.", "fulltext") for i in range(2)]
    got = {(r.article_id, r.line_no) for r in B.furniture_lines(frame(spark, rows), "article_id", "content", "domain").collect()}
    assert got == {(i, k) for i in range(40) for k in (0, 4)}


def test_copies_of_one_story_are_no_furniture(spark):
    rows = [(i, "a.example", "s", "A subhead of this story\nThe very same story was collected many times over, word for word.\nAnother subhead\nIt ends here, after a second long paragraph of text.", "fulltext") for i in range(30)]
    assert B.furniture_lines(frame(spark, rows), "article_id", "content", "domain").count() == 0


def test_edge_cases(spark):
    rows = [(1, None, None, None, None), (2, None, None, "", None), (3, None, None, "广告\n正文在这里。" + "很长" * 40_000 + "。", None), (4, "x", "s", "\r\n \r\n广告\r\n", None)]
    df = frame(spark, rows)
    assert {(r.article_id, r.line_no) for r in B.furniture_lines(df, "article_id", "content", "domain").collect()} == {(3, 0), (4, 2)}
    assert R.repeated_lines(df, "article_id", "content", "source").count() == 0
    assert [r.article_id for r in T.truncated(df).collect()] == []
    for op in (lambda d: B.furniture_lines(d, "article_id", "content", "domain"), lambda d: R.repeated_lines(d, "article_id", "content", "source"), T.truncated, T.share_by_source):
        assert op(frame(spark, [])).count() == 0


def test_repeated_lines_against_counting(spark):
    rng = random.Random(5)
    pool = [f"line {k} of the set" for k in range(12)] + ["Ａ line", "A line", "A  line ", "a line", "line 7 of the Set"]
    rows = [(i, "d", rng.choice(["s1", "s2", None]), "\n".join(rng.choice(pool + [f"own {i} {rng.random()}"]) for _ in range(rng.randrange(0, 9))), "") for i in range(80)]
    got = sorted((r.article_id, r.line_no) for r in R.repeated_lines(frame(spark, rows), "article_id", "content", "source").collect())
    docs = collections.defaultdict(set)
    cells = []
    for i, _, s, c, _ in rows:
        for k, x in enumerate(consistent_forms([c])[0].split("\n") if c else []):
            x = " ".join(x.split())
            if x and s:
                docs[s, x].add(i)
                cells.append((i, k, s, x))
    assert got == sorted((i, k) for i, k, s, x in cells if len(docs[s, x]) >= 6) and got


def test_without_lines(spark):
    df = frame(spark, [(1, "d", "s", "a\nb\nc", ""), (2, "d", "s", None, ""), (3, "d", "s", "x", "")])
    found = spark.createDataFrame([(1, 1), (3, 0)], "article_id long, line_no int")
    assert {r.id: r.text for r in R.without_lines(df, found, "article_id", "content").collect()} == {1: "a\nc", 2: None, 3: ""}


@pytest.mark.parametrize(
    "text, kind, cut",
    [
        ("第一句话。第二句话没有说", "fulltext", True), ("第一句话。第二句话说完了。", "fulltext", False), ("说完了。\n责任编辑:某某", "fulltext", False), ("没有说完的句子,还\n责任编辑:某某", "fulltext", True),
        ("The first part ended. Then it was rai", "fulltext", True), ("All is said.\n(ends)", "fulltext", False), ("All is said.\n• Gross margin at X: 5.1 percent", "fulltext", False), ("Said.\n(X declined to comment on Y)", "fulltext", False),
        ("Said.\nHow X responds, only time will tell...", "fulltext", False), ("由于电价调整,平旻数据港把...", "fulltext", True), ("合同自7月起生效。首轮验证通过后<p cl", "fulltext", True), ("合同生效。考虑到上游&nb", "fulltext", True), ("合同生效。考虑到上游涨价[+605 chars]", "fulltext", True),
        ("合同生效。考虑到�", "fulltext", True), ("句子说完了。" * 10 + "还有", "db_field_186", True), ("他说:“说完了。”", "fulltext", False), ("句子说完了。\n承建方披露毛利率(详见www.1-lab.example/p.html?v", "fulltext", True), ("句子说完了。\n決算資料によると、", "fulltext", True), ("谁在抢购X的QL-70", "fulltext", False), ("", None, False), (None, None, False),
    ],
)
def test_cut(spark, text, kind, cut):
    got = T.truncated(frame(spark, [(1, "d", "s", text, kind)] + [(9 + k, "d", "s", "句子说完了。\n• Gross margin at X: 5.1 percent\nThe first part ended.", "") for k in range(3)]))
    assert (1 in {r.article_id for r in got.collect()}) == cut


def test_vocabulary_tells_half_words(spark):
    whole = [(10 + i, "d", "s", f"Inside the ledger of Foundry\nThe foundry raised output by {i}. Packaging went on.\nIt ended there.", "fulltext") for i in range(6)]
    rows = [*whole, (1, "d", "s", "It ended.\nInside the ledger of Foundry", "fulltext"), (2, "d", "s", "It ended.\nInside the ledger of Packag", "fulltext")]
    assert {r.article_id for r in T.truncated(frame(spark, rows)).collect()} == {2}
    share = {r.source: (r.records, r.cut_records) for r in T.share_by_source(frame(spark, rows)).collect()}
    assert share == {"s": (8, 1)}


def test_trie():
    t = T.Trie(["foundry", "found", "rack"])
    assert t.known("found") == (True, True) and t.known("foun") == (False, True) and t.known("rack") == (True, False) and t.known("x") == (False, False)
    assert isinstance(T._look_up(None, pd.DataFrame({"id": [1], "token": ["rac"]}), pd.DataFrame({"word": ["rack"]})), pd.DataFrame)


def test_furniture_of_a_large_host_needs_no_share_of_its_pages(spark):
    hosts = ["www.a.example", "m.a.example", "news.a.example", "a.example"]
    page = lambda i: f"Story number {i} goes on for quite a while and says something new about item {i * 7}.\nIt is number {i} that counts, and it ends here."
    rows = [(i, hosts[i % 4], "s", page(i) + ("\nFleebed by gromit" if i < 8 else ""), "fulltext") for i in range(600)]
    got = {(r.article_id, r.line_no) for r in B.furniture_lines(frame(spark, rows), "article_id", "content", "domain").collect()}
    assert got == {(i, 2) for i in range(8)}


def test_a_repeated_line_between_story_lines_is_no_furniture(spark):
    rows = [(i, "a.example", "s", f"Story number {i} goes on and says something new about item {i * 7}.\nItem {i} in short\nA stock subhead\nItem {i * 3} at length\nA second paragraph of story {i} follows here and ends well.", "fulltext") for i in range(20)]
    assert B.furniture_lines(frame(spark, rows), "article_id", "content", "domain").count() == 0


def test_long_and_closed_furniture_lines_are_found_by_repetition(spark):
    notice = "The operator of these pages processes what visitors enter and keeps it in the registers named below, for as long as the rules of the registry demand, and hands it to nobody but the offices that oversee the registry."
    tail = [notice, "All texts stay the property of the house and of those who wrote them for it.", "(zorb flim quux)", "• Fleebed by gromit"]
    rows = []
    for i in range(20):
        story = [f"Story number {i} goes on and says something new about item {i * 7}.", "A stock subhead", f"A second paragraph of story {i} follows here and ends well."]
        rows.append((i, "a.example", "s", "\n".join(story + tail), "fulltext"))
    got = {(r.article_id, r.line_no) for r in B.furniture_lines(frame(spark, rows), "article_id", "content", "domain").collect()}
    assert got == {(i, k) for i in range(20) for k in (3, 4, 5, 6)}


def test_an_unknown_word_that_begins_no_known_one_is_whole(spark):
    whole = [(10 + i, "d", "s", f"Inside the ledger\nThe foundry raised output by {i}. Packaging went on.\nIt ended there.", "fulltext") for i in range(6)]
    rows = [*whole, (1, "d", "s", "It ended.\n• Racks shipped to Quorvex", "fulltext"), (2, "d", "s", "It ended.\n• Racks shipped to Packag", "fulltext")]
    assert {r.article_id for r in T.truncated(frame(spark, rows)).collect()} == {2}


def test_bodies_are_without_furniture_that_only_repetition_tells(spark):
    from heddle.llm import near_dup as N

    tail = "All texts stay the property of the house and of those who wrote them for it. Fleebed by gromit and his kin in the yard, now and later."
    rows = [(i, "a.example", "s", f"{i * 7919} of {i} went.\nIn year {i} came {i * 31}, {i * i} and then" + "\n" + tail, "fulltext") for i in range(11, 20)]
    df = frame(spark, rows)
    assert T.truncated(df).count() == 0
    assert {r.article_id for r in T.truncated(df, host_col="domain").collect()} == set(range(11, 20))
    assert N.near_pairs(df, "article_id", "content").count() > 0 and N.near_pairs(df, "article_id", "content", host_col="domain").count() == 0
    assert all(tail not in r.body for r in B.main_bodies(df, "article_id", "content", "domain").collect())


def test_shards_of_a_host_add_up(spark):
    rng = random.Random(9)
    rows = []
    for i in range(90):
        story = [f"Story {rng.random()} of the day goes on and on, and says a little more than {rng.random()} did."] * 1 + [f"It then went to {rng.random()} and came back, before it ended well."]
        tail = rng.choice([["Zorb flim", f"Quux no. {i}"], ["Fleebed by gromit"], ["Zorb flim", "Fleebed by gromit"], []])
        rows.append((i, rng.choice(["a.example", "www.a.example", "b.example", None]), "s", "\n".join(rng.choice([["Home of zorb"], []]) + story + tail), "fulltext"))
    df = frame(spark, rows)
    whole, parts = ({(r.article_id, r.line_no) for r in B.furniture_lines(df, "article_id", "content", "domain", shard_pages=n).collect()} for n in (1000, 7))
    assert whole == parts and len(whole) > 60


def test_run_length_decides(spark):
    """A number that changes keeps a single line from being furniture, not one in a run of two."""
    story = lambda i: f"Story number {i} goes on for quite a while and says something new about item {i * 7}."
    alone = [(i, "a.example", "s", f"{story(i)}\nFlim no {i}", "fulltext") for i in range(12)]
    run = [(i, "a.example", "s", f"{story(i)}\nFlim no {i}\nQuux flam", "fulltext") for i in range(12)]
    got = lambda rows: {(r.article_id, r.line_no) for r in B.furniture_lines(frame(spark, rows), "article_id", "content", "domain").collect()}
    assert got(alone) == set() and got(run) == {(i, k) for i in range(12) for k in (1, 2)}


def test_texts_that_end_together_are_cut(spark):
    body = "The first part ended. Then they raised "
    rows = [(i, "d", "s", (body + "".join(random.Random(i).choices("abcdefgh ", k=90)))[:120].rstrip(" .").ljust(120, "x"), "excerpt") for i in range(8)]
    rows += [(20 + i, "d", "s", f"Part {i} ended. It is all said.", "excerpt") for i in range(8)]
    got = {r.reason: r.records for r in T.reasons(frame(spark, rows)).collect()}
    assert got == {"length": 8, "whole": 8}


def test_lines_with_slots(spark):
    rows = [(i, "d", "s", f"Article no {i} of the desk\nown line {chr(97 + i)}", "") for i in range(8)]
    found = lambda **k: {(r.article_id, r.line_no) for r in R.repeated_lines(frame(spark, rows), "article_id", "content", "source", **k).collect()}
    assert found() == set() and found(slots=True) == {(i, 0) for i in range(8)}


def test_only_lines_of_covering_templates_are_counted(spark):
    rows = [(i, "d", "s", "shared line\n" + "\n".join(f"w{chr(97 + i)}{chr(97 + k)} goes alone" for k in range(3)), "") for i in range(8)]
    lines = R.line_table(frame(spark, rows), "article_id", "content", "source")
    assert {(r.id, r.line_no) for r in R.survivors(lines, 6).collect()} == {(i, 0) for i in range(8)}
    assert R.covering(lines, 9).count() == 0

"""Roles of the lines of a collected page: story or page furniture.

Works on the consistent form of a content (see ``forms``), whose lines stand one to
one for the stored ones.  Cue patterns name furniture whose words differ from page
to page (bylines, counters, link lists); furniture without a cue is found by its
repetition within a host (see ``boilerplate``).
"""

from __future__ import annotations

import functools
import re

STORY, FURNITURE, UNSURE = 0, 1, 2

# Defaults: names of page sections, by which navigation is known.
SECTIONS = {
    "zh": "首页 财经 科创 数据中心 芯片 政策 产业 公司 观点 人物 专题 视频 直播 研报 会议 招聘 学院 论坛 港股 算力 新闻 国际 国内 科技 股票 基金 行情 快讯 滚动 数据 评论 图片 活动 投资 金融 能源 登录 注册 搜索 关于",
    "en": "Home Chips Energy Markets Policy Asia Companies Research Opinion Video Podcasts Events Jobs Newsletters Archive Compute Data World Business Technology Tech Science Politics Finance Europe Americas Startups Cloud Hardware Software Security News Latest Subscribe Login Search Menu",
    "de": "Startseite Märkte Wirtschaft Technik Chips Energie Firmen Karriere Video Abo Archiv Daten Politik Finanzen Börse Unternehmen Meinung Forschung Wissen Termine Suche Menü Anmelden",
    "ja": "トップ 経済 企業 市況 半導体 地域 人事 統計 特集 解説 動画 会員 ニュース 国際 政治 社会 金融 技術 データ 写真 検索 ログイン 株価",
}

# Defaults: whole-line patterns of furniture, in the consistent form. S stands for the
# name of a source, N for a number.
CUES = {
    "place": [r"(您的|当前|你的)位置:.*", r"(Home|Startseite|トップ|首页)( *[»>/›] *[^»>/›]{1,24})+"],
    "consent": [
        r"(本站使用|我们和合作伙伴使用|我们使用) ?Cookie.{0,40}", r"为提供更好的服务,.{1,30}会记录您的设备信息。?", r"接受全部.{0,30}", r"继续访问即表示同意.{0,20}",
        r"We use cookies to .{1,80}", r"This site uses cookies[;,.].{0,80}", r".{1,40} and its partners store information on your device\..{0,40}",
        r"当サイトではクッキーを.{1,40}", r"すべて許可.{0,30}", r"Wir verwenden Cookies\..{0,80}", r"(Accept all|Alle akzeptieren)( [|·] .{1,30})+",
    ],
    "byline": [
        r"(责任编辑|责编|编辑|作者|记者|校对|审校|撰文|来源|稿件来源|监制|统筹|翻译|摄影|图片|文字)[:/].{1,60}", r"(Redaktion|Autor|Autorin|Text|Bearbeitung|Quelle|Foto|Author|Editor|Edited by|Written by|Source|Photo|Byline|取材|編集|執筆|撮影|写真|記者|担当):? ?: ?[^.。!?]{2,60}", r"文\|.{1,40}", r"文[・·].{1,20}", r"本报讯 记者.{1,40}", r".{1,24}(记者|通讯员) [^,。:]{2,12}",
        r"\(.{1,24}編集部\)", r".{1,24} [^ 、。,]{2,10}記者", r"(记者|通讯员) ?[^,。]{2,8} (报道|摄|文)",
        r"By [^.,:;]{3,40}, [^.,:;]{2,40} (staff|desk|correspondent|reporter)", r"(Reporting|Additional reporting|Writing|Editing|Edited) by [^.:]{3,40}(; editing by [^.:]{3,40})?",
        r"[^.|:,]{3,40} \| [^.|:,]{2,20} desk", r"[^.,:]{3,40} covers [^.]{3,40} for [^.]{2,40}", r"Von [^.,:]{3,40}, [^.,:]{2,40}",
    ],
    "counter": [
        r"(阅读|浏览|点击|浏览量|阅读量|稿件编号|文章编号|编号)[: ]? ?[\d,]+ ?次?", r"文章ID ?\d+.{0,20}", r"(网友)?评论\(\d+\).{0,20}", r"[\d,]+ (views|comments|Aufrufe|Kommentare|reads)(\. .{0,40})?",
        r"Ref: ?\d+.{0,30}", r"Article no\. ?\d+", r"Artikel-Nr\. ?\d+", r"(記事番号|閲覧数) ?[\d,]+", r"[\d,]+ ?(回閲覧|件のコメント|人阅读|次阅读)",
    ],
    "advert": [
        r"广告", r"PR", r"ADVERTISEMENT", r"Advertisement", r"ANZEIGE", r"Anzeige", r"広告", r"点击领取.{2,40}", r"Try .{2,40} Premium free .{2,30}", r"会員限定の記事です", r".{2,40} may earn a commission on links in this text\.",
    ],
    "prompt": [
        r"扫一扫.{2,24}", r"长按识别二维码.{0,30}", r"打开.{1,24}客户端.{0,24}", r"分享到:.{1,40}", r"点赞( \S{2}){1,5}", r"(【[^】]{1,12}】){2,5}", r"(点击展开剩余内容|阅读全文|查看原文|展开全文|查看全文|查看更多)( ?>>)?", r"请先登录再发言", r"暂无评论.{0,16}",
        r"Follow .{2,40} for daily updates", r"Back to top", r"Get the app .{2,40}", r"Sign up for .{2,60}", r"Comments are closed", r"Log in to comment", r"Share this article: .{2,60}", r"Save for later.{0,40}", r"Story continues below", r"(Show full article|Continue reading|Read more)( ?>>)?",
        r"この記事をシェアする", r".{1,24}の公式アプリで読む", r"コメントはログイン後に投稿できます", r"印刷する 保存する.{0,20}", r"(続きを読む|全文を表示)( ?>>)?",
        r"Zum Newsletter anmelden", r"Artikel teilen: .{2,60}", r"Zum Kommentieren anmelden", r"Nach oben", r"Jetzt .{2,40} im Abo testen", r"Lesen Sie weiter .{2,40}", r"(Ganzen Artikel anzeigen|Weiterlesen)( ?>>)?",
    ],
    "legal": [
        r"(免责声明|特别提示|声明|版权声明):.{4,80}", r".{1,24}版权所有.{0,40}", r"本网常年法律顾问:.{2,24}", r"\S{0,12}备\D{0,8}\d+号.{0,60}", r"违法和不良信息举报:.{2,60}", r"关于我们( - \S{2,8}){1,6}", r"本文转载自合作媒体.{2,60}",
        r"About us( +\S[^.]{2,60})", r"Terms of use.{0,60}", r"Accessibility statement.{0,60}", r"Disclaimer: .{4,100}", r"© .{2,160}", r"Nothing in this article is investment advice\..{0,60}", r"Figures are delayed by at least .{2,40}\.",
        r"会社案内.{0,40}", r"サイトマップ.{0,24}", r"本記事は投資勧誘を目的としたものではありません。", r"無断転載を禁じます。.{0,24}", r"掲載情報の正確性を.{1,24}は保証しません。",
        r"Impressum.{0,60}", r"Dieser Beitrag ist keine Anlageberatung\.", r"Alle Angaben ohne Gewähr\.", r".{2,40} – Registernummer.{0,30}",
    ],
    "links": [
        r"(上一篇|下一篇|上一条|下一条|前の記事|次の記事|Previous|Next|Vorheriger (?:Artikel|Beitrag)|Nächster (?:Artikel|Beitrag)|Previous article|Next article|Vorheriger|Nächster|Zurück|Weiter):.{2,160}",
    ],
}

# Defaults: headers of lists of other stories.
LIST_HEADS = "延伸阅读 相关阅读 热门排行 猜你喜欢 编辑精选 推荐阅读 更多阅读 关联记事 関連記事 注目の記事 アクセスランキング".split()
LIST_HEAD_LINES = ["Trending now", "Related stories", "You may also like", "Editor's picks", "Most read", "Tipps der Redaktion", "Mehr zum Thema", "Meistgelesen", "Read also", "More on this"]

LINK_MARK = re.compile(r"(\[\d{1,2}\] ?|\d{1,2}[.、] ?|[·\-–»>▪■] ?|\(\d{1,2}\) ?)(?=\S)")
END_LINE = re.compile(r"\((完|终|ends|Ende|おわり|了)\)")
BULLET = re.compile(r"[•]")
SENTENCE_END = re.compile(r"[。.!?!…][\"”’」』）)】\]]*$")


@functools.cache
def patterns() -> tuple[re.Pattern, re.Pattern, frozenset, re.Pattern]:
    cues = re.compile("(?:" + "|".join(x for xs in CUES.values() for x in xs) + ")$")
    heads = re.compile(r"(?:▼ ?)?(?:" + "|".join(LIST_HEADS) + r"|\d{1,2}小时热点|" + "|".join(map(re.escape, LIST_HEAD_LINES)) + r")(?: ?▼)?:?$", re.I)
    names = frozenset(x for xs in SECTIONS.values() for x in xs.split())
    run = re.compile("(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + "){3,}$")
    return cues, heads, names, run


BARRED = re.compile(r"[^|·。!?]{1,24}(?: ?[|·] [^|·。!?]{1,24}){1,14}$")
BOXED = re.compile(r"(?:\[[^\[\]]{1,14}\]){3,}$")


@functools.lru_cache(50_000)
def cue(line: str) -> str:
    """The kind of a trimmed line by its own words alone: a furniture kind, 'head', 'section', or ''."""
    cues, heads, names, run = patterns()
    if line in names:
        return "section"
    if cues.match(line):
        return "cue"
    if heads.match(line):
        return "head"
    if (BOXED.match(line) or run.match(line) or _section_list(line)):
        return "nav"
    if BARRED.match(line) and not BULLET.match(line) and not LINK_MARK.match(line):
        return "nav"
    return ""


def _section_list(line: str) -> bool:
    """Three or more section names with nothing but spaces between them."""
    names = patterns()[2]
    words = line.split()
    return len(words) >= 3 and sum(w in names for w in words) >= 0.75 * len(words)


def roles(lines: list[str]) -> list[int]:
    """A role for each line of one content, in the consistent form; blank lines are STORY."""
    out = [STORY] * len(lines)
    kinds = [""] * len(lines)
    listing = False
    for i, x in enumerate(lines):
        x = x.strip()
        if not x:
            continue
        k = kinds[i] = cue(x)
        if k == "head":
            out[i], listing = FURNITURE, True
        elif k and k != "section":
            out[i], listing = FURNITURE, False
        elif listing and len(x) <= 160 and LINK_MARK.match(x):
            out[i] = FURNITURE
        else:
            listing = False
    # a list of marked lines behind an unknown header, below the last sentence of the story, is a list of links
    tail = len(lines)
    while tail and (out[tail - 1] or not lines[tail - 1].strip() or (len(lines[tail - 1]) <= 160 and not SENTENCE_END.search(lines[tail - 1].strip()) and not BULLET.match(lines[tail - 1].strip()))):
        tail -= 1
    i = tail
    while i < len(lines):
        marks = []
        k = i + 1
        while k < len(lines) and (m := LINK_MARK.match(lines[k].strip())):
            marks.append(re.sub(r"\d+", "0", m[1].strip()))
            k += 1
        if len(marks) >= 2 and len(set(marks)) == 1 and lines[i].strip() and len(lines[i]) <= 30 and not LINK_MARK.match(lines[i].strip()):
            out[i:k] = [FURNITURE] * (k - i)
        i = max(k, i + 1)
    # single section names count as navigation in a run of two or more, or beside furniture
    for i, k in enumerate(kinds):
        if k == "section" and any(0 <= j < len(kinds) and (kinds[j] == "section" or out[j] == FURNITURE) for j in (i - 1, i + 1)):
            out[i] = FURNITURE
    return out

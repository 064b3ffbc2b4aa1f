"""Problem 10: sentence units across languages and scripts.

Boundaries are settled within the document first: a word with a period that a
lower-case word or a comma follows somewhere is an abbreviation there, a word that
stands there without one again and again is an ordinary word, and a word seen
capitalised in the middle of a sentence is a name there. Where the document is silent,
counts over the corpus decide in the same way, and only where these are silent too a
short list of common abbreviations does. Scripts have their own terminators; quotations
and brackets are never divided.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import arrow_map, has_text, spread, stored

# Defaults: abbreviations that stand before the word they belong to, so that they end no sentence.
LEADING = frozenset(
    "Dr Mr Mrs Ms Prof St Mt Ft Gen Col Lt Sgt Capt Rev Hon Pres Sen Rep Gov No Nos Nr Fig Figs Tab Eq Sec Ch Vol pp approx ca cf vs viz resp incl "
    "i.e e.g z u d o i.d.R bzw evtl ggf vgl Mio Mrd Tsd Hr Fr Frl Abs Art Bd Kap M MM Mme Mlle Mgr env av apr fig vol réf "
    "Sr Sra Srta Dra Lic Ing núm pág págs aprox p.ej EE ej cap vol ver Ver डॉ रु श्री कि मी د أ م ดร น.ส นาย".split()
)
# Defaults: abbreviations that may also close a sentence.
EITHER = frozenset(
    "Inc Corp Ltd Co LLC Bros Jr Sr. al etc U.S U.K U.N E.U EE.UU UU S.A a.m p.m A.M P.M bn mn Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec usw usf u.a d.h z.B GmbH AG p r n".split()
)
LISTED = LEADING | EITHER
# Defaults: months, whose short forms stand before a day or a year.
MONTHS = frozenset("Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec".split())
# Defaults: German words before an ordinal number.
BEFORE_ORDINAL = frozenset("am das der die dem den des im vom zum zur bis ab seit und beim ins Am Das Der Die Im Vom Zum Zur Bis Ab Seit Beim".split())

CLOSE_OF = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "【": "】", "〈": "〉", "［": "］", "[": "]"}
BRACKETS = "（(【《〈［["
CLOSERS = set("”“»」』》）)】〉］]\"’'")
EVENT = re.compile(r"[.。!?！？।؟…．｡]+|[“”„«»「」『』《》（）()【】〈〉［］\[\]\"]")
FULL = set("。！？।؟｡!?")
LINE = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]+")
LIST_MARK = re.compile(r"\s*(?:[•·‣▪◦*–—+-]\s+|\(?\d{1,3}(?:[.)]\s+|、)|[a-z][.)]\s+)")
BULLET_MARK = re.compile(r"\s*[•·‣▪◦*–—+-]\s+")
HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
THAI = re.compile("[฀-๿]")
LATIN_WORD = re.compile(r"[^\W\d_]+")
OPENERS = set("“„«「『《（(【〈［[\"¿¡‘'")
GOES_ON = set(",，、;；:：)）」』”»")
JA_PARTICLES = set("とでのをにはがもなよへやかまだ")
WRAP_LEAST, WRAP_MOST = 66, 110
LIMIT = 50_000  # corpus words sent to every worker; beyond it each document gets its own words by a join

ABBR_SEEN = re.compile(r"(?<![^\s(“„«\"])([^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_])){0,9})\.(?=(\s+[a-zß-ÿ]|,))")
CAP_MID = re.compile(r"(?<=[a-zà-ÿ,] )([A-ZÀ-Þ][\w’'-]*)")


BARE_HERE = 2  # places of a word without a period that make it an ordinary one in a document
BARE_CORPUS = 20  # and in a corpus, where they must be four times those with a period


class Words:
    """What is known of words: by the document, then by the corpus, then by the list."""

    def __init__(self, text: str, corpus: frozenset[str] | set[str], document: bool = True) -> None:
        self.text, self.corpus, self.document = text, corpus, document
        self._abbr: set[str] | None = None
        self._names: set[str] | None = None
        self._bare: dict[str, int] = {}

    def bare(self, w: str) -> int:
        """How often a word stands without a period in the document."""
        if w not in self._bare:
            self._bare[w] = len(re.findall(rf"(?<!\S){re.escape(w)}(?=[\s,;:])", self.text))
        return self._bare[w]

    def here(self, w: str) -> bool | None:
        """Whether a word is an abbreviation by its other places in the document; None where they do not tell."""
        if not self.document:
            return None
        if self._abbr is None:
            self._abbr = {m[1] for m in ABBR_SEEN.finditer(self.text) if not _camel(self.text, m.end())}
        if w in self._abbr:
            return len(w) <= 5 or not self.bare(w)
        return False if w in LISTED and len(w) > 1 and w.isalpha() and self.bare(w) >= BARE_HERE else None

    def kind(self, w: str) -> str:
        """'lead' for an abbreviation that stands before its word, 'either' for one that may also close a sentence, '' for any other word."""
        known = self.here(w)
        if known is None and ("a\t" + w in self.corpus or "o\t" + w in self.corpus):
            known = "a\t" + w in self.corpus
        if known is False:
            return ""
        return "lead" if w in LEADING else "either" if known or w in EITHER else ""

    def starts_sentence(self, w: str) -> bool:
        """Whether a capitalised word after a doubtful period opens a sentence rather than being a name."""
        low = w.lower()
        if not self.document:
            return "s\t" + w in self.corpus
        if self._names is None:
            self._names = {m[1] for m in CAP_MID.finditer(self.text)}
        if re.search(rf"(?<![\w’']){re.escape(low)}(?![\w’'])", self.text):
            return True
        if w in self._names:
            return False
        return "s\t" + w in self.corpus


def _camel(text: str, at: int) -> bool:
    m = LATIN_WORD.search(text, at)
    return bool(m) and any(c.isupper() for c in m[0][1:])


def _word_before(text: str, at: int, low: int) -> str:
    i = at
    while i > low and not text[i - 1].isspace() and text[i - 1] not in "“„«「『（([\"¿¡’”»" and at - i < 24:
        if text[i - 1] == "." and i < at and text[i].isupper() and (text[i - 2 : i - 1].isdigit() or text[max(low, i - 4) : i - 1].isalpha() and text[max(low, i - 4) : i - 1].islower()):
            break  # a missing space between two sentences
        i -= 1
    return text[i:at]


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of text without a line break that ends a unit: lines, or runs of lines that were only wrapped."""
    spans = []
    for m in LINE.finditer(text):
        s, e = m.start(), m.end()
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            spans.append((s, e))
    if not spans:
        return
    lens = sorted(e - s for s, e in spans)
    width = max(WRAP_LEAST, lens[(3 * len(lens)) // 4] if len(lens) > 2 else lens[-1])
    wrapped = len(spans) > 1 and lens[-1] <= WRAP_MOST
    start, end = spans[0]
    first = start
    for s, e in spans[1:]:
        join = False
        if wrapped and text[end:s].replace("\r\n", "\n").count("\n") + text[end:s].count("\r") - text[end:s].count("\r\n") <= 1 and _latin(text, end) and not (LIST_MARK if text[end - 1] in ".!?:" else BULLET_MARK).match(text, s, e):
            sp = s
            while sp < e and not text[sp].isspace():
                sp += 1
            join = (end - start) + 1 + (sp - s) > width and not HAN.match(text[s])
        if not join:
            yield first, end
            first = s
        start, end = s, e
    yield first, end


def _latin(text: str, end: int) -> bool:
    """Whether the line ending here is written in letters of the Latin script."""
    for c in reversed(text[max(0, end - 12) : end]):
        if c.isalpha():
            return c < "ɐ" or "Ḁ" <= c <= "ỿ"
    return True


def _period_ends(text: str, at: int, after: int, low: int, high: int, words: Words) -> bool:
    """Whether the single period text[at] ends a sentence; after is the place behind it and any closing marks."""
    prev = text[at - 1] if at > low else ""
    if after >= high:
        return True
    nxt = after
    while nxt < high and text[nxt].isspace():
        nxt += 1
    c = text[nxt]
    spaced = nxt > after
    word = _word_before(text, at, low)
    if word.isdigit() and at - len(word) <= low + 1 and len(word) <= 3 and spaced:
        return False  # the mark of a list
    if THAI.match(prev) or THAI.match(c):
        return False
    if HAN.match(c):
        return bool(spaced and HAN.match(prev))
    if HAN.match(prev) and not spaced:
        return False
    if "ऀ" <= prev <= "ॿ" or "ऀ" <= c <= "ॿ":
        return False
    hangul = "가" <= prev <= "힣"
    kind = words.kind(word)
    if "가" <= c <= "힣" or hangul:
        if not spaced:
            return hangul and (c.isupper() or "가" <= c <= "힣" or c in OPENERS or c.isdigit())
        return not kind and not (len(word) == 1 and word.isupper())
    if "؀" <= prev <= "ۿ" or "؀" <= c <= "ۿ":
        if not spaced and not ("؀" <= prev <= "ۿ" and ("؀" <= c <= "ۿ" or c.isupper() or c in OPENERS)):
            return False
        return kind != "lead" and (len(word) > 1 or word.isdigit())
    opener = c in OPENERS
    d = c
    if opener:
        k = nxt
        while k < high and (text[k] in OPENERS or text[k].isspace()):
            k += 1
        d = text[k] if k < high else ""
    m = LATIN_WORD.match(text, nxt)
    follow = m[0] if m else ""
    if not spaced:
        if c in "¿¡“„«" and (prev.islower() or prev.isdigit() or prev in ")%"):
            return kind != "lead"
        if not c.isupper() or len(follow) < 2 and follow not in ("A", "I", "À", "L", "D") or not (follow[1:2].islower() or len(follow) < 2):
            return False
        if kind == "either" and word in EITHER:
            return words.starts_sentence(follow)
        return (prev.islower() or prev.isdigit() or prev in ")%”“»") and kind != "lead" and len(word) > 1
    if d and d.islower() and not opener:
        return _camel(text, nxt) and not (kind and word in LISTED)
    if c in GOES_ON or c in "-–—/&":
        return False
    if kind == "lead":
        return False
    if d.isdigit():
        if word in MONTHS or word in ("p", "pp", "n"):
            return False
        return not (kind and word not in EITHER) and word not in ("No", "Nr", "ca", "env")
    if len(word) == 1 and word.isalpha() and word.isupper():
        return False  # an initial
    if word.isdigit() and len(word) <= 2 and d.isupper():
        before = _word_before(text, at - len(word) - 1, low) if at - len(word) - 1 > low else ""
        return before not in BEFORE_ORDINAL
    if kind:
        return bool(opener) or words.starts_sentence(follow)
    return True


def _units_of(text: str, low: int, high: int, words: Words, by_space: bool) -> Iterator[tuple[int, int]]:
    start = low
    stack: list[tuple[str, int]] = []  # closing marks awaited, with the place of the opening
    ended_inside = False

    def trim(a: int, b: int) -> tuple[int, int]:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    done = low  # events before this are part of a settled mark
    for m in EVENT.finditer(text, low, high):
        i, e = m.start(), m.end()
        if i < done:
            continue
        c = text[i]
        if stack and c in stack[-1][0] and e - i == 1 and not (c in CLOSE_OF and c not in stack[-1][0]):
            _, opened = stack.pop()
            if stack:
                continue
            bracket = text[opened] in BRACKETS
            inner = text[opened + 1 : i].rstrip()[-1:]
            done = e
            while done < high and text[done] in CLOSERS and text[done] not in CLOSE_OF:
                done += 1
            if ended_inside and inner and (inner in FULL or inner in ".…．"):
                lead = text[start:opened].strip()
                k = done
                while k < high and text[k].isspace():
                    k += 1
                n = text[k] if k < high else ""
                if not n or bracket and lead:
                    pass
                elif n in GOES_ON or n in FULL or n in ".．…" or n.islower() and not _camel(text, k):
                    pass
                elif lead and not bracket:
                    hangul = "가" <= n <= "힣" and k == done
                    if not (hangul or (n in JA_PARTICLES and k == done and not text[done : done + 2] in ("とは", "かつ"))) and not THAI.match(n):
                        a, b = trim(start, done)
                        yield a, b
                        start = done
                elif not lead and (n.isupper() and k > done or n in OPENERS and k > done):
                    a, b = trim(start, done)
                    yield a, b
                    start = done
            ended_inside = False
            continue
        if c in CLOSE_OF and e - i == 1 or c == '"':
            close = CLOSE_OF.get(c, '"')
            if c in "“" and stack and stack[-1][0] == "“”":
                continue
            if any(text.find(x, e, high) >= 0 for x in close):
                if not stack:
                    ended_inside = False
                stack.append((close, i))
            continue
        if c in CLOSERS and c not in "”“" or c in "”“":
            continue
        # end marks
        if stack:
            ended_inside = True
            continue
        marks = text[i:e]
        done = e
        while done < high and text[done] in CLOSERS and text[done] not in "“'’(" and text[done] not in CLOSE_OF:
            done += 1
        if done < high:
            if any(x in FULL for x in marks):
                k = done
                while k < high and text[k].isspace():
                    k += 1
                n = text[k] if k < high else ""
                if n and marks[-1] in "!?" and (n.islower() and not _camel(text, k) or n in ",;:，；：、"):
                    continue
            elif len(marks) > 1 or marks == "…":  # an ellipsis goes on unless a new sentence clearly begins
                k = done
                while k < high and text[k].isspace():
                    k += 1
                n = text[k] if k < high else ""
                if not (k > done and (n.isupper() or n in "“„«¿¡" or "가" <= n <= "힣" or "؀" <= n <= "ۿ")):
                    continue
            elif not _period_ends(text, i, done, low, high, words):
                continue
        a, b = trim(start, done)
        if b > a:
            yield a, b
        start = done
    a, b = trim(start, high)
    if b > a:
        yield a, b


SPACE = re.compile(r"\s+")


def _by_space(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Statements of a text without end marks: divided at spaces between letters of its script, not beside numbers or within quotations."""
    depth, start, at = 0, a, a
    for m in SPACE.finditer(text, a, b):
        for c in text[at : m.start()]:
            depth += (c in "“「『（《") - (c in "”」』）》")
        at = m.end()
        p, n = text[m.start() - 1], text[m.end() : m.end() + 1]
        if depth <= 0 and n and (THAI.match(p) or HAN.match(p) or p in "”」』）》%％") and (THAI.match(n) or HAN.match(n) or n in "“「『（《") and not (p in "%％"):
            yield start, m.start()
            start = m.end()
    if start < b:
        yield start, b


def segment(text: str | None, corpus: frozenset[str] | set[str] = frozenset(), document: bool = True) -> list[tuple[int, int]]:
    """Sentence units (start, end) of a text; none for a null, empty or blank one. Without document, the text's own evidence on words is left out."""
    if not text or text.isspace():
        return []
    words = Words(text, corpus, document)
    thai = bool(THAI.search(text))
    silent = not thai and not re.search("[。！？｡]", text) and len(HAN.findall(text)) * 2 > len(text)
    out: list[tuple[int, int]] = []
    for low, high in _blocks(text):
        for a, b in _units_of(text, low, high, words, False):
            if thai or silent:
                out += [(x, y) for x, y in _by_space(text, a, b) if y > x]
            else:
                out.append((a, b))
    return out


def asked(text: str) -> set[str]:
    """Every corpus word that segment can ask for in a text: what stands before and after its marks."""
    out: set[str] = set()
    for low, high in _blocks(text):
        for m in EVENT.finditer(text, low, high):
            nxt = m.end()
            while nxt < high and text[nxt] in CLOSERS and text[nxt] not in "“'’(" and text[nxt] not in CLOSE_OF:
                nxt += 1
            while nxt < high and text[nxt].isspace():
                nxt += 1
            before = _word_before(text, m.start(), low)
            out |= {"a\t" + before, "o\t" + before}
            if w := LATIN_WORD.match(text, nxt):
                out.add("s\t" + w[0])
    return out


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words: with a period before a lower-case word, with one before a capital, at sure starts, capitalised inside, and, of listed ones, without a period."""
    names = ["word", "low", "cap", "start", "mid", "bare"]
    held: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in range(5))], names=names)
        held.clear()
        return b

    def add(word: str, k: int) -> None:
        held.setdefault(word, [0, 0, 0, 0, 0])[k] += 1

    period = re.compile(r"(?<![^\s(“„«\"])([^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_])){0,4})\.\s+([^\W\d_])")
    for b in batches:
        for text in b.column(0).to_pylist():
            for m in period.finditer(text):
                if m[2].islower():
                    if not _camel(text, m.start(2)):
                        add(m[1], 0)
                else:
                    add(m[1], 1)
            for m in LINE.finditer(text):
                w = LATIN_WORD.match(text, m.start())
                if w and w[0][0].isupper():
                    add(w[0], 2)
            for w, n in Counter(CAP_MID.findall(text)).items():
                held.setdefault(w, [0, 0, 0, 0, 0])[3] += n
            for w in text.split():
                if w in LISTED:
                    add(w, 4)
        if len(held) > 100_000:
            yield flush()
    if held:
        yield flush()


def corpus_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word): 'a' and a tab before abbreviations, 'o' and a tab before listed ones that are ordinary words here, 's' and a tab before words that open sentences, by counts over all documents."""
    e = docs.filter(has_text(F.col(text_col))).select(F.col(text_col).alias("text")).transform(lambda d: spread(d, "text")).mapInArrow(_evidence, "word string, low long, cap long, start long, mid long, bare long")
    c = e.groupBy("word").agg(*(F.sum(x).alias(x) for x in ("low", "cap", "start", "mid", "bare")))
    abbr = F.expr("low >= 5 and low * 2 > cap")
    plain = F.expr(f"bare >= {BARE_CORPUS} and bare > 4 * (low + cap) and length(word) > 1") & ~abbr
    starts = F.expr("start >= 5 and start > mid")
    known = F.array(*[F.when(x, F.concat(F.lit(mark + "\t"), "word")) for mark, x in (("a", abbr), ("o", plain), ("s", starts))])
    return stored(c.select(F.explode(known).alias("word")).filter("word is not null"))


def _segmenter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            own = b.column(2).to_pylist() if b.num_columns > 2 else None
            for k, (i, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                for s, e in segment(text, shared.value if own is None else set(own[k] or ())):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_char", "end_char"])

    return run


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of each sentence unit. Null, empty and blank texts give none.

    Up to `limit` corpus words (LIMIT if none is given) go to every worker; beyond it each document gets those that it asks for by a join. Both
    give the same units.
    """
    src = docs.filter(has_text(F.col(text_col))).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src, limit = spread(src, "id"), LIMIT if limit is None else limit
    known = corpus_words(docs, text_col)
    words = [r[0] for r in known.limit(limit + 1).collect()]
    schema = "doc_id long, start_char long, end_char long"
    if len(words) <= limit:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(words))
        return src.mapInArrow(_segmenter(shared), schema)
    keyed = arrow_map(src, "id long, words array<string>", lambda c: {"id": c["id"], "words": [sorted(asked(x)) for x in c["text"]]}).select("id", F.explode("words").alias("word"))
    own = keyed.join(known, "word", "left_semi").groupBy("id").agg(F.collect_set("word").alias("own"))
    return src.join(own, "id", "left").select("id", "text", "own").mapInArrow(_segmenter(None), schema)


def sentence_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, sentence): the units themselves, counted from 0."""
    u = sentences(docs, id_col, text_col)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char")) - 1
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return u.withColumn("n", n).join(t, "doc_id").select("doc_id", "n", F.substring("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")).alias("sentence"))

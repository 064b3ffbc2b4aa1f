"""Dictionary and TF-IDF text scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from .joins import sized_join, stored


def tokens(text: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token)."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))


def lexicon_hits(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, negators: list[str], flips: dict[str, str]) -> DataFrame:
    """(id, word, grp, negated, tf): hits of a word list (word, grp); a word after a token that ends in a negator counts for the opposite group."""
    ts = tokens(F.col(text_col))
    t = docs.select(F.col(id_col).alias("id"), ts.alias("ts"))
    # each token with the one before it; the array itself is not copied to its rows
    pairs = F.zip_with("ts", F.concat(F.array(F.lit("")), F.slice("ts", 1, F.greatest(F.size("ts") - 1, F.lit(0)))), lambda w, p: F.struct(w.alias("word"), p.alias("before")))
    x = t.select("id", F.explode(pairs).alias("p")).select("id", "p.word", "p.before")
    ends = F.array(*[F.lit(n) for n in negators])
    neg = F.exists(ends, lambda n: F.endswith(F.coalesce(F.col("before"), F.lit("")), n)) if negators else F.lit(False)
    hit = x.select("id", "word", neg.alias("_neg")).join(lexicon, "word")
    flip = F.create_map(*[F.lit(v) for kv in flips.items() for v in kv]) if flips else None
    other = F.try_element_at(flip, F.col("grp")) if flips else F.lit(None).cast("string")
    negated = F.col("_neg") & other.isNotNull()
    return hit.select("id", "word", F.when(negated, other).otherwise(F.col("grp")).alias("grp"), negated.cast("int").alias("negated")).groupBy("id", "word", "grp", "negated").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(hits: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(word, negated, df, idf) with idf = ln((1+N)/(1+df))+1; n_docs is a one-row frame with column n."""
    d = hits.select("id", "word", "negated").distinct().groupBy("word", "negated").agg(F.count(F.lit(1)).alias("df"))
    return d.join(F.broadcast(n_docs)).select("word", "negated", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def group_weights(hits: DataFrame, idf: DataFrame, groups: list[str]) -> DataFrame:
    """(id, w_<group>...): sums of tf * idf by group."""
    x = hits.join(idf, ["word", "negated"])
    return x.groupBy("id").agg(*[F.sum(F.when(F.col("grp") == g, F.col("tf") * F.col("idf")).otherwise(0.0)).alias(f"w_{g}") for g in groups])


COMMON = 200_000  # tokens of more than one document that every worker may hold


def tfidf(docs: DataFrame, id_col: str, text_col: str, n_docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(id, token, weight): tf * idf over the whole vocabulary, each document's weights of length 1.

    Texts are dealt by id once, and no row of a token moves after that: a token that is not in the table of those of
    several documents stands in one. Only where that table is too large to send do rows move to it, and back.
    """
    dealt = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).repartition("_id")
    tf = positions(dealt, "_id", "_text").groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = stored(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    # a common token stands in most documents: its rows are spread
    x = sized_join(tf, df, ["token"], F.col("id"), "left", most)
    w = x.join(F.broadcast(n_docs)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(1)))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "token", (F.col("w") / norm).alias("weight"))


def pattern_hits(text: Column, words: list[str]) -> Column:
    """All hits of a word list as one alternation, longest words first, case aside."""
    alt = "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({alt.lower()})"), F.lit(1))


def vocabulary(docs: DataFrame, id_col: str, text_col: str, size: int, specials: int = 4) -> DataFrame:
    """(token, n, token_id): the most frequent tokens, ties by token, ids after the specials. The limit is the feature."""
    c = positions(docs, id_col, text_col).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + specials - 1)


def encode_fixed(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, length: int, pad: int = 0, unk: int = 1, cls: int = 2) -> DataFrame:
    """(id, ids): a start id and the ids of the first tokens, unknown words as unk, padded to length (the fixed length is the feature)."""
    p = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(F.slice(tokens(F.col(text_col)), 1, length - 1)).alias("pos", "token"))
    x = p.join(vocab.select("token", "token_id"), "token", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(unk)).alias("v")))
    g = x.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("s"))  # at most length-1 items
    ids = F.concat(F.array(F.lit(cls)), F.transform("s", lambda s: s["v"].cast("int")))
    return g.select("id", F.concat(ids, F.array_repeat(F.lit(pad), F.lit(length) - F.size(ids))).alias("ids"))


def weak_labels(weights: DataFrame, g: str, c: str, pos: str, neg: str, tokens_col: str = "nt") -> DataFrame:
    """Adds relevance, orientation, tone and labels from group weights."""
    a, b, p, n = (F.col(f"w_{x}") for x in (g, c, pos, neg))
    orient, tone = maths.balance(a, b), maths.balance(p, n)
    rel = maths.density(a + b, F.col(tokens_col))
    return weights.withColumns(
        {"rel": rel, "orientation": orient, "tone": tone, "y_rel": (rel > 0.35).cast("int"), "y_object": maths.three_way(orient, 0.30), "y_tone": maths.three_way(tone, 0.20)}
    )


DICTIONARY = 5_000  # aliases sent to every worker; beyond it aliases and texts meet by their character pairs


def mentions(docs: DataFrame, id_col: str, text_col: str, aliases: DataFrame, key: str, alias: str) -> DataFrame:
    """(id, key): one row for each document and entity of which it holds an alias. Null or empty aliases match nothing."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    a = aliases.select(F.col(key).alias("key"), F.col(alias).alias("_alias")).filter("_alias is not null and _alias <> ''").distinct()
    if a.limit(DICTIONARY + 1).count() <= DICTIONARY:
        return d.join(F.broadcast(a), F.contains("_text", F.col("_alias"))).select("id", "key").distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.substring(F.col("_text"), i, F.lit(2)))
    ones = F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.substring(F.col("_text"), i, F.lit(1)))
    heads = d.filter("_text <> ''").select("id", F.explode(F.array_distinct(F.concat(pairs, ones))).alias("_head"))
    near = heads.join(a.withColumn("_head", F.substring("_alias", 1, 2)), "_head").select("id", "key", "_alias")
    return near.join(d, "id").filter(F.contains("_text", F.col("_alias"))).select("id", "key").distinct()


def alias_scan(docs: DataFrame, id_col: str, text_col: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """The same for large dictionaries: one automaton over all aliases, run in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        import ahocorasick

        auto = ahocorasick.Automaton()
        by: dict[str, set] = {}
        for k, w in aliases:
            by.setdefault(w, set()).add(k)
        for w, ks in by.items():
            auto.add_word(w, ks)
        auto.make_automaton()
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {k for _, ks in auto.iter(t) for k in ks} if t else set()
                ids += [i] * len(found)
                keys += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["id", "key"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, key string")


def alias_blocks(docs: DataFrame, id_col: str, text_col: str, aliases: DataFrame, key: str, alias: str, block: int = 200_000) -> DataFrame:
    """alias_scan for a table of aliases of any length: no automaton holds more than about `block` of them, each block scans the texts once."""
    a = aliases.filter(F.col(key).isNotNull() & F.col(alias).isNotNull() & (F.col(alias) != "")).select(F.col(key).cast("string"), F.col(alias)).distinct()
    blocks = max(1, -(-a.count() // block))
    out = None
    for k in range(blocks):
        part = [(r[0], r[1]) for r in a.filter(F.pmod(F.xxhash64(alias), F.lit(blocks)) == k).collect()]  # about `block` rows
        one = alias_scan(docs, id_col, text_col, part)
        out = one if out is None else out.unionByName(one)
    return out if blocks == 1 else out.distinct()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def scoring_text(title: Column, body: Column, n: int) -> Column:
    """Title, full stop, body, the first n characters (the cut is the feature)."""
    return F.substring(F.concat_ws("。", title, body), 1, n)

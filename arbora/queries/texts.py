"""Queries of text operators and column scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.io import table
from arbora.operators import features as X
from arbora.operators import text as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


_T = r"(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, term, count(*) AS n FROM {_T} GROUP BY doc_id, term")
def text_count_vectors(spark, folder):
    return W.count_vectors(docs(spark, folder), "doc_id", "text")


@query(f"SELECT doc_id, term, 1 AS n FROM {_T} WHERE term NOT IN ({', '.join(chr(39) + w + chr(39) for w in W.LONG)}) GROUP BY doc_id, term")
def text_binary_without_stop_words(spark, folder):
    return W.count_vectors(docs(spark, folder), "doc_id", "text", binary=True, stop=4)


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, term, count(*) AS n FROM {_T} WHERE term IN (SELECT term FROM {_T} WHERE doc_id % 4 <> 0) AND term NOT IN ('in', 'of', 'at', 'a', 'the', 'an') GROUP BY doc_id, term")
def text_count_vectors_fitted(spark, folder):
    """count_vectorizer_mod: the vocabulary of the training texts, without a short list of words."""
    d = docs(spark, folder).withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train"))
    return W.fitted_count_vectors(d, "doc_id", "text", stop=0)


_TT = r"(SELECT doc_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(g) AS term FROM {_TT}) GROUP BY doc_id, term")
def text_bigrams(spark, folder):
    return W.count_vectors(docs(spark, folder), "doc_id", "text", start=1, end=1)


@query(
    f"""WITH c AS (SELECT doc_id, term, count(*) AS n FROM {_T} GROUP BY doc_id, term), d AS (SELECT count(DISTINCT doc_id) AS docs FROM documents),
    i AS (SELECT term, ln((1.0 + max(docs)) / (1 + count(*))) + 1 AS idf FROM c, d GROUP BY term), w AS (SELECT doc_id, c.term, n * idf AS w FROM c JOIN i ON i.term = c.term)
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""
)
def text_tfidf(spark, folder):
    return W.tfidf(docs(spark, folder), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query()
def text_hashing_vectors(spark, folder):
    return W.hashing_vectors(docs(spark, folder), "doc_id", "text").withColumn("value", F.round("value", 6))


@query(f"SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS idx FROM (SELECT term, count(*) AS n FROM {_T} GROUP BY term ORDER BY n DESC, term LIMIT 500)")
def text_vocabulary(spark, folder):
    """A top-k report."""
    return W.vocabulary(docs(spark, folder), "text", 500)


@query(
    rf"""WITH t AS (SELECT doc_id, ts[p] AS term, p FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS ts FROM documents))),
    v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS idx FROM (SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 500)),
    s AS (SELECT doc_id, list(idx ORDER BY p) AS ids FROM t JOIN v ON v.term = t.term GROUP BY doc_id)
    SELECT d.doc_id, array_to_string(list_concat(list_transform(range(0, greatest(50 - len(coalesce(ids, [])), 0)), lambda i: 0), coalesce(ids, [])[greatest(len(coalesce(ids, [])) - 49, 1):]), ',') AS ids FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""
)
def text_sequences(spark, folder):
    return W.sequences(docs(spark, folder), "doc_id", "text", 500, 50).select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


_LEXICON = ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, (p, s) in W.SENTIMENT.items())


@query(f"SELECT d.doc_id, round(coalesce(avg(p), 0), 6) AS polarity, round(coalesce(avg(s), 0), 6) AS subjectivity FROM documents d LEFT JOIN (SELECT doc_id, p, s FROM {_T} t JOIN (VALUES {_LEXICON}) x(w, p, s) ON x.w = t.term) h ON h.doc_id = d.doc_id GROUP BY d.doc_id")
def text_sentiment(spark, folder):
    return W.sentiment(docs(spark, folder), "doc_id", "text").select("doc_id", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"))


def _stem(i):
    def run(spark, folder):
        return W.stemmed(docs(spark, folder), "text", i).select("doc_id", "stemmed")

    return run


SQL["text_stem_none"] = "SELECT doc_id, text AS stemmed FROM documents"
QUERIES |= {f"text_stem_{n}": _stem(i) for i, n in enumerate(("none", "suffix_rules", "light", "hard", "lemma"))}


@query()
def text_sentence_scores(spark, folder):
    return W.sentence_scores(docs(spark, folder), "doc_id", "text").withColumn("score", F.round("score", 6))


@query()
def text_named_share(spark, folder):
    return docs(spark, folder).select("doc_id", F.round(W.named_share("text"), 6).alias("share"))


@query()
def text_word_vectors(spark, folder):
    return W.word_vectors(docs(spark, folder), "doc_id", "text").select("doc_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 4))


@query()
def text_rank(spark, folder):
    return W.text_rank(docs(spark, folder), "doc_id", "text").withColumn("rank", F.round("rank", 6))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "(SELECT l_returnflag AS l, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS \"column\", unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)"


@query(
    f"""WITH g AS (SELECT "column", l, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM {_LONG} GROUP BY "column", l), t AS (SELECT "column", sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g GROUP BY "column")
    SELECT "column", round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM t"""
)
def feature_f_classif(spark, folder):
    return X.anova_f(table(spark, folder, "lineitem"), COLS, "l_returnflag").withColumn("f", F.round("f", 4))


@query(
    f"""WITH g AS (SELECT "column", l, count(*) AS n, sum(v) AS o FROM {_LONG} GROUP BY "column", l), t AS (SELECT "column", sum(n) AS tn, sum(o) AS tt FROM g GROUP BY "column")
    SELECT g."column", round(sum(pow(o - tt * n / tn, 2) / (tt * n / tn)), 4) AS chi2 FROM g JOIN t ON t."column" = g."column" GROUP BY g."column\""""
)
def feature_chi2(spark, folder):
    return X.chi2(table(spark, folder, "lineitem"), COLS, "l_returnflag").withColumn("chi2", F.round("chi2", 4))


@query("""SELECT "column", round(r * r / (1 - r * r) * (n - 2), 4) AS f FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS "column", unnest([corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), corr(l_tax, l_extendedprice)]) AS r, count(*) AS n FROM lineitem)""")
def feature_f_regression(spark, folder):
    return X.regression_f(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("f", F.round("f", 4))


@query("""SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS "column", round(unnest([var_pop(l_quantity), var_pop(l_extendedprice), var_pop(l_discount), var_pop(l_tax)]), 4) AS variance FROM lineitem""")
def feature_variance(spark, folder):
    """myVarThresh keeps the columns above a bound."""
    return X.variances(table(spark, folder, "lineitem"), COLS).withColumn("variance", F.round("variance", 4))


def _selection(mode, param):
    def run(spark, folder):
        t = table(spark, folder, "lineitem").select(*COLS, "l_returnflag")
        kept = X.select(t, COLS, "l_returnflag", mode, param)
        return t.select("l_returnflag", *kept).groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("kept", F.lit(",".join(sorted(kept))))

    return run


#: The columns kept are those of greatest F, by its formula over sums per class.
_BEST = f"""WITH g AS (SELECT "column", l, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM {_LONG} GROUP BY "column", l), a AS (SELECT "column", sum(n * m) / sum(n) AS mm FROM g GROUP BY "column"),
  f AS (SELECT g."column", sum(n * pow(m - mm, 2)) / sum(n * s) AS f FROM g JOIN a ON a."column" = g."column" GROUP BY g."column"),
  b AS (SELECT list("column" ORDER BY "column") AS kept FROM (SELECT "column" FROM f ORDER BY f DESC LIMIT 2))
  SELECT l_returnflag, count(*) AS n, (SELECT array_to_string(kept, ',') FROM b) AS kept FROM lineitem GROUP BY l_returnflag"""
SQL |= {"feature_select_k_best": _BEST, "feature_select_percentile": _BEST}
QUERIES |= {f"feature_select_{m}": _selection(m, p) for m, p in (("k_best", 2), ("percentile", 50), ("fpr", 0.05), ("fdr", 0.05), ("fwe", 0.05))}


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INT) AS a, CAST(l_returnflag = 'N' AS INT) AS n, CAST(l_returnflag = 'R' AS INT) AS r FROM lineitem")
def feature_one_hot(spark, folder):
    """Targets encoded over their classes."""
    t = X.one_hot(table(spark, folder, "lineitem"), "l_returnflag", "h")
    return t.select("l_orderkey", "l_linenumber", F.col("h")[0].alias("a"), F.col("h")[1].alias("n"), F.col("h")[2].alias("r"))


def _decompose(f, **options):
    def run(spark, folder):
        t = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *[(F.col(c) / s).alias(c) for c, s in zip(COLS, (50.0, 1e5, 0.1, 0.1))])
        out = f(t, COLS, 2, **options)
        new = [c for c in out.columns if c not in t.columns]
        return out.select("l_orderkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in new])

    return run


QUERIES |= {"decompose_pca": _decompose(X.pca), "decompose_pca_white": _decompose(X.pca, whiten=True), "decompose_sparse_pca": _decompose(X.sparse_pca), "decompose_ica": _decompose(X.ica)}

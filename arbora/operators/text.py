"""Text operators: tokens, n-grams, vocabularies, count and tf-idf vectors, hashing, stems, sentiment, sentence scores.

Vectors are kept long, (doc, term, value): at scale no row holds a vocabulary. Tokens are runs of two or more word
characters in lower case. NULL and empty texts have no tokens and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.staging import stage

#: The words of the two short lists, the second the published English list of 127 words in its order.
SHORT = ["in", "of", "at", "a", "the", "an"]
LONG = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def stop_list(index: int) -> list[str]:
    """Words left out, by index modulo 5: a short list, Spark's English list, none, Spark's English list again, a long list."""
    kind = index % 5
    if kind in (1, 3):
        from pyspark.ml.feature import StopWordsRemover

        return list(StopWordsRemover.loadDefaultStopWords("english"))
    return {0: SHORT, 2: [], 4: LONG}[kind]


#: The index of the list without words.
NO_STOP = 2


def tokens(text: Column | str, stop: int = NO_STOP) -> Column:
    t = F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    words = stop_list(stop)
    return F.filter(t, lambda w: ~w.isin(words)) if words else t


def ngrams(toks: Column, start: int = 1, end: int = 1) -> Column:
    """All n-grams of lengths ``start % 3 + 1`` to ``end % 3 + 1``, swapped if reversed."""
    lo, hi = sorted((start % 3 + 1, end % 3 + 1))
    def of(n: int) -> Column:
        if n == 1:
            return toks
        return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in range(lo, hi + 1)]
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def count_vectors(df: DataFrame, id: str, text: str, binary: bool = False, start: int = 0, end: int = 0, stop: int = NO_STOP) -> DataFrame:
    """(id, term, n): how often each n-gram occurs in each text, or 1."""
    t = df.select(id, tokens(text, stop).alias("__t")).select(id, F.explode(ngrams(F.col("__t"), start, end)).alias("term"))
    c = t.groupBy(id, "term").agg(F.count("*").alias("n"))
    return c.withColumn("n", F.lit(1).cast("long")) if binary else c


def fitted_count_vectors(df: DataFrame, id: str, text: str, split: str = "split", **options) -> DataFrame:
    """(id, split, term, n): counts of the terms that occur in some text of split 'train', for the texts of all splits. Terms
    of other splits that no training text has are left out, as a vocabulary fitted on the training texts leaves them."""
    c = count_vectors(df.select(id, text), id, text, **options)
    known = df.select(id, split).distinct()
    c = c.join(known, id)
    return c.join(c.where(F.col(split) == "train").select("term").distinct(), "term", "left_semi").select(id, split, "term", "n")


def tfidf(df: DataFrame, id: str, text: str, **options) -> DataFrame:
    """(id, term, weight): n * (ln((1 + docs) / (1 + docs with term)) + 1), scaled to length 1 per text."""
    docs = df.select(id).distinct().count()
    c = count_vectors(df, id, text, **options)
    idf = c.groupBy("term").agg((F.log((1.0 + docs) / (1 + F.count("*"))) + 1).alias("idf"))
    w = c.join(idf, "term").select(id, "term", (F.col("n") * F.col("idf")).alias("w"))
    # One shuffle by text for the norm and what it divides: a window over the terms of one text, spilled where it is long.
    return w.select(id, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id)))).alias("weight"))


def hashing_vectors(df: DataFrame, id: str, text: str, dims: int = 1 << 20, **options) -> DataFrame:
    """(id, slot, value): n-grams by hashed slot, signed by another bit of the hash, scaled to length 1. No vocabulary."""
    c = count_vectors(df, id, text, **options)
    h = F.xxhash64("term")
    sign = F.when(F.shiftrightunsigned(h, 63) == 0, 1.0).otherwise(-1.0)
    s = c.select(id, F.pmod(h, F.lit(dims)).alias("slot"), (F.col("n") * sign).alias("v")).groupBy(id, "slot").agg(F.sum("v").alias("v"))
    norm = s.groupBy(id).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return s.join(norm, id).select(id, "slot", F.when(F.col("len") > 0, F.col("v") / F.col("len")).otherwise(0.0).alias("value"))


def vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """(term, n, idx): the ``size`` most frequent tokens, numbered from 1; ties in order of the term. Top-k first, so the
    numbering sees no more than ``size`` rows."""
    top = df.select(F.explode(tokens(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "term")))


def sequences(df: DataFrame, id: str, text: str, size: int, length: int) -> DataFrame:
    """(id, ids): token numbers of each text, unknown tokens left out, cut or padded with 0 on the left to ``length``."""
    vocab = vocabulary(df, text, size).select("term", "idx")
    t = df.select(id, F.posexplode(tokens(text)).alias("pos", "term")).join(vocab, "term")
    seq = t.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("ids"))
    kept = F.slice("ids", F.greatest(F.size("ids") - length + 1, F.lit(1)), length)
    padded = F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size("ids"), F.lit(0))), kept)
    return df.select(id).distinct().join(seq, id, "left").select(id, F.when(F.col("ids").isNull(), F.array_repeat(F.lit(0), length)).otherwise(padded).alias("ids"))


#: Words with a polarity from -1 to 1 and a subjectivity from 0 to 1.
SENTIMENT = {
    "good": (0.7, 0.6), "better": (0.5, 0.5), "best": (1.0, 0.3), "fine": (0.4, 0.5), "lucky": (0.3, 0.8), "stable": (0.3, 0.4), "steady": (0.2, 0.3), "careful": (0.1, 0.9), "patient": (0.2, 0.4), "well": (0.4, 0.4), "wide": (-0.1, 0.4), "cheap": (0.4, 0.7),
    "bad": (-0.7, 0.7), "worse": (-0.4, 0.6), "worst": (-1.0, 1.0), "late": (-0.3, 0.6), "slow": (-0.3, 0.4), "fragile": (-0.3, 0.6), "noisy": (-0.4, 0.6), "odd": (-0.2, 0.3), "stubborn": (-0.2, 0.5), "costly": (-0.4, 0.6), "lost": (-0.5, 0.5), "error": (-0.4, 0.3),
}


def sentiment(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, polarity, subjectivity): means over the words of the lexicon in each text; 0 where there are none."""
    lex = df.sparkSession.createDataFrame([(w, p, s) for w, (p, s) in SENTIMENT.items()], "term string, p double, s double")
    hit = df.select(id, F.explode(tokens(text)).alias("term")).join(F.broadcast(lex), "term").groupBy(id).agg(F.avg("p").alias("p"), F.avg("s").alias("s"))
    return df.select(id).distinct().join(hit, id, "left").select(id, F.coalesce("p", F.lit(0.0)).alias("polarity"), F.coalesce("s", F.lit(0.0)).alias("subjectivity"))


# --- stems ---------------------------------------------------------------------------------------------------------------

_VOWEL = set("aeiou")


def _shape(word: str) -> str:
    """'v' or 'c' for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWEL or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc") if stem else 0


def _short(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


#: Suffix rules of the public stemming algorithm of 1980, by step.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "lszaeiou":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        s = max((s for s in rules if w.endswith(s)), key=len, default=None)
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + rules[s]
    s = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def light_stem(word: str) -> str:
    """Only endings of number and tense are taken off."""
    for s in ("ings", "ing", "edly", "ed", "ies", "es", "s"):
        if word.endswith(s) and len(word) - len(s) > 2:
            return word[: -len(s)] + ("y" if s == "ies" else "")
    return word


def hard_stem(word: str) -> str:
    """Endings are taken off for as long as a stem of three letters with a vowel is left."""
    while True:
        s = next((s for s in ("ational", "ization", "ation", "ness", "ment", "able", "ible", "ing", "ity", "ive", "ous", "ful", "ed", "er", "ly", "al", "es", "s", "e") if word.endswith(s) and len(word) - len(s) > 2 and _VOWEL & set(word[: -len(s)])), None)
        if s is None:
            return word
        word = word[: -len(s)]


#: Irregular forms and their lemma.
LEMMAS = {"was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "did": "do", "went": "go", "fell": "fall", "rose": "rise", "kept": "keep", "held": "hold", "took": "take", "froze": "freeze", "shrank": "shrink", "left": "leave", "ran": "run", "beat": "beat", "better": "good", "best": "good", "worse": "bad", "worst": "bad"}


def lemma(word: str) -> str:
    return LEMMAS.get(word) or light_stem(word)


STEMMERS = [None, stem, light_stem, hard_stem, lemma]


def stemmed(df: DataFrame, text: str, index: int, output: str = "stemmed") -> DataFrame:
    """Texts with each token replaced by its stem, by stemmer ``index % 5`` (0: unchanged); NULL stays NULL."""
    f = STEMMERS[index % len(STEMMERS)]
    if f is None:
        return df.withColumn(output, F.col(text))

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict = {}

        def one(w):
            if w not in known:
                known[w] = f(w)
            return known[w]

        return batch.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return df.withColumn(output, F.array_join(run(tokens(text)), " "))


def sentence_scores(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, score): mean over a text's sentences of term frequency times inverse sentence frequency within the corpus."""
    s = df.select(id, F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("pos", "s")).where("s <> ''")
    s = stage(s.select(id, "pos", tokens("s").alias("t")), "sentences")
    n = s.count()
    c = s.select(id, "pos", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy(id, "pos", "len", "term").agg(F.count("*").alias("k"))
    isf = c.groupBy("term").agg(F.log(F.lit(float(max(n, 1))) / F.count("*")).alias("isf"))
    per = c.join(isf, "term").groupBy(id, "pos").agg(F.sum(F.col("k") / F.col("len") * F.col("isf")).alias("v"))
    return per.groupBy(id).agg(F.avg("v").alias("score"))


def named_share(text: Column | str) -> Column:
    """Share of capitalised words that do not begin a sentence."""
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.regexp_extract_all(t, F.lit(r"(?<=[\p{Ll},;] )\p{Lu}\w+"), F.lit(0))) / F.greatest(F.size(F.regexp_extract_all(t, F.lit(r"\b\w+\b"), F.lit(0))), F.lit(1))


def word_vectors(df: DataFrame, id: str, text: str, size: int = 16, window: int = 3, min_count: int = 2, stop: int = NO_STOP, seed: int = 7) -> DataFrame:
    """(id, vector): mean word vector of each text, scaled to length 1; vectors are trained on the same texts."""
    from pyspark.ml.feature import Normalizer, Word2Vec

    t = df.select(id, F.coalesce(tokens(text, stop), F.array().cast("array<string>")).alias("__t"))
    m = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="__t", outputCol="__v", maxIter=1).fit(t)
    out = Normalizer(inputCol="__v", outputCol="vector").transform(m.transform(t))
    from pyspark.ml.functions import vector_to_array

    return out.select(id, vector_to_array("vector").alias("vector"))


#: Texts ranked together, and pairs of sentence lengths of one word held at once.
RANK_TEXTS, RANK_PAIRS = 512, 1 << 20


def sentence_ranks(doc: np.ndarray, size: np.ndarray, row: np.ndarray, word: np.ndarray, rounds: int) -> np.ndarray:
    """Rank of each sentence. ``doc`` and ``size`` are per sentence, (``row``, ``word``) the words of each sentence, all
    different. A shared word weighs 1 / (log size + log size), which depends on the sizes only: sentences of one size act
    through their sum for each word, so memory follows the words of a text, not the pairs of its sentences."""
    _, term, shared = np.unique(doc[row] * (int(word.max(initial=0)) + 1) + word, return_inverse=True, return_counts=True)
    row, term = row[shared[term] > 1], term[shared[term] > 1]
    sizes, group = np.unique(size, return_inverse=True)
    logs = np.log(sizes)
    keys, pair = np.unique(term * len(sizes) + group[row], return_inverse=True)  # (word, size), in order of the word
    _, first, at, many = np.unique(keys // max(len(sizes), 1), return_index=True, return_inverse=True, return_counts=True)
    log, first, many = logs[keys % max(len(sizes), 1)], first[at], many[at]
    ends = np.cumsum(many)
    own = np.bincount(row, minlength=len(doc)) / (2 * logs[group])

    def meet(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        to = np.repeat(np.arange(lo, hi), many[lo:hi])
        of = np.arange(len(to)) - np.repeat(ends[lo:hi] - many[lo:hi] - (ends[lo] - many[lo]), many[lo:hi]) + first[to]
        return to - lo, of, 1 / (log[to] + log[of])

    cuts = [0]
    while cuts[-1] < len(keys):
        lo = cuts[-1]
        cuts.append(max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + RANK_PAIRS, "right"))))
    blocks = list(zip(cuts, cuts[1:]))
    kept = [meet(*b) for b in blocks] if len(blocks) == 1 else None

    def spread(x: np.ndarray) -> np.ndarray:
        y, z = np.bincount(pair, x[row], len(keys)), np.zeros(len(keys))
        for i, (lo, hi) in enumerate(blocks):
            to, of, w = kept[i] if kept else meet(lo, hi)
            z[lo:hi] = np.bincount(to, y[of] * w, hi - lo)
        return np.bincount(row, z[pair], len(doc)) - own * x

    linked = own > 0
    out = np.where(linked, spread(np.ones(len(doc))), 1.0)
    rank = np.ones(len(doc))
    for _ in range(rounds):
        rank = 0.15 + 0.85 * np.where(linked, spread(np.where(linked, rank / out, 0.0)), 0.0)
    return rank


def text_rank(df: DataFrame, id: str, text: str, rounds: int = 10) -> DataFrame:
    """(id, pos, rank): rank of each sentence within its text, from the words sentences share. Every row is a text of its
    own, so all rounds run inside the task that reads it; sentences meet through their words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, RANK_TEXTS):
                part = b.slice(lo, RANK_TEXTS)
                sentences = part.column(1).flatten()
                count = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), count)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                size = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                word = sentences.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                kept = size > 1
                number = np.cumsum(kept) - 1
                row = np.repeat(np.arange(len(doc)), size)
                word, row = word[kept[row]], number[row[kept[row]]]
                doc, pos = doc[kept], pos[kept]
                rank = sentence_ranks(doc, size[kept], row, word, rounds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(rank)], [id, "pos", "rank"])

    words = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.array_distinct(tokens(s)))
    schema = T.StructType([df.schema[id], T.StructField("pos", T.IntegerType()), T.StructField("rank", T.DoubleType())])
    return df.select(id, words.alias("__t")).where(F.col("__t").isNotNull()).mapInArrow(run, schema)

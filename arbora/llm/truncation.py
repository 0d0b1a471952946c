"""Text cut off by field limits or mid-transfer, by a backward character n-gram model.

The model reads each text's final characters backwards and compares two explanations of them: the text ended there,
or it went on. For contexts of growing length (the last 1 to 20 characters, digits folded, together with what is open
at that place: a code fence, a parenthesis, a quotation, a short line of a known kind) it counts how often a text of
the corpus ends after the context and how often it continues. Interpolated from short contexts to long ones, that
gives the odds of an end; set against the odds of an end at any place they are the score of a text. A text does not
vote for itself: its own end is taken out of the counts. Thresholds are set per column and language where the scores
of all texts fall apart.

An ellipsis or broken character at the end marks the place of a cut and is no evidence of an end: it is left off
before the context is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.keys import WHITE
from arbora.staging import drop_stage, stage

#: Lengths of the contexts, weight of the shorter context, and the longest line whose head is part of the state.
ORDERS, WEIGHT, LINE = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20), 5.0, 60
#: Texts of a language needed for a threshold of its own, and the range and bins in which it is looked for.
OWN_THRESHOLD, RANGE, BINS, SEARCH = 1000, (-6.0, 4.0), 50, (-1.0, 2.0)
#: Most bits of the bitmap of end contexts (it only saves shuffling, so a full one costs time and no counts), and the
#: share of ends from which a context is broadcast: at most ``len(ORDERS) / HOT`` contexts have it.
MOST_BITS, HOT = 28, 1e-3
#: Zero-width and broken characters, and with the ellipsis and white space what marks a cut at an end.
_HIDDEN = "\u200b\u200c\u200d\ufeff\ufffd"
_MARKS = WHITE + _HIDDEN + "\u2026"
_DROPPED = re.compile(f"[{_HIDDEN}]")
_SPACE, _DIGITS = re.compile(r" [^\S\n]+|[^\S\n ][^\S\n]*"), re.compile(r"\d+(?:[.,]\d+)*")
_FENCE = re.compile("(?=```)")
_GAP = max(ORDERS)
_SEP = np.uint64(0x1FFFFF)
_M = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> str:
    """A text as the model reads it: without marks of a cut at its end, digits and white space folded."""
    t = text.rstrip(_MARKS)
    while len(u := t.rstrip(".")) <= len(t) - 3:
        t = u.rstrip(_MARKS)
    return _SPACE.sub(" ", _DIGITS.sub("0", _DROPPED.sub("", t)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _since(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    c = np.cumsum(flags, dtype=np.int32)
    return c - c[start]


def _state(short: np.ndarray, head: np.ndarray, fence: np.ndarray, paren: np.ndarray, quote: np.ndarray) -> np.ndarray:
    """What is open at a place, as one hash."""
    with np.errstate(over="ignore"):
        s = _mix(head * _M) * short.astype(np.uint64) + fence.astype(np.uint64) + np.uint64(2) * paren.astype(np.uint64) + np.uint64(4) * quote.astype(np.uint64)
        return _mix((s + np.uint64(1)) * _M)


def _symbols(text: str) -> np.ndarray:
    sym = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sym[sym == 0x10FFFF] = _SEP
    return sym


def end_contexts(texts: list[str]) -> np.ndarray:
    """The hashed contexts at the end of each folded text, a row per text and a column per order. Only the last line and
    the last characters are hashed; the whole text is searched for what it leaves open."""
    if not texts:
        return np.zeros((0, len(ORDERS)), np.uint64)
    gap = chr(0x10FFFF) * _GAP
    tails = _symbols("".join((gap + t[-_GAP:])[-_GAP:] for t in texts)).reshape(-1, _GAP)
    lines = [t[t.rfind("\n") + 1 :] for t in texts]
    short = np.array([len(l) < len(t) and 0 < len(l) <= LINE for l, t in zip(lines, texts)])
    fence = np.array([len(_FENCE.findall(t)) % 2 if "```" in t else 0 for t in texts])
    paren = np.array([l.count("(") > l.count(")") for l in lines])
    quote = np.array([l.count('"') % 2 == 1 or l.count("«") > l.count("»") for l in lines])
    with np.errstate(over="ignore"):
        heads = _symbols("".join((l[:3] + l[-1:] * 3)[:3] if l else "\n\n\n" for l in lines)).reshape(-1, 3)
        head = (heads[:, 0] * np.uint64(1 << 21) + heads[:, 1]) * np.uint64(1 << 21) + heads[:, 2]
        state = _state(short, head, fence, paren, quote)
        out, h, power = [], np.zeros(len(texts), np.uint64), np.uint64(1)
        for n in range(1, _GAP + 1):
            h = h + tails[:, -n] * power
            power *= np.uint64(0x100000001B3)
            if n in ORDERS:
                out.append(_mix((h ^ state) + np.uint64(n) * _M))
    return np.stack(out, axis=1)


def place_contexts(texts: list[str], known=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of folded texts with their hashed contexts, one order after the other: (place, context, whether an end).

    ``known`` tells of contexts which to follow: the places of others are left out of all longer orders, and cost nothing
    more. Places count the separators before each text.
    """
    gap = chr(0x10FFFF) * _GAP
    sym = _symbols(gap + gap.join(texts) + gap)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(lengths + _GAP) - 1
    i = np.arange(len(sym), dtype=np.int32)
    sep = sym == _SEP
    text_start = np.maximum.accumulate(np.where(sep, i, np.int32(0)))
    line_start = np.maximum.accumulate(np.where(sep | (sym == 10), i, np.int32(0)))
    tick = sym == 96
    mark = np.zeros(len(sym), bool)
    mark[2:] = tick[2:] & tick[1:-1] & tick[:-2]
    fence = _since(mark, text_start) & 1
    paren = _since((sym == 40).view(np.int8) - (sym == 41).view(np.int8), line_start) > 0
    quote = (_since(sym == 34, line_start) & 1 == 1) | (_since((sym == 0xAB).view(np.int8) - (sym == 0xBB).view(np.int8), line_start) > 0)
    on_line = i - line_start
    is_end = np.zeros(len(sym), bool)
    is_end[end] = True
    places = np.flatnonzero(~sep)
    flags = (fence + 2 * paren + 4 * quote).astype(np.uint64)[places]
    short = np.flatnonzero(((line_start > text_start) & (on_line <= LINE) & (on_line > 0))[places])
    with np.errstate(over="ignore"):
        state = _mix((np.arange(8, dtype=np.uint64) + np.uint64(1)) * _M)[flags.view(np.int64)]
        head = np.zeros(len(short), np.uint64)
        for k in (1, 2, 3):
            head = head * np.uint64(1 << 21) + sym[np.minimum(line_start[places[short]] + k, places[short])]
        state[short] = _mix((_mix(head * _M) + flags[short] + np.uint64(1)) * _M)
        h, power = np.zeros(len(places), np.uint64), np.uint64(1)
        for n in range(1, _GAP + 1):
            h = h + sym[places - (n - 1)] * power
            power *= np.uint64(0x100000001B3)
            if n in ORDERS:
                x = _mix((h ^ state) + np.uint64(n) * _M)
                if known is not None:
                    on = np.flatnonzero(known(x))
                    if not len(on):
                        return
                    places, state, h, x = places[on], state[on], h[on], x[on]
                yield places, x, is_end[places]


def _parts(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of a batch with their folded texts, in parts of bounded size; rows whose text is blank are left out."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        if t is None or not (f := folded(t)).strip():
            continue
        rows.append(i)
        texts.append(f)
        size += len(f) + _GAP
        if size > most:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the text, a key of the folded text, and the contexts at its end."""
    for b in batches:
        for rows, texts in _parts(b):
            ends = end_contexts(texts)
            key = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(ORDERS)), pa.array(ends.view(np.int64).ravel()))
            columns = [*b.take(pa.array(rows)).columns[:-1], pa.array(np.array(key, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def _goes_on(bitmap, bits: int):
    """Counts of contexts at places where text goes on: all that some text ends with, and few others. A text that ends
    with a context ends with its shorter ones too, so a place is left once a shorter one is unknown, and most places are
    never hashed beyond their first characters."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        # A byte for each bit where that is at most 16 MB: one look-up instead of shifts.
        flags = np.unpackbits(words.view(np.uint8), bitorder="little").view(bool) if bits <= 24 else None

        def known(x: np.ndarray) -> np.ndarray:
            at = x >> shift
            if flags is not None:
                return flags[at.view(np.int64)]
            return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)

        for b in batches:
            for _, texts in _parts(b):
                found = [x[~is_end] for _, x, is_end in place_contexts(texts, known)]
                if found:
                    seen = pa.array(np.concatenate(found).view(np.int64)).value_counts()
                    yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["h", "n"])

    return run


def _counts(voters: DataFrame, texts: DataFrame) -> tuple[DataFrame, float, int]:
    """(staged table of h, e, t: ends and places of each context that some voter ends with; ends at any place; voters).

    ``voters`` has the contexts ``ends`` of each distinct text, ``texts`` the texts whose places are counted, in a column t.
    Counts are summed over the cluster and stay there.
    """
    spark = texts.sparkSession
    ends = stage(voters.select(F.explode("ends").alias("h")).groupBy("h").agg(F.count("*").alias("e")), "ends")
    known, n_ends = ends.agg(F.count("*"), F.coalesce(F.sum("e"), F.lit(0)) / len(ORDERS)).first()
    bits = min(MOST_BITS, max(16, (16 * known).bit_length()))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    found = ends.groupBy(F.shiftrightunsigned("h", 64 - bits + 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    went = texts.mapInArrow(_goes_on(spark.sparkContext.broadcast(words), bits), "h long, n long")
    both = ends.select("h", "e", F.lit(0).cast("long").alias("n")).unionByName(went.select("h", F.lit(0).cast("long").alias("e"), "n"))
    sums = both.groupBy("h").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where(F.col("e") > 0)
    counts = stage(sums.select("h", "e", (F.col("e") + F.col("n")).alias("t")), "contexts")
    drop_stage(ends)
    n_places = texts.agg(F.sum(F.length("t"))).first()[0] or 1
    return counts, max(n_ends, 1) / max(n_places, 2), int(n_ends)


def _odds(e: np.ndarray, t: np.ndarray, base: float) -> np.ndarray:
    """Chance of an end from the counts of nested contexts (columns, short to long). What a longer context has counted
    is taken out of the shorter one, so that no place is evidence twice."""
    e, t = np.maximum(e, 0), np.maximum(t, 0)
    e = e - np.concatenate([e[:, 1:], np.zeros((len(e), 1), e.dtype)], axis=1)
    t = t - np.concatenate([t[:, 1:], np.zeros((len(t), 1), t.dtype)], axis=1)
    p = np.full(len(e), base)
    for k in range(e.shape[1]):
        p = (np.maximum(e[:, k], 0) + WEIGHT * p) / (np.maximum(t[:, k], 0) + WEIGHT)
    return p


def _score(base: float):
    """The score of each key from its counts: e of every order, then t of every order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            p = _odds(n[:, : len(ORDERS)], n[:, len(ORDERS) :], base)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.log(p / (1 - p)) - np.log(base / (1 - base)))], names=["__key", "score"])

    return run


def _valley(counts: dict[int, int]) -> float:
    """Where the scores fall apart: the emptiest place between the two crowds, by a window over the histogram. Among
    equally empty places the middle one."""
    n = np.array([counts.get(b, 0) for b in range(BINS)], float)
    smooth = np.convolve(n, [1, 2, 3, 2, 1], "same")
    low, high = RANGE
    mids = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
    inside = np.flatnonzero((mids > SEARCH[0]) & (mids < SEARCH[1]))
    least = inside[smooth[inside] == smooth[inside].min()]
    return float(mids[least[len(least) // 2]])


def language(col: str = "lang"):
    """A language as its lower-case main part; 'und' where none is given."""
    l = F.lower(F.regexp_extract(F.col(col), r"([A-Za-z]+)", 1))
    return F.when(l != "", l).otherwise(F.lit("und"))


def _scored(df: DataFrame, text: str, train_texts: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """What :func:`scored` returns, and the staged tables it reads."""
    rest = [c for c in df.columns if c != text]
    present = df.where(F.col(text).isNotNull())
    votes = F.lit(True)
    if train_texts is not None:
        share = min(1.0, train_texts / max(present.count(), 1))
        votes = F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(share * 1_000_000)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != text)
    rows = stage(present.select(*rest, votes.alias("__votes"), text).mapInArrow(_ends, f"{fields}__votes boolean, __key long, __ends array<long>"), "rows")
    # One vote per distinct text.
    each = stage(rows.groupBy("__key").agg(F.first("__ends").alias("ends"), F.max("__votes").alias("__votes")), "texts")
    counts, base, n_ends = _counts(each.where("__votes"), present.where(votes).select(F.col(text).alias("t")))
    # Contexts of very many ends are broadcast, so no key of the shuffled join has more than their share of the texts.
    one = each.select("__key", F.col("__votes").cast("long").alias("own"), F.posexplode("ends").alias("k", "h"))
    hot = F.col("e") > HOT * n_ends
    hits = one.join(F.broadcast(counts.where(hot)), "h").unionByName(one.join(counts.where(~hot), "h"))
    of = lambda c: [F.coalesce(F.max(F.when(F.col("k") == k, F.col(c) - F.col("own"))), F.lit(0)).alias(f"{c}{k}") for k in range(len(ORDERS))]
    scores = hits.groupBy("__key").agg(*of("e"), *of("t")).mapInArrow(_score(base), "__key long, score double")
    out = rows.join(scores, "__key", "left").select(*[f"`{c}`" for c in rest], F.coalesce("score", F.lit(0.0)).alias("score"))
    return out, [rows, each, counts]


def scored(df: DataFrame, text: str = "text", train_texts: int | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``score``, the log-odds of an end against those at any place.

    NULL, empty and blank texts, and texts of nothing but marks of a cut, have no final context and are left out.
    Repeated texts vote once and are each scored. Whole texts are read. All texts are counted, unless the caller asks
    for a model of about ``train_texts`` of them; a text that has voted never has its own vote.
    """
    return _scored(df, text, train_texts)[0]


def truncated(df: DataFrame, lang: str = "lang", text: str = "text", train_texts: int | None = None) -> DataFrame:
    """Rows of ``df`` (all columns but ``text``) with ``score``, ``threshold`` and ``cut``, true for a text cut off.

    Thresholds come from the histogram of all scores, one per language with ``OWN_THRESHOLD`` texts or more, and one
    for the rest. Names that begin with two underscores are the operator's own.
    """
    scores, read = _scored(df, text, train_texts)
    s = stage(scores.withColumn("__lang", language(lang)), "scores")
    for d in read:
        drop_stage(d)
    low, high = RANGE
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") - low) / (high - low) * BINS).cast("int")))
    hist = stage(s.groupBy("__lang", bin_.alias("b")).agg(F.count("*").alias("n")), "histogram")
    whole = {r["b"]: r["n"] for r in hist.groupBy("b").agg(F.sum("n").alias("n")).collect()}  # at most BINS rows
    large = hist.groupBy("__lang").agg(F.sum("n").alias("n")).where(F.col("n") >= OWN_THRESHOLD).select("__lang")

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"__lang": [key[0]], "__own": [_valley(dict(zip(pdf["b"], pdf["n"])))]})

    thresholds = hist.join(large, "__lang").groupBy("__lang").applyInPandas(own, "__lang string, __own double")
    s = s.join(thresholds, "__lang", "left").withColumn("threshold", F.coalesce("__own", F.lit(_valley(whole)))).drop("__own")
    return s.withColumn("cut", F.col("score") < F.col("threshold")).drop("__lang")

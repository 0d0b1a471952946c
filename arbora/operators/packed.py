"""Several values packed in one field: one row per value, by the cheapest dialect of each field.

A dialect says which separators, which quote characters and which nesting rule a field uses. Every dialect a field's
characters allow is tried: each set of separators that stand outside parentheses in it, each set of its quote
characters, both nesting rules. A dialect that does not close what it opens is out; among the others the minimum
description length decides. It is the sum of the bits that declare the dialect and, for each value, the code length of
its shape, of its characters, and of each separator or quote it holds as an ordinary character. Those codes come from
counts over the whole table, so what a value looks like in the corpus says where values begin and end: nothing fixes
the separators first. The counts are those of the parses that are cheapest while all values cost the same.

Fields with neither separators, quotes nor parentheses have one reading under every dialect and stay inside the JVM.
All others go to Arrow batches. What decides is a field's skeleton (word characters made alike), so dialects are
chosen once for each skeleton a task has in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.keys import WHITE, stripped
from arbora.staging import drop_stage, stage

#: Separators besides white space.
MARKS = ",;|/"
#: Bits: one declared separator, one declared quote character, the nesting rule, one character of a value.
MARK_BITS, QUOTE_BITS, NEST_BITS, CHAR_BITS = 2.0, 2.0, 1.0, 5.0
#: Shapes with a code of their own. The code of any other is that of the rest together and the choice among the rest, so
#: the bound is on what is broadcast: counts cover all shapes.
MOST_SHAPES = 4096
#: Skeletons whose dialect a task remembers, and the longest it remembers.
SKELETONS, LONGEST = 1 << 14, 2048
_WORD = regex.compile(r"[A-Za-z0-9_.\-]+")


class Dialect(NamedTuple):
    marks: str  # declared separators; a blank stands for white space
    quotes: str
    opaque: bool  # within parentheses, quoted text hides parentheses

    @property
    def bits(self) -> float:
        return MARK_BITS * len(self.marks) + QUOTE_BITS * len(self.quotes) + NEST_BITS * self.opaque


class Codes(NamedTuple):
    """Code lengths in bits: of known shapes, of any other shape, and of separators and quotes as ordinary characters."""

    shapes: dict[str, float]
    escape: float
    special: dict[str, float]


#: Before anything is counted: bits of any value, and of a separator or quote that a value holds as an ordinary character.
PRIOR_VALUE, PRIOR_SPECIAL = 12.0, 24.0
SPECIALS = MARKS + " \"'"
PRIOR = Codes({}, PRIOR_VALUE, dict.fromkeys(SPECIALS, PRIOR_SPECIAL))


@lru_cache(maxsize=None)
def _nest(opaque: bool) -> str:
    hidden = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S])*{q}" for q in "\"'")
    inner = rf"(?:[^()\"']|{hidden}|(?&nest))*" if opaque else r"(?:[^()]|(?&nest))*"
    return rf"(?P<nest>\({inner}\))"


@lru_cache(maxsize=None)
def _nested(opaque: bool) -> regex.Pattern:
    return regex.compile(_nest(opaque))


@lru_cache(maxsize=512)
def _grammar(marks: str, quotes: str, opaque: bool) -> tuple[regex.Pattern, regex.Pattern]:
    quoted = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S]|{q}{q})*{q}" for q in quotes)
    chars = regex.escape(marks.replace(" ", WHITE))
    sep = rf"[{chars}]" if marks else "(?!)"
    plain = rf"(?:[^{chars}()]|{_nest(opaque)})+"
    value = rf"(?:(?P<quoted>{quoted})|(?P<plain>{plain}))" if quotes else rf"(?P<plain>{plain})"
    return regex.compile(rf"{value}(?={sep}|$)"), regex.compile(rf"{sep}+")


def _unquote(text: str) -> str:
    q, body = text[0], text[1:-1]
    return body.replace(q + q, q).replace("\\" + q, q)


def parse(body: str, dialect: Dialect) -> list[tuple[str, bool]] | None:
    """(value, quoted) of a field already without outer white space and brackets; None if something stays open."""
    value, gap = _grammar(*dialect)
    out, at = [], 0
    while at < len(body):
        if m := gap.match(body, at):
            at = m.end()
            continue
        if not (m := value.match(body, at)):
            return None
        quoted = bool(dialect.quotes) and m["quoted"] is not None
        if v := (_unquote(m[0]) if quoted else m[0]).strip(WHITE):
            out.append((v, quoted))
        at = m.end()
    return out


def literal(body: str) -> list[str]:
    """The reading of last resort, for fields that close nothing they open: split at every separator."""
    return [v for v in regex.split(rf"[{regex.escape(WHITE + MARKS)}]+", body) if v]


def shape(value: str) -> str:
    """What a value looks like: words alike, parentheses empty, its length as a power of two."""
    flat = _nested(True).sub("()", value) if "(" in value else value
    return _WORD.sub("w", flat)[:8] + "#" + str(len(flat).bit_length())


def bare(value: str, dialect: Dialect) -> str:
    """Separators and quotes a plain value holds outside parentheses, white space as blanks."""
    if value.isalnum():
        return ""
    outside = _nested(dialect.opaque).sub("", value) if "(" in value else value
    return "".join(" " if c in WHITE else c for c in outside if c in WHITE or c in SPECIALS)


def dialects(body: str) -> Iterator[tuple[Dialect, str]]:
    """Candidates for a field, from what occurs in it, with the field less its parentheses. Separators that only stand in
    parentheses split nothing."""
    there = [q for q in "\"'" if q in body]
    quotes = ["", *there] + (["\"'"] if len(there) == 2 else [])
    for opaque in (True, False) if there and "(" in body else (False,):
        outside = _nested(opaque).sub("", body) if "(" in body else body
        marks = [m for m in MARKS if m in outside] + [" "] * any(c in WHITE for c in outside)
        for n in range(len(marks), -1, -1):
            for some in combinations(marks, n):
                for q in quotes:
                    yield Dialect("".join(some), q, opaque), outside


def strip_brackets(field: str) -> str:
    body = field.strip(WHITE)
    return body[1:-1].strip(WHITE) if len(body) > 1 and body[0] == "[" and body[-1] == "]" else body


def description(values: list[tuple[str, bool]], dialect: Dialect, codes: Codes) -> float:
    """Bits of a field's values under a dialect."""
    bits = dialect.bits
    for v, quoted in values:
        bits += codes.shapes.get(shape(v), codes.escape) + CHAR_BITS * len(v)
        if not quoted:
            bits += sum(codes.special.get(c, 0.0) for c in bare(v, dialect))
    return bits


def cheapest(body: str, codes: Codes) -> Dialect | None:
    """The dialect of least description length; ties go to the first candidate, which declares most. None if no dialect
    closes what it opens."""
    best, least = None, math.inf
    fixed = len(body) - sum(map(body.count, WHITE))  # characters no dialect drops but as marks, quotes or escapes
    for d, outside in dialects(body):
        kept = fixed - sum(map(body.count, d.marks.replace(" ", ""))) - (sum(map(body.count, d.quotes + "\\")) if d.quotes else 0)
        bare_ = 0.0 if d.quotes else sum(outside.count(m) * codes.special.get(m, 0.0) for m in MARKS if m not in d.marks)
        if d.bits + CHAR_BITS * kept + bare_ >= least:  # its values' characters alone cost more
            continue
        if (values := parse(body, d)) is not None and (bits := description(values, d, codes)) < least:
            best, least = d, bits
    return best


def _closed(body: str) -> str | None:
    """The field with empty parentheses, if both nesting rules agree on them and no quoted value ends inside any."""
    safe = True

    def empty(m: regex.Match) -> str:
        nonlocal safe
        for q in "\"'":
            if q in m[0] and body.count(q, 0, m.start()) % 2 and q in m[0].replace(q + q, "").replace("\\" + q, ""):
                safe = False
        return "()"

    flat = _nested(True).sub(empty, body)
    return flat if safe and flat == _nested(False).sub("()", body) else None


def skeleton(body: str) -> str:
    """The field with words of one kind and, where no reading looks inside, empty parentheses. A word keeps its length as
    a power of two, as shapes do."""
    flat = (_closed(body) or body) if "(" in body else body
    return _WORD.sub(lambda m: "w" * (1 << (m.end() - m.start()).bit_length() - 1), flat)


def chooser(codes: Codes):
    """:func:`cheapest` that remembers skeletons."""
    known = lru_cache(maxsize=SKELETONS)(lambda body: cheapest(body, codes))
    return lambda body: known(s) if len(s := skeleton(body)) <= LONGEST else cheapest(s, codes)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes of the values of each field's parse that is cheapest by the prior codes, the separators and quotes these
    values hold (named by the character alone), and their characters (the empty name)."""
    choose, counts = chooser(PRIOR), {}
    for batch in batches:
        for field in batch.column(0).to_pylist():
            body = strip_brackets(field)
            if (d := choose(body)) is None:
                continue
            for v, quoted in parse(body, d):
                s = shape(v)
                counts[s] = counts.get(s, 0) + 1
                counts[""] = counts.get("", 0) + len(v)
                for c in "" if quoted else bare(v, d):
                    counts[c] = counts.get(c, 0) + 1
    yield pa.RecordBatch.from_pydict({"shape": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def learned(counts: DataFrame) -> Codes:
    """Code lengths from (shape, n), n adding up over rows of one name."""
    sums = stage(counts.groupBy("shape").agg(F.sum("n").alias("n")), "shapes")
    names = F.length("shape") > 1
    total, different = sums.where(names).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sums.where(names).orderBy(F.desc("n"), "shape").limit(MOST_SHAPES).collect()
    other = {r["shape"]: r["n"] for r in sums.where(~names).collect()}
    rest, kinds = total - sum(r["n"] for r in top), different - len(top)
    shapes = {r["shape"]: -math.log2(r["n"] / (total + 1)) for r in top}
    escape = -math.log2((rest + 1) / (total + 1)) + math.log2(kinds + 2)
    chars = other.get("", 0) + 2
    drop_stage(sums)
    return Codes(shapes, escape, {c: -math.log2((other.get(c, 0) + 1) / chars) for c in SPECIALS})


def split_packed(df: DataFrame, field: str, pos: str = "pos", val: str = "val") -> DataFrame:
    """``df`` with one row per value of ``field``: columns ``pos`` (INT, from 1) and ``val`` (STRING) are added.

    NULL, empty and blank fields, and fields of separators only, give no row. Repeated rows are each split. A field
    that closes no quote or parenthesis it opens is split at every separator. Other columns are kept, whatever their
    names; ``pos`` and ``val`` must be new. Two scans of the field: one for the shape counts, one for the values.
    """
    if clash := {pos, val} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    spark = df.sparkSession
    several = rf"[{_ESCAPED}\"'()]"

    fields = df.select(F.col(field).alias("f")).where(F.col("f").isNotNull())
    one = fields.select(body_of("f").alias("v")).where(~F.col("v").rlike(several) & (F.col("v") != ""))
    word = F.regexp_replace("v", r"[A-Za-z0-9_.\-]+", "w")
    bits = (F.floor(F.log2(F.length("v").cast("double"))) + 1).cast("string")
    single = one.groupBy(F.concat(F.substring(word, 1, 8), F.lit("#"), bits).alias("shape")).agg(F.count("*").alias("n"), F.sum(F.length("v")).alias("chars"))
    single = single.select(F.explode(F.array(F.struct("shape", "n"), F.struct(F.lit("").alias("shape"), F.col("chars").alias("n")))).alias("x")).select("x.*")
    many = fields.where(body_of("f").rlike(several)).mapInArrow(_counts, "shape string, n long")
    shared = spark.sparkContext.broadcast(learned(single.unionByName(many)))

    schema = T.StructType([*df.schema.fields, T.StructField("__vals", T.ArrayType(T.StringType()))])
    names = df.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose, at = chooser(shared.value), names.index(field)
        for batch in batches:
            values = []
            for text in batch.column(at).to_pylist():
                body = strip_brackets(text)
                values.append(literal(body) if (d := choose(body)) is None else [v for v, _ in parse(body, d)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.string()))], names=[*[f"c{i}" for i in range(len(names))], "v"])

    present = df.where(F.col(field).isNotNull())
    body = body_of(field)
    single_rows = present.where(~body.rlike(several) & (body != "")).withColumn("__vals", F.array(body))
    many_rows = present.where(body.rlike(several)).mapInArrow(read, schema)
    both = single_rows.union(many_rows)
    out = both.select("*", F.posexplode("__vals").alias("__p", val)).withColumn(pos, (F.col("__p") + 1).cast("int"))
    return out.select(*names, pos, val)


#: White space and separators inside a Java character class.
_ESCAPED = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE + MARKS)


def body_of(field: str):
    """The field without outer white space and one pair of brackets around all of it, as a column."""
    b = stripped(field)
    inner = stripped(b.substr(F.lit(2), F.length(b) - 2))
    return F.when(b.startswith("[") & b.endswith("]") & (F.length(b) > 1), inner).otherwise(b)

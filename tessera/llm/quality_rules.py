"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each text is measured once. A sketch of a measure is a histogram over buckets that keep the seven leading
bits of an integer (relative error at most 1/64); sketches are merged by adding counts, so partial
aggregation builds them and a coarser group's sketch is the sum of its groups' sketches. Every language and
source gets fences from its own sketch: a high quantile, and beyond it a multiple of its distance from the median.
Its quantiles are drawn towards those of its language, and these towards those of all documents, by n / (n + PRIOR),
so a small group's fences pass smoothly into its own as it grows. A join with the fences filters the documents.

Null text counts as empty and fails the base rules; null languages and sources are groups of their own;
repeated rows each count; an empty table gives an empty table. Input columns named like a result column are
dropped from ``judge`` (``keep`` returns the input's columns unchanged).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES, bounded, fresh, materialize, texts, with_arrow

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
RESULT = ("base_failed", "kept")


@dataclass(frozen=True)
class Fence:
    """A measure as ``1000 * part div whole``; a document goes whose value is above the fence.

    The fence is q + times * (q - median), where q is the quantile of rank ``level`` of 100; it is at least TINY above
    q, as the value of one line, word or character in a short text moves that much by itself. With ``both`` there is a
    fence below, from the quantile of rank 100 - level.
    """

    name: str
    part: str
    whole: str
    level: int
    times: int
    both: bool = False


#: Levels are such that what is no document of the group's kind stays above them: symbols and long words come with
#: texts that are no prose, of which a group may have a tenth; repeats, capitals and equal lines are part of prose.
FENCES = (
    Fence("word_length", "word_chars", "n_words", 90, 3, both=True),
    Fence("symbols", "n_symbols", "n_words", 75, 2),
    Fence("dup_lines", "n_dup_lines", "n_lines", 99, 2),
    Fence("repeats", "n_repeat_words", "n_words", 99, 2),
    Fence("capitals", "n_upper", "word_chars", 99, 2),
)
#: Thousandths by which a fence is beyond its quantile at least.
TINY = 20
#: Documents for which a parent's quantiles stand in a group.
PRIOR = 200


def measure_one(b: bytes | None) -> tuple[int, ...]:
    b = b or b""
    words = b.split()
    n = len(words)
    chars = len(b.decode("utf-8", "replace")) - (len(b) - len(b.translate(None, SPACES)))
    lines = [x for x in b.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        v = len(seen)
        pair = ids[:-1] * v + ids[1:]
        if v * v * v >= 2**62:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        _, which, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[which] > 1)
        if len(at):
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[at + k] = True
            repeated = int(cover.sum())
    return n, chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(b) - len(b.translate(None, UPPER))


def measure(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``column`` of MEASURES."""
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    arrow = pa.struct([(m, pa.int64()) for m in MEASURES])

    def of(batch: pa.RecordBatch) -> pa.Array:
        rows = [measure_one(b) for b in texts(batch, text)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(MEASURES))], names=list(MEASURES))

    return with_arrow(docs, column, kind, of, arrow, text)


def base_failed(m: F.Column) -> F.Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _value(m: F.Column, f: Fence) -> F.Column:
    return F.floor(1000 * m[f.part] / F.greatest(m[f.whole], F.lit(1)))


def _bucket(v: F.Column) -> F.Column:
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame, column: str, lang: str = "lang", source: str = "source", fences=FENCES) -> DataFrame:
    """One row per language, source, measure and bucket: lang, source, measure, bucket, n."""
    m = F.col(column)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("measure"), _bucket(_value(m, f)).alias("bucket")) for f in fences])
    return (
        measured.filter(~base_failed(m))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
        .groupBy("lang", "source", "p.measure", "p.bucket")
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, fences=FENCES, prior: int = PRIOR) -> DataFrame:
    """One row per language and source of the sketch: lang, source and <measure>_high, and <measure>_low for some."""
    ranks = {f.name: (100 - f.level, 50, f.level) for f in fences}
    rank = lambda k: F.coalesce(*[F.when(F.col("measure") == m, F.lit(r[k])) for m, r in ranks.items()])

    def quantiles(keys: list[str], tag: str) -> DataFrame:
        by = [*keys, "measure"]
        over = lambda more: F.expr(f"sum(n) over (partition by {', '.join(by)} {more})")
        run = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n")).select(*by, "bucket", over("order by bucket").alias("cum"), over("").alias("total"))
        q = [F.min(F.when(100 * F.col("cum") >= rank(k) * F.col("total"), F.col("bucket"))).cast("double").alias(f"{tag}{k}") for k in range(3)]
        return run.groupBy(*by).agg(F.max("total").alias(f"{tag}n"), *q)

    own, lang, whole = quantiles(["lang", "source"], "s"), quantiles(["lang"], "l"), quantiles([], "a")
    lang = lang.withColumnRenamed("lang", "l_lang").withColumnRenamed("measure", "l_measure")
    whole = whole.withColumnRenamed("measure", "a_measure")
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(whole, F.col("measure") == F.col("a_measure"))
    drawn = lambda n, q, parent: (F.col(n) * q + prior * parent) / (F.col(n) + prior)
    q = [drawn("sn", F.col(f"s{k}"), drawn("ln", F.col(f"l{k}"), F.col(f"a{k}"))) for k in range(3)]
    rows = rows.select("lang", "source", "measure", *[x.alias(f"q{k}") for k, x in enumerate(q)])
    out = []
    for f in fences:
        reach = lambda k, f=f: F.greatest(F.lit(float(TINY)), f.times * F.abs(F.col(k) - F.col("q1")))
        mine = F.col("measure") == f.name
        out += [F.max(F.when(mine, F.col("q2") + reach("q2"))).alias(f"{f.name}_high")]
        if f.both:
            out += [F.max(F.when(mine, F.col("q0") - reach("q0"))).alias(f"{f.name}_low")]
    return rows.groupBy("lang", "source").agg(*out)


def _verdicts(measured: DataFrame, column: str, lang: str, source: str, fences, prior: int) -> tuple[DataFrame, F.Column]:
    limits = materialize(thresholds(sketches(measured, column, lang, source, fences), fences, prior))
    names = {c: fresh(measured, c) for c in limits.columns}
    limits = limits.select(*[F.col(c).alias(n) for c, n in names.items()])
    m, inside = F.col(column), F.lit(True)
    for f in fences:
        inside = inside & (_value(m, f) <= F.col(names[f"{f.name}_high"]))
        if f.both:
            inside = inside & (_value(m, f) >= F.col(names[f"{f.name}_low"]))
    joined = measured.join(bounded(limits), F.col(lang).eqNullSafe(F.col(names["lang"])) & F.col(source).eqNullSafe(F.col(names["source"])), "left")
    return joined, ~base_failed(m) & F.coalesce(inside, F.lit(True))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fences=FENCES, prior: int = PRIOR) -> DataFrame:
    """The input's columns but ``text``, the measures, base_failed and kept."""
    keep = [c for c in docs.columns if c not in {*MEASURES, *RESULT, text} or c in {lang, source}]
    column = fresh(docs, "measures")
    measured = materialize(measure(docs.select(*keep, text), column, text).drop(text))
    joined, kept = _verdicts(measured, column, lang, source, fences, prior)
    return joined.select(*keep, *[F.col(column)[m].alias(m) for m in MEASURES], base_failed(F.col(column)).alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", fences=FENCES, prior: int = PRIOR) -> DataFrame:
    """The documents that pass, with their columns unchanged. Texts are measured twice rather than shuffled or stored."""
    column = fresh(docs, "measures")
    measured = measure(docs, column, text)
    joined, kept = _verdicts(measured, column, lang, source, fences, prior)
    return joined.filter(kept).select(*docs.columns)

"""Column functions on text: tokens, headings, entities, clips and names.

All are built-in expressions but ``entities``, ``term_counts`` and the forms for one text that chunks are made by, which
run in Arrow batches: as nested higher-order functions, which Spark interprets, and as Java's patterns over whole lines
they took most of the time of making chunks and their index.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tessera import schema as S

#: White space as the results define it (a Java character class without brackets).
WS = r"\t\n\x0B\f\r    -     　﻿"
#: Characters that are tokens by themselves, alone and in pairs.
# Code point ranges.
CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿０-９Ａ-Ｚａ-ｚ"
IDEOGRAPHS = r"一-鿿"

# Words that are no entities.
STOPWORDS = (
    "the a an and or but of to in on for with is are was were be been being this that these those it its as at by from "
    "we you they he she his her their our your i not no yes if then than so can will would should may might "
    "的 了 和 与 及 或 是 在 我们 他们 它们 这个 那个 一种 可以 通过 使用 对于 以及 由于 因此 一个 没有 这样"
).split()

# Patterns of headings, phrases and quoted terms.
ATX = r"^(#{1,6})[" + WS + r"]+(.+?)[" + WS + r"]*#*[" + WS + r"]*$"
NUMBERED = r"^(\d+(?:\.\d+){0,4})[.、)．]?[" + WS + r"]+([^" + WS + r"].{0,70})$"
CHAPTER = r"^第[" + WS + r"]*[一二三四五六七八九十百零〇0-9]{1,4}[" + WS + r"]*[章节篇][" + WS + r"]*(.{0,60})$"
PHRASE = f"[A-Z][a-zA-Z]+(?:[{WS}]+[A-Z][a-zA-Z]+)*"
QUOTED = '["“”][^"“”]{2,40}["“”]'
UNTITLED = "片段"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^[{WS}]+|[{WS}]+$", "")


def trim_end(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"[{WS}]+$", "")


def squeeze(x: Column | str) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(_c(x), f"[{WS}]+", " ")


def flat(x: Column | str) -> Column:
    return trim(squeeze(F.coalesce(_c(x), F.lit(""))))


def cut(x: Column, n: int | Column) -> Column:
    return F.substring(x, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def tokenize(x: Column | str) -> Column:
    """Lower-case Latin words, and each character of a CJK run followed by its pair with the next one.

    Null text has no tokens.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(f"[{CJK}]+|[a-z0-9][a-z0-9._+-]*"), F.lit(0))

    def of(run: Column) -> Column:
        n = F.length(run)
        pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.array(F.substring(run, i, F.lit(1)), F.substring(run, i, F.lit(2)))).otherwise(F.array(F.substring(run, i, F.lit(1)))))
        return F.when(run.rlike(f"^[{CJK}]"), F.flatten(pairs)).otherwise(F.array(F.regexp_replace(run, r"[._+-]+$", "")))

    return F.flatten(F.transform(runs, of))


def chunk_tokens(title: Column | str, summary: Column | str, text: Column | str, entities: Column | str) -> Column:
    """The tokens of a chunk, weighted by repetition: title, summary, the text's first, the first entities'."""
    named = F.flatten(F.transform(F.slice(F.coalesce(_c(entities), F.array().cast("array<string>")), 1, S.ENTITY_TOKENS), tokenize))
    return F.concat(
        F.flatten(F.array_repeat(tokenize(title), S.TITLE_REPEAT)),
        F.flatten(F.array_repeat(tokenize(summary), S.SUMMARY_REPEAT)),
        F.slice(tokenize(text), 1, S.TEXT_TOKENS),
        named,
    )


# What a heading loses, a first sentence, what a file name loses, and a page number.
LEADER, HASHES = f"[{WS}.·・…]{{3,}}[{WS}]*\\d{{1,4}}$", f"^#{{1,6}}[{WS}]*"
SENTENCE = "^[^。．.!！?？;；]{8,}[。．.!！?？]"
SENTENCE_LENGTH = 90
EXTENSION, FORBIDDEN = r"\.[A-Za-z0-9]{1,8}$", r'[\\/:*?"<>|\x00-\x1f]'
PAGE_NUMBER = f"^[-–—{WS}.]*\\d{{1,4}}[-–—{WS}.]*$"


def clean_heading(x: Column | str) -> Column:
    """A heading without dotted leaders, page numbers and hashes, clipped."""
    t = squeeze(F.coalesce(_c(x), F.lit("")))
    t = F.regexp_replace(t, LEADER, "")
    t = trim(F.regexp_replace(t, HASHES, ""))
    return bound(t, lambda t: F.when(F.length(t) > S.TITLE_LENGTH, F.concat(trim_end(cut(t, S.TITLE_LENGTH - 1)), F.lit("…"))).otherwise(t))


def is_heading_line(x: Column | str) -> Column:
    """A line that is marked up, numbered or counted as a heading."""

    def marked(t: Column) -> Column:
        title = trim(F.regexp_extract(t, NUMBERED, 2))
        numbered = t.rlike(NUMBERED) & (F.length(title) >= 2) & (F.length(title) <= 60) & ~title.rlike("[，。；：,;]$")
        return (t != "") & (F.length(t) <= 100) & (t.rlike(ATX) | t.rlike(CHAPTER) | numbered)

    return bound(trim(F.coalesce(_c(x), F.lit(""))), marked)


def is_heading_title(x: Column | str) -> Column:
    """A title short enough to head a section, and not a sentence."""
    t = trim(F.coalesce(_c(x), F.lit("")))
    return (t != "") & (F.length(t) <= 40) & ~t.rlike("[。．.；;，,：:！!？?、…]$")


def first_line(x: Column | str) -> Column:
    return F.substring_index(_c(x), "\n", 1)


def title_from(x: Column | str) -> Column:
    t = clean_heading(first_line(F.coalesce(_c(x), F.lit(""))))
    return bound(t, lambda t: F.when(t == "", F.lit(UNTITLED)).when(F.length(t) <= 60, t).otherwise(F.concat(cut(t, 57), F.lit("…"))))


def clip(x: Column | str, n: int) -> Column:
    t = flat(x)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(trim_end(cut(t, n - 1)), F.lit("…")))


def first_sentence(x: Column | str, n: int = SENTENCE_LENGTH) -> Column:
    t = flat(x)
    s = F.regexp_extract(t, SENTENCE, 0)
    return clip(F.when(s != "", s).otherwise(t), n)


def escape(x: Column | str) -> Column:
    t = F.coalesce(_c(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def body_of(title: Column | str, text: Column | str) -> Column:
    """The text without its first line, if that is the title."""
    x, t = F.coalesce(_c(text), F.lit("")), trim(F.coalesce(_c(title), F.lit("")))
    bare = trim(F.regexp_replace(trim(first_line(x)), f"^#{{1,6}}[{WS}]*", ""))
    rest = F.when(F.instr(x, "\n") > 0, F.substring(x, F.instr(x, "\n") + 1, F.length(x))).otherwise(F.lit(""))
    return F.when((t != "") & (bare == t), trim(rest)).otherwise(trim(x))


def sanitize_base(x: Column | str) -> Column:
    """A file name without extension and forbidden characters."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), EXTENSION, "")
    t = flat(F.regexp_replace(t, FORBIDDEN, "_"))
    t = trim(F.regexp_replace(F.regexp_replace(t, r"^\.+", ""), r"\.+$", ""))
    return F.when(F.length(t) > 60, trim(cut(t, 60))).otherwise(t)


def title_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), f"[^0-9a-z{IDEOGRAPHS}]+", "")


def repeats_name(title: Column | str, name: Column | str) -> Column:
    a, b = title_key(title), title_key(sanitize_base(name))
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))


def format_bytes(n: Column | str) -> Column:
    n = _c(n)
    return (
        F.when(n < 0, n.cast("string"))
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024 / 1024), F.lit(" MB")))
    )


def is_numbered(x: Column | str) -> Column:
    return _c(x).rlike(f"^[{WS}]*(?:\\d+(?:\\.\\d+)*|第[{WS}]*[一二三四五六七八九十百零〇0-9]{{1,4}}[{WS}]*[章节篇])")


def section_label(title: Column | str, number: Column | str) -> Column:
    return F.when(is_numbered(title), _c(title)).otherwise(F.concat(_c(number), F.lit(". "), _c(title)))


def is_page_number(x: Column | str) -> Column:
    return _c(x).rlike(PAGE_NUMBER)


def normalize_tags(x: Column | str) -> Column:
    """Trimmed, single-spaced, lower-case, clipped, distinct tags in order, at most 20; null gives none."""
    tags = F.transform(F.coalesce(_c(x), F.array().cast("array<string>")), lambda t: cut(F.lower(flat(t)), S.TAG_LENGTH))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, S.TAGS_PER_DOC)


def folder_name(x: Column | str) -> Column:
    """A folder's name without forbidden characters; null if nothing is left or it is too long."""
    t = F.regexp_replace(flat(x), r'[\\/:*?"<>|]', "")
    return F.when((t != "") & (F.length(t) <= S.FOLDER_NAME), t)


def printable(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"[^\\x20-\\x7E{IDEOGRAPHS}{WS}]", " ")


def strip_html(x: Column | str) -> Column:
    """Text without scripts, styles and tags; four entities are decoded one after the other."""
    t = F.regexp_replace(_c(x), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return trim(squeeze(t))


def snippet(x: Column | str, terms: Column | None = None) -> Column:
    """At most 700 characters around the earliest term of two letters or more, else from the start."""
    t = F.coalesce(_c(x), F.lit(""))
    at = F.lit(0)
    if terms is not None:
        found = F.filter(F.transform(F.filter(terms, lambda w: F.length(w) >= 2), lambda w: F.instr(F.lower(t), w)), lambda i: i > 0)
        at = F.coalesce(F.array_min(found) - 1, F.lit(0))
    start = F.greatest(F.lit(0), at - S.SNIPPET // 3)
    end = F.least(F.length(t), start + S.SNIPPET)
    body = trim(F.substring(t, (start + 1).cast("int"), (end - start).cast("int")))
    whole = F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(end < F.length(t), F.lit("…")).otherwise(F.lit("")))
    return F.when(F.length(t) <= S.SNIPPET, t).otherwise(whole)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of x, with x computed once a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


_PHRASE, _QUOTED, _RUN = re.compile(PHRASE), re.compile(QUOTED), re.compile(f"[{IDEOGRAPHS}]{{2,6}}")
_STOP, _QUOTES, _DIGITS = frozenset(STOPWORDS), re.compile('["“”]'), re.compile("[0-9]+")
_SPACE = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{WS}]", c))


def stripped(text: str) -> str:
    """``trim`` of one text."""
    return text.strip(_SPACE)


def entities_in(text: str, most: int = S.CHUNK_ENTITIES) -> list[str]:
    """Title-case phrases of up to three words, quoted terms, and recurring CJK pieces, most frequent first.

    Ties keep the order in which the terms were found.
    """
    found = [p for p in _PHRASE.findall(text) if p.count(" ") < 3] + [_QUOTES.sub("", q) for q in _QUOTED.findall(text)]
    plain = Counter(w for w in map(stripped, found) if len(w) >= 2 and w.lower() not in _STOP and not _DIGITS.fullmatch(w))
    parts = Counter(r[i : i + n] for r in _RUN.findall(text) for n in range(2, min(4, len(r)) + 1) for i in range(len(r) - n + 1))
    for w, n in parts.items():
        if n > 1:
            plain[w] += n
    return [w for w, _ in sorted(plain.items(), key=lambda x: -x[1])[:most]]


@arrow_udf(T.ArrayType(T.StringType()))
def _entities_of(texts: pa.Array) -> pa.Array:
    return pa.array([entities_in(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))


def entities(x: Column | str) -> Column:
    """``entities_in`` the texts of a column; null text has none."""
    return _entities_of(_c(x))


_SPACES, _LEADER, _HASHES = re.compile(f"[{WS}]{{2,}}|(?! )[{WS}]"), re.compile(LEADER, re.ASCII), re.compile(HASHES)
# in Java's patterns a point is none of these line ends
_ATX, _CHAPTER, _NUMBERED = (re.compile(re.sub(r"\.(?=\{0,|\+\?)", r"[^\\n\\r\\x85\\u2028\\u2029]", p), re.ASCII) for p in (ATX, CHAPTER, NUMBERED))
_OPEN_END = re.compile("[，。；：,;]$")


def title_of(text: str) -> str:
    """``title_from`` one text."""
    t = _SPACES.sub(" ", text.split("\n", 1)[0])
    t = stripped(_HASHES.sub("", _LEADER.sub("", t) if t[-1:].isdigit() else t))
    if len(t) > S.TITLE_LENGTH:
        t = t[: S.TITLE_LENGTH - 1].rstrip(_SPACE) + "…"
    return UNTITLED if not t else t if len(t) <= 60 else t[:57] + "…"


def heads(text: str) -> bool:
    """Whether the first line of a text ``is_heading_line``."""
    t = stripped(text.split("\n", 1)[0])
    if not t or len(t) > 100:
        return False
    m = _NUMBERED.search(t)
    title = stripped(m[2]) if m else ""
    return bool(_ATX.search(t) or _CHAPTER.search(t)) or 2 <= len(title) <= 60 and not _OPEN_END.search(title)


_TOKEN, _FIRST_CJK = re.compile(f"[{CJK}]+|[a-z0-9][a-z0-9._+-]*"), re.compile(f"[{CJK}]")


def _tokens(text: str | None) -> list[str]:
    """``tokenize`` of one text."""
    if not text:
        return []
    text = text.lower()
    runs = [r.rstrip("._+-") for r in _TOKEN.findall(text)]
    if text.isascii() or not _FIRST_CJK.search(text):
        return runs
    out = []
    for r in runs:
        out += [w for i in range(len(r)) for w in (r[i], r[i : i + 2])][: 2 * len(r) - 1] if _FIRST_CJK.match(r) else [r]
    return out


_COUNTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


@arrow_udf(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("terms", _COUNTED)]))
def term_counts(title: pa.Array, summary: pa.Array, text: pa.Array, entities: pa.Array) -> pa.Array:
    """The number of a chunk's ``chunk_tokens`` and how often each of them occurs."""
    lengths, starts, terms, counts = [], [0], [], []
    for a, b, c, d in zip(title.to_pylist(), summary.to_pylist(), text.to_pylist(), entities.to_pylist(), strict=True):
        every = _tokens(a) * S.TITLE_REPEAT + _tokens(b) * S.SUMMARY_REPEAT + _tokens(c)[: S.TEXT_TOKENS]
        for e in (d or [])[: S.ENTITY_TOKENS]:
            every += _tokens(e)
        n = Counter(every)
        lengths.append(len(every))
        terms.extend(n)
        counts.extend(n.values())
        starts.append(len(terms))
    made = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), made)], ["length", "terms"])

"""Line dedup by an exact set-similarity join of lines, with DataFrame operations only.

A line's tokens are its distinct words. Lines with one and the same token set are a class, whose first line
(by id, then part, then line number) stands for it. Tokens are ordered by rarity: by the frequency of their hash slot,
counted over all lines, then by hash; any fixed order keeps the join exact. Two classes can only be similar
enough if their prefixes share a token, their sizes are close, and the shared token's positions leave room
for the overlap they need; bitmaps of the sets then bound how much they differ, with more bits for larger sets.
Candidates are verified on their words.

Groups of one key are kept from pairing out. In a group of more than STAR classes the first one is compared with all
others, and those that this removes are left out as the later line of any further pair, so a group of near copies
costs a row each. Where more than PAIRED classes of a group are left, which share a common token but are not alike,
the key is extended by the next token that both may share, until groups are small; a row then meets PAIRED others at
most, so pairs stay in proportion to the input.

A line goes if an earlier line, removed or not, has a Jaccard similarity of at least PERCENT / 100 to it.
Lines of fewer than ``least`` words are neither removed nor compared. Null text has no lines. A document is
told by its id and by its part, a hash of its text, so documents that share an id, or have none, are cut each by
its own lines; null ids come last. Of rows that agree in id and text one counts as the first, and the lines of
the others repeat it. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, fresh, materialize, prepare, stored

PERCENT = 75
LEAST_WORDS = 1
SLOT_BITS = 18
SPACES = r"[\x20\x09-\x0D]+"
#: Classes of a group from which its first one is compared with all others before these are paired.
STAR = 16
#: Classes of a group that are paired with the others; a key with more is extended.
PAIRED = 2048
#: Tokens of a key at most. At 75 % similar sets of three tokens or more share three.
KEY_TOKENS = 3
#: A set's bitmap: 64 bits, twice as many from 64 tokens on, four times from 128 on; a longer one folds into a shorter.
BITS, WIDER, WIDEST = ("bits0", "bits1", "bits2", "bits3"), 64, 128
#: Bytes of a row of lines by document, besides four a line; hot keys that may be broadcast, of eight bytes each.
ROW_BYTES, BROADCAST_KEYS = 40, 500_000
_LAST = (1 << 63) - 1
#: What tells a line and, without the last, its document; lines come in this order.
PLACE = ("doc", "part", "line_no")


def _once(x: Column) -> Column:
    """x as a column of one value a row that is computed once, however often it is used."""
    return F.explode(F.array(x))


def _split(line: Column) -> Column:
    """The line's words, with empty strings between and around them."""
    return F.when(line.rlike(r"[\t\x0B\f\r]"), F.split(line, SPACES, -1)).otherwise(F.split(line, " ", -1))


def _doc(id_: str) -> Column:
    return F.coalesce(F.col(id_).cast("long"), F.lit(_LAST))


def _lines(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """doc, part, line_no (from 0), line."""
    return docs.select(_doc(id_).alias("doc"), F.xxhash64(text).alias("part"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")


def _levels(lines: DataFrame) -> list[int]:
    """The rarity of each hash slot: four levels for each doubling of the number of words in it."""
    words = lines.select(F.explode(_split(F.col("line"))).alias("w")).filter("w != ''")
    level = F.floor(4 * F.log2(F.count("*") + 1)).cast("int")
    found = words.groupBy(_slot(F.xxhash64("w")).alias("slot")).agg(level.alias("level")).toPandas()
    levels = np.zeros(1 << SLOT_BITS, np.int64)
    levels[found["slot"].to_numpy(np.int64)] = found["level"]
    return levels.tolist()


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def _missing(n: Column, percent: int) -> Column:
    """Tokens of a set that a similar one may lack."""
    return n - F.ceil(percent * n / F.lit(100)).cast("int")


def _sets(docs: DataFrame, id_: str, text: str, percent: int, least: int) -> DataFrame:
    """Lines of at least ``least`` words: cls and cls2 (hashes of the token set), PLACE, n (tokens), BITS (a bitmap
    of the set) and prefix, the rarest tokens as ints in the order of rarity."""
    lines = _lines(docs, id_, text)
    table = F.split(F.lit(",".join(map(str, _levels(lines)))), ",").cast("array<int>")
    empty = F.xxhash64(F.lit(""))
    token = lambda h: F.shiftleft(F.get(table, _slot(h)).cast("long"), 54).bitwiseOR(h.bitwiseAND(F.lit((1 << 54) - 1)))
    words = lines.select(*PLACE, _once(F.transform(_split(F.col("line")), lambda w: F.xxhash64(w))).alias("h"))
    words = words.select(*PLACE, _once(F.array_remove("h", empty)).alias("h")).filter(F.size("h") >= least)
    ids = words.select(*PLACE, _once(F.sort_array(F.transform(F.array_distinct("h"), token))).alias("ids"))
    n = F.size("ids")
    prefix = F.slice("ids", F.lit(1), _missing(n, percent) + KEY_TOKENS)
    return ids.select(F.xxhash64("ids").alias("cls"), F.xxhash64(F.lit(1), "ids").alias("cls2"), *PLACE, n.alias("n"), *_bitmap(F.col("ids")), F.transform(prefix, lambda x: F.pmod(x, F.lit(2147483647)).cast("int")).alias("prefix"))


def _bitmap(ids: Column) -> list[Column]:
    """The words of a set's bitmap; those that it does not need are 0."""
    n = F.size(ids)
    words = F.when(n < WIDER, 1).when(n < WIDEST, 2).otherwise(4)
    own = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    part = lambda k: own(F.filter(ids, lambda x: F.shiftright(x, 6).bitwiseAND((words - 1).cast("long")) == k))
    return [F.when(words == 1, own(ids) if k == 0 else F.lit(0).cast("long")).when(words > k, part(k)).otherwise(F.lit(0).cast("long")).alias(c) for k, c in enumerate(BITS)]


def _differing(n_a: Column, n_b: Column) -> Column:
    """The bits in which two bitmaps differ, at the length of the shorter: no more than the tokens in which the sets do."""
    a, b = ([F.col(f"{c}_{k}") for c in BITS] for k in "ab")
    fold = lambda w, to: [reduce(Column.bitwiseOR, w[k::to]) for k in range(to)]
    count = lambda to: reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(fold(a, to), fold(b, to), strict=True)])
    least = F.least(n_a, n_b)
    return F.when(least >= WIDEST, count(4)).when(least >= WIDER, count(2)).otherwise(count(1))


CLASS = ("cls", "cls2")


def similar_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Every line of at least ``least`` words as CLASS and PLACE; and CLASS, PLACE, later of each class.

    The place of a class is that of its first line; later tells that an earlier class is similar.
    """
    prepare(docs.sparkSession)
    own = stored(_sets(docs, id_, text, percent, least))
    classes = own.groupBy(*CLASS).agg(F.min(F.struct(*PLACE, "n", *BITS, "prefix")).alias("x")).select(*CLASS, "x.*")
    # Classes are numbered in the order of their first lines.
    classes = stored(classes.orderBy(*PLACE).withColumn("node", F.monotonically_increasing_id()))
    gone = _later(classes, docs, id_, text, percent)
    found = classes.select(*CLASS, *PLACE, "node").join(gone.withColumn("later", F.lit(True)), "node", "left").withColumn("later", F.coalesce("later", F.lit(False)))
    return own.select(*CLASS, *PLACE), found.drop("node")


def _later(classes: DataFrame, docs: DataFrame, id_: str, text: str, percent: int) -> DataFrame:
    """node of each class that an earlier one is similar to."""
    # A set this small is similar to no other set, so its class settles it.
    joined = classes.filter(100 * F.col("n") >= percent * (F.col("n") + 1))
    rows = _rows(joined, percent)
    verified = lambda found: _verified(found, classes, docs, id_, text, percent)
    large = _large(rows, STAR)
    gone = verified(_stars(rows, large, joined, percent, 1))
    found = [gone]
    for tokens in range(1, KEY_TOKENS + 1):
        wider = large.filter(F.col("many") > PAIRED).select("key")
        wider = wider if wider.limit(1).count() else None
        wide = None if tokens == KEY_TOKENS or wider is None else _wide(rows, gone, wider)
        # Whether a node is gone is joined to classes, not to their rows, which are many times as many.
        done = bounded(gone.withColumn("done", F.lit(True)), BROADCAST_KEYS)
        flagged = lambda x, done=done: x.join(done, "node", "left").withColumn("open", F.col("done").isNull()).drop("done")
        open_rows = _rows(flagged(joined), percent) if tokens == 1 else flagged(rows)
        found.append(verified(_paired(open_rows, wider, wide, percent, tokens)))
        if wide is None:
            break
        held = rows.join(bounded(wide, BROADCAST_KEYS), "key", "left_semi")
        rows = stored(_extended(held, joined, percent, tokens))
        large = _large(rows, STAR)
        gone = materialize(reduce(DataFrame.unionByName, [*found, verified(_stars(rows, large, joined, percent, tokens + 1))]).distinct())
        found = [gone]
    return reduce(DataFrame.unionByName, found).distinct()


def _rows(classes: DataFrame, percent: int) -> DataFrame:
    """A row for each token of a class's prefix: key, node, at (the set's size and the token's place), BITS, and open if
    the classes have it."""
    size, more = F.shiftleft(F.col("n").cast("long"), 32), [c for c in classes.columns if c == "open"]
    rows = classes.select("node", *BITS, *more, size.alias("size"), F.posexplode(F.slice("prefix", F.lit(1), _missing(F.col("n"), percent) + 1)).alias("p", "token"))
    return rows.select(F.col("token").cast("long").alias("key"), "node", (F.col("size") + F.col("p")).alias("at"), *BITS, *more)


def _large(rows: DataFrame, most: int) -> DataFrame:
    """key, many, first (the least node) of the keys of more than ``most`` rows."""
    return materialize(rows.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("first")).filter(F.col("many") > most))


def _wide(rows: DataFrame, gone: DataFrame, wider: DataFrame) -> DataFrame | None:
    """Of the keys of many rows those of which more than PAIRED are left; None if there are none."""
    rest = rows.join(bounded(wider, BROADCAST_KEYS), "key", "left_semi").join(bounded(gone, BROADCAST_KEYS), "node", "left_anti")
    found = _large(rest, PAIRED).select("key")
    return found if found.limit(1).count() else None


def _extended(rows: DataFrame, classes: DataFrame, percent: int, tokens: int) -> DataFrame:
    """Rows of keys of so many tokens -> rows of keys with one more, each of the tokens that may be the next shared one."""
    p, n = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.col("n")
    room = _missing(n, percent) + tokens - p
    more = rows.join(classes.select("node", "n", "prefix"), "node").select("key", "node", *BITS, "at", F.posexplode(F.slice("prefix", p + 2, F.greatest(room, F.lit(0)))).alias("k", "token"))
    return more.select(F.xxhash64("key", "token").alias("key"), "node", (F.col("at") + 1 + F.col("k")).alias("at"), *BITS)


def _candidates(a: DataFrame, b: DataFrame, percent: int, tokens: int, more: Column | None = None) -> DataFrame:
    """a, b: key, node, at, BITS. Pairs of an earlier and a later node of one key that pass the length, positional and
    bitmap filters, and in how many bits they differ; the key's tokens are the first that both share, or later ones."""
    a, b = (x.select("key", *[F.col(c).alias(f"{c}_{k}") for c in x.columns if c != "key"]) for k, x in (("a", a), ("b", b)))
    n = {k: F.shiftright(F.col(f"at_{k}"), 32) for k in "ab"}
    left = {k: n[k] - F.col(f"at_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in "ab"}
    need = _least_overlap(n["a"], n["b"], percent)
    close = (100 * n["a"] >= percent * n["b"]) & (100 * n["b"] >= percent * n["a"])
    room = F.least(left["a"], left["b"]) + F.lit(tokens - 1) >= need
    differ = _differing(n["a"], n["b"])
    alike = differ <= n["a"] + n["b"] - 2 * need
    fits = (F.col("node_a") < F.col("node_b")) & close & room & alike
    return a.join(b, "key").filter(fits if more is None else more & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), differ.alias("differ"))


def _stars(rows: DataFrame, large: DataFrame, classes: DataFrame, percent: int, tokens: int) -> DataFrame:
    """a, b, differ: of each group of a large key, the first class with each other one that passes the filters.

    The first's size and bitmap come with its key, so the rows are compared where they are; its token's place is not known.
    """
    of_first = classes.join(large.select(F.col("first").alias("node")).distinct(), "node", "left_semi")
    firsts = large.select("key", "first").join(of_first.select(F.col("node").alias("first"), F.col("n").cast("long").alias("n_a"), *[F.col(c).alias(f"{c}_a") for c in BITS]), "first")
    size = F.shiftright("at", 32)
    held = rows.select("key", "node", size.alias("n_b"), (size - F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("left_b"), *[F.col(c).alias(f"{c}_b") for c in BITS])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = _least_overlap(n_a, n_b, percent)
    close = (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a) & (F.col("left_b") + F.lit(tokens - 1) >= need)
    differ = _differing(n_a, n_b)
    fits = (F.col("first") < F.col("node")) & close & (differ <= n_a + n_b - 2 * need)
    return held.join(bounded(materialize(firsts), BROADCAST_KEYS), "key").filter(fits).select(F.col("first").alias("a"), F.col("node").alias("b"), differ.alias("differ")).distinct()


def _paired(rows: DataFrame, wider: DataFrame | None, wide: DataFrame | None, percent: int, tokens: int) -> DataFrame:
    """rows: with open. The candidates of all pairs in groups of keys that are not wide, the later node an open one.

    Groups of PAIRED rows at most are dealt out once for both sides. In larger ones, of which few rows are left, the
    two sides are dealt out by themselves, so that Spark can split the earlier rows of one key.
    """
    small = (rows if wider is None else rows.join(bounded(wider, BROADCAST_KEYS), "key", "left_anti")).repartition("key")
    # Neither side's alone and with the same columns of both, so that both read what was dealt out once.
    either = F.col("open_b") | (F.col("open_a") & (F.col("node_a") > F.col("node_b")))
    pairs = _candidates(small, small, percent, tokens, either)
    if wider is not None:
        held = rows.join(bounded(wider, BROADCAST_KEYS), "key", "left_semi")
        held = held if wide is None else held.join(bounded(wide, BROADCAST_KEYS), "key", "left_anti")
        pairs = pairs.unionByName(_candidates(held.drop("open"), held.filter("open").drop("open"), percent, tokens))
    return pairs.distinct()


def _verified(found: DataFrame, classes: DataFrame, docs: DataFrame, id_: str, text: str, percent: int) -> DataFrame:
    """found: a, b, differ. The later nodes of similar pairs, as node.

    One similar class is enough, so a node is compared with the likeliest first, whose bitmap differs least, and with
    its others only if that one is not similar: of many near copies each costs a row, not one for each other copy.
    """
    found = materialize(found)
    nodes = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    words = materialize(_words(docs, id_, text, classes.select("node", *PLACE).join(nodes, "node", "left_semi")))
    a, b = (words.select(*[F.col(c).alias(n) for c, n in (("node", k), ("words", f"words_{k}"))]) for k in "ab")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    alike = 100 * shared >= percent * (F.size("words_a") + F.size("words_b") - shared)
    likeliest = found.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("b", F.col("x.a").alias("a"))
    first = materialize(likeliest.join(a, "a").join(b, "b").select(F.col("b").alias("node"), alike.alias("alike")))
    # The likeliest one is not taken out of a node's others: that would cost a join more.
    others = found.join(bounded(first.filter(~F.col("alike")).select(F.col("node").alias("b")), BROADCAST_KEYS), "b", "left_semi").select("a", "b")
    rest = others.join(a, "a").join(b, "b").filter(alike).select(F.col("b").alias("node")).distinct()
    return materialize(first.filter("alike").select("node").unionByName(rest))


def _words(docs: DataFrame, id_: str, text: str, wanted: DataFrame) -> DataFrame:
    """wanted: node, PLACE. node with the 64-bit hashes of the distinct words of its line."""
    by_doc = materialize(wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("line_no", "node")).alias("wanted")))
    held = docs.select(_doc(id_).alias("doc"), F.xxhash64(text).alias("part"), F.col(text).alias("text")).join(bounded(by_doc, 1 << 31, ROW_BYTES + 12 * F.size("wanted")), ["doc", "part"])
    lines = held.select("wanted", _once(F.split("text", "\n", -1)).alias("lines"))
    found = lines.select(F.explode(F.transform("wanted", lambda x: F.struct(x["node"].alias("node"), F.get(F.col("lines"), x["line_no"]).alias("line")))).alias("x")).filter("x.line is not null")
    words = F.array_distinct(F.array_remove(F.transform(_split(F.col("x.line")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    return found.select("x.node", words.alias("words")).dropDuplicates(["node"])


def removed_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """PLACE of each line that goes from the first row of its id and text (doc: the id, null ids as the largest
    long), and of each line of at least ``least`` words; rows that agree in id and text give a line once each."""
    own, classes = similar_lines(docs, id_, text, percent, least)
    first = classes.select(*CLASS, *[F.col(c).alias(f"first_{c}") for c in PLACE], "later")
    later = F.col("later") | ~F.struct(*PLACE).eqNullSafe(F.struct(*[F.col(f"first_{c}").alias(c) for c in PLACE]))
    return own.join(first, [*CLASS]).filter(later).select(*PLACE), own.select(*PLACE)


def _cut(docs: DataFrame, id_: str, text: str, percent: int, least: int, instead: Column | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more column, of that name: the numbers of the lines that go, ascending, null if none does.

    instead, if given, is all that is kept besides the id.
    """
    gone, lines = removed_lines(docs, id_, text, percent, least)
    doc, part, again, out = (fresh(docs, x) for x in ("doc", "part", "again", "gone"))

    def listed(x: DataFrame, other: bool) -> DataFrame:
        by_doc = x.distinct().groupBy("doc", "part").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))
        return materialize(by_doc.select(F.col("doc").alias(doc), F.col("part").alias(part), F.lit(other).alias(again), F.col("lines").alias(out)))

    def small(x: DataFrame) -> DataFrame:
        return bounded(x, 1 << 31, ROW_BYTES + 4 * F.size(out))

    place = {doc: _doc(id_), part: F.xxhash64(text)}
    whole = docs.withColumns(place)
    rows = whole if instead is None else docs.select(F.col(id_), instead, *[c.alias(k) for k, c in place.items()])
    copies = materialize(whole.filter(F.col(text).isNotNull()).groupBy(doc, part).count().filter("count > 1").select(doc, part))
    if not copies.limit(1).count():
        return rows.join(small(listed(gone, False)).drop(again), [doc, part], "left").drop(doc, part), out
    # Rows that agree in id and text: one, by a row number made once, is the first; all lines of the others repeat it.
    many, row = bounded(copies), fresh(docs, "row")
    numbered = materialize(rows.join(many, [doc, part], "left_semi").withColumn(row, F.monotonically_increasing_id()))
    firsts = bounded(numbered.groupBy(doc, part).agg(F.min(row).alias(f"{row}_first")))
    others = numbered.join(firsts, [doc, part]).withColumn(again, F.col(row) != F.col(f"{row}_first")).drop(row, f"{row}_first")
    rows = rows.join(many, [doc, part], "left_anti").withColumn(again, F.lit(False)).unionByName(others)
    repeated = lines.join(bounded(copies.select(F.col(doc).alias("doc"), F.col(part).alias("part"))), ["doc", "part"], "left_semi")
    return rows.join(small(listed(gone, False).unionByName(listed(repeated, True))), [doc, part, again], "left").drop(doc, part, again), out


def report(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, ascending, joined by commas) of each document."""
    n = F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines")
    rows, gone = _cut(docs, id_, text, percent, least, n_lines)
    return rows.select(F.col(id_).alias("doc_id"), "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(gone, ","), F.lit("")).alias("removed"))


def dedupe(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the removed lines taken out of the texts; the other columns are unchanged."""
    rows, gone = _cut(docs, id_, text, percent, least)
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, k: ~F.array_contains(F.col(gone), k)), "\n")
    columns = [F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*columns)

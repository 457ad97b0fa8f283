"""URL filters by prefix rules and, where no rule speaks, by a path-template tree.

Urls that a rule covers are the labelled ones. Per host, path segments become the levels of a tree, as many as
the deepest path has. A segment with a digit is a wildcard; so are all children of a node that has many children
of few urls each. From the root down, a branch merges into a wildcard if it and its siblings taken together both
have some labelled urls, their shares of blocked ones differ by no more than chance, and their shapes are alike;
branches without such evidence stay apart. A template is rejected if the share of blocked urls among its labelled
ones, smoothed by its host's share and that by one half, is above one half: without labels a url is allowed.
Everything after the first aggregation works on one row per host and distinct path shape; nodes with one shape
are finished at once; only DataFrame operations are used.

A null url, or one without ``://``, has an empty host and path. Repeated rows each count; ties between rules
of one length go to the smaller string; an empty table gives an empty table. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, materialize

#: host, path, verdict
Rule = tuple[str, str, str]
#: A node is variable from so many children with fewer than so many urls each on average.
CHILDREN, URLS_EACH = 12, 5
#: Branches merge within so many standard errors of blocked share, and within this difference of shape.
ERRORS, SHAPE = 2.0, 0.25
#: Labelled urls that a branch needs to merge, and its siblings together.
EVIDENCE = 5
#: Weight of the prior in smoothed shares, and the share that hosts are smoothed by.
PRIOR, NEUTRAL = 4.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == r[0]) | F.endswith(host, F.lit("." + r[0]))) & F.startswith(path, F.lit(r[1]))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _level(t: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """t: open rows with prefix, the template so far. Those that are finished, and the others one level on."""
    s, deeper = F.get("shape", F.lit(k)), F.size("shape") > k + 1
    t = t.withColumns({"s": s, "deep": F.when(deeper, F.col("n")).otherwise(0)})
    nodes = t.groupBy("host", "prefix").agg(F.count_distinct("s").alias("kids"), F.sum("n").alias("urls"), F.count("*").alias("shapes"))
    t = t.join(bounded(materialize(nodes)), ["host", "prefix"])
    rest = F.array_join(F.slice("shape", k + 1, F.size("shape")), "/")
    done = t.filter("shapes = 1").select("host", "shape", "n", "labelled", "blocked", F.concat("prefix", F.lit("/"), rest).alias("prefix"))
    variable = (F.col("kids") >= CHILDREN) & (F.col("urls") < URLS_EACH * F.col("kids"))
    t = t.filter("shapes > 1").withColumn("s", F.when(variable, F.lit("*")).otherwise(F.col("s"))).drop("kids", "urls", "shapes")
    sums = lambda of: [F.sum(c).alias(f"{of}_{c}") for c in ("n", "labelled", "blocked", "deep")]
    branches = materialize(t.filter("s != '*'").groupBy("host", "prefix", "s").agg(*sums("b")))
    pooled = branches.groupBy("host", "prefix").agg(*[F.sum(f"b_{c}").alias(f"p_{c}") for c in ("n", "labelled", "blocked", "deep")])
    other = {c: F.col(f"p_{c}") - F.col(f"b_{c}") for c in ("n", "labelled", "blocked", "deep")}
    share = F.col("p_blocked") / F.col("p_labelled")
    off = F.abs(F.try_divide("b_blocked", "b_labelled") - F.try_divide(other["blocked"], other["labelled"]))
    error = F.sqrt(share * (1.0 - share) * (F.try_divide(F.lit(1.0), "b_labelled") + F.try_divide(F.lit(1.0), other["labelled"])))
    known = (F.col("b_labelled") >= EVIDENCE) & (other["labelled"] >= EVIDENCE)
    alike = known & (off <= ERRORS * error) & (F.abs(F.col("b_deep") / F.col("b_n") - F.try_divide(other["deep"], other["n"])) <= SHAPE)
    merged = branches.join(pooled.filter(f"p_labelled >= {2 * EVIDENCE}"), ["host", "prefix"]).filter(alike).select("host", "prefix", "s", F.lit(True).alias("merge"))
    t = t.join(bounded(materialize(merged)), ["host", "prefix", "s"], "left")
    named = F.concat("prefix", F.lit("/"), F.when(F.col("merge"), F.lit("*")).otherwise(F.col("s")))
    return done, t.select("host", "shape", "n", "labelled", "blocked", named.alias("prefix"))


def tree(urls: DataFrame) -> DataFrame:
    """urls: host, shape, block (null: no rule). One row per host and shape: host, shape, template, purity."""
    counts = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("block").alias("labelled"), F.sum(F.coalesce("block", F.lit(0))).alias("blocked"))
    t, k, done = materialize(counts.withColumn("prefix", F.lit(""))), 0, []
    while True:
        done.append(t.filter(F.size("shape") <= k))
        open_ = t.filter(F.size("shape") > k)
        if not open_.limit(1).count():
            break
        finished, t = _level(open_, k)
        done.append(materialize(finished))
        t, k = materialize(t), k + 1
    found = materialize(reduce(DataFrame.unionByName, done).withColumnRenamed("prefix", "template"))
    sums = [F.sum(x).alias(x) for x in ("labelled", "blocked")]
    smooth = lambda prior: (F.col("blocked") + PRIOR * prior) / (F.col("labelled") + PRIOR)
    hosts = found.groupBy("host").agg(*sums).select("host", smooth(F.lit(NEUTRAL)).alias("ph"))
    templates = found.groupBy("host", "template").agg(*sums).join(hosts, "host").select("host", "template", smooth(F.col("ph")).alias("purity"))
    return found.select("host", "shape", "template").join(templates, ["host", "template"])


def shape(path: Column) -> Column:
    """The path's segments, those with a digit as wildcards."""
    segments = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), F.lit("*")).otherwise(x))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """The input's columns but ``url``, host, path, rule, verdict, template."""
    result = ("host", "path", "rule", "verdict", "template")
    keep = [F.col(c).alias(f"in_{k}") for k, c in enumerate(pages.columns) if c != url and c not in result]
    back = [F.col(f"in_{k}").alias(c) for k, c in enumerate(pages.columns) if c != url and c not in result]
    host, path = host_and_path(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    of = lambda value: rule_for(F.col("host"), F.col("path"), rules, value)
    rows = rows.select("*", of(lambda r: r[0] + r[1]).alias("rule"), of(lambda r: r[2]).alias("said"), shape(F.col("path")).alias("shape"))
    block = F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("long"))
    found = materialize(tree(rows.select("host", "shape", block.alias("block"))))
    joined = rows.join(bounded(found), ["host", "shape"])
    method = F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(*back, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template")

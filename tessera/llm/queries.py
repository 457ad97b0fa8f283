"""The operators' queries over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, centroids, importance, line_dedup, lm_scoring, minhash, mixing, product_codes, quality_rules, substring_dedup, syncmers, topk, url_filters
from tessera.llm.common import documents, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the digests of each text's ids and of what they decode to; ``vocabulary`` is a .tiktoken file."""
    ranks = byte_bpe.read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = byte_bpe.round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.dot_search(vectors, F.col("vec_id") % 50 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir).select("doc_id", "text"))


#: host, path, verdict
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, URL_RULES)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(documents(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = product_codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(product_codes.digest(books)).alias("codebooks_sha256"))


def op13_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.against_next(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_topk": op3_exact_topk,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash": op5_minhash,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_centroids": op11_centroids,
    "op12_product_codes": op12_product_codes,
    "op13_syncmers": op13_syncmers,
}

def _op1_sql(fences=quality_rules.FENCES, prior: int = quality_rules.PRIOR) -> str:
    """Measures by lists; quantiles of bucketed values by running sums; fences drawn towards their parents'."""
    word = r"[^\x20\x09-\x0D]"
    value = lambda f: f"CAST(floor(1000 * {f.part} / greatest({f.whole}, 1)) AS BIGINT)"
    values = " UNION ALL ".join(f"SELECT rid, lang, source, '{f.name}' AS measure, {value(f)} AS v, {100 - f.level} AS r0, {f.level} AS r2, {f.times} AS times, {f.both} AS both_ends FROM f" for f in fences)

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}measure"
        return f"""{name}r AS (SELECT {by}, bucket, r0, r2, sum(count(*)) OVER (PARTITION BY {by} ORDER BY bucket) AS cum, sum(count(*)) OVER (PARTITION BY {by}) AS total FROM v GROUP BY {by}, bucket, r0, r2),
{name} AS (SELECT {by}, max(total)::DOUBLE AS n, (min(bucket) FILTER (100 * cum >= r0 * total))::DOUBLE AS q0, (min(bucket) FILTER (100 * cum >= 50 * total))::DOUBLE AS q1, (min(bucket) FILTER (100 * cum >= r2 * total))::DOUBLE AS q2 FROM {name}r GROUP BY {by}),"""

    drawn = ", ".join(f"(s.n * s.q{k} + {prior} * ((l.n * l.q{k} + {prior} * a.q{k}) / (l.n + {prior}))) / (s.n + {prior}) AS q{k}" for k in range(3))
    tiny = f"{quality_rules.TINY}::DOUBLE"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '{word}+'), []) AS ws FROM documents),
x AS (SELECT *, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{word}')) AS ls FROM t),
k3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win FROM x WHERE len(ws) > 2)),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM k3 WHERE c > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM x LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT * FROM b WHERE NOT base_failed),
u AS ({values}),
v AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM u),
{quantiles("s", "lang, source, ")}
{quantiles("l", "lang, ")}
{quantiles("a", "")}
q AS (SELECT s.lang, s.source, s.measure, {drawn} FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure JOIN a ON s.measure = a.measure),
bad AS (SELECT DISTINCT rid FROM v JOIN q ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND v.measure = q.measure
  WHERE v > q2 + greatest({tiny}, times * abs(q2 - q1)) OR both_ends AND v < q0 - greatest({tiny}, times * abs(q0 - q1)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM b
"""


def _op10_sql() -> str:
    """N-gram counts by joins. crc32 is folded bit by bit."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    fail = lambda c: f"CASE WHEN coalesce({c}, 0) > 0 THEN {lm_scoring.FAIL}::DOUBLE * pow({c}, -{lm_scoring.FALL}::DOUBLE) ELSE 1 END"
    step = lambda f, n, c, p: f"(1 - {f}) * coalesce({n}, 0) / greatest(coalesce({c}, 0), 1) + {f} * {p}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS s, list_append(coalesce(regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '[^\x20\x09-\x0D]+'), []), chr(10)) AS ws FROM documents),
h AS (SELECT *, coalesce({crc} % 10 = 0, true) AS held_out FROM d),
t AS (SELECT rid, held_out, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(list_prepend(chr(10), ws[:-2])) AS p, unnest(list_prepend(NULL, list_prepend(chr(10), ws[:-3]))[:len(ws)]) AS pp FROM h),
c1 AS (SELECT w, count(*) AS n1 FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT p, w, count(*) AS n2 FROM t WHERE NOT held_out GROUP BY p, w),
c3 AS (SELECT pp, p, w, count(*) AS n3 FROM t WHERE NOT held_out AND i > 1 GROUP BY pp, p, w),
k AS (SELECT coalesce(sum(n1), 0) AS total, count(*) AS v FROM c1),
j AS (SELECT t.rid, total, a.n1, (coalesce(a.n1, 0) + {lm_scoring.ADD}::DOUBLE) / (total + {lm_scoring.ADD}::DOUBLE * (v + 1)) AS root, b.n1 AS cw, c2.n2, e.n2 AS cp, c3.n3
  FROM t CROSS JOIN k LEFT JOIN c1 a ON a.w = t.w LEFT JOIN c1 b ON b.w = t.p LEFT JOIN c2 ON c2.p = t.p AND c2.w = t.w LEFT JOIN c2 e ON t.i > 1 AND e.p = t.pp AND e.w = t.p LEFT JOIN c3 ON c3.pp = t.pp AND c3.p = t.p AND c3.w = t.w),
s1 AS (SELECT *, {fail("cw")} AS f2, {fail("cp")} AS f3 FROM j),
s2 AS (SELECT *, {step("f2", "n2", "cw", "root")} AS p2 FROM s1),
r AS (SELECT rid, any_value(total) AS train_tokens, count(*) AS n_tokens, count(*) FILTER (n1 > 0) AS n_known, sum(log10(root)) AS base_score, sum(log10({step("f3", "n3", "cp", "p2")})) AS score FROM s2 GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, CAST(train_tokens AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM r JOIN h USING (rid)
"""


OP3_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.w, b.w), lambda p: COALESCE(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS win FROM w WHERE len(ws) >= 35),
r AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM x JOIN r USING (win)),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM w WHERE len(ws) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM p ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(ws)) AS toks FROM w WHERE len(ws) >= 1),
c AS (SELECT toks, min((doc_id, line_no)) AS place, len(toks) AS n, row_number() OVER () AS cls FROM s GROUP BY toks),
t AS (SELECT cls, n, place, unnest(toks) AS tok FROM c),
f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
p AS (SELECT cls, n, place, tok FROM (SELECT t.*, row_number() OVER (PARTITION BY cls ORDER BY df, tok) AS k FROM t JOIN f USING (tok)) WHERE k <= n - ceil(75 * n / 100) + 1),
cand AS (SELECT DISTINCT a.cls AS x, b.cls AS y FROM p a JOIN p b ON a.tok = b.tok AND a.place < b.place AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n),
later AS (SELECT DISTINCT y AS cls FROM (SELECT y, len(list_intersect(a.toks, b.toks)) AS i, a.n + b.n AS t FROM cand JOIN c a ON a.cls = x JOIN c b ON b.cls = y) WHERE 100 * i >= 75 * (t - i)),
gone AS (SELECT s.doc_id, s.line_no FROM s JOIN c USING (toks) LEFT JOIN later USING (cls) WHERE later.cls IS NOT NULL OR (s.doc_id, s.line_no) <> c.place),
g AS (SELECT doc_id, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) AS r FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.r, '') AS removed
FROM documents d LEFT JOIN g USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS doc, len(sh) AS n, row_number() OVER () AS node FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT node, n, unnest(sh) AS tok FROM c),
df AS (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1),
p AS (SELECT a.node AS x, b.node AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM t a JOIN df USING (tok) JOIN t b ON a.tok = b.tok AND a.node < b.node GROUP BY a.node, b.node),
l AS (SELECT x, y FROM p WHERE 100 * i >= 75 * (nx + ny - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, seen) AS (SELECT node, node FROM c UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
m AS (SELECT r.node, min(c.doc) AS component_id FROM r JOIN c ON c.node = r.seen GROUP BY r.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.sh = c.sh AND len(s.sh) > 0 LEFT JOIN m ON m.node = c.node
"""


#: Levels of the tree in SQL, which has to name each; the operator goes as deep as the paths, the given ones have two.
SQL_DEPTH = 4


def _op9_sql(d: int = SQL_DEPTH) -> str:
    """The tree level by level, as SQL."""
    steps = []
    for k in range(1, d + 1):
        steps.append(f"""
n{k} AS (SELECT host, prefix, count(DISTINCT shape[{k}]) AS kids, sum(n) AS urls FROM t{k - 1} WHERE len(shape) >= {k} GROUP BY ALL),
v{k} AS (SELECT t.*, CASE WHEN len(shape) >= {k} THEN CASE WHEN kids >= {url_filters.CHILDREN} AND urls < {url_filters.URLS_EACH} * kids THEN '*' ELSE shape[{k}] END END AS s,
  CASE WHEN len(shape) > {k} THEN n ELSE 0 END AS deep FROM t{k - 1} t LEFT JOIN n{k} USING (host, prefix)),
b{k} AS (SELECT host, prefix, s, sum(n) AS bn, sum(labelled) AS bl, sum(blocked) AS bb, sum(deep) AS bd FROM v{k} WHERE s <> '*' GROUP BY ALL),
o{k} AS (SELECT *, sum(bn) OVER w - bn AS xn, sum(bl) OVER w - bl AS xl, sum(bb) OVER w - bb AS xb, sum(bd) OVER w - bd AS xd FROM b{k} WINDOW w AS (PARTITION BY host, prefix)),
m{k} AS (SELECT host, prefix, s, true AS merge FROM o{k} WHERE bl >= {url_filters.EVIDENCE} AND xl >= {url_filters.EVIDENCE}
  AND abs(bb::DOUBLE / bl - xb::DOUBLE / xl) <= {url_filters.ERRORS}::DOUBLE * sqrt((bb + xb)::DOUBLE / (bl + xl) * (1::DOUBLE - (bb + xb)::DOUBLE / (bl + xl)) * (1::DOUBLE / bl + 1::DOUBLE / xl))
  AND abs(bd::DOUBLE / bn - xd::DOUBLE / xn) <= {url_filters.SHAPE}::DOUBLE),
t{k} AS (SELECT v.* EXCLUDE (s, deep, prefix, kids, urls), CASE WHEN s IS NULL THEN prefix ELSE prefix || '/' || CASE WHEN merge THEN '*' ELSE s END END AS prefix FROM v{k} v LEFT JOIN m{k} USING (host, prefix, s)),""".replace("SELECT t.*, CASE", "SELECT t.*, kids, urls, CASE"))
    prior, neutral = f"{url_filters.PRIOR}::DOUBLE", f"{url_filters.NEUTRAL}::DOUBLE"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM h),
g AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS block,
  list_transform(segs, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS shape FROM f),
t0 AS (SELECT host, shape, count(*) AS n, count(block) AS labelled, coalesce(sum(block), 0) AS blocked, '' AS prefix FROM g GROUP BY host, shape),{"".join(steps)}
tt AS (SELECT *, prefix || CASE WHEN len(shape) > {d} THEN '/' || array_to_string(shape[{d + 1}:], '/') ELSE '' END AS template FROM t{d}),
ph AS (SELECT host, (sum(blocked) + {prior} * {neutral}) / (sum(labelled) + {prior}) AS ph FROM tt GROUP BY host),
pt AS (SELECT host, template, (sum(blocked) + {prior} * any_value(ph)) / (sum(labelled) + {prior}) AS purity FROM tt JOIN ph USING (host) GROUP BY host, template)
SELECT page_id, host, path, rule,
  CASE WHEN block = 1 THEN 'block' WHEN block = 0 THEN 'allow' WHEN purity > 0.5 THEN 'block' ELSE 'allow' END AS verdict, template
FROM g JOIN tt USING (host, shape) JOIN pt USING (host, template)
"""


_VECTORS = """e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"""


def _far(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of full scans."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rid, min((d, c)) AS best FROM (SELECT rid, c, {_far("e.w", "z.w")} AS d FROM e CROSS JOIN c{r} z) GROUP BY rid),""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, list(s ORDER BY pos) AS w FROM (SELECT best[2] AS c, pos, CAST(floor(sum(x) // count(*)) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS s
  FROM (SELECT best, unnest(w) AS x, unnest(range(64)) AS pos FROM a{r} JOIN e USING (rid)) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c)),""")
    return f"""
WITH {_VECTORS},
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, w) - 1 AS INTEGER) AS c, w FROM e QUALIFY c < {k}),{"".join(steps)}
r AS (SELECT vec_id, best[2] AS cluster, CAST(best[1] AS BIGINT) AS distance FROM a{rounds} JOIN e USING (rid))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.w, ',')) AS centroid_sha256
FROM r JOIN c{rounds} z ON z.c = cluster
"""


def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of full scans of parts."""
    d = 64 // parts
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rid, p, min((d, c)) AS best FROM (SELECT rid, x.p, c, {_far("x.w", "z.w")} AS d FROM x JOIN c{r} z USING (p)) GROUP BY rid, p),""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT p, c, list(s ORDER BY pos) AS w FROM (SELECT p, best[2] AS c, pos, CAST(floor(sum(y) // count(*)) - CASE WHEN sum(y) < 0 AND sum(y) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS s
  FROM (SELECT p, best, unnest(w) AS y, unnest(range({d})) AS pos FROM a{r} JOIN x USING (rid, p)) GROUP BY ALL) GROUP BY p, c),
c{r + 1} AS MATERIALIZED (SELECT p, c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (p, c)),""")
    return f"""
WITH {_VECTORS},
x AS MATERIALIZED (SELECT rid, p, w[{d} * p + 1:{d} * p + {d}] AS w FROM (SELECT rid, w, unnest(range({parts})) AS p FROM e)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS c FROM e QUALIFY c < {entries}),
c0 AS MATERIALIZED (SELECT p, c, w FROM f JOIN x USING (rid)),{"".join(steps)}
b AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT rid, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN e USING (rid) CROSS JOIN b
"""


def _op13_sql(most: int = syncmers.MOST) -> str:
    """Hashes of doubled lengths as lists; matches in order by patience."""
    k, s, prime, base = syncmers.K, syncmers.S, syncmers.PRIME, syncmers.BASE
    double = lambda a, n: f"list_transform(range(1, n - {2 * n} + 2), lambda i: ({a}[i] * {pow(base, n, prime)} + {a}[i + {n}]) % {prime})"
    least = lambda a, n: f"list_transform(range(1, len({a}) - {n} + 1), lambda i: least({a}[i], {a}[i + {n}]))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS i, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT i, doc_id, t, length(t) AS n, coalesce(lead(i) OVER w, 1) AS ni, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d WINDOW w AS (ORDER BY i)),
e AS MATERIALIZED (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS et FROM n),
x AS (SELECT 'own' AS side, i, t AS s FROM e UNION ALL SELECT 'edited', i, et FROM e),
h1 AS (SELECT side, i, length(s) AS n, list_transform(regexp_extract_all(s, '(?s).'), lambda c: unicode(c)::BIGINT) AS a1 FROM x WHERE s <> ''),
h2 AS (SELECT *, {double("a1", 1)} AS a2 FROM h1), h4 AS (SELECT *, {double("a2", 2)} AS a4 FROM h2), h8 AS (SELECT * EXCLUDE (a2, a4), {double("a4", 4)} AS a8 FROM h4),
h16 AS (SELECT *, {double("a8", 8)} AS a16 FROM h8), h32 AS (SELECT * EXCLUDE a16, {double("a16", 16)} AS a32 FROM h16),
l2 AS (SELECT *, {least("a8", 1)} AS b2 FROM h32), l4 AS (SELECT * EXCLUDE b2, {least("b2", 2)} AS b4 FROM l2),
l8 AS (SELECT * EXCLUDE b4, {least("b4", 4)} AS b8 FROM l4), l16 AS (SELECT * EXCLUDE b8, {least("b8", 8)} AS b16 FROM l8),
lw AS (SELECT * EXCLUDE b16, {least("b16", k - s + 1 - 16)} AS b FROM l16),
sel AS (SELECT side, i, n, a1, a32, list_filter(range(1, n - {k} + 2), lambda j: a8[j] = b[j] OR a8[j + {k - s}] = b[j]) AS js FROM lw),
hp AS (SELECT side, i, unnest(js) - 1 AS p, unnest(list_transform(js, lambda j: a32[j])) AS h FROM sel WHERE len(js) > 0
  UNION ALL SELECT side, i, 0, (list_reduce(a1, lambda y, z: (y * {base} + z) % {prime}) * {base} + n) % {prime} FROM sel WHERE len(js) = 0),
g AS MATERIALIZED (SELECT side, i, h, min(p) AS p FROM hp GROUP BY ALL),
v AS MATERIALIZED (SELECT side, i, list_filter(range(32), lambda b: len(list_filter(hs, lambda h: h % (1 << b) = 0)) <= {most})[1] AS level FROM (SELECT side, i, list(h) AS hs FROM g GROUP BY ALL)),
f AS MATERIALIZED (SELECT side, i, level, p, h FROM g JOIN v USING (side, i) WHERE h % (1 << level) = 0),
m AS MATERIALIZED (SELECT side, i, any_value(level) || ':' || to_base64(unhex(string_agg(printf('%08x%08x', h, p), '' ORDER BY p))) AS mark FROM f GROUP BY side, i),
pairs AS (SELECT i, 'edited' AS side, i AS j FROM e UNION ALL SELECT i, 'own', ni FROM e),
q AS MATERIALIZED (SELECT pairs.*, coalesce(a.mark, '') AS ma, coalesce(b.mark, '') AS mb, 1 << greatest(va.level, vb.level) AS step
  FROM pairs LEFT JOIN m a ON a.side = 'own' AND a.i = pairs.i LEFT JOIN m b ON b.side = pairs.side AND b.i = pairs.j LEFT JOIN v va ON va.side = 'own' AND va.i = pairs.i LEFT JOIN v vb ON vb.side = pairs.side AND vb.i = pairs.j),
ta AS (SELECT q.i, q.side, count(*) AS n FROM q JOIN f ON f.side = 'own' AND f.i = q.i WHERE f.h % q.step = 0 GROUP BY ALL),
tb AS (SELECT q.i, q.side, count(*) AS n FROM q JOIN f ON f.side = q.side AND f.i = q.j WHERE f.h % q.step = 0 GROUP BY ALL),
c AS (SELECT q.i, q.side, list([fb.p] ORDER BY fa.p) AS ps FROM q JOIN f fa ON fa.side = 'own' AND fa.i = q.i JOIN f fb ON fb.side = q.side AND fb.i = q.j AND fb.h = fa.h WHERE fa.h % q.step = 0 GROUP BY ALL),
r AS (SELECT i, side, len(list_reduce(ps, lambda y, z: list_concat(y[:len(list_filter(y, lambda o: o < z[1]))], list_concat(z, y[len(list_filter(y, lambda o: o < z[1])) + 2:])))) AS run FROM c),
w AS (SELECT q.i, q.side, ma, mb, CASE WHEN ma = mb THEN 1.0::DOUBLE WHEN ma = '' OR mb = '' THEN 0.0::DOUBLE ELSE coalesce(2.0::DOUBLE * coalesce(run, 0) / (coalesce(ta.n, 0) + coalesce(tb.n, 0)), 0.0::DOUBLE) END AS near
  FROM q LEFT JOIN r USING (i, side) LEFT JOIN ta USING (i, side) LEFT JOIN tb USING (i, side))
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, o.ma AS fingerprint, o.mb AS edited_fingerprint, o.near AS near_edited, x.near AS near_next
FROM e JOIN w o ON o.i = e.i AND o.side = 'edited' JOIN w x ON x.i = e.i AND x.side = 'own'
"""


ORACLE: dict[str, str] = {
    "op1_quality_rules": _op1_sql(),
    "op3_exact_topk": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_minhash": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_url_filters": _op9_sql(),
    "op10_lm_scoring": _op10_sql(),
    "op11_centroids": _op11_sql(),
    "op12_product_codes": _op12_sql(),
    "op13_syncmers": _op13_sql(),
}

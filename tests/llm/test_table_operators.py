"""Search, mixing, url filters, components and the pipeline against brute force."""

import collections
import importlib.util
import math
import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality_rules, queries, topk, url_filters
from tessera.llm.graph import components

SF = "/root/testdata/sf0.001"


def test_topk(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for k in range(120)]
    rows += [(50, rows[3][1]), (7, rows[7][1]), (200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [1.0] * 8), (204, []), (205, [1.0]), (206, [0.5] * 12)]
    good = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    by = collections.defaultdict(list)
    for q, a in good:
        if q % 50 == 0:
            by[q] += [(-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in good if c != q]
    for q, s in by.items():
        want.update((q, r, c, -n) for r, (n, c) in enumerate(sorted(s)[:5], 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size, room in ((512, topk.PASS_BYTES), (7, topk.PASS_BYTES), (3, 900)):
        scaled = df.withColumn("w", topk.quantized(F.col("embedding")))
        got = topk.search(scaled, scaled.filter("vec_id % 50 = 0"), 5, "vec_id", "w", size, size, room)
        assert collections.Counter(map(tuple, got.collect())) == want
    assert topk.dot_search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_weights(spark):
    df = spark.createDataFrame([(k, [k * 1e9 + 1, -3e9]) for k in range(5)], "vec_id long, embedding array<double>")
    got = topk.dot_search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, 2**63 - 1) for k in (1, 2, 3, 4)]


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 30, 3) == pytest.approx([18.75, 7.5, 3.75])
    filled = mixing.water_fill([1, 100, 100], [5, 2, 1], 201, 3)
    assert filled == pytest.approx([3, 132, 66]) and sum(filled) == pytest.approx(201)
    assert mixing.water_fill([], [], 0, 3) == []


def test_flow_spreads_repeats_and_overlaps():
    patterns = {"a": (("x",), 100), "ab": (("x", "y"), 100), "b": (("y",), 50)}
    got = mixing.route(patterns, {"x": 150, "y": 200}, 3)
    assert got["a"]["x"] + got["ab"]["x"] == 150 and got["ab"]["y"] + got["b"]["y"] == 200
    passes = [sum(got[p].values()) / patterns[p][1] for p in patterns]
    assert max(passes) <= 2 and min(passes) >= 1
    short = mixing.route({"a": (("x",), 10)}, {"x": 100}, 3)
    assert short["a"]["x"] == 30


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(0, 60), f"s{min(k % 9, 5)}" if k % 17 else None) for k in range(600)] + [(1000, None, "s0"), (None, "a b c", "s1"), (1001, "x " * 900, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=mixing.order)
    target = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], sum(sizes.values()), 3), strict=True))
    taken = collections.Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in names:
        if s != "tiny":
            assert abs(taken[s] - target[s]) <= 60
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in found}
    copies = collections.Counter(r.doc_id for r in mixing.resample(docs.drop("size")).collect())
    assert copies == collections.Counter({r.doc_id: r.taken // r.size for r in found if r.taken})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_goes_on_behind_a_document_that_does_not_fit(spark):
    """A source misses its target by at most half of its smallest document that is left, whatever stands in the way."""
    rng = random.Random(18)
    rows = [(k, "w " * rng.randrange(5, 80), "s") for k in range(700)] + [(1000, "w " * 20_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        got = mixing.mix(docs, weights=(1,), share=0.55, seed=seed).collect()
        assert all(r.taken in (0, r.size) for r in got)
        assert 2 * abs(sum(r.taken for r in got) - got[0].target) <= min(r.size for r in got if not r.taken)


def test_mix_of_overlapping_sources(spark):
    rows = [(k, "w " * 10, [["a"], ["a", "b"], ["b", None]][k % 3]) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(docs, sources="sources", weights=(1,), share=0.5).collect()
    assert len(got) == 90 and all(r.taken in (0, 10, 20, 30) for r in got)
    assert 600 <= sum(r.taken for r in got) <= 900


URLS = [
    "http://A.Example.COM/x/1?q#f", "https://example.net/en/2", "https://sub.example.net/fr/", "https://example.net/en", "nothing", None, "", "://", "http://example.net", "http://net/", "http://internet/x",
    "http://x.org/fr/1", "http://fr.org/fr", "http://e.example.com/de/1/2/3/4/5", "http://h?x/y", "http://h#x", "a://b://c/d", "http://example.com/de/",
]


def test_url_rules(spark):
    def brute(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [h + p for h, p, _ in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=len, default=None)

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filters.judge(df, queries.URL_RULES).collect()}
    for k, u in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == brute(u), u
        if got[k].rule:
            assert got[k].verdict == ("block" if got[k].rule in ("net/", "example.com/de/") else "allow")
    assert url_filters.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_url_templates_reject_by_purity(spark):
    """Paths of a host that is blocked almost throughout are rejected where no rule speaks."""
    urls = [f"http://bad.com/spam/{k}" for k in range(40)] + [f"http://bad.com/offer/{k}" for k in range(4)] + [f"http://good.com/a{w}/x" for w in "bcdefghijklmnopq"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge(df, [("bad.com", "/spam/", "block")])
    verdicts = {(r.host, r.verdict) for r in got.filter("rule is null").collect()}
    assert verdicts == {("bad.com", "block"), ("good.com", "allow")}
    assert {r.template for r in got.filter("host = 'good.com'").collect()} == {"/*/x"}


def verdicts_brute(urls, rules):
    """The verdict of each url by recursion over its host's paths."""
    rows, labels = [], collections.defaultdict(list)
    for u in urls:
        host, path = u.split("://", 1)[1].split("/", 1)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and f"/{path}".startswith(r[1])]
        rule = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        rows.append((host, tuple("*" if any(c.isdigit() for c in x) else x for x in path.split("/") if x), rule and rule[2] == "block"))
        labels[host].append(rows[-1][2])

    def walk(paths, k):
        """paths: distinct shapes -> their labels. shape -> template."""
        out = {p: () for p in paths if len(p) == k}
        open_ = {p: v for p, v in paths.items() if len(p) > k}
        kids, urls = {p[k] for p in open_}, sum(map(len, open_.values()))
        variable = len(kids) >= url_filters.CHILDREN and urls < url_filters.URLS_EACH * len(kids)
        groups = collections.defaultdict(dict)
        for p, v in open_.items():
            groups["*" if variable else p[k]][p] = v

        def counts(some):
            found = [(x, len(p) > k + 1) for g in some for p, v in groups[g].items() for x in v]
            return len(found), sum(x is not None for x, _ in found), sum(x is True for x, _ in found), sum(d for _, d in found)

        plain = [g for g in groups if g != "*"]
        merged = collections.defaultdict(dict)
        for g in groups:
            n, known, bad, deep = counts([g])
            on, oknown, obad, odeep = counts([x for x in plain if x != g])
            alike = False
            if g != "*" and min(known, oknown) >= url_filters.EVIDENCE:
                p = (bad + obad) / (known + oknown)
                error = math.sqrt(p * (1 - p) * (1 / known + 1 / oknown))
                alike = abs(bad / known - obad / oknown) <= url_filters.ERRORS * error and abs(deep / n - odeep / on) <= url_filters.SHAPE
            merged["*" if alike else g] |= groups[g]
        for g, some in merged.items():
            out |= {p: (g, *t) for p, t in walk(some, k + 1).items()}
        return out

    out = []
    smooth = lambda some, prior: (sum(x is True for x in some) + 4 * prior) / (sum(x is not None for x in some) + 4)
    trees = {}
    for host in labels:
        shapes = collections.defaultdict(list)
        for h, p, x in rows:
            if h == host:
                shapes[p].append(x)
        trees[host] = walk(shapes, 0)
    by = collections.defaultdict(list)
    for h, p, x in rows:
        by[h, trees[h][p]].append(x)
    for h, p, x in rows:
        purity = smooth(by[h, trees[h][p]], smooth(labels[h], 0.5))
        out.append("block" if x or (x is None and purity > 0.5) else "allow")
    return out


def test_url_verdicts_of_deep_paths(spark):
    """Trees of any depth against recursion; urls that differ at the fifth segment only get different verdicts."""
    rng = random.Random(21)
    rules = [("h0.com", "/a/b/c/d/bad/", "block"), ("h0.com", "/a/b/c/d/good/", "allow"), ("h1.com", "/x/", "block"), ("h2.com", "/n/", "allow"), ("h2.com", "/m/", "block")]
    urls = [f"http://h0.com/a/b/c/d/{rng.choice(['bad', 'good'])}/{rng.choice('pqrs')}" for _ in range(80)] + ["http://h0.com/a/b/c/d/bad", "http://h0.com/a/b/c/d/good"]
    for _ in range(400):
        urls.append(f"http://h{rng.randrange(1, 4)}.com/" + "/".join(rng.choice(["x", "n", "m", "k", f"id{rng.randrange(99)}", f"w{chr(97 + rng.randrange(20))}"]) for _ in range(rng.randrange(0, 6))))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge(df, rules).collect()}
    assert [got[k] for k in range(len(urls))] == verdicts_brute(urls, rules)
    assert len(set(got.values())) == 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(500, 500 + k) for k in range(1, 80)] + [(7, 7), (None, 3)]
    up = {}

    def top(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    want = {k: top(k) for k in up}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: collections.Counter(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def load_pipeline():
    path = Path(__file__).parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    pipeline = importlib.util.module_from_spec(spec)
    sys.modules["corpus_pipeline"] = pipeline
    spec.loader.exec_module(pipeline)
    return pipeline


def test_pipeline(spark):
    pipeline = load_pipeline()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    out = pipeline.run(spark, SF).collect()
    source = {r.doc_id: r for r in docs.collect()}
    assert out and {r.doc_id for r in out} <= source.keys()
    for r in out:
        assert r.n_tokens == len(r.token_ids) // 4 and r.n_chars == len(r.text)
        lines = source[r.doc_id].text.split("\n")
        assert all(x in lines for x in r.text.split("\n"))
    assert max(collections.Counter(r.doc_id for r in out).values()) <= 3


def quality_fences(rows):
    """The rows that stay, by sorted lists of bucketed values for each language and source."""
    found = [((*r, at), dict(zip(quality_rules.MEASURES, quality_rules.measure_one((r[1] or "").encode()), strict=True))) for at, r in enumerate(rows)]
    found = [(r, m) for r, m in found if not (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])]
    out = {r[-1]: r[:-1] for r, _ in found}
    for f in quality_rules.FENCES:
        value = lambda m, f=f: 1000 * m[f.part] // max(m[f.whole], 1)

        def quantiles(some, f=f, value=value):
            drop = lambda v: max(v.bit_length() - 7, 0)
            x = sorted((v := value(m)) >> drop(v) << drop(v) for _, m in some)
            return [float(x[max(-(-k * len(x) // 100) - 1, 0)]) for k in (100 - f.level, 50, f.level)]

        def drawn(n, q, parent):
            return [(n * a + quality_rules.PRIOR * b) / (n + quality_rules.PRIOR) for a, b in zip(q, parent, strict=True)]

        for lang in {r[2] for r, _ in found}:
            own = [(r, m) for r, m in found if r[2] == lang]
            parent = drawn(len(own), quantiles(own), quantiles(found))
            for source in {r[3] for r, _ in own}:
                group = [(r, m) for r, m in own if r[3] == source]
                q = drawn(len(group), quantiles(group), parent)
                high = q[2] + max(quality_rules.TINY, f.times * abs(q[2] - q[1]))
                low = q[0] - max(quality_rules.TINY, f.times * abs(q[0] - q[1]))
                for r, m in group:
                    if value(m) > high or (f.both and value(m) < low):
                        out.pop(r[-1], None)
    return list(out.values())


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before kept: nulls, repeats, copies, long texts, and columns of clashing names."""
    from tests.llm.test_text_operators import lines_brute, near_brute, words

    pipeline = load_pipeline()
    rng = random.Random(31)
    base = [words(rng, rng.randrange(60, 120), 3000) for _ in range(60)]
    texts = ["\n".join(t.split(" w1")[0:1] + [words(rng, 12, 3000) for _ in range(3)]) + " " + t for t in base]
    texts += [texts[3], texts[4] + " one more", texts[5].replace("w2", "w3", 1), "# " * 200 + texts[6], words(rng, 9000, 9000), "short", "", None, f"{texts[7]}\n{texts[8]}"]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    rows += [(None, words(rng, 70, 3000), "en", "a"), (None, words(rng, 70, 3000), "en", "a"), (5, words(rng, 80, 3000), "en", "b"), rows[9], rows[9]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, `size` double"
    put = lambda some: spark.createDataFrame([(*r, len(r[1] or ""), f"n{k}", k, 0.5) for k, r in enumerate(some)], schema)
    take = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    count = lambda some: collections.Counter(map(repr, some))
    columns = put(rows).columns

    kept = pipeline.quality(spark, put(rows), "")
    assert kept.columns == columns
    now = take(kept)
    assert count(now) == count(quality_fences(rows)) and 50 < len(now) < len(rows)

    cut = pipeline.lines(spark, put(now), "")
    assert cut.columns == columns
    distinct = list(dict.fromkeys(now))
    # The order of rows that share an id is that of a hash, so only rows with ids of their own are compared.
    single = {r[0] for r in distinct if r[0] is not None and sum(x[0] == r[0] for x in distinct) == 1}
    gone = lines_brute(distinct, least=1)
    want = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[at]) for at, r in enumerate(distinct) if r[0] in single}
    made = take(cut)
    assert len(made) == len(now)
    for k, t in want.items():
        assert t in [x[1] for x in made if x[0] == k]
    longest = sorted(made, key=lambda r: -len(r[1] or ""))[:4]
    now = [*made, *((900 + k, f"{r[1]} more", r[2], r[3]) for k, r in enumerate(longest)), (None, longest[0][1], "en", "a")]

    left = pipeline.near_duplicates(spark, put(now), "")
    assert left.columns == columns
    made = take(left)
    assert not count(made) - count(now)
    groups = near_brute([(k, *r[1:]) for k, r in enumerate(now)])
    roots = {least for _, n, least, _ in groups if n}
    blank = sum(n == 0 for _, n, _, _ in groups.elements())
    assert len(made) == len(roots) + blank < len(now)
    now = made

    mixed = pipeline.mix(spark, put(now), "")
    assert mixed.columns == columns
    taken, held = count(take(mixed)), count(now)
    assert all(n <= 3 * held[r] for r, n in taken.items())
    sizes = collections.Counter()
    for r in now:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted(sizes, key=mixing.order)
    target = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], sum(sizes.values()), 3), strict=True))
    got = collections.Counter()
    for r in take(mixed):
        got[r[3]] += len(r[1].encode().split())
    most = {s: max(len((r[1] or "").encode().split()) for r in now if r[3] == s) for s in names}
    assert all(2 * abs(got[s] - target[s]) <= most[s] + 1 for s in names)

    out = pipeline.tokens(spark, mixed, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((r[0], r[1]) for r in take(mixed))
    for name, stage in pipeline.STAGES:
        assert stage(spark, put([]), "").count() == 0, name

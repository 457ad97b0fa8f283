"""Centroids, product codes and syncmer fingerprints against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, product_codes, syncmers, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, near string, cluster int"


def vector_rows(n=700, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        mid = rng.randrange(6)
        rows.append((k * 3, [float(np.float32(rng.gauss(math.sin(mid * 7 + c), 0.2))) for c in range(64)], rng.choice([None, 0, 1, 1, 1]), "x", 7))
    same = rows[5][1]
    rows += [(9000 + k, same, 1, "x", 7) for k in range(300)]  # a third are copies
    rows += [(None, None, 1, "x", 7), (1, None, 1, "x", 7), (2, [1.0] * 63, 1, "x", 7), (4, [float("nan")] * 64, 0, "x", 7), (5, [None] + [0.0] * 63, 0, "x", 7), (7, [float("inf")] + [0.0] * 63, 0, "x", 7)]
    return [*rows, rows[3], rows[3], (None, rows[9][1], None, "x", 7), (rows[2][0], rows[4][1], 1, "x", 7), (1, [], 1, "x", 7)]


def usable(rows):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in good]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, book):
    return min((far(v, c), k) for k, c in enumerate(book))


def moved(vs, book):
    groups = collections.defaultdict(list)
    for v in vs:
        groups[nearest(v, book)[1]].append(v)
    return [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else list(old) for k, old in enumerate(book)]


def clusters_brute(rows, k, rounds):
    kept = usable(rows)
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    book = [r[1] for r in sorted(kept, key=key)[:k]]
    for _ in range(rounds):
        book = moved([r[1] for r in kept], book)
    found = [(r[0], *nearest(r[1], book)[::-1]) for r in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    return collections.Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, book[c])).encode()).hexdigest()) for i, c, d in found)


def codes_brute(rows, parts, entries, rounds):
    kept, width = usable(rows), 64 // parts
    first = [r[1] for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    for _ in range(rounds):
        books = [moved([cut(r[1], p) for r in kept], b) for p, b in enumerate(books)]
    found = [(r[0], [nearest(cut(r[1], p), b) for p, b in enumerate(books)], r[2]) for r in kept]
    total = collections.Counter()
    for _, c, label in found:
        total[label] += sum(d for d, _ in c)
    return collections.Counter((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), label, total[label]) for i, c, label in found), books


def counted(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize(("k", "block"), [(40, 128), (3, 4096), (2000, 4096)])
def test_centroids_against_brute_force(spark, k, block):
    rows = vector_rows(300 if k > 100 else 700)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert counted(centroids.cluster(table, k=k, rounds=3, block=block)) == clusters_brute(rows, k, 3)


@pytest.mark.parametrize("parts", [16, 8])
def test_product_codes_against_brute_force(spark, parts):
    rows = vector_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, books = product_codes.encode(table, parts=parts, block=200)
    want, want_books = codes_brute(rows, parts, 64, 2)
    assert got.columns == ["vec_id", "code", "error", "label", "label_error"]
    assert counted(got) == want
    assert books.tolist() == want_books
    assert product_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_components_of_any_size(spark):
    rng = random.Random(2)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1) * 10.0 ** rng.randrange(12))) for _ in range(64)], k % 2, "x", 7) for k in range(90)]
    table = spark.createDataFrame(rows, SCHEMA)
    clip = lambda r: tuple(min(x, 2**63 - 1) if isinstance(x, int) else x for x in r)
    want = collections.Counter(clip(r) for r in clusters_brute(rows, 7, 2).elements())
    assert counted(centroids.cluster(table, k=7, rounds=2)) == want
    got, _ = product_codes.encode(table, entries=8)
    assert counted(got) == collections.Counter(clip(r) for r in codes_brute(rows, 16, 8, 2)[0].elements())


def test_vectors_of_no_rows(spark):
    for rows in ([], [(1, None, 1, "x", 7), (2, [], None, "x", 7)]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert centroids.cluster(table).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert centroids.cluster(table).count() == 0
        assert product_codes.encode(table)[0].count() == 0


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(3000, 64)) * 0.05 + rng.normal(size=(20, 64))[rng.integers(0, 20, 3000)])).astype(np.int64)
    c, state, drift, scans = x[:20].copy(), None, np.zeros(20), []
    for _ in range(6):
        *state, scanned = centroids.assign(x, c, state, drift, centroids.half_gaps(c))
        near, upper, lower = state
        true = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2).astype(float))
        assert (near == np.argmin(true, axis=1)).all()
        assert (upper >= true[np.arange(len(x)), near]).all()
        true[np.arange(len(x)), near] = np.inf
        assert (lower <= true.min(1)).all()
        new = np.array([x[near == k].sum(0) // max(1, (near == k).sum()) if (near == k).any() else c[k] for k in range(20)])
        drift, c = centroids.drifts(c, new), new
        scans.append(scanned)
    assert scans[0] == 3000
    assert scans[-1] < 300


def test_trees_settle_most_parts_whole():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(4000, 4)) * 0.1)
    x[1000:2500] = x[7]
    tree = product_codes.Tree.over(x[product_codes.tree_order(x)])
    for book in (np.floor(x[:64]), np.repeat(x[:8], 8, axis=0)):
        entry, sums, counts, compared = product_codes.filtered(tree, book)
        want = np.argmin(((tree.points[:, None] - book[None]) ** 2).sum(2), axis=1)
        assert (entry == want).all()
        assert (counts == np.bincount(want, minlength=64)).all()
        assert all((sums[k] == tree.points[want == k].sum(0)).all() for k in range(64))
        assert compared < 3000  # the copies never reach a leaf comparison
    one = product_codes.Tree.over(x[:1][product_codes.tree_order(x[:1])])
    assert product_codes.filtered(one, x[:1])[0].tolist() == [0]


def test_packed_integers_come_back():
    for top in (0, 3, 40_000, 2**40, 2**63 - 1):
        a = np.array([0, -top, top, -top - 1])
        assert vectors.get(vectors.put(a)).tolist() == a.tolist()


def test_doubles_are_used_as_long_as_they_are_exact():
    for width, most in ((64, 2_900_000), (4, 11_000_000), (4096, 360_000)):
        x = np.array([[most, -most] * (width // 2), [-most, most] * (width // 2)])
        for y in (x, 2 * x):
            made = vectors.exact(y)[0]
            assert (made.dtype == object) is (y is not x)
            assert vectors.as_longs(vectors.squares(made, made))[0].tolist() == [0, sum((int(a) - int(b)) ** 2 for a, b in zip(*y, strict=True))]


# --- syncmers


def poly(codes):
    h = 0
    for c in codes:
        h = (h * syncmers.BASE + c) % syncmers.PRIME
    return h


def anchors_brute(text):
    codes, k, s = list(map(ord, text)), syncmers.K, syncmers.S
    found = {}
    for a in range(len(codes) - k + 1):
        inner = [poly(codes[b : b + s]) for b in range(a, a + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(poly(codes[a : a + k]), a)
    if not found and codes:
        found[(poly(codes) * syncmers.BASE + len(codes)) % syncmers.PRIME] = 0
    return found


def likeness_brute(a, b, most):
    level = lambda f: next(x for x in range(32) if sum(h % 2**x == 0 for h in f) <= most)
    if not a or not b:
        return float(a == b)
    top = 2 ** max(level(a), level(b))
    a, b = ({h: p for h, p in f.items() if h % top == 0} for f in (a, b))
    ps = [b[h] for h in sorted(a, key=a.get) if h in b]
    best = []
    for i, p in enumerate(ps):
        best.append(1 + max((best[j] for j in range(i) if ps[j] < p), default=0))
    return 2 * max(best, default=0) / (len(a) + len(b)) if len(a) + len(b) else 0.0


def prose(rng, n):
    return " ".join(rng.choice("ab cde fghi ärger 漢字 lorem ipsum dolor 😀 sit amet consectetur".split()) + rng.choice(["", str(rng.randrange(50))]) for _ in range(n))


def doc_rows(seed=3):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(25)]
    texts += [None, "", "a", "ab" * 16, "z" * 5000, prose(rng, 3000), texts[3], texts[3] + "!", "\n \t", prose(rng, 31)]
    rows = [(k * 2, t, "en", "s") for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[4], None, None), (None, None, None, None), (None, None, None, None), (6, "other text of one id", "en", "s"), (1, texts[3], "en", "s")]


def against_next_brute(rows, most):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = map(anchors_brute, (t, edited, after))
        out.append((i, len(t), edited, round(likeness_brute(a, e, most), 9), round(likeness_brute(a, n, most), 9)))
    return collections.Counter(out)


@pytest.mark.parametrize(("parts", "most"), [(1, 512), (4, 40)])
def test_against_next_as_brute_force(spark, parts, most):
    rows = doc_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, bucket string").repartition(parts)
    got = syncmers.against_next(docs, most=most).select("doc_id", "n_chars", "edited_text", F.round("near_edited", 9), F.round("near_next", 9))
    assert counted(got) == against_next_brute(rows, most)


def test_all_anchors_of_long_texts_give_exact_likeness(spark):
    rng = random.Random(5)
    head, tail = prose(rng, 1500), prose(rng, 1500)
    rows = [(1, head + " " + tail), (2, tail + " " + head), (3, head), (4, None)]
    assert len(anchors_brute(rows[0][1])) > 2 * syncmers.MOST
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = syncmers.against_next(docs, most=None)
    assert counted(got.select("doc_id", "n_chars", "edited_text", F.round("near_edited", 9), F.round("near_next", 9))) == against_next_brute(rows, 1 << 40)
    marks = {r["doc_id"]: r["fingerprint"] for r in syncmers.fingerprints(docs, most=None).collect()}
    assert marks == {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert len(syncmers._read(marks[1])[1]) == len(anchors_brute(rows[0][1]))


def test_against_next_of_one_many_equal_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert syncmers.against_next(spark.createDataFrame([], schema)).count() == 0
    one = syncmers.against_next(spark.createDataFrame([(1, "abcd" * 20)], schema)).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(80, 1.0)]
    many = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(spark.createDataFrame([(5, "last text")], schema))
    got = counted(syncmers.against_next(many).select("doc_id", "n_chars", "edited_text", "near_next"))
    assert got == {(None, 0, "", 1.0): 2999, (None, 0, "", 0.0): 1, (5, 9, "last ", 0.0): 1}


def test_fingerprints_have_all_anchors_or_a_share_by_content():
    rng = random.Random(8)
    text = prose(rng, 400)
    found, brute = syncmers.anchors(text), anchors_brute(text)
    assert dict(zip(*(x.tolist() for x in found), strict=True)) == brute
    assert sorted(brute.values()) == found[1].tolist()
    few = syncmers._read(syncmers.fingerprint(text, 50))
    assert len(few[1]) <= 50
    assert set(few[1].tolist()) == {h for h in brute if h % 2 ** few[0] == 0}
    big = "".join(rng.choice("abcdefgh ") for _ in range(syncmers.PIECE + 500))
    assert len(syncmers.anchors(big)[0]) > syncmers.PIECE / 20


def test_passages_keep_their_anchors_anywhere():
    rng = random.Random(9)
    a, b, c = prose(rng, 300), prose(rng, 200), prose(rng, 250)
    share = len(a) / (len(a) + (len(b) + len(c)) / 2)
    assert abs(syncmers.likeness(syncmers.fingerprint(a + b), syncmers.fingerprint(c + a)) - share) < 0.06
    assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) < 0.05
    assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(a.replace("lorem", "Lorem", 2))) > 0.9
    swapped = syncmers.likeness(syncmers.fingerprint(a + b), syncmers.fingerprint(b + a))
    assert swapped < (len(a) + 60) / (len(a) + len(b)) + 0.06  # only one of both stays in order


def test_fingerprint_columns(spark):
    docs = spark.createDataFrame([(1, None, "old"), (2, "x" * 50, "old"), (3, "x" * 50, None)], "doc_id int, text string, fingerprint string")
    marks = syncmers.fingerprints(docs)
    assert marks.columns == ["doc_id", "text", "fingerprint"]
    got = {r["doc_id"]: r["fingerprint"] for r in marks.collect()}
    assert got[1] == ""
    assert got[2] == got[3] == syncmers.fingerprint("x" * 50)
    pairs = spark.createDataFrame([("", got[2]), (got[2], got[2]), (None, "")], "a string, b string")
    assert [r["likeness"] for r in syncmers.compared(pairs, "a", "b").collect()] == [0.0, 1.0, None]

"""The operators on texts against brute force, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, fm_index, importance, line_dedup, lm_scoring, minhash, queries, quality_rules, substring_dedup
from tessera.llm.common import Lookup, by_text, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, la, s, len(t or "")) for k, t, la, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, lines with odd spaces, empty and null texts, repeated rows, null ids."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(25)]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(100 + k, base[k], "en", "s0") for k in range(5)]
    for k in range(8):
        w = base[9].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((200 + k, " ".join(w), "fr", None))
    passage = words(rng, 60)
    rows += [(300 + k, f"{words(rng, 40)} {passage}\n{words(rng, 30)}", None, "s1") for k in range(4)]
    rows += [(400, "", "en", "s1"), (401, None, "en", "s1"), (402, " \t\n\r ", "en", "s1"), (403, "One two", "en", "s1"), (404, "one TWO", "en", "s1")]
    rows += [(405, "a\u00a0b c\u3000d \x0b e\x0cf é漢😀", "en", "s1"), (406, "x " * 500, "en", "s1"), (0, base[0], "en", "s0"), (None, base[3], "en", "s0"), (None, "alone " * 3, "en", "s0")]
    return rows


EMPTY = []


def tokens(text):
    return [w for w in (text or "").encode().split()]


def test_word_hashes():
    rows = [b"A b  c", None, b"", b"a\x0bb\x1fc d"]
    h, n = word_hashes(rows, lower=True)
    assert n.tolist() == [3, 0, 0, 3]
    assert [len(x) for x in by_text(h, n)] == [3, 0, 0, 3]
    assert h[0] == h[3] and len(set(h.tolist())) == 5
    many = [f"w{k}".encode() for k in range(50_000)]
    h, _ = word_hashes([b" ".join(many)], lower=False)
    assert len(set(h.tolist())) == len(many)
    assert Lookup(h)(h[::-1]).tolist() == list(range(len(h)))[::-1]
    assert Lookup(np.empty(0, np.uint64))(h[:2]).tolist() == [-1, -1]


def quality_brute(text):
    w = [x.decode() for x in tokens(text)]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, corpus):
    rows = [*corpus, (500, "# " * 60 + words(random.Random(1), 60), "en", "s0"), (501, "\n".join([words(random.Random(2), 20)] * 6), "en", "s1")]
    found = quality_rules.judge(table(spark, rows)).collect()
    assert len(found) == len(rows)
    want = collections.Counter((k, *quality_brute(t)) for k, t, _, _ in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in found}
    assert not by_id[500].kept and by_id[7].kept and by_id[12].kept
    kept = quality_rules.keep(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == sum(r.kept for r in found)
    assert quality_rules.judge(table(spark, EMPTY)).count() == 0


def test_quality_sketches_merge(spark, corpus):
    whole = quality_rules.measure(table(spark, corpus), "m")
    parts = [quality_rules.sketches(quality_rules.measure(table(spark, corpus[k::2]), "m"), "m") for k in range(2)]
    merged = parts[0].unionByName(parts[1]).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert collections.Counter(map(tuple, merged.collect())) == collections.Counter(map(tuple, quality_rules.sketches(whole, "m").collect()))


def test_quality_clashing_columns(spark):
    df = table(spark, [(1, "a b c", "en", "s")]).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    assert [r.n_words for r in quality_rules.judge(df).collect()] == [3]
    assert quality_rules.keep(df).columns == df.columns


def test_byte_bpe(spark, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = queries.token_digests(table(spark, corpus), path).collect()
    want = collections.Counter()
    for k, t, _, _ in corpus:
        ids = own.encode_ordinary(t or "")
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, found)) == want
    rng = random.Random(3)
    encode = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, room=50).encode
    for n in [*range(40), 3000]:
        s = "".join(rng.choice("ab cé漢😀\n\t1'sTh,.") for _ in range(n))
        assert np.frombuffer(encode(s.encode()), "<u4").tolist() == own.encode_ordinary(s)
    assert byte_bpe.decode(byte_bpe.encode(table(spark, EMPTY), ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_fm_index():
    rng = np.random.default_rng(0)
    for sigma in (3, 9, 200):
        t = np.append(rng.integers(1, sigma, 800), 0)
        f = fm_index.FMIndex(t)
        for _ in range(80):
            k, n = int(rng.integers(0, 780)), int(rng.integers(1, 8))
            p = t[k : k + n]
            low, high = np.zeros(1, np.int64), np.full(1, len(t))
            for c in p[::-1]:
                low, high = f.extend(np.array([c]), low, high)
            assert high[0] - low[0] == sum((t[i : i + n] == p).all() for i in range(len(t) - n + 1))


def repeats_brute(texts):
    lists = [tokens(t) for t in texts]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in lists for k in range(len(w) - 34))
    out = []
    for w in lists:
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize(("index_words", "hot"), [(400_000, 4096), (150, 4096), (150, 3)])
def test_substring_dedup(spark, corpus, index_words, hot):
    rng = random.Random(8)
    rows = [*corpus, *[(600 + k, " ".join(rng.choice("ab") for _ in range(120)), "en", "s0") for k in range(6)]]
    found = substring_dedup.remove_repeats(table(spark, rows), index_words=index_words, hot_segments=hot)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    assert got == collections.Counter((k, *x) for (k, *_), x in zip(rows, repeats_brute([r[1] for r in rows]), strict=True))
    assert substring_dedup.remove_repeats(table(spark, EMPTY)).count() == 0


def near_brute(rows):
    sets = []
    for _, t, _, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                up[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(k)
    out = collections.Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        least = min(ids) if ids else None
        for k in members:
            out[rows[k][0], len(sets[k]), least, rows[k][0] == least] += 1
    return out


def test_minhash(spark, corpus):
    rng = random.Random(2)
    base = words(rng, 80).split()
    # A chain of variants: neighbours are similar enough, the ends are not.
    chain = [(700 + k, " ".join([*base[: 60 - 3 * k], *[f"c{j}" for j in range(3 * k)], *base[60:]]), "en", "s") for k in range(12)]
    rows = [*corpus, *chain]
    assert collections.Counter(map(tuple, minhash.near_duplicates(table(spark, rows)).collect())) == near_brute(rows)
    kept = minhash.dedupe(table(spark, [r for r in rows if r[0] is not None]))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == table(spark, rows).columns and len(ids) == len(set(ids))
    assert minhash.near_duplicates(table(spark, EMPTY)).count() == 0


def test_minhash_settles_what_stars_miss(spark, monkeypatch):
    """With one band of one row buckets hold unlike documents, so the exact join has to find the links."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rng = random.Random(4)
    shared = words(rng, 40)
    rows = []
    for g in range(6):
        own = words(rng, 50, 5000)
        for k in range(4):
            w = own.split()
            w[10 * k] = "z"
            rows.append((10 * g + k, f"{shared} {' '.join(w)}", "en", "s"))
    assert collections.Counter(map(tuple, minhash.near_duplicates(table(spark, rows)).collect())) == near_brute(rows)


def test_minhash_dedupe_keeps_one_row_of_each_component(spark):
    """Null and repeated ids neither lose clean documents nor bring copies back."""
    rng = random.Random(14)
    clean = [words(rng, 60, 5000) for _ in range(8)]
    rows = [(None, t, "en", "s") for t in clean[:4]] + [(7, t, "en", "s") for t in clean[4:]]
    rows += [(3, clean[0], "en", "s"), (None, clean[1], "fr", "s"), (7, clean[5], "en", "s"), (None, f"{clean[6]} more", "en", "s"), (9, clean[7].upper(), "en", "s")]
    rows += [(None, None, "en", "s"), (None, None, "en", "s"), (None, " ", "en", "s"), (7, "", "en", "s")]
    out = minhash.dedupe(table(spark, rows))
    want = [(3, clean[0]), *((None, t) for t in clean[1:4]), *((7, t) for t in clean[4:]), (None, None), (None, None), (None, " "), (7, "")]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(want)


def test_importance(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, 80), "en", "s") for k in range(150)] + [(1000 + k, " ".join(f"{w}###" for w in words(rng, 80).split()), "en", "s") for k in range(50)]
    labels = spark.createDataFrame([(k, int(k < 1000)) for k, *_ in rows[::2]] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = importance.classify(table(spark, [*rows, (None, None, None, None), (5000, "", "", "")]), labels).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert sum(k < 1000 for k in kept if k is not None) >= 140 and sum(1000 <= k < 2000 for k in kept if k is not None) <= 5
    again = importance.classify(table(spark, [*rows, (None, None, None, None), (5000, "", "", "")]).repartition(3), labels).collect()
    assert {r.doc_id for r in again if r.kept} == kept
    share = importance.classify(table(spark, rows), labels, share=0.25)
    assert share.filter("kept").count() == 50
    best = sorted(share.collect(), key=lambda r: (-r.key, r.doc_id))[:50]
    assert all(r.kept for r in best)
    assert importance.classify(table(spark, EMPTY), labels).count() == 0


def test_importance_share_is_that_of_all_labels(spark):
    rng = random.Random(17)
    rows = table(spark, [(k, words(rng, 20), "en", "s") for k in range(100)])
    labels = spark.createDataFrame([(k, int(k % 10 < 3)) for k in range(100)], "doc_id long, quality int")
    for most in (1, 7):
        assert importance.classify(rows, labels, most_labels=most).filter("kept").count() == 30


def test_importance_weights(spark):
    """Weights are sums of log ratios of add-one models over the slots of words, pairs and byte trigrams."""
    rng = random.Random(19)
    rows = [(k, words(rng, rng.randrange(0, 30), 40), "en", "s") for k in range(40)] + [(50, None, "", ""), (51, "A", "", ""), (None, "w1 w2 w3", "", ""), (52, "long " * 20_000, "", "")]
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(0, 40, 2)], "doc_id long, quality int")

    def slots(t):
        h, _ = word_hashes([t], lower=True)
        h = h.tolist()
        pairs = importance.join_hash(np.array(h[:-1], np.uint64), np.array(h[1:], np.uint64)).tolist() if len(h) > 1 else []
        low = t.lower()
        three = [int(importance.mix(np.array([low[k] << 16 | low[k + 1] << 8 | low[k + 2]], np.uint64))[0]) for k in range(len(low) - 2)]
        n = importance.SLOTS
        return [x % n for x in h + pairs], [x % n for x in three]

    found = [(k, slots((t or "").encode())) for k, t, *_ in rows]
    ratio = []
    for part in range(2):
        every = collections.Counter(x for _, s in found for x in s[part])
        good = collections.Counter(x for k, s in found if k is not None and k < 20 and k % 2 == 0 for x in s[part])
        n, m = sum(every.values()) + importance.SLOTS, sum(good.values()) + importance.SLOTS
        ratio.append(lambda x, e=every, g=good, n=n, m=m: np.log((g[x] + 1) / m) - np.log((e[x] + 1) / n))
    want = collections.Counter((k, round(sum(ratio[p](x) for p in range(2) for x in s[p]), 6) + 0.0) for k, s in found)
    got = importance.classify(table(spark, rows), labels).collect()
    assert collections.Counter((r.doc_id, round(r.log_weight, 6) + 0.0) for r in got) == want


def test_importance_ties_and_repeats(spark):
    """Repeated rows are taken alike; null ids with different texts are told apart."""
    rng = random.Random(20)
    rows = [(None, words(rng, 30), "en", "s") for _ in range(50)] + [(7, "same text " * 9, "en", "s")] * 40
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    got = importance.classify(table(spark, rows), labels, share=0.5).collect()
    kept = collections.Counter(r.kept for r in got if r.doc_id == 7)
    assert len(kept) == 1 and sum(r.kept for r in got) >= 45
    assert len({r.key for r in got if r.doc_id is None}) == 50


def test_largest_narrows(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 10)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 700).cast("double").alias("key"))
    order = sorted((float(k % 700) for k in range(3000)), reverse=True)
    for k in (1, 9, 500, 2999):
        assert importance.largest(rows, k) == order[k - 1]


def lines_brute(rows, least=1):
    found = []
    for at, (k, t, _, _) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            w = line.encode().split()
            if len(w) >= least:
                found.append(((k if k is not None else 1 << 63, n), at, set(w)))
    gone = collections.defaultdict(set)
    for p, at, s in found:
        for q, _, r in found:
            if q < p and 100 * len(s & r) >= 75 * len(s | r):
                gone[at].add(p[1])
                break
    return gone


def test_line_dedup(spark, corpus, monkeypatch):
    rng = random.Random(9)
    line = words(rng, 24)
    variants = []
    for k in range(30):
        w = line.split()
        w[rng.randrange(24)] = f"v{k}"
        variants.append((800 + k, f"{words(rng, 12)}\n{' '.join(w)}\nshort line\n{words(rng, 7)}", "en", "s"))
    rows = [r for r in [*corpus, *variants] if r != (0, corpus[0][1], "en", "s0")]
    want = lines_brute(rows)
    for star, paired in ((line_dedup.STAR, line_dedup.PAIRED), (2, 3)):
        monkeypatch.setattr(line_dedup, "STAR", star)
        monkeypatch.setattr(line_dedup, "PAIRED", paired)
        got = collections.Counter((r.doc_id, r.n_removed) for r in line_dedup.report(table(spark, rows)).collect())
        assert {k: n for (k, n) in got if k is not None} == {k: len(want[at]) for at, (k, *_) in enumerate(rows) if k is not None}
    out = line_dedup.dedupe(table(spark, rows))
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    for at, (k, t, _, _) in enumerate(rows):
        if k is not None:
            assert texts[k] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[at]))
    assert out.columns == table(spark, rows).columns
    assert line_dedup.report(table(spark, EMPTY)).count() == 0


def test_line_dedup_of_short_lines(spark):
    """The pipeline's stage removes repeats of short lines and of lines without spaces; blank lines stay."""
    import corpus_pipeline

    rng = random.Random(16)
    texts = ["\n".join(words(rng, rng.randrange(1, 7), 5) if rng.random() < 0.8 else rng.choice(["", " ", "漢字の行", "a b c", "a b c d"]) for _ in range(8)) for _ in range(60)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    want = lines_brute(rows, least=1)
    assert sum(map(len, want.values())) > 100
    out = corpus_pipeline.lines(spark, table(spark, rows), "").collect()
    assert {r.doc_id: r.text for r in out} == {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[k]) for k, t, _, _ in rows}


def joined_rows(df):
    """The rows that the joins of a DataFrame's finished plan have made."""
    rows, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if "Join" in name:
            rows += node.metrics().get("numOutputRows").get().value()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in name:
            stack.append(node.plan())
        stack += [node.children().apply(k) for k in range(node.children().size())]
    return rows


def test_line_dedup_verifies_near_copies_in_proportion(spark, monkeypatch):
    """Of 60 near copies, whose words other lines have first, each is compared with few others on its words."""
    made, plain = [], line_dedup.materialize

    def counted(df):
        out = plain(df)
        if "words_a" in df._jdf.queryExecution().analyzed().toString():
            made.append(joined_rows(df))
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    ws, common = [f"w{k}" for k in range(39)], [f"c{k}" for k in range(30)]
    first = [" ".join(ws[k : k + 10] + common) for k in range(0, 39, 10)]
    copies = [" ".join([*ws, f"own{k}"]) for k in range(60)]
    others = [" ".join(common + [f"u{k}v{i}" for i in range(40)]) for k in range(120)]
    got = {r.doc_id: r.n_removed for r in line_dedup.report(table(spark, [(k, x, "en", "s") for k, x in enumerate(first + copies + others)])).collect()}
    assert got == {k: int(4 < k < 64) for k in range(184)}
    assert 0 < sum(made) < 600  # 60 * 59 / 2 pairs, joined twice, are 3,540


def test_line_dedup_keys_lines_by_row(spark):
    """Documents without an id, or with a repeated one, lose their own repeated lines and no others."""
    rng = random.Random(15)
    a, b, c, d, e = (words(rng, 12, 5000) for _ in range(5))
    rows = [(1, a, "en", "s"), (None, f"{b}\n{a}", "en", "s"), (None, f"{c}\n{d}", "en", "s"), (5, f"x\n{e}", "en", "s"), (5, f"y\n{e}", "en", "s"), (5, f"y\n{e}", "fr", "s")]
    out = [r.text for r in line_dedup.dedupe(table(spark, rows), least=5).collect()]
    kept = collections.Counter(x for t in out for x in t.split("\n"))
    assert kept == collections.Counter([a, b, c, d, e, "x", "y", "y"])
    assert sorted(x for x in out if x[0] not in "xy") == sorted([a, b, f"{c}\n{d}"])
    found = line_dedup.report(table(spark, rows), least=5).collect()
    assert collections.Counter((r.doc_id, r.n_lines) for r in found) == collections.Counter((k, len(t.split("\n"))) for k, t, _, _ in rows)
    assert sum(r.n_removed for r in found) == 3


def lm_brute(rows):
    """doc_id, held_out, tokens, known ones, training tokens, base and score of each row, by dictionaries."""
    toks = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    train = [k is not None and zlib.crc32(str(k).encode()) % 10 != 0 for k, *_ in rows]
    c = [collections.Counter() for _ in range(3)]
    for w, use in zip(toks, train, strict=True):
        past = [None, *w]
        for i, x in enumerate(w) if use else ():
            c[0][x] += 1
            c[1][past[i], x] += 1
            if i:
                c[2][past[i - 1], past[i], x] += 1
    total, distinct = sum(c[0].values()), len(c[0])
    out = []
    for (k, *_), w, use in zip(rows, toks, train, strict=True):
        past, base, score = [None, *w], 0.0, 0.0
        for i, x in enumerate(w):
            p = (c[0][x] + 0.1) / (total + 0.1 * (distinct + 1))
            base += np.log10(p)
            contexts = [(c[0][past[i]], c[1][past[i], x])]
            if i:
                contexts.append((c[1][past[i - 1], past[i]], c[2][past[i - 1], past[i], x]))
            for n, both in contexts:
                if n:
                    fail = lm_scoring.FAIL * n**-lm_scoring.FALL
                    p = (1 - fail) * both / n + fail * p
            score += np.log10(p)
        out.append((k, not use, len(w), sum(c[0][x] > 0 for x in w), total, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize(("block", "keys"), [(6_000_000, 250_000), (700, 10)])
def test_lm_scoring(spark, corpus, monkeypatch, block, keys):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    rng = random.Random(11)
    rows = [*corpus, *[(900 + k, words(rng, 60, 30), "en", "s") for k in range(40)], (990, "long " * 30_000, "en", "s")]
    df = table(spark, rows).withColumn("score", F.lit("clash")).withColumn("train", F.lit(1))
    found = lm_scoring.score(df, shard_keys=keys).collect()
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert got == collections.Counter(lm_brute(rows))
    held = [r for r in found if r.held_out and (r.doc_id or 0) >= 900]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score(table(spark, EMPTY)).count() == 0
    assert [r.score for r in lm_scoring.score(table(spark, [(None, "a b", "en", "s")])).collect()] == [0.0]


def test_lm_packing():
    rng = np.random.default_rng(3)
    for m in (0, 1, 7, 3000):
        codes = [np.unique(rng.integers(0, 1 << b, m, dtype=np.uint64)) for b in (36, 20, 63)]
        counts = [rng.integers(0, most, len(c)) for c, most in zip(codes, (2, 300, 1 << 40), strict=True)]
        got = lm_scoring.unpacked(*lm_scoring.packed(counts, codes), coded=True)
        assert all((x == y).all() for x, y in zip([*counts, *codes], [*got[0], *got[1]], strict=True))
        assert all((x == y).all() for x, y in zip(counts, lm_scoring.unpacked(*lm_scoring.packed(counts), coded=False)[0], strict=True))


def test_lm_tells_documents_that_occur_twice_apart_at_any_size(spark):
    """Documents that stand twice among the training texts score higher a token, in a small corpus and a larger one."""
    for size in (150, 900):
        rng = random.Random(size)
        rows = [(2 * k, words(rng, 80, 30 * size), "en", "s") for k in range(size)]
        twice = {k for k, *_ in rows[::10] if zlib.crc32(str(k).encode()) % 10}
        copies = [(k + 1_000_001, t, "en", "s") for k, t, *_ in rows if k in twice and zlib.crc32(str(k + 1_000_001).encode()) % 10]
        twice = {k - 1_000_001 for k, *_ in copies}
        rows += copies
        found = [r for r in lm_scoring.score(table(spark, rows)).collect() if not r.held_out and r.doc_id < 1_000_000]
        gain = sorted(((r.score - r.base_score) / r.n_tokens, r.doc_id in twice) for r in found)
        assert [x for _, x in gain] == sorted(x for _, x in gain)


def lm_counts(rows):
    c = [collections.Counter() for _ in range(3)]
    for w in rows:
        for i, x in enumerate(w):
            c[0][x] += 1
            c[1][w[i - 1], x] += 1
            if i:
                c[2][w[i - 2] if i > 1 else "END", w[i - 1], x] += 1
    return c


def lm_walk(c, w, to):
    """The automaton of one text, walked over its first ``to`` tokens: log probability and failures of each token."""
    past = ["END", *w]
    grams = (w, [(past[i], y) for i, y in enumerate(w)], [(past[i - 1], past[i], y) if i else ("first", y) for i, y in enumerate(w)])
    every = [sorted(set(g), key=repr) for g in grams]
    places = [np.array([e.index(x) for x in g]) for g, e in zip(grams, every, strict=True)]
    counts = [np.array([c[k][x] for x in e], float) for k, e in enumerate(every)]
    machine = lm_scoring.Automaton.of(places, counts, np.array([len(w)]), sum(c[0].values()), len(c[0]))
    failed = []
    return machine.walk(*(p[:to] for p in places), failed), failed


def test_lm_states_are_distributions():
    """In every state the probabilities of all words and of an unseen one sum to one."""
    rng = random.Random(12)
    c = lm_counts([[rng.choice("abcdefgh") for _ in range(40)] + ["END"] for _ in range(30)])
    for context in (["a", "b"], ["h", "h"], ["?", "c"], ["a", "?"], ["b"], []):
        found = []
        for x in [*c[0], "unseen"]:
            w, n = [*context, x, "END"] if x != "END" else [*context, x], len(context)
            found.append(10 ** (lm_walk(c, w, n + 1)[0] - lm_walk(c, w, n)[0]))
        assert abs(sum(found) - 1) < 1e-9


def test_lm_walk_fails_where_training_lacks_the_arc():
    """A walk carries the longest context that training has, and takes a failure arc for each order that has no arc."""
    rng = random.Random(13)
    c = lm_counts([[rng.choice("abcdefghijkl") for _ in range(30)] + ["END"] for _ in range(8)])
    seen = collections.Counter()
    for _ in range(40):
        w = [rng.choice("abcdefghijkl??") for _ in range(25)] + ["END"]
        want, state = [], ("END",)
        for x in w:
            fails = 0
            while state and not c[len(state)][(*state, x)]:
                state, fails = state[1:], fails + 1
            want.append(fails)
            longer = [y for y in ((*state, x)[-2:], (x,)) if c[len(y) - 1][y if len(y) > 1 else y[0]]]
            state = longer[0] if longer else ()
        assert lm_walk(c, w, len(w))[1] == want
        seen.update(want)
    assert min(seen[0], seen[1], seen[2]) > 20

"""Every operator on awkward tables: nulls, empty and very long texts, repeated rows, ties, clashing column names."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, importance, line_dedup, lm_scoring, minhash, mixing, quality_rules, substring_dedup, topk, url_filters
from tests.llm.test_text_operators import lines_brute, near_brute, repeats_brute, words

#: Names that operators use for results and within.
CLASHES = "key node doc part hash size members kept score base_score n_words n_removed kept_text component_id n_shingles block shard found made token_ids decoded lines gone again row class digest log_weight held_out train target taken source_size measures base_failed n_lines bucket __key __gone __row".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    long = words(rng, 12_000, 6000)
    base = [words(rng, rng.randrange(50, 90), 900) for _ in range(12)]
    texts = [*base, base[2], f"{base[3]} x", None, "", " \t\x0b", "one", long, f"new start {long}", "w" * 200_000, "\n".join(base[:4]), f"{base[5]}\n{base[5]}\n"]
    out = [(k, t, rng.choice(["en", None]), rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, base[7], "en", "a"), (None, None, None, None), (None, None, None, None), (3, base[9], "en", "b")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def counted(df, columns):
    return collections.Counter(map(repr, (tuple(r) for r in df.select([F.col(f"`{c}`") for c in columns]).collect())))


def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


LABELS = [(0, 1), (1, 0), (2, 1), (None, 1), (4, None)]
OPERATORS = {
    "judge": lambda s, d: quality_rules.judge(d),
    "keep": lambda s, d: quality_rules.keep(d),
    "round_trip": lambda s, d: byte_bpe.round_trip(d, ranks(), public_tokenizers.PATTERN),
    "remove_repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "near_duplicates": lambda s, d: minhash.near_duplicates(d),
    "dedupe": lambda s, d: minhash.dedupe(d),
    "classify": lambda s, d: importance.classify(d, s.createDataFrame(LABELS, "doc_id long, quality int")),
    "mix": lambda s, d: mixing.mix(d),
    "resample": lambda s, d: mixing.resample(d),
    "report": lambda s, d: line_dedup.report(d),
    "dedupe_lines": lambda s, d: line_dedup.dedupe(d, least=1),
    "score": lambda s, d: lm_scoring.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, rows, name):
    plain = OPERATORS[name](spark, table(spark, rows))
    columns = plain.columns
    awkward = table(spark, rows).withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})
    got = OPERATORS[name](spark, awkward)
    assert set(columns) <= set(got.columns)
    assert counted(got, columns) == counted(plain, columns)
    assert OPERATORS[name](spark, table(spark, [])).count() == 0
    nothing = [(None, None, None, None)] * 3
    assert OPERATORS[name](spark, table(spark, nothing)).count() <= 3


def test_results_on_awkward_rows(spark, rows):
    df = table(spark, rows)
    found = substring_dedup.remove_repeats(df).collect()
    want = collections.Counter((r[0], *x) for r, x in zip(rows, repeats_brute([r[1] for r in rows]), strict=True))
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == want
    assert collections.Counter(map(tuple, minhash.near_duplicates(df).collect())) == near_brute(rows)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mixed)
    alike = collections.defaultdict(set)
    for r in mixed:
        alike[r.doc_id, r.size, r.source].add(r.taken)
    assert len(alike[0, *next((r.size, r.source) for r in mixed if r.doc_id == 0)]) == 1


def test_long_and_repeated_lines(spark):
    rng = random.Random(42)
    long = words(rng, 9000, 20_000)
    rows = [(1, f"{long}\nshort one", "en", "a"), (2, f"{long} more\nshort one", "en", "a"), (3, words(rng, 9000, 20_000), "en", "a"), (4, "same\n" * 50, "en", "a"), (5, "\n".join(words(rng, 6, 3) for _ in range(60)), "en", "a")]
    want = lines_brute(rows, least=1)
    got = {r.doc_id: r.removed for r in line_dedup.report(table(spark, rows), least=1).collect()}
    assert got == {k: ",".join(map(str, sorted(want[at]))) for at, (k, *_) in enumerate(rows)}
    assert "0" in got[2].split(",") and got[4].count(",") == 48


def test_hot_groups_of_unlike_lines(spark, monkeypatch):
    """Many lines that share their rarest words but are not alike: keys are extended to three words, and no pair is lost."""
    monkeypatch.setattr(line_dedup, "STAR", 3)
    monkeypatch.setattr(line_dedup, "PAIRED", 4)
    monkeypatch.setattr(line_dedup, "SLOT_BITS", 2)
    rng = random.Random(43)
    rows = []
    for k in range(90):
        own = [f"r{rng.randrange(6)}" for _ in range(3)] + [f"c{rng.randrange(40)}" for _ in range(rng.randrange(3, 9))]
        rows.append((k, " ".join(own), "en", "a"))
        if k % 4 == 0:
            rows.append((200 + k, " ".join([*own[1:], "z"]), "en", "a"))
    want = lines_brute(rows, least=1)
    got = {r.doc_id: r.removed for r in line_dedup.report(table(spark, rows), least=1).collect()}
    assert got == {k: ",".join(map(str, sorted(want[at]))) for at, (k, *_) in enumerate(rows)}
    assert sum(map(len, want.values())) > 5


def test_bpe_of_long_texts(monkeypatch):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=(held := ranks()), special_tokens={})
    rng = random.Random(44)
    encode = byte_bpe.Encoder(held, public_tokenizers.PATTERN).encode
    one = "".join(rng.choice("abcdeé漢") for _ in range(30_000))
    assert np.frombuffer(encode(one.encode()), "<u4").tolist() == own.encode_ordinary(one)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 1000)
    many = words(rng, 20_000, 5000) + "\n\n  1234567 <|endoftext|> don't"
    assert np.frombuffer(encode(many.encode()), "<u4").tolist() == own.encode_ordinary(many)


def test_minhash_recall_of_buckets():
    """Pairs at a similarity of 0.75 to 0.80 share a bucket, in sets of any size."""
    rng = np.random.default_rng(45)
    missed = {}
    for n in (3, 4, 7, 16, 40, 130, 500, 3000):
        lost, times = 0, 400
        for _ in range(times):
            both = max(-(-3 * n // 4), 1)
            rest = n - both
            x = rng.integers(1, 1 << 63, both + rest, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, both + rest, dtype=np.uint64)
            a, b = np.sort(x), np.sort(x[:both])
            if 4 * len(b) < 3 * len(a):
                continue
            lost += not (minhash.buckets(a) == minhash.buckets(b)).any()
        missed[n] = lost / times
    assert max(missed.values()) <= 0.005, missed


def test_urls_and_vectors_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/1"), (1, "http://a.com/x/1"), (None, None), (2, "http://a.com/" + "d/" * 60)], "page_id long, url string")
    rules = [("a.com", "/x/", "block")]
    plain = url_filters.judge(pages, rules)
    clash = pages.withColumns({c: F.lit(7) for c in ("host", "path", "shape", "template", "purity", "s", "n", "prefix", "in_0", "said", "segments")})
    assert counted(url_filters.judge(clash, rules), plain.columns) == counted(plain, plain.columns)
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<double>")
    plain = topk.dot_search(vectors, F.col("vec_id") == 0)
    clash = vectors.withColumns({c: F.lit(7) for c in ("id", "weights", "score", "rank", "query_id")})
    assert counted(topk.dot_search(clash, F.col("vec_id") == 0), plain.columns) == counted(plain, plain.columns)
    assert [r.vec_id for r in plain.filter("rank <= 2").collect()][:2] in ([3, 3], [3, 5])

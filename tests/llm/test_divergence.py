"""The divergence audit against a loop over dense counts, and its perfect hash."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tickloom.llm import divergence


def hashes(keys):
    return np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_is_minimal_and_rejects_others(n):
    keys = [b"k%d" % i for i in range(n)]
    perfect = divergence.PerfectHash(hashes(keys), keys)
    assert sorted(perfect.slot.tolist()) == list(range(n))
    assert (perfect.find(hashes(keys), pa.array(keys, pa.large_binary())) == perfect.slot).all()
    others = [b"x%d" % i for i in range(500)]
    assert (perfect.find(hashes(others), pa.array(others, pa.large_binary())) == -1).all()


def test_keys_of_one_hash_are_told_apart():
    keys = [b"a", b"b", b"c"]
    perfect = divergence.PerfectHash(np.array([7, 7, 9], np.uint64), keys)
    assert sorted(perfect.slot.tolist()) == [0, 1, 2]
    got = perfect.find(np.array([7, 7, 9, 7, 11], np.uint64), pa.array([*keys, b"d", b"a "], pa.large_binary()))
    assert got.tolist() == [*perfect.slot.tolist(), -1, -1]


def brute(rows, least, top):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for la, _, ts in docs if la == lang for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        sources = sorted({s for la, s, _ in docs if la == lang}, key=lambda s: s.encode())
        count = {s: Counter(t for la, so, ts in docs if (la, so) == (lang, s) for t in ts) for s in sources}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p = {s: shares(c) for s, c in count.items()}
        q = shares(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = [(-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(found), 1)]
            found = [(-f(a, b), t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if count[s][t] and a > b]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"shard_keys": 7, "broadcast_bytes": 60, "tile": 2}])
def test_divergence_against_brute_force(spark, how, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(60)] + ["漢字", "X"]
    said = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 30, 62])]) + rng.choice(["", ".", "7", "\x00"]) for _ in range(n))
    rows = [(said(rng.randrange(1, 40)), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", "Z", "é", None])) for _ in range(250)]
    rows += [rows[0], rows[0], (None, "en", "only null"), ("", "", None), ("12 34", "xx", "a"), ("rare words", "xx", "b"), (said(30_000), "de", "long"), ("z" * 100_000, "en", "a"), ("Aa aA", "en", "a\x00b")]
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BLOCKS", 2)
    monkeypatch.setattr(divergence, "MEMO", 50)
    docs = spark.createDataFrame([(k, *r, 1, 2, 3) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, slot int, term int, count int")
    got = divergence.divergence(docs.repartition(5), least=4, top=3, **how)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert divergence.divergence(docs).count() == 0


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**17 + 7, 3 * 10**18 + 11, 12345), (0, 0, 1), (5, 7, 2), (9 * 10**18, 9 * 10**18, 10**6)]
    got = spark.createDataFrame(rows, "c bigint, n bigint, v bigint").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]

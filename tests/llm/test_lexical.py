"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import lexical

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def said(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(PATTERN, text or "")]


def brute(docs, items, top=10):
    bags = [(i, Counter(said(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(said(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"query_bytes": 400, "width": 12, "block": 3}, {"top": 3, "block": 1}])
def test_search_against_brute_force(spark, how, monkeypatch):
    if how:
        monkeypatch.setattr(lexical, "SHARD", 40)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["Été", "漢字", "MiXed"]
    text = lambda n, sep=" ": sep.join(vocabulary[min(302, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(k, text(rng.randrange(1, 80))) for k in range(300)]
    docs += [(5, docs[9][1]), docs[9], docs[9], (None, docs[9][1]), (900, None), (901, ""), (902, ".,; \x00"), (903, text(20_000)), (904, "a" * 200_000)]
    docs += [(1000 + k, docs[20][1]) for k in range(60)]
    items = [(k, docs[7 * k][1] + " " + text(4)) for k in range(20)] + [(3, text(5)), (4, None), (5, ""), (6, "unheard of"), (7, docs[49][1] + " " + text(4, ".")), (None, docs[20][1]), (30, "w0"), (31, text(400))]
    items += [items[0]]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id bigint, text string, n int, terms int, score int").repartition(3)
    got = lexical.ranked(frame, spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, rank int"), **how)
    rows = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=repr)
    assert rows == brute(docs, [i for i in items if i[1] is not None], how.get("top", 10))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    assert lexical.ranked(docs, items).count() == 0
    assert lexical.ranked(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical.ranked(some, items).count() == 0


def test_blocks_hold_similar_documents_and_bounds_hold(spark):
    """Every posting is in one block of its list, and no member's score exceeds the block's bound."""
    rng = random.Random(8)
    topics = [[f"t{k}x{j}" for j in range(12)] + ["the", "of"] for k in range(4)]
    docs = [(k, " ".join(rng.choice(topics[k % 4]) for _ in range(40))) for k in range(400)]
    items = [(k, " ".join(topics[k])) for k in range(4)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    queries = lexical.read_queries(items, 10, lexical.WIDTH)
    found = frame.sparkSession.createDataFrame(lexical.forward(frame, queries.vocabulary).toPandas(), lexical.FORWARD).coalesce(1)
    queries = lexical.weighed(found, queries)
    rows = lexical.index(found, queries, 16).toPandas()
    cols, weight = queries.cols[0], queries.weight[queries.cols[0]]
    matrix = np.zeros((len(cols), 400), np.int64)
    for r in rows.itertuples():
        if r.term >= 0:
            matrix[r.term, r.docs] = r.impacts
    assert (matrix > 0).sum() == sum(len(r.docs) for r in rows.itertuples())
    pure = 0
    for r in rows[rows.block >= 0].itertuples():
        for q in queries.parts[0]:
            own = queries.own[q]
            if r.term in own:
                bound = sum(int(weight[c]) * int(m) for c, m in zip(r.coords, r.maxima, strict=True) if c in own)
                assert (weight[own] @ matrix[np.ix_(own, r.docs)]).max() == bound or (weight[own] @ matrix[np.ix_(own, r.docs)]).max() < bound
        pure += len({int(d) % 4 for d in r.docs}) == 1
    common = rows[(rows.block >= 0) & rows.term.isin([i for i, c in enumerate(cols) if c in (queries.vocabulary[b"the"], queries.vocabulary[b"of"])])]
    assert np.mean([len({int(d) % 4 for d in r.docs}) == 1 for r in common.itertuples()]) > 0.9

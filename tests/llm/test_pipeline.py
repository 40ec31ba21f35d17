"""The pipeline stage by stage against brute force, each stage on what the one before kept."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_passages, brute_targets, words
from tickloom.llm.bpe import word_bpe_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, data):
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id").quality

    good = stages[0](spark, docs, data).toPandas()
    wrong = sum((i in set(good.doc_id)) != (q == 1) for i, q in labels.items())
    assert list(good.columns) == COLUMNS and wrong <= 0.03 * len(labels)

    one = stages[1](spark, spark.createDataFrame(good), data).toPandas()
    want = brute_groups(list(good[["doc_id", "text", "source"]].itertuples(index=False, name=None)))
    assert sorted(one.doc_id) == sorted(set(want.values())) and list(one.columns) == COLUMNS

    cut = stages[2](spark, spark.createDataFrame(one), data).toPandas().set_index("doc_id")
    for i, text, (removed, kept) in zip(one.doc_id, one.text, brute_passages(list(one.text)), strict=True):
        assert (i in cut.index) == (not removed or kept.strip() != "")
        if i in cut.index:
            assert cut.text[i] == (kept if removed else text) and cut.n_chars[i] == len(cut.text[i])

    frame = cut.reset_index()[COLUMNS]
    mixed = stages[3](spark, spark.createDataFrame(frame), data).toPandas()
    assert list(mixed.columns) == COLUMNS
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    by = frame.assign(w=frame.text.map(size)).groupby("source").w.sum().sort_index()
    taken = mixed.assign(w=mixed.text.map(size)).groupby("source").w.sum().reindex(by.index, fill_value=0)
    assert np.abs(taken.to_numpy() - np.array(brute_targets(list(by)))).max() <= 1
    whole = dict(zip(frame.doc_id, frame.text, strict=True))
    assert all(whole[i].startswith(t) for i, t in zip(mixed.doc_id, mixed.text, strict=True)) and mixed.doc_id.value_counts().max() <= 3

    last = stages[4](spark, spark.createDataFrame(mixed), data).toPandas()
    tok = Tokenizer.from_file(word_bpe_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [tok.encode(t, add_special_tokens=False).ids for t in mixed.text]
    rows = sorted((i, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in zip(mixed.doc_id, ids, strict=True))
    assert sorted(last.itertuples(index=False, name=None)) == rows

    assert sorted(corpus_pipeline.run(spark, data).toPandas().itertuples(index=False, name=None)) == rows


def test_defined_cases_through_the_whole_pipeline(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ids of several texts, clashing columns; then no rows at all."""
    rng = random.Random(3)
    passage = words(rng, 60, 10**6)
    texts = [words(rng, 40 + k) for k in range(30)] + [None, "", " \n", words(rng, 60_000, 10**5), passage, words(rng, 30) + " " + passage, words(rng, 45) + " " + passage + " " + words(rng, 20)]
    rows = [(k, t, None if k % 7 == 0 else "en", ["a", None, "b"][k % 3], None if k % 5 == 0 else len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (4, texts[9] + " more", "en", "a", 5), (None, texts[2], "en", None, 1), (None, "two null ids", None, "a", None)]
    names = ["score", "predicted", "row", "data", "size", "doc", "left", "ctx", "key", "x", "class_id", "head", "times", "shard", "c"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(k, k % 2 if k < 20 else None, 0) for k in range(25)] + [(3, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for at, (d, label) in {"all": (docs, labels), "unlabelled": (docs, labels.limit(0)), "none": (docs.limit(0), labels)}.items():
        d.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        label.write.parquet(f"{tmp_path}/{at}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{at}").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    step = spark.read.parquet(f"{tmp_path}/unlabelled/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = spark.createDataFrame(stage(spark, step, f"{tmp_path}/unlabelled").collect(), docs.schema)
        assert step.columns == docs.columns
        for r in step.collect():
            assert list(r)[5:] == list(range(len(names)))
        kept = Counter(r["text"] or "" for r in step.collect())
        if k == 0:
            assert kept == Counter(r[1] or "" for r in rows)  # without labels nothing is rejected
        if k == 1:
            # texts[9] goes: its near copy has the lesser id.
            assert set(kept) == {t or "" for t in texts if t != texts[9]} | {texts[9] + " more", "two null ids"} and max(kept.values()) == 1
        if k == 2:
            assert not any(passage in t for t in kept) and texts[33] in kept and texts[0] in kept and "" in kept
    assert spark.read.parquet(f"{tmp_path}/none/documents.parquet").count() == 0 and corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

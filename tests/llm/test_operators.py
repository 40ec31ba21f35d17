"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, chat, classifier, fingerprints, metric_join, minhash, mixing, suffix_dedup, token_files, url_filter
from tickloom.llm.common import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, row int, data int, key int, rep int, ids int, start int, bucket int"


def make_docs(spark, rows):
    """rows: (doc_id, text, source). Further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 5, 6, 7, 8) for i, t, s in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), words(rng, 90), words(rng, 30) + " " + base, "", None, "x", "été 漢字 😀 " * 30, words(rng, 9000), "a" * 3000, "ab" * 800, "\n \n  x \t", "one two three four", "one two three four"]
    return [(i, t, ["a", None, "b"][i % 3]) for i, t in enumerate(texts)] + [(3, texts[3], "a")]


# ---- 1


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("length,shrink", [(400, 7), (60, 7), (60, 100), (11, 2), (1, 7)])
def test_suffix_removals(spark, rows, length, shrink):
    docs = make_docs(spark, rows)
    base = suffix_dedup.numbered(docs)
    got = {(r["doc_id"], r["row"]): r for r in suffix_dedup.removals(base, length, shrink=shrink).collect()}
    want = brute_removal([r["data"].decode() for r in base.orderBy("doc_id", "row").collect()], length)
    for r, (n, removed, spans, kept) in zip(base.orderBy("doc_id", "row").collect(), want, strict=True):
        g = got.get((r["doc_id"], r["row"]))
        assert len(r["data"]) == n
        assert (g["n_removed"], g["n_spans"], bytes(g["kept"])) == (removed, spans, kept) if g else removed == 0


def brute_passages(texts, length=51):
    """Of each text the number of words within repeats of length words, and the text without them."""
    bounds = [[m.span() for m in re.finditer(r"[\u3000-\U0010ffff]|[^\t-\r \u3000-\U0010ffff]+", t or "")] for t in texts]
    said = [[t[a:b] for a, b in at] for t, at in zip(texts, bounds, strict=True)]
    count = Counter(tuple(w[p : p + length]) for w in said for p in range(len(w) - length + 1))
    out = []
    for text, w, at in zip(texts, said, bounds, strict=True):
        gone = [any(count[tuple(w[p : p + length])] > 1 for p in range(max(0, k - length + 1), min(k, len(w) - length) + 1)) for k in range(len(w))]
        begins = [a for a, _ in at] + [len(text or "")]
        kept = (text or "")[: begins[0]] + "".join(text[begins[k] : begins[k + 1]] for k, g in enumerate(gone) if not g)
        out.append((sum(gone), kept))
    return out


def test_passages_of_over_50_words(spark, data):
    """Passages of 51 and more words below 400 bytes go, those of 50 words stay, and clean texts are as they were."""
    rng = random.Random(12)
    new = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))
    long, short, wide = [new(51) for _ in range(6)], [new(50) for _ in range(6)], "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(60))
    assert max(len(x) for x in long) < 400
    texts = [new(80) + "\n" + long[k % 6] + " \n " + new(70) for k in range(18)] + [new(40) + " " + short[k % 6] + "  " + new(60) for k in range(18)] + [new(200) for _ in range(10)]
    texts += [new(20) + wide + new(9), wide + new(30), long[0], "", None, " \n", new(5000) + " " + long[1], new(30) + " " + long[2] + " " + long[3] + " " + long[2]]
    docs = make_docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    want = brute_passages(texts)
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_stage(spark, docs, "").collect()}
    assert sum(n > 0 for n, _ in want) == 18 + 2 + 1 + 2
    for k, (n, kept) in enumerate(want):
        if n and not kept.strip():
            assert k not in got
        else:
            assert got[k]["text"] == (kept if n else texts[k]) and got[k]["n_chars"] == len(texts[k] or "") * (not n) + len(kept) * bool(n)
    passages = suffix_dedup.repeated_spans(suffix_dedup.numbered(docs), 51, "words")
    counted = {r["doc_id"]: r["c"] for r in passages.select("doc_id", suffix_dedup.covered(F.col("spans"), 51).alias("c")).collect()}
    assert {k: counted.get(k, 0) for k in range(len(texts))} == {k: n for k, (n, _) in enumerate(want)}
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    base = spark.createDataFrame(real, "doc_id bigint, text string")
    counted = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in suffix_dedup.removals(suffix_dedup.numbered(base), 51, "words", as_text=True).collect()}
    for (i, text), (n, kept) in zip(real, brute_passages([t for _, t in real]), strict=True):
        assert counted.get(i, (0, text)) == (n, kept if n else text)


def test_suffix_random_repeats(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "s") for i in range(60)]
    base = suffix_dedup.numbered(make_docs(spark, rows))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.removals(base, 40).collect()}
    for (i, t, _), (n, removed, spans, kept) in zip(rows, brute_removal([t for _, t, _ in rows], 40), strict=True):
        assert got.get(i, (0, 0, t.encode())) == (removed, spans, kept)


def test_suffix_ranks_are_places_in_order(spark):
    """Pairs of one row drop out; the ranks of the others rise with (rank, added), whatever partition they are in."""
    pairs = [(k % 7, (k * 37) % 11 - 5, k % 3, 1) for k in range(150)] + [(9, 9, 0, 1), (9, 8, 0, 2)]
    found = spark.createDataFrame(pairs, "rank bigint, added bigint, outer bigint, n int").repartition(5)
    scratch = suffix_dedup.Scratch()
    got = sorted((r["next"], (r["rank"], r["added"]), r["mixed"]) for r in suffix_dedup.sorted_ranks(found, scratch).collect())
    count, outers = Counter(), {}
    for rank, added, outer, n in pairs:
        count[rank, added] += n
        outers.setdefault((rank, added), set()).add(outer)
    assert [p for _, p, _ in got] == sorted(p for p, n in count.items() if n > 1)
    assert all(mixed == (len(outers[p]) > 1) for _, p, mixed in got)
    assert suffix_dedup.class_widths(301, 7) == [49, 7, 1] and suffix_dedup.class_widths(2, 7) == [1] and suffix_dedup.class_widths(1, 7) == []


def test_segments_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    data = np.frombuffer("".join(t or "" for _, t, _ in rows).encode(), np.uint8)
    h = suffix_dedup.Hashes(data)
    a, b = np.array([3, 10]), np.array([40, 47])
    assert h.of(a, b)[0] == suffix_dedup.Hashes(data[3:]).of(np.array([0]), np.array([37]))[0]


# ---- 2


def shingle_set(text):
    w = re.findall(r"[^\t-\r ]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_groups(rows):
    """Groups by weighted Jaccard: runs of five words weigh as often as they occur."""
    ids = [i for i, _, _ in rows]
    sets = [shingle_set(t) for _, t, _ in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            same = (rows[x][1] or "") == (rows[y][1] or "")
            if same or sets[x] and (sets[x] & sets[y]).total() >= 0.8 * (sets[x] | sets[y]).total():
                label[root(x)] = root(y)
    least = {}
    for x in range(len(rows)):
        least[root(x)] = min(ids[x], least.get(root(x), ids[x]))
    return {i: least[root(x)] for x, i in enumerate(ids)}


def test_near_duplicates(spark, rows):
    rng = random.Random(2)
    more = list(rows)
    for g in range(15):
        base = words(rng, rng.choice([6, 40, 200]), 5000).split()
        for _ in range(12):
            edited = list(base)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            more.append((100 + len(more), " ".join(edited), "s"))
    found = minhash.groups(minhash.with_digest(make_docs(spark, more))).collect()
    want = brute_groups(more)
    assert len(found) == len(more)
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    docs = make_docs(spark, more)
    kept = minhash.minhash_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == docs.columns


def test_chains_of_near_duplicates(spark, monkeypatch):
    """Texts linked only through one another: the first member of a bucket is not like all of them."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(6)
    rows = []
    for g in range(6):
        text = words(rng, 100, 9000).split()
        for k in range(25):
            text = list(text)
            text[(7 * k) % 100] = f"g{g}k{k}"
            rows.append((1000 * g + (k * 11) % 25, " ".join(text), "s"))
    found = minhash.groups(minhash.with_digest(make_docs(spark, rows)))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute_groups(rows)


def test_texts_that_share_a_doc_id(spark):
    """A doc_id may stand for several texts, or be null: texts are compared and kept on their own."""
    rng = random.Random(9)
    a, b, c, d = (words(rng, 80, 9000) for _ in range(4))
    near = lambda t: t + " x"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, near(c)), (None, d), (None, d), (None, near(d)), (None, near(b)), (5, near(a)), (5, near(a))]
    docs = make_docs(spark, [(i, t, "s") for i, t in rows])
    got = minhash.groups(minhash.with_digest(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in got) == sorted(zip([1, 1, 2, 3, 4, 4, 0, 0, 0, 0, 5, 5], [1, 1, 1, 1, 4, 4, 0, 0, 0, 1, 1, 1]))
    assert sorted((r["class_id"] or 0) for r in got if r["kept"]) == [0, 1, 1, 4]
    kept = [(r["doc_id"], r["text"]) for r in minhash.minhash_stage(spark, docs, "").collect()]
    assert len(kept) == 4 and {(1, a), (1, b)} < set(kept) and sorted(i or 0 for i, _ in kept) == [0, 1, 1, 4]


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    text = np.repeat([0, 1], 300)
    element = np.concatenate([np.arange(300), np.arange(100, 400)]).astype(np.uint64)
    plain = minhash.signatures(text, element, np.ones(600), 2, 4000)
    assert abs((plain[0] == plain[1]).mean() - 0.5) < 0.03
    weight = rng.integers(1, 9, 600).astype(float)
    a, b = (dict(zip(element[s].tolist(), weight[s].tolist(), strict=True)) for s in (slice(0, 300), slice(300, 600)))
    keys = set(a) | set(b)
    jaccard = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    heavy = minhash.signatures(text, element, weight, 2, 4000)
    assert abs((heavy[0] == heavy[1]).mean() - jaccard) < 0.03


@pytest.mark.parametrize("few", [0, 20_000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()}
    assert set(got.values()) == {0, 100} and got[60] == 0 and got[300] == 100


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_of_no_edges(spark, few):
    for edges in ([], [(3, 3)]):
        assert connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect() == []


@pytest.mark.parametrize("few", [0, 20_000])
def test_components_of_long_chains(spark, few):
    """Chains longer than any fixed number of rounds of neighbours' labels: shuffled ids, and the least id at the far end."""
    rng = random.Random(8)
    shuffled = list(range(1000, 1600))
    rng.shuffle(shuffled)
    far = [*range(5001, 5500), 5000]
    edges = [e for chain in (shuffled, far) for e in zip(chain, chain[1:])]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()}
    assert got == dict.fromkeys(shuffled, 1000) | dict.fromkeys(far, 5000)


# ---- 3


def test_token_files(spark, rows, tmp_path):
    path = token_files.byte_bpe_path()
    extra = [(50, "<|endoftext|> hello  world\n \n x", "s"), (51, "tab\tand  spaces   ", "s"), (52, " lead", "s"), (53, "it's don't 12 345!!", "s")]
    docs = make_docs(spark, rows + extra)
    folder = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, folder)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    tok = token_files.Tokenizer.from_file(path)
    at = 0
    for (i, t), g in zip(sorted((i, t or "") for i, t, _ in rows + extra), got, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        counts = np.zeros(n + 5, np.int64)
        counts[:n] = rng.integers(200, 1000, n)
        lengths = token_files.code_lengths(counts)
        heap = [(int(c), k) for k, c in enumerate(counts[:n])]
        heapq.heapify(heap)
        cost = int(counts.sum()) if n == 1 else 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1]))
        assert int((counts * lengths).sum()) == cost
    steep = np.array([1 << min(k, 50) for k in range(40)])
    lengths = token_files.code_lengths(steep)
    assert lengths.max() <= 16 and sum(2.0 ** -int(x) for x in lengths) <= 1
    ids = rng.integers(0, 40, 5000)
    payload, marks = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
    assert np.array_equal(token_files.unpack(payload, marks, len(ids), token_files.decoding_table(lengths)), ids)


def test_more_ids_than_sixteen_bits_number():
    """A vocabulary of which more than 65,536 ids occur gets longer codes, also ones that a third byte doesn't hold."""
    rng = np.random.default_rng(3)
    for n, longest in ((1 << 16, 16), ((1 << 16) + 1, 17), (200_000, 18)):
        counts = rng.integers(1, 1000, n)
        lengths = token_files.code_lengths(counts)
        assert lengths.max() == longest and sum(2.0 ** -k * c for k, c in enumerate(np.bincount(lengths)) if k) <= 1
        ids = np.append(rng.integers(0, n, 3000), [0, n - 1])
        payload, marks = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
        assert np.array_equal(token_files.unpack(payload, marks, len(ids), token_files.decoding_table(lengths)), ids)


def test_special_tokens_of_any_form_and_a_decoder(tmp_path):
    """Special tokens are found by the vocabulary's own list; a vocabulary with a decoder is decoded by it."""
    import json

    with open(bpe.word_bpe_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"] += [{**spec["added_tokens"][0], "id": 49408, "content": "[SEP]"}]
    spec["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}
    path = str(tmp_path / "vocabulary.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library = Tokenizer.from_file(path)
    ours = bpe.PairIndexBPE(path)
    texts = ["one [SEP] two", "[SEP]", "a<|endoftext|>b[sep]", "", "plain words only"]
    for text, ids in zip(texts, ours.encode_batch(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


# ---- 4


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>", "<\\/turn>", "<\\\\/turn>", "####", "#\\##", "", None, "a\nb</turn>\n### User: x", "# ## ###", "\\"]
    rows = [(1, k, ["user", "assistant", "tool: x"][k % 3], t) for k, t in enumerate(odd)] + [(2, 0, None, "x"), (2, 0, "user", "x"), (2, None, "user", "first"), (None, 1, "user", "n")]
    rows += [(3, k, "assistant", f"t{k} ###") for k in range(700)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, piece int")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert all(r["identical"] for r in got.values()) and len(got) == 4
    for conv in got:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv]["formatted"].count("</turn>") == len(mine)
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 5


def test_bpe(spark, rows):
    path = bpe.word_bpe_path()
    extra = [(60 + k, t, "s") for k, t in enumerate(["<|endoftext|>Hi<|startoftext|>", "ΑΣ ςσ İI", "aaaa aaaaaaa", "don't 123 !!??", "ﬁ ꙮ \U0001a8b8x", "\x1c\x85 a"])]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(make_docs(spark, rows + extra), path, slice_chars=500).collect()}
    tok = bpe.Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t, _ in rows + extra:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == want


# ---- 6


def test_fingerprints(spark, rows):
    docs = make_docs(spark, [r for k, r in enumerate(rows) if k < 15])
    near = {r["doc_id"]: (r["text"], r["next_text"]) for r in fingerprints.with_next(docs, per_bucket=4).collect()}
    texts = {i: t or "" for i, t, _ in rows[:15]}
    ids = sorted(texts)
    assert near == {i: (texts[i], texts[ids[k - 1]]) for k, i in enumerate(ids)}
    assert near == {r["doc_id"]: (r["text"], r["next_text"]) for r in fingerprints.with_next(docs, per_bucket=1, max_cuts=3).collect()}
    edited = {r["doc_id"]: r["edited_text"] for r in fingerprints.edited(fingerprints.with_next(docs, 4)).collect()}
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[k - 1]]
        h = len(t) // 2
        assert edited[i] == t[: len(t) - h] + n[:h]
    prints = {r["doc_id"]: r["p"] for r in docs.select("doc_id", fingerprints.fingerprint(fingerprints.leaf_digests(F.coalesce("text", F.lit("")))).alias("p")).collect()}
    for a in ids:
        for b in ids:
            assert (prints[a] == prints[b]) == (texts[a] == texts[b])


def test_next_text_with_a_crowded_id(spark):
    """One id holds most rows, a third of them equal: its rows are dealt out, and the order is that of (id, text hash)."""
    rows = [(7, f"t{k}", "s") for k in range(2000)] + [(7, "same", "s")] * 1500 + [(k, f"u{k}", "s") for k in range(300)] + [(None, None, "s")] * 4
    docs = make_docs(spark, rows)
    sizes = sorted(r["count"] for r in fingerprints.dealt(docs, 100, 16).groupBy("bucket").count().collect())
    assert sizes[-1] <= 5 * sizes[len(sizes) // 2]
    texts = spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()
    h = {r["t"]: r["h"] for r in texts}
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    want = Counter((i, t, ordered[k - 1][1]) for k, (i, t) in enumerate(ordered))
    for how in ((100, 16), (4000, 1024), (50, 3)):
        assert Counter(tuple(r) for r in fingerprints.with_next(docs, *how).collect()) == want


# ---- 7


def plain_features(text):
    """What classifier.features() documents, counted one by one."""
    data = (text or "").encode()
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    if not data:
        return [0.0] * (2 * (len(marks) + 11) + 1)
    chars = [chr(b) for b in data]
    inside = [lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z", lambda c: "0" <= c <= "9", lambda c: c in " \t\r", lambda c: c == "\n"]
    shares = [chars.count(m) / len(data) for m in marks]
    rest = [sum(map(f, chars)) / len(data) for f in inside]
    shares += [1 - sum(shares) - sum(rest), *rest]
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    times = Counter(words)
    shares += [max(1, len(times)) / n, max(times.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines), min(1.0, len(data) / n / 30)]
    shares = [max(0.0, x) for x in shares]
    return shares + [x**0.5 for x in shares] + [np.log1p(len(data)) / 12]


def test_classifier_against_brute_force(spark, rows, data):
    """Features counted one by one; the weights against plain gradient descent on the same pairs; the threshold by trying all."""
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    for t in [*(t for _, t, _ in rows), *docs.text]:
        assert np.allclose(classifier.features(t), plain_features(t), atol=1e-7)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(80, 4)), (np.arange(80) % 3 == 0).astype(int)
    x[:, 0] += y
    model = classifier.fit(x, y, pairs=600, l2=0.05, seed=3)
    z = (x - x.mean(0)) / x.std(0)
    again = np.random.default_rng(3)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[again.choice(good, 600)] - z[again.choice(bad, 600)]
    w = np.zeros(4)
    for _ in range(20_000):
        w += 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 0.05 * w)
    assert np.abs(w - model.weights).max() < 1e-6
    s = z @ model.weights
    wrong = lambda cut: int((s[good] < cut).sum() + (s[bad] >= cut).sum())
    assert wrong(model.threshold) == min(wrong(c) for c in np.append(s, s.max() + 1))
    assert np.allclose((model.score(x) >= 0.3), s >= model.threshold)  # ties of score are judged alike
    equal = classifier.fit(np.ones((6, 2)), np.array([0, 1, 0, 1, 1, 1]))
    assert len(set(equal.score(np.ones((6, 2))))) == 1


def test_classifier(spark, data):
    got = classifier.op7_quality_classifier(spark, data).toPandas()
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() >= 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_classifier_edges(spark, rows):
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(0, 1), (3, 1), (9, None), (99, 7)], "doc_id bigint, quality int")
    model = classifier.train(docs, labels)
    assert classifier.classify(docs, model, "doc_id").where("predicted = 0").count() == 0  # one label only: all are kept
    assert classifier.classify(docs.limit(0), model, "doc_id").count() == 0
    assert not np.isnan([r["score"] for r in classifier.classify(docs, model, "doc_id").collect()]).any()


def test_classifier_learns_once_from_repeated_documents(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    often = docs.unionByName(docs.where("doc_id % 3 = 0").crossJoin(spark.range(20).drop("id")))
    a, b = classifier.train(docs, labels), classifier.train(often, labels)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


# ---- 8


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/x", "https://net", "http://net/", "x.net/en/", None, "", "ftp://b.example.com/de/?q", "http://example.com/d", "http://y.org/fr/", "http://org/fr/a#b", "http://notnet/", "http://xexample.net/en/", "a://b://net/", "http://u@net/x", "http://É.net/en/"]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls + urls[:2])], "page_id bigint, url string, host string, path string, rule string")
    for r in url_filter.filter_urls(df, url_filter.RULES).collect():
        url = (urls + urls[:2])[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(k), k, v) for k, v in url_filter.RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want)
    assert url_filter.filter_urls(df, []).where("rule is not null").count() == 0
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


def test_digest_collisions_are_confirmed(tmp_path):
    url_filter.build_index([("net/", "block"), ("org/", "allow")], f"{tmp_path}/i")
    index = url_filter.DigestIndex(f"{tmp_path}/i")
    index.keys = np.repeat(index.keys[:1], 2)  # both rules under one digest
    assert index.find(np.array([index.rule(0)], object))[0] == 0
    assert index.find(np.array(["else"], object))[0] == -1


# ---- 9


@pytest.mark.parametrize("block,pivots", [(4096, 24), (17, 5), (10, 40), (3, 1)])
def test_metric_join(spark, block, pivots):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, 16)) * 0.28, rng.normal(size=(60, 16))])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v.astype(np.float32).astype(float))]
    rows += [(900, rows[0][1], 1), (901, rows[0][1], 1), (902, [2 * x for x in rows[5][1]], 1), (903, None, 1), (904, [0.0] * 16, 1), (905, [float("nan")] + [1.0] * 15, 1), (906, [None] + [1.0] * 15, 1), (907, [], 1), (900, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_duplicates(df, 0.9, block=block, pivots=pivots).collect()}
    use = {i: np.array(x) for i, x, _ in rows if x and None not in x and np.isfinite(x).all() and np.any(x)}
    ids = sorted(use)
    m = np.array([use[i] / np.linalg.norm(use[i]) for i in ids])
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    for _ in ids:
        label = np.array([min(label[k], *(label[np.flatnonzero(link[k])]), label[k]) if link[k].any() else label[k] for k in range(len(ids))])
    want = {i: (int(link[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i in (903, 904, 905, 906, 907)}
    assert got == want
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_metric_join_of_every_row(spark, block):
    """Two lengths in one table, several vectors under one id, null ids."""
    u, v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, u), (1, v), (2, u), (3, [0.1, 5.0, 0.0]), (8, [0.0, -1.0, 0.0]), (4, [1.0, 1.0]), (5, [2.0, 2.0]), (5, None), (None, w), (None, w), (None, v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in metric_join.near_duplicates(df, 0.9, block=block, pivots=2).collect()]
    want = [(1, 1, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (None, 2, 1, False), (8, 0, 8, True), (4, 1, 4, True), (5, 1, 4, False), (5, 0, 5, True), (None, 1, None, True), (None, 1, None, False)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_long_vectors_near_the_threshold(spark):
    """2,000 dimensions, cosines within 1e-6 of the threshold on either side: float32 products err by more."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(12):
        x = rng.normal(size=2000)
        x /= np.linalg.norm(x)
        y = rng.normal(size=2000)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9 + (1 if k % 2 else -1) * 1e-6
        z = c * x + np.sqrt(1 - c * c) * y
        rows += [(2 * k, x.tolist()), (2 * k + 1, z.tolist())]
        want |= {2 * k: k % 2, 2 * k + 1: k % 2}
    got = metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.9).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want


def test_every_row_of_a_components_least_id_is_kept_by_the_query(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (3, [1.0, 0.0], 0), (4, [0.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["vec_id"], r["component_id"], r["kept"]) for r in metric_join.op9_embedding_near_dedup(spark, str(tmp_path)).collect())
    assert got == [(1, 1, True), (1, 1, True), (3, 1, False), (4, 4, True)]


# ---- 10


def brute_targets(sizes, cap=3.0):
    """sizes: words by source in order; iterative resharing of the excess by weight."""
    weight = [1 + k % 3 for k in range(len(sizes))]
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(target[k] for k in full)
        free = [k for k in range(len(sizes)) if k not in full]
        share = sum(weight[k] for k in free)
        for k in free:
            target[k] = left * weight[k] / share
        over = {k for k in free if target[k] > cap * sizes[k]}
        if not over:
            return target
        for k in over:
            target[k] = cap * sizes[k]
        full |= over


def test_mixing(spark, rows):
    rng = random.Random(8)
    more = [(i, t, s) for i, t, s in rows] + [(1000 + i, words(rng, rng.randint(0, 60)), rng.choice(["a", "b", "c", "tiny", None, "é"]) if i else "tiny") for i in range(400)]
    docs = make_docs(spark, more)
    got = mixing.mix_sources(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in more)
    by = {}
    for i, t, s in more:
        by[s] = by.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, brute_targets([by[s] for s in order]), strict=True))
    taken = {}
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == by[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    counts = Counter(c["shard"] for r in got for c in r["copies"])
    assert set(counts) <= set(range(16)) and max(counts.values()) <= 2 * min(counts.values()) + 8
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_hypergeometric_draws(spark):
    sql = mixing.hypergeometric("good", "total", "draws", "u")
    df = spark.range(20_000).selectExpr("30L as good", "100L as total", "40L as draws", "(id + 0.5D) / 20000D as u")
    x = np.array([r[0] for r in df.selectExpr(f"{sql} as x").collect()])
    assert abs(x.mean() - 12) < 0.02 and abs(x.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.1 and x.min() >= 0 and x.max() <= 30
    edge = spark.createDataFrame([(0, 5, 3, 0.5), (5, 5, 3, 0.5), (3, 9, 9, 0.5), (4, 5, 4, 0.01), (10**6, 3 * 10**6, 10**6, 0.5)], "good bigint, total bigint, draws bigint, u double")
    got = [r[0] for r in edge.selectExpr(f"{sql} as x").collect()]
    assert got[:4] == [0, 3, 3, 3] and abs(got[4] - 333_333) < 5


# ---- empty tables


def test_empty_documents(spark, rows, tmp_path):
    none = make_docs(spark, rows).limit(0)
    assert suffix_dedup.removals(suffix_dedup.numbered(none)).count() == 0
    assert minhash.groups(minhash.with_digest(none)).count() == 0
    token_files.write_token_files(none, token_files.byte_bpe_path(), f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    assert bpe.encode_documents(none, bpe.word_bpe_path()).count() == 0
    assert fingerprints.with_next(none).count() == 0

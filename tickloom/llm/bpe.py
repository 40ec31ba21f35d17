"""BPE encoding and decoding with a pair occurrence index.

Encoding: texts are split at special tokens, normalised (NFC, lower case) and cut into words; each distinct word of a
batch becomes a row of symbols in one flat array. An index maps the rank of every mergeable pair to all positions where
that pair stands, in all words at once. The lowest active rank is taken from a heap, all its positions that still hold
the pair are merged together, and the two pairs that each merge makes go into the lists of their ranks. Words share no
pair, so this gives each word the merges it would get alone, lowest rank first and leftmost first. A rank whose merge
can open a lower one (its product stands in a pair of lower rank) merges one occurrence a word at a time.

Decoding joins the tokens of the ids by spaces when the vocabulary has no decoder, which is how the vocabulary's own
library decodes it; a vocabulary with a decoder is decoded by that.

The vocabulary file (the JSON of the tokenizers library) is a parameter; executors load it by path, once per worker.
What a worker keeps: the vocabulary and at most CACHE distinct words.

Defined cases: null text counts as empty (no ids); special tokens' strings in a text become their ids; repeated rows
are encoded alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tickloom.llm.common import give_back

CACHE = 150_000
#: Characters outside the blocks that the vocabularies' libraries and Python's regex module are known to treat alike.
UNUSUAL = regex.compile("[^\u0000-\u02ff\u0390-\u03ff\u0400-\u04ff\u2000-\u206f\u2190-\u21ff\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndexBPE:
    """A word-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.id_text = [str(i) for i in range(max(self.token) + 1)]
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special))
        self.decoder = spec["decoder"]
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.cutter = Tokenizer.from_file(path)
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.size = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.left, self.right = left, right
        lowest = np.full(self.size, len(merges))
        np.minimum.at(lowest, left, np.arange(len(merges)))
        np.minimum.at(lowest, right, np.arange(len(merges)))
        self.opens_lower = lowest[self.made] < np.arange(len(merges))
        self.known: dict[str, list[int]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        n = len(symbol)
        of = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[ends - lengths] = n
        symbol = np.append(symbol, -1)  # what stands beyond either end of a word
        live = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[first].tolist(), np.split(at, first[1:]), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        rank = self.ranks(symbol[:n], symbol[after])
        found = np.flatnonzero(rank >= 0)
        if len(found):
            enter(found, rank[found])
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[live[at] & (symbol[at] == a) & (symbol[after[at]] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping occurrences the first, third ... of a run are merged
                run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[nth % 2 == 0]
            if self.opens_lower[r] and len(at) > 1:
                first = np.append(True, of[at[1:]] != of[at[:-1]])
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(active, r)
                    at = at[first]
            gone = after[at]
            symbol[at] = self.made[r]
            live[gone] = False
            beyond = after[gone]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            prior = before[at]
            has = prior < n
            where = np.concatenate([prior[has], at])
            rank = self.ranks(symbol[where], symbol[after[where]])
            ok = rank >= 0
            if ok.any():
                enter(where[ok], rank[ok])
        left = np.flatnonzero(live[:n])
        counts = np.bincount(of[left], minlength=len(words))
        ids, stops = symbol[left].tolist(), np.cumsum(counts).tolist()
        return [ids[s - c : s] for s, c in zip(stops, counts.tolist(), strict=True)]

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if UNUSUAL.search(text):
            # Unicode tables differ between libraries here: normaliser and word cutter are the vocabulary's own.
            cut = self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in cut]
        text = unicodedata.normalize("NFC", text)
        # The vocabulary's lower case goes character by character: a capital sigma never becomes a final one.
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.word.findall(low)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [[p for p in self.cut.split(t) if p] if self.cut and self.special_start in t else [t] for t in texts]
        parts = [[self.special[p] if p in self.special else self.words(p) for p in s] for s in split]
        new = set()
        for p in parts:
            for words in p:
                if not isinstance(words, int):
                    new.update(words)
        new.difference_update(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {w for p in parts for words in p if not isinstance(words, int) for w in words}
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, self.merge(fresh), strict=True))
        get = self.known.__getitem__
        return [list(chain.from_iterable([p] if isinstance(p, int) else chain.from_iterable(map(get, p)) for p in s)) for s in parts]

    def decode(self, ids: list[int]) -> str:
        if self.decoder:
            return self.cutter.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids))


_loaded: dict[str, PairIndexBPE] = {}


def loaded(path: str) -> PairIndexBPE:
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, slice_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; path: the vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)

        def encoded(doc_ids: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
            counts, digests, decoded = [], [], []
            for ids in bpe.encode_batch(texts):
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(bpe.id_text.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            arrays = [pa.concat_arrays(doc_ids), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        # An index over many texts has longer lists: batches are gathered up to slice_chars.
        held: list[str] = []
        ids: list[pa.Array] = []
        size = 0
        for batch in batches:
            low = 0
            for at, text in enumerate(batch.column(1).to_pylist(), 1):
                held.append(text or "")
                size += len(held[-1])
                if size >= slice_chars:
                    yield encoded([*ids, batch.column(0).slice(low, at - low)], held)
                    held, ids, size, low = [], [], 0, at
                    give_back()
            ids.append(batch.column(0).slice(low))
        if held:
            yield encoded(ids, held)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path())

"""URL filters: a sorted, memory-mapped array of 64-bit xxhash digests, probed by vectorised binary search.

Rules are (host/path, action). A rule fits its host and every subdomain when the url's path starts with the rule's
path; the longest fitting rule wins. Every (host suffix, path prefix) of a url that could equal a rule is hashed and
looked up with numpy.searchsorted; a hit counts only when the stored rule string itself equals the probe, so digest
collisions cannot decide. The index is one file in the shared folder, handed out with SparkContext.addFile; each
executor fetches it once (a new executor fetches it again) and its Python workers map that copy.

Defined cases: null url or one without "://": host and path are empty, no rule fits. Equal rules: the last listed wins.
Repeated page rows give repeated results. An empty table or empty rule list gives no rows / only defaults. Further
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import put, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index_bytes(rules: list[tuple[str, str]]) -> bytes:
    """The index file: int64 header (keys, path lengths, string bytes), path lengths, sorted digests, spans, strings.

    A span is (start, end, 1 if the action is allow) of a key's rule among the strings.
    """
    unique = dict(rules)
    entries = sorted((xxhash.xxh64_intdigest(rule.encode()), rule, action) for rule, action in unique.items())
    blob, spans = bytearray(), []
    for _, rule, action in entries:
        start = len(blob)
        blob += rule.encode()
        spans.append((start, len(blob), int(action == "allow")))
    lengths = sorted({len(rule) - len(rule.partition("/")[0]) for rule in unique})
    head = np.array([len(entries), len(lengths), len(blob), *lengths], np.int64)
    return head.tobytes() + np.array([e[0] for e in entries], np.uint64).tobytes() + np.array(spans, np.int64).tobytes() + bytes(blob)


def build_index(rules: list[tuple[str, str]], path: str) -> None:
    """Writes the index file to a local path."""
    with open(path, "wb") as f:
        f.write(index_bytes(rules))


class DigestIndex:
    """The index file of build_index(), memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, n_lengths, n_blob = (int(v) for v in raw[:24].view(np.int64))
        ends = np.cumsum([24, 8 * n_lengths, 8 * n, 24 * n, n_blob])
        self.path_lengths = [int(v) for v in raw[ends[0] : ends[1]].view(np.int64)]
        self.keys = raw[ends[1] : ends[2]].view(np.uint64)
        self.spans = raw[ends[2] : ends[3]].view(np.int64).reshape(-1, 3)
        self.blob = raw[ends[3] : ends[4]]

    def find(self, probes: np.ndarray) -> np.ndarray:
        """For each probe string the index of the rule equal to it, or -1."""
        found = np.full(len(probes), -1, np.int64)
        if not len(probes) or not len(self.keys):
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(p.encode()) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        for i in hits:
            k = at[i]
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if bytes(self.blob[self.spans[k, 0] : self.spans[k, 1]]) == probes[i].encode():
                    found[i] = k
                    break
                k += 1
        return found

    def rule(self, k: int) -> str:
        return bytes(self.blob[self.spans[k, 0] : self.spans[k, 1]]).decode()

    def judge(self, hosts: pd.Series, paths: pd.Series, default: str) -> pd.DataFrame:
        """The longest fitting rule of each url, and its verdict."""
        urls = pd.DataFrame({"host": hosts.to_numpy(), "path": paths.to_numpy()})
        best = np.full(len(urls), -1, np.int64)
        length = np.full(len(urls), -1, np.int64)
        suffix, rows = urls.host.to_numpy(object), np.arange(len(urls))
        while len(rows):
            for n in self.path_lengths:
                fits = urls.path.to_numpy(object)[rows]
                long = np.fromiter((len(p) >= n for p in fits), bool, len(fits))
                codes, probes = pd.factorize(np.array([s + p[:n] for s, p in zip(suffix[long], fits[long], strict=True)], object))
                hit = self.find(probes)[codes] if len(probes) else np.zeros(0, np.int64)
                at = rows[long]
                size = np.where(hit >= 0, self.spans[hit, 1] - self.spans[hit, 0], -1) if len(self.spans) else hit
                better = size > length[at]
                best[at[better]], length[at[better]] = hit[better], size[better]
            dots = [s.find(".") for s in suffix]
            keep = np.array([d >= 0 for d in dots], bool)
            suffix = np.array([s[d + 1 :] for s, d in zip(suffix, dots, strict=True) if d >= 0], object)
            rows = rows[keep]
        names = {k: self.rule(k) for k in np.unique(best) if k >= 0}
        verdicts = {k: "allow" if self.spans[k, 2] else "block" for k in names}
        return pd.DataFrame({"rule": [names.get(k) for k in best], "verdict": [verdicts.get(k, default) for k in best]})


_open: dict[str, DigestIndex] = {}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of each url; default: the verdict of urls not in the index."""
    spark = pages.sparkSession
    name = f"url-index-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    put(spark, path, index_bytes(rules))
    spark.sparkContext.addFile(path)

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        if name not in _open:
            _open[name] = DigestIndex(SparkFiles.get(name))
        return _open[name].judge(host, path, default)

    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    parts = pages.select(F.col(id_col), rest.alias("__rest")).select(
        F.col(id_col),
        F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("__host"),
        F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1).alias("__path"),
    )
    got = parts.withColumn("__got", judged("__host", "__path"))
    return got.select(F.col(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__got.rule").alias("rule"), F.col("__got.verdict").alias("verdict"))


#: The rules of the query, in the order given.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP8_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule, h, p, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                     ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path,
         (SELECT max_by(r.rule, length(r.rule)) FROM rules r
          WHERE (parts.host = r.h OR ends_with(parts.host, '.' || r.h)) AND starts_with(parts.path, r.p)) AS rule
  FROM parts)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(r.action, 'allow') AS verdict FROM best b LEFT JOIN rules r ON b.rule = r.rule
"""

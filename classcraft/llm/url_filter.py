"""URL filter: rules first, then word segmentation of hosts and multinomial naive Bayes.

A rule (host, path prefix, verdict) fits its host and all subdomains if the url's path starts with the rule's; the longest
rule that fits decides. Urls that a rule decides are the training rows for those that none does: allow against block.

Host labels and path parts are concatenated names, so they are split into words first, by Viterbi over unigram
probabilities: the split of greatest product, where a word of the lexicon has its share of all words and any other string of
length n a share that falls tenfold with each letter. The lexicon is counted over the visible text of all pages; its `LEXICON` most
frequent words are broadcast (bounded by that parameter). Naive Bayes counts each token by class in `BUCKETS` hashed
buckets with add-one smoothing: at most `BUCKETS` rows come to the driver and are broadcast, whatever the number of urls.

Edge cases: a null url, or one without `://`, has empty host and path and gets the more frequent class of the training rows;
without training rows of both classes the verdict is the one class there is, or allow; null html adds no words; long labels
are split whole; repeated rows count as often as they occur; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXICON = 50_000
MAX_WORD = 24
BUCKETS = 1 << 18
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TAG, _WORD, _PART = re.compile(r"<[^>]*>"), re.compile(r"[a-z]+"), re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, prefix, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name, verdict = F.when(fits, rule_host + prefix).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


# ---------------------------------------------------------------- segmentation

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def send(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for html in batch.column(0):
            counts.update(_WORD.findall(_TAG.sub(" ", (html.as_py() or "").lower())))
            if len(counts) >= 1 << 18:
                yield send(counts)
                counts = Counter()
    if counts:
        yield send(counts)


def lexicon(pages: DataFrame, size: int = LEXICON) -> tuple[dict[str, float], float]:
    """(word -> log10 share of the ``size`` most frequent words, log10 of all words) over all pages' visible text."""
    counts = pages.select("html").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.where(F.length("word") <= MAX_WORD)
    total = counts.agg(F.sum("n")).first()[0] or 1
    top = counts.orderBy(F.col("n").desc(), "word").limit(size).collect()
    return {r.word: math.log10(r.n / total) for r in top}, math.log10(total)


class Segmenter:
    def __init__(self, shares: dict[str, float], log_total: float):
        self.shares, self.unknown, self.known = shares, 1 - log_total, {}

    def split(self, name: str) -> list[str]:
        """The words of a concatenated name; among equal products the one with the longest last word."""
        if name in self.known:
            return self.known[name]
        best, last = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = -math.inf, 0
            for start in range(max(0, end - MAX_WORD), end):
                word = name[start:end]
                score = best[start] + self.shares.get(word, self.unknown - len(word))
                if score > top:
                    top, at = score, start
            best.append(top)
            last.append(at)
        words, end = [], len(name)
        while end:
            words.append(name[last[end]:end])
            end = last[end]
        if len(self.known) > 100_000:  # a memo only
            self.known.clear()
        self.known[name] = words[::-1]
        return self.known[name]

    def tokens(self, host: str | None, path: str | None) -> list[str]:
        out = []
        for mark, text in (("h", host or ""), ("p", (path or "").lower())):
            for part in _PART.findall(text):
                out += [f"{mark}:#"] if part[0].isdigit() else [f"{mark}:{w}" for w in self.split(part)]
        return out


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token) % BUCKETS


# ---------------------------------------------------------------- naive Bayes

class Bayes:
    """log P(block) / P(allow) of a bag of tokens."""

    def __init__(self, rows: list[tuple[int, int, int]], documents: tuple[int, int]):
        self.documents = documents
        counts = np.zeros((2, BUCKETS))
        for at, allow, block in rows:
            counts[0, at], counts[1, at] = allow, block
        used = max(1, len(rows))
        logs = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + used)
        logs[:, counts.sum(axis=0) == 0] = 0  # never seen: says nothing
        self.weights = logs[1] - logs[0]
        self.prior = math.log(documents[1] / documents[0]) if all(documents) else 0.0

    def score(self, tokens: list[str]) -> float:
        if not all(self.documents):
            return 1.0 if self.documents[1] else -1.0
        return self.prior + float(sum(self.weights[bucket(t)] for t in tokens))


def train(urls: DataFrame, words: Segmenter) -> Bayes:
    """From the columns host, path and ruling (allow, block or null)."""
    shared = urls.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for host, path, ruling in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts.update((bucket(t), ruling == "block") for t in shared.value.tokens(host, path))
        rows = sorted(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([n * (not k[1]) for k, n in rows], pa.int64()),
                                          pa.array([n * k[1] for k, n in rows], pa.int64())], names=["bucket", "allow", "block"])

    known = urls.where("ruling IS NOT NULL").select("host", "path", "ruling")
    counts = known.mapInArrow(run, "bucket long, allow long, block long").groupBy("bucket").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    sizes = known.agg(F.count(F.when(F.col("ruling") == "allow", 1)), F.count(F.when(F.col("ruling") == "block", 1))).first()
    return Bayes([tuple(r) for r in counts.collect()], tuple(sizes))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the longest rule's verdict, or else naive Bayes'."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruling = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), ruling.alias("ruling"))
    words = Segmenter(*lexicon(pages))
    shared = pages.sparkSession.sparkContext.broadcast((words, train(urls, words)))

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            names, bayes = shared.value
            yield pa.array([bayes.score(names.tokens(h, p)) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.float64())

    scored = urls.withColumn("score", score("host", "path"))
    guess = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruling", guess).alias("verdict"), "score")

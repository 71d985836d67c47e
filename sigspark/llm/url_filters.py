"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Features: lengths of url, host and path; depth; labels of the host, hyphens in it and its longest run between dots and hyphens; shares of digits and of
other characters; entropy; number of parameters; and of the host's last label and last two labels, and of the words that its labels are made of, the
smoothed block rate among the labelled hosts. A host is one vote; hosts are dealt into folds, and a host's statistics are those of the other folds, in training as in
judging: what trees learn of them is what they say of hosts that weren't seen, and no host is remembered. Features are counted over the bytes of a batch at once; trees (``boosting``) are grown on the driver from at most ``SAMPLE``
labelled URLs (those with the smallest hashes).

Defined results: a null url, or one without ``://``, has empty host and path, matches no rule and goes to
the method; without labelled URLs the method allows everything; equal urls get equal verdicts; rows that repeat give
equal rows; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm import boosting
from sigspark.llm.bytetext import string_buffers

#: Labelled URLs that the trees are trained on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF = 40, 3, 32, 0.2, 2.0
#: Hosts of the overall block rate that a suffix's or word's rate is smoothed by.
PRIOR = 1.0
#: Folds of hosts.
FOLDS = 8

_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)


def host_of(url: str | Column) -> Column:
    at = F.locate("://", url if isinstance(url, str) else url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)), F.lit(""))


def path_of(url: str | Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path); nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, under in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):  # a longer one goes before
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    found = _URL.match(url or "")
    return (found.group(1).translate(_LOWERED), found.group(2)) if found else ("", "")


def _fold(host: str) -> int:
    return zlib.crc32(host.encode()) % FOLDS


def _keys(host: str) -> list[tuple[int, str]]:
    """What a host has votes under: its last label, its last two, and its words."""
    labels = host.split(".")
    return [(0, labels[-1]), (1, ".".join(labels[-2:])), *dict.fromkeys((2, w) for x in labels[:-1] for w in x.split("-") if w)]


def _counted(texts: Sequence[str], kinds: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its bytes, how many of them are of each kind, the entropy of its bytes, the longest run without dot, hyphen or colon."""
    data, at = string_buffers(pa.array(texts, pa.large_string()))
    data = data[at[0] : at[-1]] if len(data) else data
    at = at - at[0]
    n, size = len(texts), np.diff(at)
    row = np.repeat(np.arange(n), size)
    found = np.stack([np.bincount(row[np.isin(data, np.frombuffer(k.encode(), np.uint8))], minlength=n) for k in kinds], axis=1) if kinds else np.zeros((n, 0))
    cells, counts = np.unique(row * 256 + data, return_counts=True)
    share = counts / np.maximum(size, 1)[cells // 256]
    entropy = np.bincount(cells // 256, -share * np.log2(share), n)
    # Ends of runs: separators, and the ends of texts.
    cut = np.union1d(np.flatnonzero(np.isin(data, np.frombuffer(b".-:", np.uint8))), at[1:] - 1)
    cut = cut[cut >= 0]
    run = np.diff(np.concatenate([[-1], cut]))
    longest = np.zeros(n, int)
    np.maximum.at(longest, row[cut], run) if len(cut) else None
    return size, found, entropy, longest


_DIGITS = "0123456789"
_PLAIN = "/.:" + _DIGITS + _UPPER + _LOWER


def lexical(urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """A row of lexical features for each url."""
    size, found, entropy, _ = _counted([u or "" for u in urls], [_DIGITS, _PLAIN, "&", "?"])
    host_size, of_host, _, longest = _counted(hosts, [".", "-", _DIGITS])
    path_size, of_path, _, _ = _counted(paths, ["/", _DIGITS])
    whole = np.maximum(size, 1)
    return np.column_stack([
        size, host_size, path_size, of_path[:, 0], of_host[:, 0] + 1, of_host[:, 1], longest, of_host[:, 2], of_path[:, 1], found[:, 0] / whole, (size - found[:, 1]) / whole, entropy,
        found[:, 2] + (found[:, 3] > 0),
    ]).astype(float)


@dataclass
class Model:
    trees: boosting.Trees
    rate: float = 0.0
    #: By suffix and word, of each fold the blocked hosts and all hosts.
    votes: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)

    def statistics(self, hosts: Sequence[str]) -> np.ndarray:
        """Of each host the rates of its last label, its last two, and the least and greatest of its words."""
        none = np.zeros((FOLDS, 2))

        def rates(host: str) -> tuple[float, ...]:
            out: list[list[float]] = [[], [], []]
            for level, key in _keys(host):
                of_key = self.votes.get((level, key), none)
                blocked, count = of_key.sum(axis=0) - of_key[_fold(host)]
                out[level].append((blocked + PRIOR * self.rate) / (count + PRIOR))
            words = out[2] or [self.rate]
            return out[0][0], out[1][0], min(words), max(words)

        known = {h: rates(h) for h in set(hosts)}
        return np.array([known[h] for h in hosts], float).reshape(len(hosts), 4)

    def probability(self, urls: Sequence[str | None], parts: Sequence[tuple[str, str]] | None = None) -> np.ndarray:
        """Of being blocked. ``parts``: the urls' hosts and paths, if they are known."""
        hosts, paths = zip(*(parts or [_parts(u) for u in urls]), strict=True) if len(urls) else ((), ())
        z = self.trees.margin(np.hstack([lexical(urls, hosts, paths), self.statistics(hosts)])) if len(urls) else np.zeros(0)
        return 1 / (1 + np.exp(-z))


def train(urls: Sequence[str | None], blocked: Sequence[int]) -> Model:
    """Trees for labelled URLs (1: block)."""
    y = np.array(blocked, float)
    hosts, paths = zip(*[_parts(u) for u in urls], strict=True) if len(urls) else ((), ())
    labels: dict[str, list[float]] = defaultdict(list)
    for host, label in zip(hosts, blocked, strict=True):
        labels[host].append(label)
    share = {host: sum(x) / len(x) for host, x in labels.items()}
    sums: dict[tuple[int, str], np.ndarray] = defaultdict(lambda: np.zeros((FOLDS, 2)))
    for host, blocked_share in share.items():
        for key in _keys(host):
            sums[key][_fold(host)] += blocked_share, 1
    model = Model(boosting.Trees(-20.0, DEPTH), sum(share.values()) / max(1, len(share)), dict(sums))
    if len(urls):
        model.trees = boosting.grow(np.hstack([lexical(urls, hosts, paths), model.statistics(hosts)]), y, TREES, DEPTH, BINS, RATE, LEAF)
    return model


def fit(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked") -> Model:
    """A model of labelled URLs: the SAMPLE of them with the smallest hashes.

    Counts of the hashes' first 16 bits tell where the sample ends, so that the driver gets little more than it, whatever the number of
    partitions (each would send a sample of its own); rows that repeat come as one with their number.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(blocked_col).cast("int").alias("blocked")).filter("url is not null and blocked is not null")
    hashed = rows.withColumn("h", F.xxhash64("url")).withColumn("first", F.shiftright("h", 48))
    last, seen = None, 0
    for last, n in sorted(tuple(r) for r in hashed.groupBy("first").agg(F.count(F.lit(1))).collect()):
        seen += n
        if seen >= SAMPLE:
            break
    if last is None:
        return train([], [])
    few = hashed.filter(F.col("first") <= last).groupBy("h", "url", "blocked").agg(F.count(F.lit(1)).alias("n"))
    chosen = [(r.url, r.blocked) for r in few.orderBy("h", "url", "blocked").limit(SAMPLE).collect() for _ in range(min(r.n, SAMPLE))][:SAMPLE]
    return train([r[0] for r in chosen], [r[1] for r in chosen])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every url; score is the method's probability of block."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("said", verdict)
    kind = ruled.schema["page_id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = model.probability(pdf["url"].tolist(), list(zip(pdf["host"], pdf["path"], strict=True)))
            own = np.where(p >= 0.5, "block", "allow")
            yield pdf.assign(verdict=np.where(pdf["said"].isna(), own, pdf["said"]), score=p)[["page_id", "host", "path", "rule", "verdict", "score"]]

    return ruled.mapInPandas(work, f"page_id {kind}, host string, path string, rule string, verdict string, score double")

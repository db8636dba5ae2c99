"""URL filter: rules first, then boosted trees over lexical features.

Rules name a host and the beginning of a path; they hold for the host and its subdomains, and the
longest that fits decides.  Where none fits, gradient-boosted trees judge the URL by its length,
depth, digits, entropy, parameters and by statistics of its suffixes: how many URLs end their host
(or path) the same way, and which share of the labelled ones among them was blocked.

The statistics are counts over all URLs, added up per hashed suffix, so their size is fixed.  While
the trees are trained, a URL sees the labels of the other folds only; else they would just
learn that a suffix repeats the label at hand.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from convq.llm.boosting import Trees, fit_trees

ALLOW, BLOCK = "allow", "block"
SAMPLE_ROWS = 8_000  # labelled URLs that the trees are fitted on
BINS = 1 << 16  # of the hashed suffix statistics
FOLDS = 4
PRIOR = 20.0  # a suffix counts as if so many more labelled URLs of the mean share ended in it
NAMES = (
    "length host_length path_length query_length depth longest_segment labels longest_label host_hyphens "
    "digit_ratio host_digit_ratio longest_digits entropy host_entropy parameters longest_value "
    "escapes secure fragment".split()
)
SUFFIXES = ("1", "2", "3", "host", "file")  # last labels of the host, the whole host, file name suffix


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_and_action(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and what it says, null where none does.

    ``rules`` are ``(text, allow or block)``, the text a host and, from the first slash on, the
    beginning of a path; one without a slash fits any path, an empty one too.  Of equally long
    ones that of the longer host decides.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].find("/"), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(action)
    return rule, action


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host`` and ``path``; columns of these names are replaced."""
    host, path = host_and_path(F.col("url").cast("string"))
    return urls.withColumns({"host": host, "path": path})


def _bins() -> Column:
    """The bins of a URL's suffixes, one per kind; ``_suffix_bins`` does the same in Python."""
    host, path = F.col("host"), F.col("path")
    texts = [F.substring_index(host, ".", -k) for k in (1, 2, 3)]
    texts += [host, F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})\z", 1)]
    return F.array(*[F.crc32(F.concat(F.lit(f"{kind}:"), t)) % BINS for kind, t in zip(SUFFIXES, texts)])


def _suffix_bins(host: str, path: str) -> list[int]:
    labels = host.split(".")
    found = re.search(r"\.([A-Za-z0-9]{1,8})\Z", path)
    texts = [".".join(labels[-k:]) for k in (1, 2, 3)] + [host, found.group(1) if found else ""]
    return [zlib.crc32(f"{kind}:{t}".encode("utf-8", "replace")) % BINS for kind, t in zip(SUFFIXES, texts)]


def _fold(url: Column) -> Column:
    return (F.crc32(url) % FOLDS).cast("int")


@dataclass(frozen=True)
class Statistics:
    """Per bin: URLs, and per fold the labelled and the blocked ones."""

    urls: np.ndarray
    labelled: np.ndarray
    blocked: np.ndarray

    def values(self, bins: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        """Two features per suffix; without the labels of ``fold`` where it is given."""
        labelled, blocked = self.labelled.sum(0)[bins], self.blocked.sum(0)[bins]
        mean = (self.blocked.sum() + 0.5) / (self.labelled.sum() + 1.0)
        if fold is not None:
            labelled = labelled - self.labelled[fold[:, None], bins]
            blocked = blocked - self.blocked[fold[:, None], bins]
        share = (blocked + PRIOR * mean) / (labelled + PRIOR)
        return np.hstack([np.log1p(self.urls[bins]), share])


def statistics(urls: DataFrame) -> Statistics:
    """Counts over all rows of ``urls`` (``url, host, path, label``); at most ``BINS`` rows reach the driver."""
    in_bins = urls.select("label", _fold(F.coalesce(F.col("url"), F.lit(""))).alias("fold"), F.explode(_bins()).alias("bin"))
    counts = [F.count("*").alias("urls")]
    for f in range(FOLDS):
        known = F.col("label").isNotNull() & (F.col("fold") == f)
        counts += [F.count_if(known).alias(f"known{f}"), F.count_if(known & F.col("label")).alias(f"blocked{f}")]
    table = in_bins.groupBy("bin").agg(*counts).toPandas()
    out = Statistics(np.zeros(BINS), np.zeros((FOLDS, BINS)), np.zeros((FOLDS, BINS)))
    at = table["bin"].to_numpy(np.int64)
    out.urls[at] = table["urls"]
    for f in range(FOLDS):
        out.labelled[f, at], out.blocked[f, at] = table[f"known{f}"], table[f"blocked{f}"]
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features of ``NAMES``."""
    query = url.partition("?")[2].partition("#")[0]
    values = [p.partition("=")[2] for p in query.split("&") if p]
    segments, labels = [s for s in path.split("/") if s], host.split(".")
    digits = sum("0" <= c <= "9" for c in url)
    host_digits = sum("0" <= c <= "9" for c in host)
    longest = lambda texts: float(max(map(len, texts), default=0))
    return [
        float(len(url)), float(len(host)), float(len(path)), float(len(query)),
        float(len(segments)), longest(segments), float(len(labels)), longest(labels), float(host.count("-")),
        digits / max(len(url), 1), host_digits / max(len(host), 1), longest(re.findall("[0-9]+", url)),
        _entropy(url), _entropy(host), float(len(values)), longest(values),
        float(url.count("%")), float(url[:6].lower() == "https:"), float("#" in url),
    ]


def _matrix(batch: pd.DataFrame, known: Statistics, fold: np.ndarray | None = None) -> np.ndarray:
    rows = [(u or "", h, p) for u, h, p in zip(batch["url"], batch["host"], batch["path"])]
    plain = np.array([lexical(*r) for r in rows], float).reshape(len(rows), len(NAMES))
    bins = np.array([_suffix_bins(h, p) for _, h, p in rows], np.int64).reshape(len(rows), len(SUFFIXES))
    return np.hstack([plain, known.values(bins, fold)])


@dataclass(frozen=True)
class Model:
    trees: Trees | None
    known: Statistics
    constant: float  # share of blocked URLs, the score where there are no trees


def fit(urls: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``urls`` (``url``, and ``label``: true for blocked, null where not known).

    The trees learn from at most ``sample_rows`` different labelled URLs, those of the smallest
    hashes; of a URL with both labels, blocked counts.  The suffix statistics count all rows, repeats
    included.  With labels of one kind there are no trees and every score is 0 or 1; without any
    it is 0.  A null URL is not learned from.  Runs two jobs.
    """
    rows = parts(urls.select(F.col("url").cast("string").alias("url"), F.col("label").cast("boolean").alias("label")))
    known = statistics(rows)
    labelled = rows.filter("label is not null and url is not null").groupBy("url", "host", "path").agg(F.max("label").alias("label"))
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(sample_rows).withColumn("fold", _fold(F.col("url")))

    def features(batches):
        for batch in batches:
            yield pd.DataFrame({"x": list(_matrix(batch, known, batch["fold"].to_numpy())), "label": batch["label"]})

    found = sample.mapInPandas(features, "x array<double>, label boolean").collect()
    found.sort(key=lambda r: (r["x"], r["label"]))
    y = np.array([r["label"] for r in found], float)
    if len(set(y)) < 2:
        return Model(None, known, float(y.mean()) if len(y) else 0.0)
    return Model(fit_trees(np.array([r["x"] for r in found], float), y), known, float(y.mean()))


def _scorer(model: Model):
    trees, known, constant = model.trees, model.known, model.constant

    @F.pandas_udf("double")
    def score(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.Series:
        if trees is None or not len(url):
            return pd.Series(np.full(len(url), constant))
        return pd.Series(trees.probability(_matrix(pd.DataFrame({"url": url, "host": host, "path": path}), known)))

    return score


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], model: Model, threshold: float = 0.5) -> DataFrame:
    """``urls`` with ``host, path, rule, score, verdict``; columns of these names are replaced.

    ``verdict`` is what the rule says, and where there is none whether the model's ``score`` reaches
    ``threshold``.  Every row is judged on its own: repeated URLs and ids get the same verdict, an
    empty table none.  A null or empty URL has an empty host and path, fits no rule and is scored as an
    empty text; long ones are read whole.
    """
    rows = parts(urls.withColumn("url", F.col("url").cast("string")))
    rule, action = rule_and_action(rules, F.col("host"), F.col("path"))
    scored = rows.withColumns({"rule": rule, "score": _scorer(model)("url", "host", "path")})
    judged = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    return scored.withColumn("verdict", F.coalesce(action, judged))


def labelled_by_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``urls`` with ``label``: blocked or not by the rule that fits, null where none does."""
    host, path = host_and_path(F.col("url").cast("string"))
    return urls.withColumn("label", rule_and_action(rules, host, path)[1] == BLOCK)

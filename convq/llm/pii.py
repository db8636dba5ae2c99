"""Personal data by candidate gradient boosting.

Generators of high recall propose overlapping spans: the base patterns, matches that fail
their checks included, and looser forms (an address with "at" and "dot", a phone number
without plus, digits in odd groups).  Boosted trees judge each candidate by its format and its
context.  Base matches that pass their checks always stay; another candidate is added if its
probability reaches the threshold of its kind and it overlaps no better span.

The trees are trained on the candidates of all texts, equal ones counted.  The checks give the labels,
and every base candidate is also shown in a looser spelling under the same label, so that the
trees learn forms that the base patterns miss.  Loose candidates that the texts themselves hold
have no label; they count as wrong, which keeps prose that looks like an address out.
Thresholds are calibrated on the third of the texts the trees have not seen, against both; a kind that cannot
reach the wanted precision there adds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convq.llm.boosting import Trees, fit_counted
from convq.llm.tables import stored

# ---- fixed values: kinds, base patterns, number of digits, words of the context ----
KINDS = ("email", "ip", "card", "phone")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = range(14, 20)
PHONE_DIGITS = range(10, 16)
LOOSE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:\[at\]|\(at\))\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
        r"(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,4}"
    ),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.\[\]]{1,3}\x20?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{3,6}){2,3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?|[0-9][\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
}
#: What a text must hold for a pattern to match, found faster than by the pattern; see ``_matches``.
NEEDED = {
    IP: re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]"),
    LOOSE["ip"]: re.compile(r"[.\[\]]\x20?[0-9]{1,3}\x20?[.\[\]]{1,3}\x20?[0-9]"),
    LOOSE["card"]: re.compile(r"[0-9]{4}[\x20./_-]{1,2}[0-9]{3}"),
    LOOSE["phone"]: re.compile(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}"),
}
AT = re.compile(r"[\x20\[(]at(?=[\x20\])])")
LOCAL_PART = 64  # of a loose address, at most
HINTS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}
# ---- end of fixed values ----
CONTEXT = 40
#: Steps between 0 and 1 that thresholds are judged at.
LEVELS = 10_000
#: Wanted share of right spans among the added ones, and the least number of them to judge it by.
PRECISION = 0.98
LEAST_SEEN = 10


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        d = int(digit) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, span: str) -> bool:
    """The check of a base match."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in span.split("."))
    digits = _digits(span)
    if kind == "card":
        return len(digits) in CARD_DIGITS and luhn(digits)
    return len(digits) in PHONE_DIGITS


def _emails(text: str):
    """Matches of the base pattern, in time linear in the text, from one at-sign to the next."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LEFT:
            start -= 1
        right = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if right:
            yield start, right.end()
        free = right.end() if right else at + 1
        at = text.find("@", free)


def _loose_emails(text: str):
    """Matches of the loose pattern, from one " at " or "[at]" to the next.

    All starts before such a place have the same rest, so the first one decides.
    """
    free = 0
    for at in AT.finditer(text):
        end = at.start()
        if text[end] != " " and text[max(end - 1, 0)] == " ":
            end -= 1
        start = end
        while start > max(free, end - LOCAL_PART) and text[start - 1] in EMAIL_LEFT:
            start -= 1
        found = LOOSE["email"].match(text, start) if start < end else None
        if found:
            yield found
            free = found.end()


def _matches(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """``pattern.finditer``, but in less time where there is little to find."""
    if pattern is LOOSE["email"]:
        return _loose_emails(text)
    needed = NEEDED.get(pattern)
    return pattern.finditer(text) if needed is None or needed.search(text) else iter(())


def candidates(text: str) -> list[tuple[str, int, int, bool, bool]]:
    """``kind, start, end, base, passes``: all matches of the base patterns and of the loose ones."""
    found = [("email", a, b, True, True) for a, b in _emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in _matches(pattern, text):
            found.append((kind, m.start(), m.end(), True, valid(kind, m.group())))
    known = {c[:3] for c in found}
    for kind, pattern in LOOSE.items():
        for m in _matches(pattern, text):
            if (kind, m.start(), m.end()) not in known:
                found.append((kind, m.start(), m.end(), False, False))
    return found


def features(kind: str, before: str, span: str, after: str) -> list[float]:
    """Numbers of the format of ``span`` and of the text around it."""
    digits, low = _digits(span), before.lower()
    groups = re.findall(r"[0-9]+", span)
    parts = [int(g[-4:]) for g in groups]
    normal = re.sub(r"\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?", "@", span)
    normal = re.sub(r"\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?", ".", normal)
    tail = normal.rpartition(".")[2]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(digits)),
        float(len(span)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(groups) == 4 and all(p <= 255 for p in parts) and all(len(g) <= 3 for g in groups)),
        float(luhn(digits)) if digits else 0.0,
        float(span.count(".")),
        float(span.count("-") + span.count(" ")),
        float("(" in span),
        float(bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", normal))),
        float(tail.isalpha() and 2 <= len(tail) <= 6),
        float(any(hint in low for hint in HINTS[kind])),
        float(before[-1:].isalnum()),
        float(before[-1:] in (".", "-", "/", "#", "$")),
        float(after[:1].isalnum()),
        float(after[:1] in ("-", "/", "%", ":")),
        float(sum(c.isdigit() for c in before[-10:] + after[:10])),
    ]


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def _looser(kind: str, span: str) -> str:
    """The same datum in a spelling that the base pattern does not take."""
    if kind == "email":
        return span.replace("@", " at ", 1)
    if kind == "ip":
        return span.replace(".", "[.]", 1)
    if kind == "card":
        digits = _digits(span)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", span)


def examples(text: str) -> list[tuple[str, bool, bool, list[float]]]:
    """``kind, loose, label, features`` of the base candidates, as they are and respelled, and of
    the loose candidates outside of personal data."""
    rows, found = [], candidates(text)
    sure = [(a, b) for _, a, b, _, passes in found if passes]
    for kind, start, end, base, passes in found:
        if not base and not _overlaps(sure, start, end):
            rows.append((kind, True, False, features(kind, *_around(text, start, end))))
        if base and end - start <= 200:
            before, span, after = _around(text, start, end)
            rows.append((kind, False, passes, features(kind, before, span, after)))
            rows.append((kind, True, passes, features(kind, before, _looser(kind, span), after)))
    return rows


@dataclass(frozen=True)
class Model:
    trees: Trees | None
    thresholds: dict[str, float]


EXAMPLES = "fold int, kind string, loose boolean, label boolean, x array<double>, n bigint"


def _count_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            found = examples(text)
            if found:
                fold = zlib.crc32(text.encode("utf-8", "replace")) % 3
                counts.update((fold, kind, loose, label, tuple(x)) for kind, loose, label, x in found)
        if counts:
            fold, kind, loose, label, x = zip(*counts)
            types = (pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()), pa.int64())
            columns = [pa.array(c, t) for c, t in zip((fold, kind, loose, label, x, counts.values()), types)]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "kind", "loose", "label", "x", "n"])


def _levels(trees: Trees):
    """Loose examples by the level that their score reaches."""

    def score(batches):
        for batch in batches:
            level = np.floor(trees.probability(np.array(batch.column("x").to_pylist(), float)) * LEVELS)
            columns = [batch.column("kind"), pa.array(level.astype(np.int64)), batch.column("label"), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "level", "label", "n"])

    return score


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from the candidates of all texts, on Spark; runs jobs.

    Examples that are equal in all features are one row with a count; they stay on the executors,
    and sums over them come to the driver.  With candidates of one label only there is nothing
    to learn, and no span is added.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    seen = texts.mapInArrow(_count_examples, EXAMPLES).groupBy("fold", "kind", "loose", "label", "x").agg(F.sum("n").alias("n"))
    seen = stored(seen, "examples")
    trees = fit_counted(seen.filter("fold < 2"))
    if trees is None:
        return Model(None, {})
    unseen = seen.filter("fold = 2 and loose").select("kind", "x", "label", "n")
    levels = unseen.mapInArrow(_levels(trees), "kind string, level bigint, label boolean, n bigint").groupBy("kind", "level")
    found = levels.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label"), F.col("n")).otherwise(0)).alias("right")).collect()
    thresholds = {}
    for kind in KINDS:
        rows = sorted(((r["level"], r["n"], r["right"]) for r in found if r["kind"] == kind), reverse=True)
        taken = good = 0
        for level, n, right in rows:  # from the best scores down; the lowest level that is good enough stays
            taken, good = taken + n, good + right
            if right and taken >= LEAST_SEEN and good / taken >= PRECISION:
                thresholds[kind] = max(0.5, level / LEVELS)
    return Model(trees, thresholds)


def spans(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """``kind, start, end, base, score`` of the chosen spans, by start, then kind as listed."""
    found = candidates(text)
    chosen = [(k, a, b, True, 1.0) for k, a, b, base, passes in found if base and passes]
    loose = [c for c in found if not c[3]]
    if loose and model.trees is not None and model.thresholds:
        scores = model.trees.probability(np.array([features(k, *_around(text, a, b)) for k, a, b, *_ in loose]))
        taken = sorted((a, b) for _, a, b, *_ in chosen)
        for (k, a, b, *_), score in sorted(zip(loose, scores), key=lambda c: (-c[1], c[0][1], c[0][2])):
            if score >= model.thresholds.get(k, 2.0) and not _overlaps(taken, a, b):
                chosen.append((k, a, b, False, float(score)))
                taken = sorted([*taken, (a, b)])
    return sorted(chosen, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b in taken)


SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, score: double>>"


def with_spans(docs: DataFrame, model: Model, redact: bool = False) -> DataFrame:
    """``docs`` with ``spans``; with ``redact`` the text has [KIND] in their places.

    Offsets count code points of the text as it was, ends excluded.  Overlapping spans are
    redacted as one, named after the first.  A null text has no spans; when redacting it stays
    null, and ``n_chars``, where there is one, follows the new text.  A column ``spans`` is
    replaced.  Texts are searched whole.
    """
    kept = docs.drop("spans").withColumn("text", F.col("text").cast("string"))
    schema = kept.withColumn("spans", F.lit(None).cast(SPANS)).schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def search(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans(t, model) if t else [] for t in texts]
            columns, names = list(batch.columns), batch.schema.names
            if redact:
                columns[names.index("text")] = pa.array([redacted(t, f) for t, f in zip(texts, found)], pa.string())
            values = [[dict(zip(("kind", "start", "end", "base", "score"), s)) for s in f] for f in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, arrow)], [*names, "spans"])

    out = kept.mapInArrow(search, schema)
    if redact and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def redacted(text: str | None, found: list[tuple]) -> str | None:
    if not found:
        return text
    parts, at, until = [], 0, 0
    for kind, start, end, *_ in found:
        if start >= until:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = until = max(until, end)
    return "".join([*parts, text[at:]])

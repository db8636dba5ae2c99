"""Toxicity scores from misspelled lexicon terms in their context.

The terms form a trie.  A state of the matcher is a set of (trie node, edits so far): the
Levenshtein automata of all terms, walked together with the trie and made deterministic, so
one table lookup per letter decides every word of a text at once.  Short terms must match
exactly, longer ones may differ by one or two edits.

The lexicon is a fixed list and, beside it, words that the labelled sample shows to be typical
of toxic texts, in whatever language and script.  Scripts that put no spaces between words have
runs of two or four letters for words.  A found term counts by its context window: quoted or
reported words speak against abuse, words that address somebody speak for it.  A logistic
regression, fitted on another part of the sample than the words, turns the counts into a score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, deque
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convq.llm.tables import stored

# ---- fixed values: insulting terms; words of reporting and of address ----
LEXICON = """
    clown disgusting garbage idiot imbecile loser lowlife moron parasite pathetic scum stupid
    trash vermin worthless
""".split()
REPORTING = frozenset("called calls means mentions quote quoted quotes said say says term word wrote".split())
ADDRESS = frozenset("all are he r she they u ur you your yours youre".split())
QUOTES = "\"'‘’‚“”„«»‹›`"
# ---- end of fixed values ----
#: Code points around a term that make its context window.
WINDOW = 60
#: At most so many labelled rows, those of the smallest hash of their id, fit the model.
SAMPLE_ROWS = 12_000
#: A word becomes a term if so many toxic texts of the sample have it, and their share is so
#: many times that of the others.
LEAST_TEXTS, LEAST_ODDS = 5, 20.0
#: Terms of one table; more terms make more tables, which keeps each of them small.
TERMS = 256
#: Of the four folds that may be learned from, the last fits the regression.
FIT_FOLD = 4
#: A misspelling found in so many harmless texts of the sample, and in no smaller share of them
#: than of the toxic ones, is a word of its own.
COMMON = 2
#: Code points scanned at once.
BLOCK = 1 << 21
FEATURES = ("exact", "near", "learned", "near_learned", "quoted", "addressed", "density", "loud")
FOLDS = 5
#: Scripts without spaces between words, by the letters that stand for a word: Han and kana; Thai,
#: Lao, Burmese and Khmer.
UNSPACED = {
    2: ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    4: ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)),
}
#: Hangul puts a syllable into a letter, so that words of two count.
HANGUL = r"\x{AC00}-\x{D7A3}"


def allowed(term: str) -> int:
    """Edits that a term may be away: none up to four letters, one up to seven, else two.

    A learned term of five letters or more may be one away.
    """
    if term not in LEXICON:
        return int(len(term) > 4)
    return 0 if len(term) <= 4 else 1 if len(term) <= 7 else 2


@dataclass(frozen=True)
class Table:
    """``step[state, letter]``; ``term[state]`` is the index of the term found, or -1.

    The last letter is any that is not in ``letters``.
    """

    letters: str
    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    shortest: int
    longest: int


@dataclass(frozen=True)
class Automaton:
    """The terms, and tables of at most ``TERMS`` of them each."""

    lexicon: list[str]
    tables: list[Table]


@cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 between words, 1 in words, n where n letters are a word; its lower case."""
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.int32)
    for i in (*range(0x33480), *range(0xE0100, 0xE01F0)):  # all others are unassigned or private
        c = chr(i)
        kinds[i] = c.isalnum() or unicodedata.category(c)[0] == "M"
        if len(l := c.lower()) == 1:
            lower[i] = ord(l)
    for width, ranges in UNSPACED.items():
        for low, high in ranges:
            kinds[low : high + 1] *= width
    return kinds, lower


@cache
def _classes(letters: str) -> np.ndarray:
    """The letter of each code point, whatever its case, kept for the next text."""
    numbers = np.full(0x110000, len(letters), np.int16)
    numbers[[ord(c) for c in letters]] = np.arange(len(letters))
    return numbers[_points()[1]]


def automaton(lexicon: list[str]) -> Automaton:
    """The deterministic automata of all words near a term."""
    starts = range(0, max(len(lexicon), 1), TERMS)
    return Automaton(lexicon, [_table(lexicon[at : at + TERMS], at) for at in starts])


def _table(lexicon: list[str], offset: int) -> Table:
    """The table of some terms, which are numbered from ``offset``."""
    children, accepts, room = [{}], {}, [0]
    for number, term in enumerate(lexicon):
        node = 0
        for letter in term:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                room.append(0)
            node = children[node][letter]
        accepts[node] = number
    for number, term in enumerate(lexicon):  # the most edits that a term below a node may still have
        node = 0
        room[0] = max(room[0], allowed(term))
        for letter in term:
            node = children[node][letter]
            room[node] = max(room[node], allowed(term))

    def closed(pairs: dict[int, int]) -> frozenset:
        todo = deque(pairs.items())
        while todo:  # a letter of the term is left out
            node, edits = todo.popleft()
            if pairs.get(node, 9) < edits:
                continue
            for child in children[node].values():
                if edits + 1 <= room[child] and pairs.get(child, 9) > edits + 1:
                    pairs[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(pairs.items())

    def after(state: frozenset, letter: str) -> frozenset:
        pairs: dict[int, int] = {}

        def reach(node, edits):
            if edits <= room[node] and pairs.get(node, 9) > edits:
                pairs[node] = edits

        for node, edits in state:
            reach(node, edits + 1)
            for own, child in children[node].items():
                reach(child, edits + (own != letter))
        return closed(pairs)

    known = sorted({c for term in lexicon for c in term})
    letters = [*known, ""]
    start = closed({0: 0})
    numbers, states, rows = {start: 0}, [start], []
    for state in states:
        row = []
        for letter in letters:
            target = after(state, letter)
            if target not in numbers:
                numbers[target] = len(states)
                states.append(target)
            row.append(numbers[target])
        rows.append(row)
    term, edits = np.full(len(states), -1, np.int32), np.zeros(len(states), np.int32)
    for i, state in enumerate(states):
        found = [(e, accepts[n]) for n, e in state if n in accepts and e <= allowed(lexicon[accepts[n]])]
        if found:
            edits[i], term[i] = min(found)
    term[term >= 0] += offset
    lengths = [(len(t), allowed(t)) for t in lexicon]
    shortest, longest = min(n - k for n, k in lengths), max(n + k for n, k in lengths)
    return Table("".join(known), np.array(rows, np.int32), term, edits, shortest, longest)


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and ends of the words, and their number; a run without spaces counts as one."""
    kinds = np.concatenate((np.zeros(1, np.uint8), _points()[0][points], np.zeros(1, np.uint8)))
    if kinds.max() == 1:  # spaces between all words
        change = np.flatnonzero(kinds[1:] != kinds[:-1])
        return change[::2], change[1::2], len(change) // 2
    change = np.flatnonzero(np.diff(kinds))
    run = kinds[change[:-1] + 1]
    first, last, width = change[:-1][run > 0], change[1:][run > 0], run[run > 0].astype(np.int64)
    size = last - first
    whole = (width == 1) | (size < width)
    n = np.where(whole, 1, size - width + 1)
    owner = np.repeat(np.arange(len(n)), n)
    starts = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return starts, starts + np.where(whole, size, width)[owner], len(first)


def find_terms(points: np.ndarray, machine: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """``start, end, term, edits`` of the words that match, and the number of words."""
    starts, ends, n_words = _words(points)
    best, edits = np.full(len(starts), -1, np.int32), np.full(len(starts), 1 << 20, np.int32)
    for table in machine.tables:
        size = ends - starts
        fits = np.flatnonzero((size >= table.shortest) & (size <= table.longest))
        begin, size = starts[fits], size[fits]
        state = np.zeros(len(fits), np.int32)
        padded = np.concatenate((_classes(table.letters)[points], np.zeros(table.longest, np.int16)))
        for i in range(table.longest):
            state = np.where(size > i, table.step[state, padded[begin + i]], state)
        better = (table.term[state] >= 0) & (table.edits[state] < edits[fits])
        best[fits[better]], edits[fits[better]] = table.term[state[better]], table.edits[state[better]]
    found = best >= 0
    return starts[found], ends[found], best[found], edits[found], n_words


def _quoted(text: str, start: int, end: int) -> bool:
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    near = any(q in before[-2:] for q in QUOTES) and any(q in after[:2] for q in QUOTES)
    doubles = "\"“„«"
    open_quote = max(before.rfind(q) for q in doubles)
    closed = any(q in after for q in "\"”“»")
    return near or (open_quote >= 0 and closed and before.count('"') % 2 == 1)


def hits(text: str, machine: Automaton) -> tuple[list[dict], int]:
    """Every term found in a text, with its context, and the number of words of the text."""
    found, n_words, at = [], 0, 0
    while at < len(text):
        until = min(len(text), at + BLOCK)
        while until < len(text) and _points()[0][ord(text[until])]:  # never cut a word
            until += 1
        points = np.frombuffer(text[at:until].encode("utf-32-le", "replace"), np.uint32)
        starts, ends, terms, edits, n = find_terms(points, machine)
        n_words += n
        for start, end, term, distance in zip(starts + at, ends + at, terms, edits):
            around = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
            words = set("".join(c if c.isalnum() else " " for c in around.lower()).split())
            found.append(
                {
                    "start": int(start),
                    "end": int(end),
                    "term": int(term),
                    "edits": int(distance),
                    "learned": machine.lexicon[term] not in LEXICON,
                    "surface": text[start:end].lower(),
                    "quoted": _quoted(text, start, end) or bool(words & REPORTING),
                    "addressed": bool(words & ADDRESS),
                    "loud": "!" in text[end : end + 3] or text[start:end].isupper(),
                }
            )
        at = until
    return found, n_words


def features(found: list[dict], n_words: int, common: frozenset[str]) -> list[float]:
    """The numbers of ``FEATURES`` for one text."""
    real = [h for h in found if not h["edits"] or h["surface"] not in common]
    return [
        *(np.log1p(sum((h["edits"] > 0) == near and h["learned"] == learned for h in real)) for learned in (False, True) for near in (False, True)),
        np.log1p(sum(h["quoted"] for h in real)),
        np.log1p(sum(h["addressed"] and not h["quoted"] for h in real)),
        min(1.0, 20 * len(real) / max(n_words, 20)),
        np.log1p(sum(h["loud"] for h in real)),
    ]


@dataclass(frozen=True)
class Model:
    machine: Automaton
    weights: np.ndarray  # of FEATURES, then the constant
    common: frozenset[str]

    def score(self, found: list[dict], n_words: int) -> float:
        z = float(np.dot(self.weights[:-1], features(found, n_words, self.common)) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str = "doc_id"):
    """True for a fifth of the ids, which never fit the model; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the ridge-penalised logistic loss; the constant is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _patterns() -> list[str]:
    """Patterns of the words that may become terms, as ``_words`` cuts them, in their first group."""
    ranges = {n: "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in all_of) for n, all_of in UNSPACED.items()}
    spaced = rf"[\p{{L}}\p{{M}}&&[^{''.join(ranges.values())}]]"
    runs = [rf"(?=([\p{{L}}\p{{M}}&&[{own}]]{{{n}}}))" for n, own in ranges.items()]
    return [rf"({spaced}{{4,24}}|[{HANGUL}]{{2,3}})", *runs]


def learned_terms(sample: DataFrame) -> list[str]:
    """Words of ``sample`` (``text, toxic``) that are typical of toxic texts."""
    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    words = F.array_distinct(F.concat(*(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(1)) for p in _patterns())))
    odds = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (clean + 1))
    counts = (
        sample.select("toxic", F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.count_if("toxic").alias("bad"))
        .filter(F.col("bad") >= LEAST_TEXTS)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_ODDS)
    )
    return sorted({r["word"] for r in counts.select("word").collect()} - set(LEXICON))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Terms and weights from at most ``sample_rows`` labelled rows outside the held-out fifth.

    ``labels`` has ``doc_id, toxic``; rows without either are passed over.  Where the part that
    fits the weights has no labels, or only one kind, fixed weights stand in.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).select("doc_id", "toxic")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    chosen = chosen.select("doc_id", (F.col("toxic") > 0).alias("toxic"), fold.alias("fold"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold"), "sample")  # sample_rows ids at most
    machine = automaton([*LEXICON, *learned_terms(sample.filter(F.col("fold") != FIT_FOLD).select("text", "toxic"))])
    rows = sample.filter(F.col("fold") == FIT_FOLD).select("text", F.col("toxic").cast("bigint").alias("toxic"))
    names = ("edits", "learned", "surface", "quoted", "addressed", "loud")
    kinds = dict(zip(names, (pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())))
    arrow = pa.schema([("hits", pa.list_(pa.struct(list(kinds.items())))), ("n_words", pa.int64()), ("toxic", pa.int64())])

    def scan(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                found, n = hits(text.as_py() or "", machine)
                out.append({"hits": [{k: h[k] for k in names} for h in found], "n_words": n, "toxic": int(toxic.as_py() > 0)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = (
        "hits array<struct<edits: bigint, learned: boolean, surface: string, quoted: boolean, addressed: boolean, loud: boolean>>, "
        "n_words bigint, toxic bigint"
    )
    sample = [(r["hits"], r["n_words"], r["toxic"]) for r in rows.mapInArrow(scan, schema).collect()]
    seen = [Counter(s for found, _, toxic in sample if toxic == y for s in {h["surface"] for h in found if h["edits"]}) for y in (0, 1)]
    y = np.array([toxic for *_, toxic in sample], float)
    bad, clean = int(y.sum()), len(y) - int(y.sum())
    common = frozenset(s for s, n in seen[0].items() if n >= COMMON and n * bad >= seen[1][s] * clean)
    if len(y) == 0 or y.min() == y.max():
        return Model(machine, np.array([6.0, 4.0, 3.0, 1.0, -2.0, 1.0, 1.0, 1.0, -2.0]), common)
    x = np.array([features(found, n, common) for found, n, _ in sample])
    return Model(machine, _logistic(x, y), common)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``terms``: start, end, term, edits, quoted of each hit.

    A null text counts as empty.  Columns of those names are replaced; offsets count code
    points.  Texts are scanned whole.
    """
    machine = model.machine
    kept = docs.drop("score", "terms")
    terms = "array<struct<start: bigint, end: bigint, term: string, edits: bigint, quoted: boolean>>"
    schema = kept.withColumn("score", F.lit(0.0)).withColumn("terms", F.lit(None).cast(terms)).schema
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_())]))

    def score(batches):
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(text_col):
                found, n = hits(text.as_py() or "", machine)
                scores.append(model.score(found, n))
                spans.append([{k: machine.lexicon[h[k]] if k == "term" else h[k] for k in ("start", "end", "term", "edits", "quoted")} for h in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, arrow)], [*batch.schema.names, "score", "terms"]
            )

    return kept.mapInArrow(score, schema)

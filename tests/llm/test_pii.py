import random
import time

import numpy as np

from . import brute
from convq.llm import boosting, pii

TEXTS = [
    "write to a.b+c@mail.example.com or x@y or @z.com or a@@b.co", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.2.3.4 1.2.3.0255",
    "4417 7442-8035 1547 then 4417744280351548 and 1", "+1 (171) 555-2028, +12 34, +1234567890123456 ++1 555 555 5555", "", None, "none here",
    "q@a-b.c.d.e, 9999999999999999999999999 1" * 3, "é@ü.de ünï@x.yz.ab +49 30 1234567",
]


def base_of(text):
    return [f"{k}:{a}:{b}" for k, a, b, base, _ in pii.spans(text or "", pii.Model(None, {})) if base]


def test_base_matches_equal_the_patterns():
    rng = random.Random(2)
    made = ["".join(rng.choice("ab1.2@+- ()59%_") for _ in range(80)) for _ in range(3000)]
    for text in [*TEXTS, *made]:
        assert base_of(text) == brute.base_pii(text)


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "(at)" * 100_000):
        pii.spans(text, pii.Model(None, {}))
    assert time.time() - start < 30


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    trees = boosting.fit_trees(x[:400], y[:400])
    assert ((trees.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.95


def corpus(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        card = [rng.randint(0, 9) for _ in range(15)]
        check = next(d for d in range(10) if pii.luhn("".join(map(str, [*card, d]))))
        digit = check if i % 2 else (check + 1) % 10
        number = "".join(map(str, [*card, digit]))
        rows.append((i, f"mail {i}@mail{i % 7}.example.com ip 10.0.{i % 300}.{i % 400} pay {number} call +1 (123) 555-{i % 10000:04d} end", "s", 1))
    return rows


def test_model_adds_spans_and_keeps_the_base(table):
    rows = corpus() + [(1000, "reach me: john at mail.example.com or call 123 555 0199 now", "s", 1), (1001, None, None, None), (1002, "", "s", 0)]
    df = table(rows, "doc_id bigint, text string, source string, spans int")
    model = pii.fit(df)
    assert model.trees is not None and model.thresholds
    out = {r["doc_id"]: r["spans"] for r in pii.with_spans(df, model).collect()}
    for doc, text, *_ in rows:
        spans = [f"{s['kind']}:{s['start']}:{s['end']}" for s in out[doc]]
        assert [x for x, s in zip(spans, out[doc]) if s["base"]] == brute.base_pii(text)
    assert any(not s["base"] for s in out[1000])


def test_redaction(table):
    df = table([(1, "x a@b.cd y 1.2.3.4 z", 20), (2, None, None), (3, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.with_spans(df, pii.Model(None, {}), redact=True).collect()}
    assert out == {1: ("x [EMAIL] y [IP] z", 18), 2: (None, None), 3: ("clean", 5)}
    assert pii.redacted("abcdef", [("ip", 0, 3), ("card", 2, 5)]) == "[IP]f"


def test_empty(table):
    df = table([], "doc_id bigint, text string")
    model = pii.fit(df)
    assert model.trees is None and pii.with_spans(df, model).count() == 0


def test_trees_of_a_counted_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, size=(900, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 3).astype(float)
    counts = {}
    for row, label in zip(x.tolist(), y):
        counts[(bool(label), *row)] = counts.get((bool(label), *row), 0) + 1
    table = spark.createDataFrame([(k[0], list(k[1:]), n) for k, n in counts.items()], "label boolean, x array<double>, n bigint")
    want, got = boosting.fit_trees(x, y, trees=4), boosting.fit_counted(table.repartition(3), trees=4)
    assert got.start == want.start
    assert np.allclose(got.probability(x), want.probability(x), atol=1e-5)
    assert boosting.fit_counted(table.filter("label")) is None and boosting.fit_counted(table.limit(0)) is None


def test_the_model_learns_from_all_texts(table):
    rows = corpus(5000)
    rows.append((None, "an ip 10.1.2.3", "s", 1))
    model = pii.fit(table(rows, "doc_id bigint, text string, source string, spans int"))
    labels = [y for r in rows if pii.zlib.crc32(r[1].encode()) % 3 < 2 for _, _, y, _ in pii.examples(r[1])]
    ones = sum(labels)
    assert len(labels) > 4000 and np.isclose(model.trees.start, np.log(ones / (len(labels) - ones)))


def test_faster_search_finds_what_the_patterns_find():
    rng = random.Random(3)
    parts = ["a", "b.c", " ", "at", " at ", " [at] ", "(at)", " dot ", "[dot]", ".", "12", "123", "4567", "-", "(", ")", "/", "+", "00", "[", "]", "@", "x" * 70]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        for pattern in (*pii.LOOSE.values(), pii.IP, pii.CARD, pii.PHONE):
            assert [m.span() for m in pii._matches(pattern, text)] == [m.span() for m in pattern.finditer(text)]

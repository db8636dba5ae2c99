import re

import pytest

from convq.llm import decontaminate

ITEMS = "item_id bigint, text string"


def plain(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def report(docs, items, **options):
    rows = decontaminate.report(docs, items, **options).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows], key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
DOCS = [
    (1, f"Before it: {PASSAGE.upper()}, and after"), (2, PASSAGE[4:]), (3, PASSAGE.replace("seven", "sieben")), (4, None), (5, ""),
    (6, "the the the the " * 50 + PASSAGE), (7, "short item"), (7, "short item"), (None, "a short item here"), (8, "É é short Été item"),
    (9, PASSAGE + " filler" * 400), (10, "the " * 3000),
]
BENCHMARK = [(10, PASSAGE), (11, "x " + PASSAGE[:60]), (2, "short, ITEM!"), (2, "Été"), (3, None), (4, "..."), (None, "filler filler"), (5, "the " * 20)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_against_plain(table, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    docs, items = table([(*d, 1) for d in DOCS], "doc_id bigint, text string, n_words int"), table(BENCHMARK, ITEMS)
    assert report(docs, items) == plain(DOCS, BENCHMARK)


def test_other_windows(table):
    docs, items = table(DOCS, "doc_id bigint, text string"), table(BENCHMARK, ITEMS)
    assert report(docs, items, window=4, shingle=2) == plain(DOCS, BENCHMARK, 4)


def test_clean_keeps_columns_and_clean_rows(table):
    docs, items = table([(*d, "s") for d in DOCS], "doc_id bigint, text string, source string"), table(BENCHMARK, ITEMS)
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns
    want = sorted(str(d) for d, *_, bad in plain(DOCS, BENCHMARK) if not bad)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == want


def test_empty(table):
    docs, none = table(DOCS, "doc_id bigint, text string"), table([], ITEMS)
    assert all(r[2] == 0 and not r[4] for r in report(docs, none))
    assert report(docs.limit(0), table(BENCHMARK, ITEMS)) == []


def test_no_python_on_the_executors(table):
    docs, items = table(DOCS, "doc_id bigint, text string"), table(BENCHMARK, ITEMS)
    plan = decontaminate.report(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

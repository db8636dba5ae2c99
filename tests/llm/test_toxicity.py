import random

import numpy as np
from pyspark.sql import functions as F

from . import brute
from convq.llm import toxicity


def test_automaton_equals_edit_distance():
    lexicon = ["scum", "idiot", "worthless", "réeux"]
    machine = toxicity.automaton(lexicon)
    rng = random.Random(3)
    words = lexicon + ["idi0t", "idoit", "wortless", "wrthles", "scam", "RÉEUX", "reeux"]
    for term in lexicon * 100:
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é", "t", "7"])
        words.append("".join(w))
    for word in filter(None, words):
        found, n = toxicity.hits(word, machine)
        best = min((brute.edit_distance(word.lower(), t), t) for t in lexicon)
        near = [t for t in lexicon if brute.edit_distance(word.lower(), t) <= toxicity.allowed(t)]
        assert bool(found) == bool(near), word
        if found:
            assert found[0]["edits"] == min(brute.edit_distance(word.lower(), t) for t in near) and best and n == 1


def test_context_and_places():
    machine = toxicity.automaton(toxicity.LEXICON)
    text = 'She said "idiot" is a term. ' + "filler " * 30 + "You are a WORTHLES clown!"
    found, _ = toxicity.hits(text, machine)
    assert [(text[h["start"] : h["end"]], h["quoted"], h["edits"]) for h in found] == [("idiot", True, 0), ("WORTHLES", False, 1), ("clown", False, 0)]
    assert found[1]["addressed"] and found[2]["loud"]


def test_words_are_not_cut_between_blocks(monkeypatch):
    machine = toxicity.automaton(toxicity.LEXICON)
    text = "idiot scum stupid xx " * 50
    whole = toxicity.hits(text, machine)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert toxicity.hits(text, machine) == whole


def labelled(n=600):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = list(rng.choice(["tree", "house", "river", "cloud", "stone"], 30))
        if bad:
            words[5:7] = list(rng.choice(["idiot", "scum", "abscheu", "stupid"], 2))
        rows.append((i, " ".join(words), 0.25))
        labels.append((i, int(bad)))
    return rows, labels


def test_fit_and_scores(table):
    rows, labels = labelled()
    rows += [(1000, None, 0.0), (1001, "", 0.0), (1002, "abscheu abscheu here", 0.0), (None, "an idoit and scum", 0.0)]
    docs, marks = table(rows, "doc_id bigint, text string, score double"), table([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks)
    assert "abscheu" in model.machine.lexicon
    out = {r["doc_id"]: r for r in toxicity.with_scores(docs, model).collect()}
    assert len(out) == len(rows) and out[1002]["score"] > 0.5 and out[1000]["score"] == out[1001]["score"] < 0.5
    assert sum((out[i]["score"] >= 0.5) == bool(y) for i, y in labels) / len(labels) > 0.97
    assert out[1002]["terms"][0]["term"] == "abscheu"


def test_held_out_rows_do_not_matter(table):
    rows, labels = labelled(200)
    docs = table(rows, "doc_id bigint, text string, x double")
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out()).select("doc_id").collect()}
    turned = [(i, 1 - y if i in held else y) for i, y in labels]
    one, other = (toxicity.fit(docs, table(marks, "doc_id bigint, toxic int")) for marks in (labels, turned))
    assert np.array_equal(one.weights, other.weights) and one.machine.lexicon == other.machine.lexicon


def test_without_labels(table):
    docs = table([(1, "you idiot", 1)], "doc_id bigint, text string, n int")
    model = toxicity.fit(docs, table([], "doc_id bigint, toxic int"))
    assert toxicity.with_scores(docs, model).filter("score > 0.5").count() == 1
    assert toxicity.with_scores(docs.limit(0), model).count() == 0 and F


def test_terms_of_other_scripts(table):
    terms = ["غبيحقير", "मूर्खता", "იდიოტი", "바보", "笨蛋", "คนโง่เขลา", "đồngốc"]
    rows, labels = labelled()
    for i, (number, text, x) in enumerate(rows):
        if number % 4 == 0:
            term = terms[number // 4 % len(terms)]
            joined = {"笨蛋": "你是个笨蛋吗", "คนโง่เขลา": "เธอคือคนโง่เขลานะ"}.get(term, term)
            rows[i] = (number, f"tree {joined} river", x)
        elif number % 4 == 1:
            rows[i] = (number, f"{text} 你是个学生吗 เธอคือเพื่อนนะ", x)
    model = toxicity.fit(table(rows, "doc_id bigint, text string, x double"), table(labels, "doc_id bigint, toxic int"))
    for text in [*terms, "他是笨蛋", "นี่คนโง่เขลา"]:
        assert toxicity.hits(text, model.machine)[0], text
    assert model.score(*toxicity.hits("stone 他是笨蛋", model.machine)) > 0.5
    assert not toxicity.hits("tree 你是个学生吗 เธอคือเพื่อนนะ", model.machine)[0]


def test_no_number_of_terms_is_too_large(table):
    words = ["".join(chr(97 + (i // 26**k * 7 + i) % 26) for k in range(3)) * 3 + chr(97 + i % 26) for i in range(600)]
    words = sorted(set(words))
    rows = [(i, " ".join(words) if i % 4 == 0 else "tree house", 0.0) for i in range(100)]
    found = toxicity.learned_terms(table([(t, i % 4 == 0) for i, t, _ in rows], "text string, toxic boolean"))
    assert found == words and len(words) > 256
    machine = toxicity.automaton(words)
    assert [machine.lexicon[h["term"]] for h in toxicity.hits(" ".join(words), machine)[0]] == words


def test_a_misspelling_is_judged_by_its_share(table):
    rows, labels = labelled()
    added = lambda i: " morron" if i % 4 == 0 or i % 10 == 1 else " moran" if i % 3 == 0 else ""
    rows = [(i, text + added(i), x) for i, text, x in rows]
    model = toxicity.fit(table(rows, "doc_id bigint, text string, x double"), table(labels, "doc_id bigint, toxic int"))
    assert "morron" not in model.machine.lexicon and "morron" not in model.common and "moran" in model.common

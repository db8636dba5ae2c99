import itertools
import random

import pytest

from convq.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = {1: "system", 2: "user", 3: "assistant", chat.UNKNOWN: "?"}


def cheapest(symbols):
    """Least cost of a repair, tried out over all sequences of states."""
    best = chat.NEVER
    for states in itertools.product(range(4), repeat=len(symbols)):
        cost, at = 0, chat.START
        for symbol, after in zip(symbols, states):
            move = chat.moves(symbol).get((at, after))
            cost, at = (cost + move[0], after) if move else (chat.NEVER, after)
        best = min(best, cost + chat.finish()[at][0])
    return best


def rendered(df):
    out = {}
    for r in df.orderBy("conv", "part").collect():
        text, cost, turns = out.get(r["conv"], ("", 0, 0))
        out[r["conv"]] = (text + r["rendered"], cost + r["cost"], turns + r["n_turns"])
    return out


def legal(text):
    roles = [p.split("\n", 1)[0] for p in text.split("<|im_start|>")[1:]]
    body = roles[1:] if roles[:1] == ["system"] else roles
    assert roles.count("system") == (roles[:1] == ["system"])
    assert body == ["user", "assistant"] * (len(body) // 2)
    assert text.count("<|im_start|>") == text.count("<|im_end|>\n")


@pytest.mark.parametrize("chunk", [2, 64])
def test_least_cost_and_legal(table, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(4)
    convs = {i: [rng.choice([1, 2, 3, 4]) for _ in range(rng.randint(1, 6))] for i in range(60)}
    rows = [(c, t, NAMES[s], f"<{c}.{t}>") for c, symbols in convs.items() for t, s in enumerate(symbols)]
    got = rendered(chat.format_chats(table(rows, SCHEMA)))
    for c, symbols in convs.items():
        text, cost, turns = got[c]
        assert (cost, turns) == (cheapest(symbols), len(symbols))
        legal(text)
        places = [text.index(f"<{c}.{t}>") for t in range(len(symbols))]
        assert places == sorted(places)  # no text is lost or moved


def test_legal_conversations_stay(table):
    rows = [(1, 0, "System", "be brief"), (1, 1, " user ", "hi"), (1, 2, "GPT", "hello"), (2, 0, "human", "a"), (2, 1, "bot", "b")]
    got = rendered(chat.format_chats(table(rows, SCHEMA)))
    assert got[1][0] == "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert got[1][1] == got[2][1] == 0


def test_odd_rows(table):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", None), (1, None, None, ""), (1, 5, "user", "q"), (1, 5, "user", "q"),
            (1, 900_000, "assistant", "z" * 200_000), (2, -3, "assistant", "only")]
    df = table([(*r, 7) for r in rows], SCHEMA + ", cost int")
    got = rendered(chat.format_chats(df))
    assert set(got) == {None, 1, 2}
    assert got[None][1] == 0 and got[1][2] == 4 and "z" * 200_000 in got[1][0]
    for text, *_ in got.values():
        legal(text)


def test_long_conversation_comes_in_parts(table):
    rows = [(1, t, "assistant" if t % 2 else "user", f"<{t}>") for t in range(1000)]
    out = chat.format_chats(table(rows, SCHEMA))
    assert out.count() == 1000 // chat.CHUNK + 1
    text, cost, turns = rendered(out)[1]
    assert (cost, turns) == (0, 1000)
    legal(text)


def test_empty(table):
    assert chat.format_chats(table([], SCHEMA)).count() == 0

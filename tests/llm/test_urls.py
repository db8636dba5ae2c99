"""The URL filter: rules against a plain version, the trees on unseen URLs."""

import random

import pytest

from convq.llm import urls
from convq.llm.queries import QUERIES, RULES

SF_DIR = "/root/testdata/sf0.001"


def plain(url, rules):
    """``host, path, rule, action`` by the words of the contract."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min((i for i in (rest.find(c, cut) for c in "?#") if i >= 0), default=len(rest))
        path = rest[cut:end]
    fits = []
    for text, action in rules:
        name, slash, tail = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail):
            fits.append((len(text), text, action))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


ODD = [
    None, "", "no scheme/com/", "http://", "http://COM/", "https://a.COM/en/x", "http://example.com/en/", "http://x.example.com/en/y?z=1",
    "http://www.example.com/en/", "http://m.www.example.com/en/y#z", "http://www.example.com", "http://www.example.com?/en/",
    "http://net/es/", "http://anet/es/", "http://a.net/ES/", "http://a.net/fr/1://b.com/", "http://Ünï.net/fr/\n?x", "x://a.com/" + "y" * 200_000,
    "http://user@a.com:80/en/", "://com/", "http://a.net/es", "http://a.net/es/?", "http:///com/", "http://a.com/", "http://a.com/",
]


def judged(table, rows, rules=RULES, model=None):
    df = table([(i, u, "clash", 0.5) for i, u in enumerate(rows)], "page_id long, url string, host string, score double")
    if model is None:
        model = urls.fit(urls.labelled_by_rules(df, rules))
    return {r["page_id"]: r for r in urls.judge(df, rules, model).collect()}


def test_rules_on_odd_urls(table):
    got = judged(table, ODD)
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        host, path, rule, action = plain(url, RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (action or ("block" if got[i]["score"] >= 0.5 else "allow"))


def test_query_on_all_pages(spark):
    given = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op12_filter_urls"](spark, SF_DIR).collect()
    assert sorted(r["page_id"] for r in got) == sorted(given)
    for r in got:
        host, path, rule, action = plain(given[r["page_id"]], RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == action if action else r["verdict"] in ("allow", "block")


def made(n, seed):
    """URLs with labels: blocked ones have long random names, many parameters or a bad ending."""
    rng, out = random.Random(seed), []
    word = lambda k, letters="aeinorst": "".join(rng.choices(letters, k=k))
    for _ in range(n):
        host = f"{word(rng.randint(4, 9))}.{rng.choice(['org', 'net', 'com'])}"
        if bad := rng.random() < 0.4:
            kind = rng.randrange(3)
            if kind == 0:
                url = f"http://{word(14, 'abcdefghijklmnopqrstuvwxyz0123456789')}.{host}/{rng.randrange(10**9)}/{word(20, '0123456789abcdef')}"
            elif kind == 1:
                url = f"http://{host}/go?" + "&".join(f"{word(3)}={rng.randrange(10**6)}" for _ in range(rng.randint(5, 9)))
            else:
                url = f"http://{word(6)}.bad/{word(5)}.html"
        else:
            url = f"https://www.{host}/{word(5)}/{word(7)}" + rng.choice(["", ".html", "?page=2", "#top"])
        out.append((url, bad))
    return out


def test_unseen_urls(spark):
    train, test = made(3_000, 1), made(1_500, 2)
    model = urls.fit(spark.createDataFrame(train, "url string, label boolean").repartition(4))
    rows = urls.judge(spark.createDataFrame(test, "url string, label boolean"), (), model).collect()
    right = sum((r["verdict"] == "block") == r["label"] for r in rows) / len(rows)
    assert right > 0.98 and all(r["rule"] is None for r in rows)


def test_suffixes_alone(spark):
    """Same form, different ending: only the statistics can tell."""
    rng = random.Random(3)
    rows = lambda n: [(f"http://{''.join(rng.choices('abcdef', k=8))}.{e}/x", e == "bad") for e in ("bad", "dab") for _ in range(n)]
    model = urls.fit(spark.createDataFrame(rows(300), "url string, label boolean"))
    found = urls.judge(spark.createDataFrame(rows(100), "url string, label boolean"), (), model).collect()
    assert all((r["verdict"] == "block") == r["label"] for r in found)


def test_bins_agree(table):
    """The suffixes that Spark counts are those that a task looks up."""
    rows = [u for u in ODD if u] + [u for u, _ in made(50, 4)]
    df = urls.parts(table([(u,) for u in rows], "url string"))
    for r in df.select("host", "path", urls._bins().alias("bins")).collect():
        assert list(r["bins"]) == urls._suffix_bins(r["host"], r["path"])


@pytest.mark.parametrize("label, verdict", [(True, "block"), (False, "allow"), (None, "allow")])
def test_one_kind_of_label(table, label, verdict):
    model = urls.fit(table([("http://a.b/c", label), (None, label)], "url string, label boolean"))
    assert {r["verdict"] for r in judged(table, ["http://x.y/z", None], (), model).values()} == {verdict}


def test_bounded_sample_and_empty_table(spark, table):
    rows = made(400, 5)
    model = urls.fit(table(rows + rows, "url string, label boolean"), sample_rows=50)
    assert model.trees is not None
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, RULES, urls.fit(urls.labelled_by_rules(empty, RULES))).count() == 0

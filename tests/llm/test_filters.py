"""URL rules, decontamination and toxicity."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from longtally.llm import decontaminate, queries, toxicity, url_filter
from longtally.llm.common import table

from .helpers import SF, documents, lower, rows_of

RULES = queries.URL_RULES


def plain_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = lower(host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_rules_over_the_table_and_odd_urls(spark):
    odd = [
        None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/x", "http://a.example.org/en/12?x=/es/", "https://org/", "https://org",
        "https://xorg/", "http://evil.com/x.org/", "http://a.com/de/", "http://com/fr/#f", "http://x.com?y=/fr/", "http://u@h.example.org:80/es/",
        "http://example.org/" + "é/" * 5000, "http://" + "a." * 3000 + "com/de/y", "http://b.org/a://c.com/de/", "http://É.org/ü",
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(odd)] + [(0, odd[5], "old")], "page_id long, url string, rule string")
    got = rows_of(url_filter.judge(url_filter.with_host_and_path(df), RULES), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *plain_verdict(u)) for i, u in enumerate(odd)] + [(0, *plain_verdict(odd[5]))], key=repr)
    assert queries.url_filters(spark, SF).count() == table(spark, SF, "pages").count()
    assert url_filter.judge(url_filter.with_host_and_path(df.limit(0)), RULES).count() == 0


def test_wildcards_cross_words_and_stop_at_the_host(spark):
    rules = [url_filter.Rule("*.shop.example", "/a*/b?c", "block"), url_filter.Rule("x" * 70 + ".net", "/", "block"), url_filter.Rule("net", "/", "allow")]
    urls = ["http://q.shop.example/a/zz/bxc/t", "http://shop.example/a/b/c", "http://q.shop.example/a/b/c", "http://" + "x" * 70 + ".net/", "http://" + "x" * 69 + ".net/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["rule"] for r in url_filter.judge(url_filter.with_host_and_path(df), rules).collect()}
    assert [got[u] for u in urls] == [rules[0].name, None, None, rules[1].name, rules[2].name]


def plain_contamination(text, items, window=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    ws, hit, found = split(text), set(), set()
    for item, content in items:
        own = split(content)
        m = min(window, len(own))
        keys = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else set()
        for i in range(len(ws) - m + 1) if own else ():
            if tuple(ws[i : i + m]) in keys:
                hit.update(range(i, i + m))
                found.add(item)
    listed = ",".join(sorted(str(i) for i in found))
    return len(ws), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("per_pass", [500_000, 30])
def test_decontamination_against_plain_search(spark, per_pass):
    items = [
        (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Two three FOUR five six seven eight nine ten eleven, thirteen"),
        (3, "short item"), (4, "é-ü"), (5, ""), (6, None), (10, "short item"), (7, "a a a a a a a a a a a"), (1, "again one item with the same id " * 2),
    ]
    texts = [
        None, "", "...", "short", "a short  item, é ü", "x one two three four five six seven eight nine ten eleven twelve thirteen y",
        "one two three four five six seven eight nine", "a " * 300, "a " * 9, "again one item with the same id again one item with the same id",
        "SHORT\nITEM" * 3, "word " * 20_000 + "short item",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[4])]
    docs = documents(spark, rows).withColumnRenamed("lang", "hit_spans")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, windows_per_pass=per_pass)
    got = sorted(((r["doc_id"], r["n_words"], sum(e - s for s, e in r["hit_spans"]), len(r["hit_items"])) for r in found.collect()), key=repr)
    assert got == sorted(((i, *plain_contamination(t, items)[:3]) for i, t in rows), key=repr)


def test_decontamination_query(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows_of(queries.benchmark_decontamination(spark, SF), *columns)
    assert got == sorted(((r["doc_id"], *plain_contamination(r["text"], items)) for r in table(spark, SF, "documents").collect()), key=repr)
    assert any(r[-1] for r in got)
    empty = table(spark, SF, "documents").limit(0)
    assert decontaminate.find_contamination(empty, table(spark, SF, "benchmark").limit(0)).count() == 0


def test_label_model_finds_voters_and_their_echo():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    good = np.where(y, rng.random(len(y)) < 0.9, rng.random(len(y)) < 0.05)
    noise = rng.random(len(y)) < 0.3
    votes = np.stack([good, good, good, noise, np.where(y, rng.random(len(y)) < 0.7, rng.random(len(y)) < 0.1)], axis=1)
    model = toxicity.LabelModel(5)
    v = votes.astype(float)
    model.maximise(np.array([(~y).sum(), y.sum()], float), np.stack([(v[~y]).T @ v[~y], (v[y]).T @ v[y]]))
    tree = {frozenset((j, int(model.parent[j]))) for j in range(5) if model.parent[j] >= 0}
    assert len(tree & {frozenset(p) for p in ((0, 1), (0, 2), (1, 2))}) == 2
    p = model.posterior(np.array([0b00111, 0b10111, 0b10000, 0]))
    # Three echoes count as one voter: by Bayes 0.6 and 0.969; as three they would give far more.
    assert p[0] == pytest.approx(0.6, abs=0.04) and p[1] == pytest.approx(0.969, abs=0.02) and p[3] < 0.02


def test_toxicity_on_held_out_rows(spark):
    from longtally.llm import queries as q

    rng = np.random.default_rng(1)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        ws = list(rng.choice(plain, 40)) + ([f"grolt{e}" for e in rng.choice(plain, 3)] if toxic else [])
        rows.append((i, " ".join(rng.permutation(ws)).upper() if i % 7 == 0 else " ".join(rng.permutation(ws))))
        labels.append((i, int(toxic)))
    extra = [(None, None), (5000, ""), (5001, "!!! " * 40_000), (0, rows[0][1])]
    docs = documents(spark, rows + extra).withColumnRenamed("lang", "score")
    given = spark.createDataFrame([*labels, (None, 1), (3, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    got = toxicity.scored(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    judged = [(r["score"] >= toxicity.THRESHOLD, r["doc_id"] % 5 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    assert next(r["score"] for r in got if r["doc_id"] == 5000) < toxicity.THRESHOLD
    # Held-out labels change nothing; neither do other columns.
    turned = given.withColumn("toxic", F.expr("CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END"))
    again = toxicity.fit(docs, turned)
    assert again.bias == pytest.approx(model.bias) and np.allclose(again.weights, model.weights)
    unlabelled = toxicity.fit(docs, given.limit(0))
    assert unlabelled.score(b"you idiot, stupid moron") > toxicity.THRESHOLD > unlabelled.score(b"a fine day")
    assert set(q.weak_toxicity(spark, SF).columns) == {"doc_id", "held_out", "score", "predicted"}

"""Archives, shards and mixing."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longtally.llm import archive, mixing, queries, sharding
from longtally.llm.common import new_path, table

from .helpers import SF, close, documents, rows_of, words

PAGES = "page_id long, url string, payload string, captured_at string, html string"


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
@settings(max_examples=60, deadline=None)
def test_loser_tree_merges_any_runs(runs):
    merged = list(archive.pieces_of([[(x,) for x in sorted(r)] for r in runs], key=lambda row: row))
    assert merged == sorted((x,) for r in runs for x in r)


def plain_records(pages):
    digest = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, (_, h) in enumerate(pages)}
    first = {}
    for i, (page, h) in enumerate(pages):
        if len((h or "").encode()) >= 100 and page is not None:
            first[digest[i]] = min(first.get(digest[i], page), page)
    out = []
    for i, (page, h) in enumerate(pages):
        to = first.get(digest[i])
        to = None if to == page or sum(d == digest[i] for d in digest.values()) < 2 else to
        out.append((page, len((h or "").encode()), digest[i], "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_archives_come_back_whole_and_in_global_order(spark):
    long = "ü" * 60
    rows = [
        (5, "http://b.org/x", long, None), (2, "http://a.b.org/y?q", long, None), (9, None, long, "2024-01-01T00:00:00Z"), (1, "u", None, None), (3, "u", "", None),
        (4, "x y\r\nWARC-Type: evil", "short", None), (8, "http://b.org/x", "short", None), (None, "http://b.org/x", long, None), (5, "http://b.org/x", long, None),
        (7, "http://c.org", "\r\n\r\nWARC/1.1\r\n\r\n" * 40 + "\x00", None), (6, "http://c.org", "z" * 300_000, None),
    ] + [(100 + i, "http://hot.org/", "same page " * 30, f"2024-01-{1 + i % 28:02d}T00:00:00Z") for i in range(150)]
    captures = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    path = new_path(spark, "test-warc")
    archive.write_archives(captures, path, records_per_file=20)
    runs = archive.read_runs(spark, path)
    merged = archive.merge_runs(runs).orderBy("range_no", "range_row").collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in merged), key=repr)
    assert got == plain_records([(r[0], r[2]) for r in rows])
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is None, r["page_id"] or 0) for r in merged]
    assert keys == sorted(keys)
    assert runs.select("run").distinct().count() > 3
    empty = new_path(spark, "test-warc")
    archive.write_archives(captures.limit(0), empty)
    assert archive.merge_runs(archive.read_runs(spark, empty)).count() == 0


def test_archive_query(spark):
    pages = [(r["page_id"], r["html"]) for r in table(spark, SF, "pages").collect()]
    assert rows_of(queries.warc_archive(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == plain_records(pages)


def test_differencing_is_tighter_than_greedy():
    rng = np.random.default_rng(0)
    for k in (2, 3, 24):
        sizes = rng.integers(1, 100_000, 600)
        part = sharding.difference(sizes, k)
        load = np.bincount(part, weights=sizes, minlength=k)
        greedy = np.zeros(k)
        for s in sorted(sizes, reverse=True):
            greedy[greedy.argmin()] += s
        assert load.sum() == sizes.sum() and np.ptp(load) <= np.ptp(greedy)
    assert sharding.difference(np.array([8, 7, 6, 5, 4]), 2).tolist().count(0) in (2, 3)
    assert np.ptp(np.bincount(sharding.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == 2
    assert sharding.difference(np.zeros(0, np.int64), 3).size == 0 and sharding.difference(np.array([5]), 3).size == 1


def test_shards_keep_groups_and_level_bytes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "t" * int(rng.integers(0, 400)) + str(i)) for i in range(900)] + [(2000 + i, "hot " * 50) for i in range(450)]
    rows += [(None, None), (3, rows[3][1]), (4001, None), (4002, ""), (4003, "")]
    docs = documents(spark, rows).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "size")
    got = sharding.shards_by_bytes(docs, 6).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by_text, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        by_text[r["digest"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = max(loads.values())
    assert hot >= 450 * 208
    rest = sorted(loads.values())[:-1]  # the hot group fills a shard alone; the others share the rest to the byte, nearly
    assert max(rest) - min(rest) < 200
    assert sharding.shards_by_bytes(docs.limit(0), 6).count() == 0


def test_sharding_query(spark):
    got = queries.karmarkar_karp_sharding(spark, SF).collect()
    import zlib

    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert len(got) == len(texts) and {r["law"] for r in got} == {"bytes"} and {r["shard"] for r in got} <= set(range(24))


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """``sizes`` by source; shares by weight, stopped at cap times the size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in stopped]
        share = {s: (total - sum(cap * sizes[x] for x in stopped)) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: cap * sizes[s] for s in stopped}
        stopped |= over


def check_mix(got, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    targets = plain_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["size"] * 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[r["source"]] and close(r["target"], targets[r["source"]], 1e-6)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1, (s, taken[s], t)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 7}" if i % 3 else "hot") for i in range(1500)]
    rows += [(9000 + i, "v " * 10, None) for i in range(40)] + [(None, None, "s1"), (None, "a b", "s2"), (7, "x", "zz"), (7, "x", "zz"), (8, "", "empty"), (5, rows[5][1], rows[5][2])]
    rows += [(20_000 + i, "\t\n a\x0bb  ", "é") for i in range(30)]
    docs = documents(spark, rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert len(got) == len(rows)
    check_mix(got, rows)
    again = rows_of(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken", "target")
    assert again == rows_of(mixed, "doc_id", "size", "taken", "target")
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_tilts_given_rates(spark):
    rows = [(i, "w " * (1 + i % 50), "a" if i % 4 else "b") for i in range(1200)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "source", "CASE WHEN doc_id % 10 = 0 THEN 4.0 WHEN doc_id % 10 = 1 THEN -1 ELSE 0.5 END AS liked")
    got = mixing.mix(docs, weights=(1, 2), prior="liked").collect()
    check = defaultdict(float)
    for r in got:
        check[r["source"]] += r["rate"] * r["size"]
    for s in check:
        assert close(check[s], next(r["target"] for r in got if r["source"] == s), 1e-6)
    tilt = {(r["source"], r["rate"] / r["prior"] if r["rate"] < 3 else None) for r in got}
    assert len({(s, round(t, 6)) for s, t in tilt if t is not None}) == 2  # one tilt a source wherever the cap does not bind


def test_mix_settles_at_all_ratios(spark):
    rng = np.random.default_rng(11)
    priors = [0.01, 0.3, 1.0, 2.5, 40.0]
    moments, targets = [], []
    ratios = [*np.geomspace(0.001, 2.9, 40), *np.linspace(2.9, 3.0, 40), 2.981, 2.99, 2.999, 3.0]
    for i, ratio in enumerate(ratios):
        for several in (False, True):
            name, sizes = f"{i}-{several}", []
            for prior in (priors if several else [1.0]):
                sizes.append(float(rng.integers(1, 10**6)))
                moments.append((name, prior, sizes[-1]))
            targets.append((name, float(ratio) * sum(sizes)))
    sized = spark.createDataFrame([*moments, ("empty", 1.0, 0.0)], "source string, prior double, size double")
    found = mixing.tilts(sized, spark.createDataFrame([*targets, ("empty", 0.0)], "source string, target double"))
    tilt = {r["source"]: r["tilt"] for r in found.collect()}
    assert len(tilt) == len(targets) + 1 and tilt["empty"] == 0
    words = defaultdict(float)
    for name, prior, size in moments:
        words[name] += size * min(3.0, prior * np.exp(tilt[name]))
    for name, target in targets:
        assert close(words[name], target, 1e-8), name


def test_mix_close_to_the_cap(spark):
    rows = [(i, "w " * 10, "a") for i in range(1000)] + [(5000 + i, "v " * 10, "b") for i in range(3186)]
    got = mixing.mix(documents(spark, rows), weights=(29_900, 11_960)).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert abs(taken["a"] - 29_900) <= 5 and abs(taken["b"] - 11_960) <= 5


def test_mixed_documents_keep_columns_of_any_name(spark):
    docs = documents(spark, [(i, "a b c", "s") for i in range(8)]).withColumns({c: F.col("doc_id") for c in ("_row", "_mix", "_copies", "size", "up", "a b`c")})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and all(r["_row"] == r["size"] == r["a b`c"] == r["doc_id"] for r in out.collect()) and out.count() == 8


def test_mixed_documents_repeat_rows(spark):
    docs = table(spark, SF, "documents")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    mixed = {r["doc_id"]: r["taken"] // r["size"] for r in queries.entropy_mixing(spark, SF).collect() if r["size"]}
    assert counts == {d: n for d, n in mixed.items() if n}

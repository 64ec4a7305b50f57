"""SimHash components, neighbours, sentence spans, language model and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from longtally.llm import common, language_model, nearest, queries, recurrent, simhash, spans
from longtally.llm.common import table

from .helpers import SF, close, documents, rows_of, words


def plain_fingerprint(text):
    ws = words(text)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(pairs):
    """pairs of (doc_id, fingerprint): smallest id reachable over links of three bits or fewer, by pair."""
    points = sorted({f for _, f in pairs})
    up = {f: f for f in points}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(points):
        for b in points[:i]:
            if bin(a ^ b).count("1") <= 3:
                up[root(a)] = root(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return {f: least.get(root(f)) for f in points}


def test_every_near_pair_meets_at_a_home():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    (row, home, _), (other, all_keys, _) = simhash._anchors(x, 1), simhash._anchors(y, None)
    at = defaultdict(set)
    for r, k in zip(other, all_keys, strict=True):
        at[r].add(k)
    assert {r for r, k in zip(row, home, strict=True) if k in at[r]} == set(range(3000))
    assert max(Counter(other).values()) <= 34


@pytest.mark.parametrize("homes", [4096, 3])
def test_components_against_all_pairs(spark, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES_PER_BLOCK", homes)
    rng = np.random.default_rng(6)
    points = [int(v) for v in rng.integers(0, 2**63, 30)]
    for p in list(points[:6]):  # chains and dense clusters
        for _ in range(25):
            for b in rng.choice(64, 2, replace=False):
                p ^= 1 << int(b)
            points.append(p)
    points += [points[0] ^ (1 << i) for i in range(40)] + [0, 0, 2**64 - 1]
    pairs = [(int(i * 7 % 1009), p) for i, p in enumerate(points)] + [(None, points[0]), (None, 12345), (5, points[1])]
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in pairs]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    got = {r["fingerprint"] % (1 << 64): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == plain_components(pairs)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [2, 3, 4, 5])
def test_the_last_home_of_a_batch_is_compared(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", pairs)
    points = np.array([1, 0, 9, 8], np.uint64)
    a, b = simhash._links(np.array([0, 0, 1, 1]), points, np.array([True, False, True, False]), 3)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (9, 8)]


def test_fingerprints_and_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    component = plain_components(prints)
    got = rows_of(queries.simhash_near_dedup(spark, SF), "doc_id", "fingerprint", "component_id")
    assert got == sorted(((d, f"{f:016x}", component[f]) for d, f in prints), key=repr)
    for odd in (None, "", " \n", "A", "a b", "Ä B c\x0bd", "x " * 70_000, "\x00 \x1f y z"):
        assert simhash.fingerprint(None if odd is None else odd.encode()) == plain_fingerprint(odd)


def test_one_of_each(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(7, base), (3, base), (3, base), (3, base + " "), (9, "other text of its own"), (None, "no id"), (None, "no id"), (None, None), (12, ""), (11, None)]
    docs = documents(spark, rows).withColumn("_rank", F.lit(1))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect()), key=repr) == sorted([(3, base), (9, "other text of its own"), (None, "no id"), (11, "")], key=repr)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_connected_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def plain_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            near = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in good if i != q)
            out[q] = near[:k]
    return out


def test_neighbours_recall_scores_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], None) for i in range(1, 1500)]
    rows += [(2000 + i, rows[0][1], None) for i in range(300)]  # one vector many times
    nan = float("nan")
    rows += [(5000, None, None), (5050, [], None), (5100, [0.0] * 16, None), (5150, [nan] + [1.0] * 15, None), (5200, [None] + [1.0] * 15, None), (5250, [float("inf")] + [0.0] * 15, None), (None, rows[0][1], None)]
    got = defaultdict(list)
    for r in nearest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    truth = plain_nearest(rows)
    assert set(got) == set(truth)
    assert all([r for r, _, _ in g] == [1, 2, 3, 4, 5] for g in got.values())
    found = np.mean([len({v for _, v, _ in got[q]} & {i for _, i in near}) / 5 for q, near in truth.items()])
    assert found >= 0.9
    by_id = {i: np.array(v, float) for i, v, _ in rows if i and v and i < 5000}
    for q, g in got.items():
        order = [(-s, v) for _, v, s in g]
        assert order == sorted(order)
        for _, v, s in g:
            assert close(s, float(by_id[q] @ by_id[v] / np.linalg.norm(by_id[q]) / np.linalg.norm(by_id[v])), 1e-12)
    assert [v for _, v, _ in got[2050]] == [1, 2000, 2001, 2002, 2003]  # of copies the smallest ids


def test_few_vectors_give_all(spark):
    rows = [(i, [1.0, float(i)], None) for i in (0, 50, 3)]
    got = rows_of(nearest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert nearest.nearest(vectors(spark, rows[:1]), F.lit(True)).count() == 0
    assert nearest.nearest(vectors(spark, rows).limit(0), F.lit(True)).count() == 0


def test_neighbours_query_recall(spark):
    rows = [(r["vec_id"], list(r["embedding"]), None) for r in table(spark, SF, "embeddings").collect()]
    truth = plain_nearest(rows)
    got = defaultdict(set)
    for r in queries.multiprobe_neighbours(spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for _, i in near}) / 5 for q, near in truth.items()]) >= 0.9


@pytest.mark.parametrize("count", [50_000, 500_000, 50_000_000])
def test_fit_reaches_recall_for_many_vectors(count):
    rng = np.random.default_rng(9)
    loose = rng.normal(size=(2048, 64))  # no near neighbours: the fifth-best cosine is about 0.4
    close_by = np.repeat(rng.normal(size=(128, 64)), 16, axis=0) + 0.2 * rng.normal(size=(2048, 64))
    for sample in (loose, rng.permutation(close_by)):
        grid = nearest.fit(sample, count, 5, 0.97)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        cells, hits = grid.cells(unit), 0
        for q in range(128):
            near = unit @ unit[q]
            near[q] = -2
            best = np.argsort(-near, kind="stable")[:5]
            seen = [set(grid.probes(unit[q : q + 1], t)[0].tolist()) for t in range(grid.tables)]
            hits += sum(any(int(cells[b, t]) in seen[t] for t in range(grid.tables)) for b in best)
        assert hits >= 0.97 * 640
    assert grid.projections > 0  # what has near neighbours needs no full scan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_vectors_are_found_through_a_grid(sf):
    data = np.array(pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").column("embedding").to_pylist())
    grid = nearest.fit(data[np.random.default_rng(3).permutation(len(data))][: nearest.SAMPLE], len(data), 5, 0.97)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    cells, hits, candidates = grid.cells(unit), 0, 0
    asked = range(0, len(data), 50)
    for q in asked:
        near = unit @ unit[q]
        near[q] = -2
        met = np.zeros(len(data), bool)
        for t in range(grid.tables):
            met |= np.isin(cells[:, t], grid.probes(unit[q : q + 1], t)[0])
        met[q] = False
        candidates += met.sum()
        hits += met[np.argsort(-near, kind="stable")[:5]].sum()
    assert grid.projections > 0 and hits >= 0.9 * 5 * len(asked) and candidates < 0.95 * len(data) * len(asked)


def test_rows_of_one_id_count_once(spark):
    rows = [(0, [1.0, 0.0], None), (1, [0.0, 1.0], None), (1, [1.0, 0.1], None), (1, [1.0, 0.1], None), (2, [1.0, 1.0], None)]
    got = nearest.nearest(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in got] == [(1, 1), (2, 2)] and close(got[0]["score"], 1 / math.sqrt(1.01), 1e-6)


def plain_repeats(rows, least_sentences=2, least_words=10):
    seen, out = set(), {}
    for doc, text in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 7) - (1 << 63))):
        pieces = spans.sentences((text or "").encode())
        gone, own = set(), set()
        for i in range(len(pieces)):
            for j in range(i + least_sentences, len(pieces) + 1):
                run = tuple(" ".join(p.lower().decode().split()) for p in pieces[i:j])
                if sum(len(p.split()) for p in run) >= least_words:
                    if run in seen or run in own:
                        gone.update(range(i, j))
                    own.add(run)
                    break
        seen |= own
        out[doc, text] = (len(pieces), len(gone), None if text is None else b"".join(p for i, p in enumerate(pieces) if i not in gone).decode())
    return out


def test_spans_against_plain_search(spark):
    passage = "First we say this much. Then we say a little more here. And now a third thing follows! Enough?\n"
    rows = [
        (1, "Own start of one. " + passage + "Own end of one."), (2, "Another begins. And goes on.\n" + passage.upper() + "Other end."), (2, "Another begins. And goes on.\n" + passage.upper() + "Other end."),
        (3, passage * 3), (4, None), (5, ""), (6, "Nothing shared here at all. Just words of its own. They stay."), (None, "Lead. " + passage), (7, "Short. Short. Short."),
        (8, "list " + " ".join(f"item{i}" for i in range(300))), (9, "other " + " ".join(f"item{i}" for i in range(300))), (6, "Same id, other text. " + passage),
    ]
    docs = documents(spark, rows).withColumnRenamed("lang", "at").withColumnRenamed("source", "kept_text")
    got = spans.remove_repeats(docs).collect()
    plain = plain_repeats(rows)
    assert sorted(((r["doc_id"], r["text"], r["n_sentences"], r["n_removed"], r["kept_text"]) for r in got), key=repr) == sorted(((d, t, *plain[d, t]) for d, t in rows), key=repr)
    assert next(r["kept_text"] for r in got if r["doc_id"] == 1) == rows[0][1]
    assert spans.remove_repeats(docs.limit(0)).count() == 0


def test_spans_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    plain = plain_repeats(rows)
    got = rows_of(queries.sentence_span_dedup(spark, SF), "doc_id", "n_sentences", "n_removed", "text")
    assert got == sorted(((d, *plain[d, t]) for d, t in rows), key=repr)
    assert any(r[2] for r in got)


def test_network_is_a_distribution_and_its_gradient_is_right():
    net = recurrent.Network(7, 3, 4).start(np.array([3.0, 5, 2, 1, 1, 1, 1, 9]))
    steady = recurrent.Pass(net, window=5)
    total = 0.0
    for last in range(8):  # the probabilities of all words after the same history
        places, _, size = recurrent.laid_out([np.array([1, 7, 4, last])], 2)
        total += float(np.exp(steady.run(places, size)[3, 0]))
    assert total == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(1, 8, n), 0) for n in (3, 9, 1, 6)]
    places, owner, size = recurrent.laid_out(texts, 2)
    whole = recurrent.Pass(net, 64).run(places, size).sum()
    assert whole == pytest.approx(float(recurrent.Pass(net, 3).run(places, size).sum()), rel=1e-4)  # the state crosses windows
    alone = sum(float(recurrent.Pass(net, 4).run(*recurrent.laid_out([t], 1)[::2]).sum()) for t in texts)
    assert whole == pytest.approx(alone, rel=1e-4)
    learner = recurrent.Pass(net, 64, learn=1e-12)
    learner.run(places, size)
    count = int(size.sum())
    for name in recurrent.Network.NAMES:
        value, grad = getattr(net, name), learner.grads[name]
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            kept, step = value[at], 1e-2
            value[at] = kept + step
            up = -recurrent.Pass(net, 64).run(places, size).astype(float).sum() / count
            value[at] = kept - step
            down = -recurrent.Pass(net, 64).run(places, size).astype(float).sum() / count
            value[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def test_lm_scores_against_counts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 300)  # so that most words take the join
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    rows += [(90_000, None), (90_001, ""), (None, "No id HERE"), (rows[5][0], rows[5][1]), (rows[5][0], "same id other text"), (90_002, "never seen wordz qqqq")]
    docs = documents(spark, rows).withColumnRenamed("lang", "rare").withColumnRenamed("source", "of")
    counts = Counter()
    trains = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1
    for d, t in rows:
        if trains(d):
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), "\n"])
    got = language_model.score(docs, ~language_model.held_out()).collect()
    assert len(got) == len(rows)
    want = sorted(((d, len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + 1, n, round(base(t), 6)) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    held = [r for r in got if not trains(r["doc_id"])]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score(docs.limit(0), F.lit(True)).count() == 0


def test_lm_scores_are_those_of_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(language_model, "CELL_WORDS", 4000)
    monkeypatch.setattr(language_model, "SHARES", 4)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.union(docs.limit(20))  # repeated rows
    runs = []
    for n in (1, 4, 16, 64):
        got = language_model.score(docs.repartition(n), ~language_model.held_out()).collect()
        runs.append(sorted((r["doc_id"], r["score"]) for r in got))
    for other in runs[1:]:
        assert [d for d, _ in other] == [d for d, _ in runs[0]]
        assert [s for _, s in other] == pytest.approx([s for _, s in runs[0]], rel=1e-5)


def test_lm_score_against_a_network_run_word_by_word(spark, monkeypatch):
    kept = {}
    train = language_model.train
    monkeypatch.setattr(language_model, "VOCABULARY", 40)
    monkeypatch.setattr(language_model, "train", lambda t, head: kept.setdefault("p", (head, train(t, head)))[1])
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()][:30] + [(900, None), (901, "zz yy")]
    got = {r["doc_id"]: r["score"] for r in language_model.score(documents(spark, rows), ~language_model.held_out()).collect()}
    head, flat = kept["p"]
    net = head.network().load(flat)
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(words(t))
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = net.hidden

    def soft(logits, at):
        e = np.exp(logits - logits.max())
        return math.log10(e[at] / e.sum())

    for d, t in rows:
        state, total = np.zeros(h), 0.0
        seen = [w.encode() for w in words(t)]
        for w in [*seen, None]:
            number = 0 if w is None else head.number.get(w, head.size)
            group = net.classes if number >= head.size else number // net.width
            total += soft(state @ net.class_out + net.class_bias, group)
            if group < net.classes:
                total += soft(state @ net.word_out[group] + net.word_bias[group], number - group * net.width)
            else:  # its share of the mass of all other words, by smoothed counts
                total += math.log10(counts[w.decode()] + 0.5) - head.other
                number = head.size
            x, again = net.embed[number] @ net.enter + net.gate_bias, state @ net.again
            z, r = sig(x[:h] + again[:h]), sig(x[h : 2 * h] + again[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * again[2 * h :])
            state = (1 - z) * new + z * state
        assert got[d] == pytest.approx(total, rel=1e-4), d


def test_lm_network_tells_4095_words_apart():
    words, counts = [b"w%d" % i for i in range(5000)], np.arange(5000, 0, -1.0)
    head = language_model.Head(words, counts, 10, int(counts.sum()) + 10, 5001)
    net = head.network()
    assert (net.vocabulary, net.classes, net.hidden) == (4096, 64, 16)
    assert head.counts[-1] == counts[4095:].sum()


def test_lm_words_are_cut_and_numbered_in_whole_batches(monkeypatch):
    odd = ["Aé b", None, "", " \x0b", "x\x0cB x\x1cy\x85\u3000Z \n", "É q" * 50, "b\x00 A"] * 30
    plain = [words(t) for t in odd]
    texts = pa.array(odd)
    for low, n in ((0, len(odd)), (5, 40), (208, 2), (1, 1), (3, 0)):
        found, starts = language_model.tokens(texts.slice(low, n))
        found = found.to_pylist()
        assert [found[a:b] for a, b in zip(starts, starts[1:], strict=False)] == plain[low : low + n]
    full = texts.drop_null()  # a column without nulls is cut into slices another way inside Arrow
    found, starts = language_model.tokens(full.slice(7, 30))
    assert found.to_pylist() == [w for t in full.slice(7, 30).to_pylist() for w in words(t)]
    assert language_model.tokens(pa.array([b"\xffA \x80"]).view(pa.string()))[0].cast(pa.binary()).to_pylist() == [b"\xffa", b"\x80"]
    counts = Counter(w for t in plain for w in t)
    known = [w.encode() for w, _ in counts.most_common(6)]
    head = language_model.Head(known, np.array([counts[w.decode()] for w in known], float), 9, sum(counts.values()) + 9, len(counts) + 1)
    head.size = 4
    monkeypatch.setattr(language_model, "SLICE_BYTES", 40)
    monkeypatch.setattr(language_model, "POOL_WORDS", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), texts], ["doc_id", "text"])
    parts = [p for pool in language_model._pools([batch.slice(0, 50), batch.slice(50)], head, 1) for p in pool]
    assert len(parts) > 20 and sum(p.rows for p in parts) == len(odd)
    rows = [(p, i) for p in parts for i in range(p.rows)]
    for (part, i), own in zip(rows, plain, strict=True):
        numbers = [head.number.get(w.encode(), -1) for w in own]
        assert part.texts[i].tolist() == [n if 0 < n < 4 else 4 for n in numbers] + [0]
        assert (part.n_tokens[i], part.n_known[i], part.n_other[i]) == (len(own) + 1, sum(n > 0 for n in numbers) + 1, sum(not 0 < n < 4 for n in numbers))
        assert part.head_sum[i] == pytest.approx(head.weight[0] + sum(head.weight[n] for n in numbers if n > 0))
        assert part.other_sum[i] == pytest.approx(sum(head.weight[n] for n in numbers if n >= 4))
        assert {r["word"]: r["n"] for r in part.rare[i].as_py()} == Counter(w.encode() for w, n in zip(own, numbers, strict=True) if n < 0)


def test_network_in_small_parts_gives_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(1, 12, n), 0) for n in (40, 9, 1, 70, 33)]
    places, _, size = recurrent.laid_out(texts, 3)
    got = []
    for part in (1024, 2):
        monkeypatch.setattr(recurrent.Pass, "PART", part)
        net = recurrent.Network(11, 3, 4).start(np.arange(12, 0, -1.0))
        logs = recurrent.Pass(net, 8, learn=0.01).run(places, size)
        got.append((logs, net.flat()))
    assert np.allclose(got[0][0], got[1][0], atol=1e-4) and np.allclose(got[0][1], got[1][1], atol=1e-3)


def test_lm_training_that_diverges_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_model, "RATE", 1e38)
    docs = documents(spark, [(i, "some words to learn from " * 40) for i in range(40)])
    with pytest.raises(Exception, match="no longer finite after [0-9]+ words"):
        language_model.score(docs, F.lit(True)).count()


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"plain words number {i} of a text that nobody has written before {i * 7}", f"s{i % 3}") for i in range(30)] + [(90, "", None), (None, None, "s1")]
    names = ("n_words", "hit_spans", "hit_items", "_toxicity", "_simhash", "_root", "_least", "_shared", "_rank", "_row", "_copies", "_copy", "score")
    docs = documents(spark, rows).withColumns({c: F.lit("mine") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == "mine" for r in got for c in names), name
    assert corpus_pipeline.into_shards(spark, docs, SF).count() == len(rows)


def test_pipeline_stages_against_their_operators(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    clean = common.stored(corpus_pipeline.without_toxic(spark, docs, SF), "test")
    scored = {r["doc_id"]: r["predicted"] for r in queries.weak_toxicity(spark, SF).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, p in scored.items() if not p}
    single = common.stored(corpus_pipeline.without_near_copies(spark, clean, SF), "test")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in clean.collect()]
    component = plain_components(prints)
    assert {r["doc_id"] for r in single.collect()} == set(component.values()) and single.count() == len(set(component.values()))
    pure = common.stored(corpus_pipeline.without_benchmark(spark, single, SF), "test")
    hit = {r["doc_id"] for r in queries.benchmark_decontamination(spark, SF).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in pure.collect()} == {r["doc_id"] for r in single.collect()} - hit
    mixed = common.stored(corpus_pipeline.mixed_to_weights(spark, pure, SF), "test")
    assert mixed.columns == docs.columns and set(r["doc_id"] for r in mixed.collect()) <= {r["doc_id"] for r in pure.collect()}
    last = corpus_pipeline.into_shards(spark, mixed, SF)
    assert Counter(r["doc_id"] for r in last.collect()) == Counter(r["doc_id"] for r in mixed.collect())
    assert re.fullmatch("[a-z_]+", last.columns[0])

"""The manifest against plain trees."""

import hashlib

import pytest
from pyspark.sql import functions as F

from longtally.llm import common, manifest

from .helpers import DOCS, rows_of


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def plain_postorder(levels):
    """(level, index, digest) in the order in which nodes are complete."""
    out = []

    def visit(level, index):
        if level:
            for i in range(index * 16, min((index + 1) * 16, len(levels[level - 1]))):
                visit(level - 1, i)
        out.append((level, index, levels[level][index]))

    visit(len(levels) - 1, 0)
    return out


SIZES = [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 273, 4095, 4096, 4097, 4112, 5000, 65_536, 65_553]


@pytest.mark.parametrize("n", SIZES)
def test_positions_and_builders(n):
    levels = plain_levels([str(i) for i in range(n)])
    order = plain_postorder(levels)
    assert all(manifest.position(level, i, n) == at for at, (level, i, _) in enumerate(order))
    assert manifest.height(n) == len(levels) - 1
    log, children, base = {}, levels[0], 0
    while True:
        roots = []
        for block in range(-(-len(children) // manifest.AT_ONCE)):
            made = list(manifest.build(children[block * manifest.AT_ONCE : (block + 1) * manifest.AT_ONCE], base, block, n))
            positions = [at for _, at, _ in made]
            assert positions == sorted(positions)
            if base == 0:  # a builder of the leaves writes one stretch of the log, but for nodes that end further up
                assert positions == list(range(positions[0], positions[0] + len(positions)))
            log |= {at: digest for _, at, digest in made}
            roots.append(made[-1][2])
        base += manifest.LEVELS
        if base >= manifest.height(n):
            break
        children = roots
    assert [log[i] for i in range(len(order))] == [d for _, _, d in order]
    for leaf in {0, n // 2, n - 1}:
        steps, at, base = [], leaf, 0
        while base < manifest.height(n):
            steps += manifest.siblings(manifest.children(log, base, at // manifest.AT_ONCE, n), at % manifest.AT_ONCE)
            at, base = at // manifest.AT_ONCE, base + manifest.LEVELS
        assert manifest.fold(str(leaf), steps) == levels[-1][0]


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, changed):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        digest = lambda t: h("".join(map(told, (doc_id, source, lang, n_chars, t))))
        lowered = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, digest(text), digest(lowered if changed(doc_id) else text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_levels([d for *_, d, _ in sorted(groups[s])]) for s in order]
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for at, (source, levels) in enumerate(zip(order, trees, strict=True)):
        for place, (known, doc_id, leaf, shown) in enumerate(sorted(groups[source])):
            proof, folded = [], shown
            for tree, i in ((levels, place), (top, at)):
                for level in tree[:-1]:
                    run = level[i // 16 * 16 : i // 16 * 16 + 16]
                    left, right = run[: i % 16], run[i % 16 + 1 :]
                    proof += left + right
                    folded = h("".join([*left, folded, *right]))
                    i //= 16
            out.append((doc_id if known else None, leaf, levels[-1][0], top[-1][0], h("".join(proof)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")


def check(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = manifest.manifest(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 0)
    assert rows_of(got, *COLUMNS) == plain_manifest(rows, lambda d: (d or 0) % 5 == 0)


def test_a_source_of_several_builders_and_many_small_ones(spark):
    rows = [(i * 7 % 4999, f"Text {i}", "en", "hot", i) for i in range(4500)]
    rows += [(10_000 + i, "ABC é 𝄞", None, f"s{i % 40}", None) for i in range(300)]
    check(spark, rows)


def test_odd_rows(spark):
    big = 2**53 + 1
    rows = [
        (None, "A", None, None, None), (None, "A", None, None, None), (big, None, "en", "", 3), (big, "", "en", "", 3), (1, "X" * 200_000, "fr", "z", 1),
        (2, "same", "fr", "z", 1), (2, "same", "fr", "z", 1), (5, "ÀB\n", "", "é", 0), (10, None, "de", "𝄞", 0), (-5, "lower", "de", "￿", 0),
    ]
    check(spark, rows, 3)
    docs = spark.createDataFrame(rows, DOCS)
    same = manifest.manifest(docs.withColumns({c: F.lit("mine") for c in ("tree", "index", "leaf", "digest", "_at", "n")}))
    assert {r["verified"] for r in same.collect()} == {True}
    assert manifest.manifest(docs.limit(0)).count() == 0
    check(spark, rows[4:5], 1)


def test_ranks_within_groups(spark):
    rows = [(i * 37 % 1000, "hot" if i % 3 else f"g{i % 5}", i) for i in range(1000)] + [(None, None, -1), (4, None, -2), (None, "hot", -3)]
    df = spark.createDataFrame(rows, "v int, g string, _at int")
    got = common.ranked(df, ["g"], ["v"], "place", "test").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["place"], r["v"]))
    assert len(got) == len(rows) and {r["_at"] for r in got} == {r[2] for r in rows}
    for found in groups.values():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        values = [v for _, v in sorted(found)]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))

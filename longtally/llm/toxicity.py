"""Toxicity by weak supervision.

Many voters look at a text: lexicons written here, lexicons mined from labelled rows, and
patterns. None is trusted. A generative label model says how often each voter fires on toxic and
on clean texts, given the voter it is most correlated with: a tree over the voters for each
class, found by conditional mutual information. It is fitted by expectation maximisation on the
votes of all documents, with the labels of the sample held fixed. Its posterior for a text, from
votes alone, is the label on which a linear classifier over traits of word stems is trained.

Labels come from a bounded sample of labelled rows (``LABELLED_ROWS``), and only from rows that
are not held out. Votes and their statistics cover all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, stored

#: At most so many labelled rows are used: those with the smallest hash of their id.
LABELLED_ROWS = 20_000
#: Mined traits that the classifier weighs at most, and mined lexicons of toxic traits.
TRAITS, MINED = 4096, 16
STEM_BYTES = (3, 4, 5, 6, 7, 8)
LONGEST_WORD = 32
EM_STEPS, THRESHOLD = 6, 0.3
#: Of the texts with a mined toxic trait at least this part is toxic, in either half of the sample.
LEAST_PRECISION = 0.6

#: Insults by theme, lower case.
LEXICONS = {
    "mind": ["idiot", "idiots", "idiotic", "stupid", "stupidity", "moron", "morons", "moronic", "dumb", "dumbass", "imbecile", "fool", "cretin", "dimwit"],
    "worth": ["worthless", "pathetic", "loser", "losers", "useless", "failure", "nobody"],
    "dirt": ["trash", "garbage", "scum", "filth", "filthy", "vermin"],
    "disgust": ["disgusting", "vile", "repulsive", "revolting", "hideous", "sickening"],
    "mockery": ["clown", "clowns", "joke", "freak", "creep", "weirdo", "crybaby"],
    "threat": ["kill", "murder", "shoot", "destroy", "strangle"],
    "hate": ["hate", "hated", "despise", "loathe", "detest"],
}
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Patterns, each on the raw text.
PATTERNS = [
    re.compile(rb"[A-Z]{4,}[^a-z]{1,3}[A-Z]{4,}"),  # shouting
    re.compile(rb"[!?]{3,}"),
    re.compile(rb"(?i)\byou(?:'re| are)? (?:an? |such an? |all )?(?:\w+ )?(?:idiots?|morons?|losers?|clowns?|stupid|pathetic|worthless)\b"),
    re.compile(rb"(?i)\b(?:shut up|go away|get lost|nobody likes)\b"),
]
PATTERN_REACH = 1 << 16  # patterns run on pieces of so many bytes, overlapping, so a long text costs no more memory


def _words(text: bytes | None) -> list[bytes]:
    """Words in lower case, cut at all ASCII but letters."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()


def _stems(word: bytes) -> Iterator[bytes]:
    """The word in full, ended by a blank, and its first bytes as stems."""
    if 3 <= len(word) <= LONGEST_WORD:
        yield word + b" "
    for n in STEM_BYTES:
        if n <= len(word):
            yield word[:n]


def traits(text: bytes | None, known: dict[bytes, list[bytes]] | None = None) -> set[bytes]:
    """What is true of a text's stems: occurs (stem + 1), twice (2), three times (3), twice and in every fiftieth
    word (%). ``known`` limits the stems looked at."""
    words = _words(text)
    counts: dict[bytes, int] = {}
    for word, n in Counter(words).items():
        for stem in _stems(word):
            if known is None or stem in known:
                counts[stem] = counts.get(stem, 0) + n
    found = set()
    for stem, n in counts.items():
        found.add(stem + b"1")
        if n >= 2:
            found.add(stem + b"2")
            if n >= 3:
                found.add(stem + b"3")
            if 50 * n >= len(words):
                found.add(stem + b"%")
    return found


def _by_stem(wanted: Iterable[bytes]) -> dict[bytes, list[bytes]]:
    stems: dict[bytes, list[bytes]] = {}
    for trait in wanted:
        stems.setdefault(trait[:-1], []).append(trait)
    return stems


class Voters:
    """Votes of a text as bits; ``mined`` are traits of toxic texts, best first, ``clean`` those of clean texts."""

    def __init__(self, mined: list[bytes], clean: list[bytes]):
        self.of: dict[bytes, int] = {}
        at = 0
        for words in LEXICONS.values():
            for w in words:
                self.of[w.encode() + b" 1"] = 1 << at
            at += 1
        for trait, n in zip(mined, cycle(range(MINED))):  # noqa: B905
            self.of[trait] = self.of.get(trait, 0) | 1 << (at + n)
        at += MINED
        for trait, n in zip(clean, cycle(range(4))):  # noqa: B905
            self.of[trait] = self.of.get(trait, 0) | 1 << (at + n)
        at += 4
        self.first_pattern = at
        self.count = at + len(PATTERNS)
        self.stems = _by_stem(self.of)

    def votes(self, text: bytes | None) -> int:
        bits = 0
        for trait in traits(text, self.stems):
            bits |= self.of.get(trait, 0)
        for n, pattern in enumerate(PATTERNS):
            if any(pattern.search(text, low, low + PATTERN_REACH) for low in range(0, len(text or b""), PATTERN_REACH // 2)):
                bits |= 1 << (self.first_pattern + n)
        return bits


def _unpacked(bits: np.ndarray, count: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(count) & 1).astype(np.float64)


class LabelModel:
    """P(toxic) and, for each voter and class, P(fires | its parent fires or not)."""

    def __init__(self, count: int):
        self.count, self.prior = count, 0.1
        self.parent = np.full(count, -1)
        self.fires = np.full((2, count, 2), 0.5)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        v = _unpacked(bits, self.count)
        above = np.where(self.parent >= 0, v[:, self.parent], 0).astype(int)
        log = [np.log(self.prior if y else 1 - self.prior) * np.ones(len(v)) for y in (0, 1)]
        for y in (0, 1):
            p = self.fires[y][np.arange(self.count)[None, :], above]
            log[y] = log[y] + np.log(np.where(v > 0, p, 1 - p)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))

    def maximise(self, mass: np.ndarray, pairs: np.ndarray) -> None:
        """From class masses and, by class, the mass on which both of two voters fire (diagonal: one fires)."""
        n = self.count
        self.prior = float(np.clip((mass[1] + 1) / (mass.sum() + 10), 1e-4, 0.9))
        information = np.zeros((n, n))
        joint = np.zeros((2, n, n, 2, 2))  # class, voter, other, voter fires, other fires
        for y in (0, 1):
            single = np.diag(pairs[y])
            joint[y, :, :, 1, 1] = pairs[y]
            joint[y, :, :, 1, 0] = single[:, None] - pairs[y]
            joint[y, :, :, 0, 1] = single[None, :] - pairs[y]
            joint[y, :, :, 0, 0] = mass[y] - single[:, None] - single[None, :] + pairs[y]
            p = (np.maximum(joint[y], 0) + 0.25) / (mass[y] + 1)
            left, right = p.sum(axis=3)[..., None], p.sum(axis=2)[..., None, :]
            information += mass[y] / mass.sum() * (p * np.log(p / (left * right))).sum(axis=(2, 3))
        inside = {0}  # the tree of largest information, grown from voter 0
        self.parent[:] = -1
        while len(inside) < n:
            of = list(inside)
            rest = [j for j in range(n) if j not in inside]
            a, b = np.unravel_index(np.argmax(information[np.ix_(rest, of)]), (len(rest), len(of)))
            self.parent[rest[a]] = of[b]
            inside.add(rest[a])
        for y in (0, 1):
            for j in range(n):
                if self.parent[j] < 0:
                    self.fires[y, j, :] = (joint[y, j, j, 1, 1] + 0.1) / (mass[y] + 1)
                else:
                    own = np.maximum(joint[y, j, self.parent[j]], 0)
                    base = (own[1].sum() + 0.1) / (own.sum() + 1)  # few cases lean on the voter's own rate
                    self.fires[y, j, :] = (own[1] + 2 * base) / (own.sum(axis=0) + 2)
        self.fires = np.clip(self.fires, 1e-6, 1 - 1e-6)


class Model:
    """Weights of traits; ``score`` is a probability."""

    def __init__(self, vocabulary: list[bytes], weights: np.ndarray, bias: float):
        self.number = {s: i for i, s in enumerate(vocabulary)}
        self.stems = _by_stem(vocabulary)
        self.weights, self.bias = weights, bias

    def present(self, text: bytes | None) -> list[int]:
        return sorted(self.number[t] for t in traits(text, self.stems) if t in self.number)

    def score(self, text: bytes | None) -> float:
        found = self.present(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.weights[found].sum() if found else 0.0), -60, 60))))


def _logistic(rows: list[list[int]], target: np.ndarray, width: int, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of present stems and bias for soft targets, by accelerated gradient descent."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    column = np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(rows)), sizes)
    n = max(1, len(rows))
    often = np.bincount(column, minlength=width) / n
    scale = 1 / (0.25 * np.sqrt(often) * np.sqrt(max(1.0, sizes.mean() if len(rows) else 1.0)) + penalty + 1e-3)
    mean = float(np.clip(target.mean() if len(rows) else 0.05, 1e-3, 1 - 1e-3))
    w, bias = np.zeros(width), np.log(mean / (1 - mean))
    ahead, ahead_bias, momentum = w.copy(), bias, 1.0
    for _ in range(steps):
        margin = np.bincount(row, weights=ahead[column], minlength=len(rows)) + ahead_bias
        wrong = 1 / (1 + np.exp(-np.clip(margin, -60, 60))) - target
        new = ahead - 0.25 * scale * (np.bincount(column, weights=wrong[row], minlength=width) / n + penalty * ahead)
        new_bias = ahead_bias - 0.5 * wrong.mean() if len(rows) else ahead_bias
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        ahead, ahead_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias, momentum = new, new_bias, following
    return w, float(bias)


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_mod(doc_id, 4) == 2


def _sketch(text: bytes | None) -> int:
    """The smallest hash of the text's five-word runs: near copies mostly share it."""
    words = _words(text)
    runs = (b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(r) for r in runs) - (1 << 63)


def _one_per_sketch(sample: DataFrame) -> DataFrame:
    """One row of (doc_id, text, toxic, half) for each sketch and label, so that copies do not count as evidence again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [_sketch(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.int64())], ["doc_id", "sketch"])

    marked = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, sketch long").distinct()
    first = marked.join(sample.select("doc_id", "toxic").distinct(), "doc_id").groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return sample.join(first.select("doc_id").distinct(), "doc_id")


def _mined(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Traits that tell toxic from clean texts: (toxic, best first; clean, best first), counted over the whole sample.

    A trait counts once per text. It must tell the classes apart in both halves of the sample, so that chance
    finds among very many traits do not pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, toxic, half in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.update((t, 2 * half + toxic) for t in traits(text.as_py()))
            if len(found) > 1_000_000:
                yield from flushed(found)
                found = Counter()
        yield from flushed(found)

    def flushed(found: Counter) -> Iterator[pa.RecordBatch]:
        stem, cell, n = [k[0] for k in found], [k[1] for k in found], list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array(stem, pa.binary()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["stem", "cell", "n"])

    cells = sample.select("text", "toxic", "half").mapInArrow(count, "stem binary, cell int, n long")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    of = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).cast("double")
    counts = cells.groupBy("stem").agg(*(of(c).alias(f"c{c}") for c in range(4)))
    seen = [sizes.get((0, y), 0) + sizes.get((1, y), 0) for y in (0, 1)]
    total = [F.col(f"c{y}") + F.col(f"c{2 + y}") for y in (0, 1)]
    share = [total[y] / float(max(1, seen[y])) for y in (0, 1)]
    # How many standard errors the shares are apart, and which part of the texts with the trait is toxic.
    pooled = (total[0] + total[1]) / float(max(1, sum(seen)))
    spread = F.sqrt(pooled * (1 - pooled) * sum(1.0 / max(1, n) for n in seen) + 1e-12)
    toxic_part = [(F.col(f"c{2 * h + 1}") + 0.5) / (F.col(f"c{2 * h}") + F.col(f"c{2 * h + 1}") + 1) for h in (0, 1)]
    base = seen[1] / max(1, sum(seen))
    judged = counts.select("stem", F.least(*toxic_part).alias("low"), F.greatest(*toxic_part).alias("high"), ((share[1] - share[0]) / spread).alias("z"), total[1].alias("in_toxic"))
    toxic = judged.where(f"z > 6 AND low > {LEAST_PRECISION} AND in_toxic >= 5").orderBy(F.desc("z"), "stem").limit(TRAITS * 3 // 4)
    clean = judged.where(f"z < -4 AND high < {0.7 * base}").orderBy("z", "stem").limit(TRAITS // 4)
    return [bytes(r["stem"]) for r in toxic.collect()], [bytes(r["stem"]) for r in clean.collect()]


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = LABELLED_ROWS) -> Model:
    """A model from ``documents`` and ``labels`` (doc_id, toxic 0 or 1).

    Labels of held-out rows are not read. Null labels and ids are passed over; of several labels of one id the
    largest counts. Without any label the written lexicons alone make the score.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen = (
        labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    chosen = F.broadcast(stored(chosen, "toxicity-labels"))  # bounded: at most ``rows`` ids with their label
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    labelled = stored(docs.join(chosen, "doc_id").select("doc_id", "text", "toxic", half.alias("half")), "toxicity-labelled")
    sample = stored(_one_per_sketch(labelled), "toxicity-sample")
    mined, clean = _mined(sample)
    voters = Voters(mined, clean)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value, toxic in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist(), strict=True):
                found[voters.votes(value.as_py()), -1 if toxic is None else toxic] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], ["votes", "toxic", "n"]
        )

    every = docs.join(chosen, "doc_id", "left").select("text", "toxic").mapInArrow(cast, "votes long, toxic int, n long")
    votes = stored(every.groupBy("votes", "toxic").agg(F.sum("n").alias("n")), "toxicity-votes")
    model = LabelModel(voters.count)
    if votes.where("toxic >= 0").isEmpty():
        lexicon = [t for t in voters.of if t.endswith(b" 1")]
        return Model(lexicon, np.full(len(lexicon), 3.0), -3.0)

    def expected(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mass, pairs = np.zeros(2), np.zeros((2, voters.count, voters.count))
            for batch in batches:
                bits, toxic, n = (batch.column(i).to_numpy() for i in range(3))
                known = toxic >= 0
                # The first step trusts labels alone; later ones take the other texts by their posterior.
                belief = np.where(known, toxic, 0.0 if step == 0 else model.posterior(bits))
                n = np.where(known | (step > 0), n, 0)
                v = _unpacked(bits, voters.count)
                for y, w in ((0, n * (1 - belief)), (1, n * belief)):
                    mass[y] += w.sum()
                    pairs[y] += (v * w[:, None]).T @ v
            flat = np.concatenate([mass, pairs.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

        return run

    for step in range(EM_STEPS):
        sums = votes.mapInArrow(expected(step), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
        flat = np.array([r["value"] for r in sums])
        model.maximise(flat[:2], flat[2:].reshape(2, voters.count, voters.count))

    vocabulary = list(dict.fromkeys([*(t for t in voters.of if t.endswith(b" 1")), *mined, *clean]))
    blank = Model(vocabulary, np.zeros(len(vocabulary)), 0.0)

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0).cast(pa.large_binary())]
            target = model.posterior(np.array([voters.votes(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([blank.present(t) for t in texts], pa.list_(pa.int32())), pa.array(target)], ["stems", "target"])

    # Bounded: LABELLED_ROWS rows of at most TRAITS numbers.
    lessons = sample.select("text").mapInArrow(taught, "stems array<int>, target double").collect()
    target = np.clip(np.array([r["target"] for r in lessons]), 0.002, 0.998)
    return Model(vocabulary, *_logistic([r["stems"] for r in lessons], target, len(vocabulary)))


def scored(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of the whole text; a null or empty text has no stems and gets the model's base rate.
    A column of that name is replaced; all others, repeated rows and nulls stay."""
    kept = [c for c in documents.columns if c != name]
    at = kept.index(text)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(t.as_py()) for t in batch.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, name])

    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField(name, T.DoubleType())])
    return documents.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)

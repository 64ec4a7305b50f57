"""Scores whole documents with a gated recurrent language model trained on the corpus itself.

1. Words of the training documents are counted, folded in the tasks and by one shuffle.
2. The most frequent words (``HEAD``, a fixed number) are sent to all tasks; the first of them
   are the network's vocabulary.
3. Training: a hash deals the training documents into cells of about the same number of words. In every round
   each share runs its cell through a copy of the network (truncated backpropagation in ``recurrent``),
   and the copies are averaged by words seen. Every training document is in exactly one cell.
4. Scoring: each task runs its documents in parallel lanes, with the state carried over window
   borders, and gives the log-likelihood of each whole document.

Words beyond the vocabulary are one output class; within it a word has the share of its smoothed
count. Counts of words beyond the head are too many to send: (document, word, number) rows are
joined with the count table and folded back per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, new_path, stored
from .recurrent import END, Network, Pass, laid_out

HEAD, VOCABULARY, CLASSES, HIDDEN = 1 << 17, 4096, 64, 16
WINDOW, LANES, RATE = 32, 512, 0.01
#: Words of a cell, which one copy of the network reads in one round; shares from which on there are more rounds; the least and the most of them.
CELL_WORDS, SHARES, ROUNDS = 2_000_000, 8, (2, 8)
#: Tasks of a round; with more shares than that, a task trains several, one after the other.
MOST_TASKS = 10_000
#: Words held at once in a task: documents are laid out into lanes pool by pool.
POOL_WORDS = 3_000_000
#: Bytes of text that are cut into words at once; a longer text is cut alone.
SLICE_BYTES = 4_000_000
#: Words counted at once in a task.
COUNT_WORDS = 2_000_000
BLOCKS = 64


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE_BYTES of text in column ``at``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, side="right"))
        high = max(high, low + 1)
        yield batch.slice(low, high - low)
        low = high


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A-Z lower-cased words without ASCII white space of all texts in turn (null: none), and where each text begins and the last ends.

    The end of a text is a token of its own, not listed here.
    """
    # Not the other way round: a slice cast to another width starts inside its bytes, which ``ascii_lower`` overlooks.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    words, starts = lists.values, lists.offsets.to_numpy().astype(np.int64)
    there = pc.binary_length(words).to_numpy() > 0  # white space at either side of a text leaves an empty word there
    if not there.all():
        words, starts = words.filter(pa.array(there)), np.append(0, np.cumsum(there))[starts]
    return words, starts


def numbered(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Places of words in ``among`` counted from 1 (0 is the end of a text), -1 for all others."""
    return pc.fill_null(pc.add(pc.index_in(words, value_set=among), pa.scalar(1, pa.int32())), -1).to_numpy()


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_mod(doc_id, 5) == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over the texts of the only column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                held.append(tokens(part.column(0))[0])
                size += len(held[-1])
                if size >= COUNT_WORDS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        found = pa.chunked_array(held).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.large_binary()).cast(pa.binary()), found.field("counts")], ["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _level() -> Column:
    """Counts by eighths of powers of two."""
    return F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")


def _head_level(counts: DataFrame) -> int:
    """The lowest level from which on there are no more than HEAD words; a few hundred levels are looked at."""
    total, lowest = 0, 2**30
    for level, words in sorted(map(tuple, counts.groupBy(_level().alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True):
        total += words
        if total > HEAD:
            break
        lowest = level
    return lowest


class Head:
    """The most frequent words in order, their counts, and the mass of all words beyond the vocabulary."""

    def __init__(self, words: list[bytes], counts: np.ndarray, documents: int, total: int, distinct: int):
        self.words = pa.array(words, pa.large_binary()).view(pa.large_string())  # compared byte by byte
        self.weight = np.log10(np.concatenate([[documents], counts]) + 0.5)
        self.total, self.distinct, self.end_known = total, distinct, documents > 0
        self.base = np.log10(total + 0.5 * (distinct + 1))
        self.size = min(VOCABULARY, len(words) + 1)
        inside = documents + int(counts[: self.size - 1].sum())
        self.counts = np.concatenate([[documents], counts[: self.size - 1], [total - inside]]).astype(np.float64)
        self.other = np.log10(max(total - inside, 0) + 0.5 * (max(distinct - (self.size - 1) - self.end_known, 0) + 1))

    @property
    def number(self) -> dict[bytes, int]:
        """As ``numbered`` counts them."""
        return {w: i + 1 for i, w in enumerate(self.words.view(pa.large_binary()).to_pylist())}

    def network(self) -> Network:
        return Network(self.size, min(CLASSES, self.size), HIDDEN).start(self.counts)


class _Part:
    """Some rows of a batch, their words as numbers and what the counts alone say about every text."""

    def __init__(self, batch: pa.RecordBatch, at: int, head: Head):
        words, starts = tokens(batch.column(at))
        found = numbered(words, head.words)
        rows = batch.num_rows
        owner = np.repeat(np.arange(rows), np.diff(starts))
        self.batch, self.rows = batch, rows
        # Words beyond the vocabulary are one number for the network, each text is followed by its end.
        far = (found < 0) | (found >= head.size)
        self.texts = np.split(np.insert(np.where(far, head.size, found), starts[1:], END), (starts[1:] + np.arange(1, rows + 1))[:-1])
        known = found > 0
        weight = np.where(known, head.weight[found], 0)
        self.n_tokens = np.diff(starts) + 1
        self.n_known = np.bincount(owner, weights=known, minlength=rows).astype(np.int64) + int(head.end_known)
        self.head_sum = np.bincount(owner, weights=weight, minlength=rows) + head.weight[0]
        self.other_sum = np.bincount(owner, weights=weight * far, minlength=rows)
        self.n_other = np.bincount(owner, weights=far, minlength=rows).astype(np.int64)
        self.rare = self._rare(words, ~known, owner)

    def _rare(self, words: pa.Array, rare: np.ndarray, owner: np.ndarray) -> pa.Array:
        """Per text: its distinct words that are not in the head, with their numbers."""
        coded = words.filter(pa.array(rare)).dictionary_encode()
        distinct = max(len(coded.dictionary), 1)
        pairs, times = np.unique(owner[rare] * distinct + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(pairs, np.arange(self.rows + 1) * distinct)
        word = coded.dictionary.take(pa.array(pairs % distinct)).cast(pa.large_binary()).cast(pa.binary())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([word, pa.array(times, pa.int64())], ["word", "n"]))


def _pools(batches: Iterator[pa.RecordBatch], head: Head, at: int) -> Iterator[list[_Part]]:
    """The rows in parts, about POOL_WORDS at a time."""
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, at):
            held.append(_Part(batch, at, head))
            size += int(held[-1].n_tokens.sum())
            if size >= POOL_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _dealt(training: DataFrame, known: pa.Array, vocabulary: int, cell: Column, rounds: int, label: str) -> DataFrame:
    """(_round, _share, _key, numbers) of the texts in the first column, written by round: what the network reads, two bytes a word."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                words, starts = tokens(batch.column(0))
                found = numbered(words, known)
                found = np.insert(np.where(found < 0, vocabulary, found).astype("<u2"), starts[1:], END)
                ends = 2 * (starts + np.arange(len(starts)))
                own = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), own], ["_round", "_share", "_key", "numbers"])

    schema = "_round int, _share int, _key long, numbers binary"
    placed = training.select(
        "text", (cell % rounds).cast("int").alias("_round"), F.floor(cell / rounds).cast("int").alias("_share"), F.col("_key")
    ).mapInArrow(encode, schema)
    path = new_path(training.sparkSession, label)
    placed.write.partitionBy("_round").parquet(path)
    return training.sparkSession.read.schema(schema).parquet(path)


def train(training: DataFrame, head: Head) -> np.ndarray:
    """Parameters of the network after all rounds over ``training`` (text, _key: a hash of the row).

    The words of the corpus alone decide into how many cells of about CELL_WORDS a hash deals the documents,
    and cells into rounds and shares. Every share of a round trains its own copy from the same start, in the order of
    the hash, and copies are averaged in the order of shares; so the result does not depend on partitions, and a copy takes as
    many steps in a large corpus as in a small one.
    """
    context = training.sparkSession.sparkContext
    now = head.network().flat()
    width = -(-len(now) // BLOCKS)
    cells = max(1, -(-head.total // CELL_WORDS))
    rounds = min(max(cells // SHARES, ROUNDS[0]), ROUNDS[1])
    shares = -(-cells // rounds)
    sizes = (head.size, min(CLASSES, head.size))
    dealt = _dealt(training, head.words.slice(0, head.size - 1), head.size, F.pmod("_key", F.lit(rounds * shares)), rounds, "lm-cells")
    schema = "block int, share int, seen double, sums binary"
    for turn in range(rounds):
        sent = context.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def follow(copy: Pass, texts: list[np.ndarray]) -> int:
                # Few lanes for little text: a gradient step for each window needs windows.
                lanes = int(np.clip(sum(map(len, texts)) // (WINDOW * 64), 16, LANES))
                places, _, size = laid_out(texts, lanes)
                copy.run(places, size)
                return int(size.sum())

            def closed(share: int, copy: Pass, seen: int) -> pa.RecordBatch:
                flat = copy.net.flat()
                if not np.isfinite(flat).all():
                    raise FloatingPointError(f"the network is no longer finite after {seen} words of a share; none of them would count")
                parts = [(flat[i : i + width].astype(np.float64) * seen).tobytes() for i in range(0, len(flat), width)]
                n = len(parts)
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([share] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(parts, pa.binary())], ["block", "share", "seen", "sums"]
                )

            at, copy, texts, held, seen = None, None, [], 0, 0
            for batch in batches:
                for share, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if share != at:
                        if at is not None:
                            yield closed(at, copy, seen + follow(copy, texts))
                        at, texts, held, seen = share, [], 0, 0
                        copy = Pass(Network(*sizes, HIDDEN).load(sent.value), WINDOW, RATE)
                    elif held >= POOL_WORDS:
                        seen += follow(copy, texts)
                        texts, held = [], 0
                    texts.append(np.frombuffer(numbers.as_buffer(), "<u2").astype(np.int32))
                    held += len(texts[-1])
            if at is not None:
                yield closed(at, copy, seen + follow(copy, texts))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, seen, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    part = np.frombuffer(part.as_buffer())
                    own = sums.setdefault(block, [0.0, np.zeros(len(part))])
                    own[0] += seen
                    own[1] += part
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.float64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["block", "seen", "sums"]
            )

        own = dealt.where(F.col("_round") == turn).repartitionById(min(shares, MOST_TASKS), F.col("_share")).sortWithinPartitions("_share", "_key", "numbers")
        copies = stored(own.select("_share", "numbers").mapInArrow(learn, schema), "lm-round")
        # Bounded: one network, block by block.
        blocks = copies.repartition("block").sortWithinPartitions("block", "share").mapInArrow(add, "block int, seen double, sums binary").orderBy("block").collect()
        if blocks:
            now = np.concatenate([np.frombuffer(bytes(b["sums"])) / b["seen"] for b in blocks]).astype(np.float32)
        sent.unpersist()
    return now


def score(documents: DataFrame, train_on: Column, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows for which ``train_on`` holds.

    Scores are base-10 log probabilities of the whole text with its end. ``base_score`` is that of smoothed word
    counts, (c + 0.5) / (N + 0.5 (V + 1)); ``score`` is the network's. A null text is empty: one token, its end.
    Repeated rows count each. Null ids are kept. An empty table gives no rows; without training rows all counts are 0.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), train_on.alias("trains"))
    training = docs.where("trains")
    counts = stored(word_counts(training.select("text")), "lm-counts")
    documents_seen = training.count()
    words_seen, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = _head_level(counts)
    # Bounded: HEAD words at most.
    top = counts.where(_level() >= frequent).toArrow()
    words, times = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-times[i], words[i]))
    head = Head([words[i] for i in order], times[order].astype(np.float64), documents_seen, words_seen + documents_seen, distinct + (documents_seen > 0))
    del top, words, times, order
    parameters = train(training.select("text", F.xxhash64("doc_id", "text").alias("_key")), head)
    sent = documents.sparkSession.sparkContext.broadcast((head, parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parameters = sent.value
        reader = Pass(head.network().load(parameters), WINDOW)
        for held in _pools(batches, head, 1):
            texts = [text for part in held for text in part.texts]
            places, owner, size = laid_out(texts, LANES)
            logs = reader.run(places, size)
            there = owner >= 0
            natural = np.bincount(owner[there], weights=logs[there].astype(np.float64), minlength=len(texts)) / np.log(10)
            at = 0
            for part in held:
                keys = [xxhash.xxh64_intdigest(t.as_py(), 7) - (1 << 63) for t in part.batch.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([
                    part.batch.column(0), pa.array(keys, pa.int64()), pa.array(part.n_tokens), pa.array(part.n_known), pa.array(part.head_sum),
                    pa.array(part.other_sum), pa.array(part.n_other), pa.array(natural[at : at + part.rows]), part.rare,
                ], ["doc_id", "text_key", "n_tokens", "head_known", "head_sum", "other_sum", "n_other", "network", "rare"])
                at += part.rows

    schema = (
        "doc_id long, text_key long, n_tokens long, head_known long, head_sum double, other_sum double, n_other long,"
        " network double, rare array<struct<word: binary, n: long>>"
    )
    parts = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "lm-parts")
    words = parts.where(F.size("rare") > 0).select("doc_id", "text_key", F.posexplode("rare").alias("at", "r")).select(
        "doc_id", "text_key", (F.col("at") == 0).cast("long").alias("row"), F.col("r.word").alias("word"), F.col("r.n").alias("times")
    )
    beyond = counts.where(_level() < frequent)
    looked = words.join(beyond, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Rows that share id and text are folded together: the sums are those of one row times their number.
    folded = looked.groupBy("doc_id", "text_key").agg(
        F.sum("row").alias("rows"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rare_sum"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    ).select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), (F.col("rare_sum") / F.col("rows")).alias("rare_sum"), (F.col("rare_known") / F.col("rows")).cast("long").alias("rare_known"))
    joined = parts.drop("rare").join(folded, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")), "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(head.total)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + rare_sum - F.col("n_tokens") * float(head.base)).alias("base_score"),
        (F.col("network") + F.col("other_sum") + rare_sum - F.col("n_other") * float(head.other)).alias("score"),
    )

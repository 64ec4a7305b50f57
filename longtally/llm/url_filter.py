"""URL rules as a bit-parallel wildcard automaton.

Every rule is a glob over a canonical address. All globs are packed one after the other
into the bits of several 64-bit words (multiword Shift-And). One step per character moves
the states of all globs of an address at once:

    state' = ((state << 1) & enter[c]) | (state & stay[c])

``enter[c]`` has the bits of glob characters that accept c, ``stay[c]`` those of wildcards
that may swallow c. Numpy applies the step to all addresses of a batch that are at least
that long, so neither the number of rules nor a very long address costs a Python loop per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii

SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` as globs: ``*`` is any run (within the host: of other characters than /), ``?`` one character."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """Masks of a rule list. Rule i is recognised by bit ``final[i]``."""

    def __init__(self, rules: list[Rule]):
        symbols: list[tuple[int | None, bool, bool]] = []  # (character or any, stays on host characters, stays on all)
        self.first: list[int] = []
        self.final: list[int] = []
        for rule in rules:
            self.first.append(len(symbols))
            symbols.append((-1, True, False))  # before the first character: any subdomain may come
            for in_path, glob in ((False, ("." + rule.host).encode()), (True, rule.path.encode() + b"*")):
                for c in glob:
                    if c == ord("*"):
                        symbols[-1] = (symbols[-1][0], True, symbols[-1][2] or in_path)
                    else:
                        symbols.append((None if c == ord("?") else c, False, False))
            self.final.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (character, on_host, on_all) in enumerate(symbols):
            word, bit = divmod(i, 64)
            one = np.uint64(1 << bit)
            if character is None:
                self.enter[:, word] |= one
                self.enter[SLASH, word] &= ~one
            elif character >= 0:
                self.enter[character, word] |= one
            if on_host or on_all:
                self.stay[:, word] |= one
                if not on_all:
                    self.stay[SLASH, word] &= ~one
        for i in self.first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def states(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """End states of addresses text[begin : begin + length], one row of words each."""
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state = np.tile(self.start, (len(begin), 1))
        ends = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for at, active in enumerate(ends):
            c = text[begin[:active] + at]
            now = state[:active]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (shifted & self.enter[c]) | (now & self.stay[c])
        out = np.empty_like(state)
        out[order] = state
        return out

    def best(self, state: np.ndarray, priority: list[int]) -> np.ndarray:
        """Index of the first rule of ``priority`` that each state accepts, or -1."""
        found = np.full(len(state), -1, np.int64)
        for rule in reversed(priority):
            word, bit = divmod(self.final[rule], 64)
            found[(state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1] = rule
        return found


def with_host_and_path(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or
    the end. Without ``://``, or null: both empty."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    parts = r"^([^/?#]*)([^?#]*)"
    return df.withColumns({host: lower_ascii(F.regexp_extract(rest, parts, 1)), path: F.regexp_extract(rest, parts, 2)})


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``rule`` (host and path of the longest rule that fits, else null) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of rules
    as long as each other the earlier wins. Without a fitting rule the verdict is ``default``.
    Null host or path counts as empty. Columns ``rule`` and ``verdict`` of the input are replaced.
    """
    rules = list(rules)
    automaton = Automaton(rules)
    priority = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    kept = [c for c in df.columns if c not in ("rule", "verdict")]
    names = [*(r.name for r in rules), None]
    verdicts = [*(r.verdict for r in rules), default]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(kept.index(c)).cast(pa.large_binary()).to_pylist() for c in (host, path))
            pieces = [b"." + (h or b"") + (p or b"") for h, p in zip(hosts, paths, strict=True)]
            length = np.fromiter(map(len, pieces), np.int64, len(pieces))
            text = np.frombuffer(b"".join(pieces), np.uint8)
            found = automaton.best(automaton.states(text, np.cumsum(length) - length, length), priority)
            columns = [pa.array([values[i] for i in found], pa.string()) for values in (names, verdicts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, "rule", "verdict"])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return df.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)

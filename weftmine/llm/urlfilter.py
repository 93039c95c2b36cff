"""URL filters by a bit-parallel wildcard automaton.

Defined results: a null url, or one without ``://``, has empty host and path, which no host rule
fits; a null page_id is carried; a url of any length takes time and memory in proportion; an empty table gives no rows; repeated rows each get their own; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that UTF-8 never has: one begins a canonical URL, one parts host and path.
BEGIN, PART = 0xFE, 0xFF


class HostRule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Glob(NamedTuple):
    """``*`` is any run of characters, ``?`` one byte. What stands before the first ``/`` is held against the host with a dot before it, the rest against the path; a star of the host part stays in the host."""

    glob: str
    verdict: str


# The rules of the contract.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
#: Where no host rule fits: hosts with a label of these kinds are blocked, and so are these paths.
GLOBS = tuple(Glob(g, "block") for g in ("*.ads-*", "*.adult-*", "*.casino-*", "*.cheap-*", "*.free-*", "*.spam-*", "*.ads.*", "*/ads/*", "*/*/ads/*", "*/*.exe", "*/*.zip"))

Token = tuple[object, object]  # the bytes that a state takes, the bytes on which it stays
ANY = frozenset(range(256)) - {BEGIN}
IN_HOST = ANY - {PART}


def _tokens(host: str, path: str | None, star: bool) -> list[list]:
    """States of one pattern. star: ``*`` and ``?`` are wildcards."""
    states = [[frozenset({BEGIN}), frozenset()]]

    def add(text: str, stay: frozenset) -> None:
        for b in text.encode():
            if star and b == ord("*"):
                states[-1][1] = states[-1][1] | stay
            else:
                states.append([stay if star and b == ord("?") else frozenset({b}), frozenset()])

    add(host, IN_HOST)
    states.append([frozenset({PART}), frozenset()])
    if path is None:
        states[-1][1] = ANY
    else:
        add(path, ANY)
    return states


#: Bytes of a text that goes with others of its batch.
LONG = 4096


class Automaton:
    """All patterns' states, one bit each, packed into as many 64-bit words as they need."""

    def __init__(self, host_rules: Sequence[HostRule], globs: Sequence[Glob]):
        patterns = []
        for r in host_rules:
            states = _tokens("." + r.host, r.path, star=False)
            states[0][1], states[-1][1] = IN_HOST, ANY  # subdomains before it, any path after it
            patterns.append(states)
        for g in globs:
            host, slash, path = g.glob.partition("/")
            patterns.append(_tokens(host, slash + path if slash else None, star=True))
        n = sum(map(len, patterns))
        self.words = max(1, -(-n // 64))
        self.take = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for states in patterns:
            for i, (take, stay) in enumerate(states):
                word, bit = divmod(at, 64)
                bit = np.uint64(1 << bit)
                for table, which in ((self.take, take), (self.stay, stay)):
                    table[list(which), word] |= bit
                if i == 0:
                    self.first[word] |= bit
                at += 1
            self.final.append((word, bit))

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each text and pattern, whether the pattern takes the whole text. Texts go side by side, a byte of all at a time; those of more than LONG bytes one by one."""
        out = np.zeros((len(lengths), len(self.final)), bool)
        long = lengths > LONG
        for i in np.flatnonzero(long).tolist():
            out[i] = self._alone(data[starts[i] : starts[i] + lengths[i]].tobytes())
        out[~long] = self._abreast(data, starts[~long], lengths[~long])
        return out

    def _alone(self, text: bytes) -> list[bool]:
        """The same automaton over one text, with all words of bits as one whole number."""
        whole = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        take, stay = ([whole(row) for row in table] for table in (self.take, self.stay))
        first = whole(self.first)
        inner, state = ~first, 0
        for j, c in enumerate(text):
            moved = (state << 1) & inner
            state = (moved if j else moved | first) & take[c] | state & stay[c]
        return [bool(state >> (64 * word) & int(bit)) for word, bit in self.final]

    def _abreast(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        state = np.zeros((len(sizes), self.words), np.uint64)
        alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for j, n in enumerate(alive):
            c, d = data[starts[:n] + j], state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved = moved & ~self.first | (self.first if j == 0 else np.uint64(0))
            state[:n] = moved & self.take[c] | d & self.stay[c]
        out = np.zeros((len(sizes), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = state[:, word] & bit != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    part = lambda k: F.coalesce(F.regexp_extract(url, found, k), F.lit(""))
    return F.translate(part(1), upper, upper.lower()), part(2)


def judge(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, globs: Sequence[Glob] = GLOBS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: the longest host rule that fits, else a blocking glob, another glob, or the default."""
    longest = sorted(range(len(host_rules)), key=lambda k: (-len(host_rules[k].name), k))
    later = sorted(range(len(globs)), key=lambda k: (globs[k].verdict != "block", k))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(host_rules, globs)
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in (1, 2))
            texts = [b"\xfe." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths, strict=True)]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
            fits = automaton.run(data, np.cumsum(lengths) - lengths, lengths)
            rule, verdict = np.full(len(texts), None, object), np.full(len(texts), default, object)
            for k in reversed(later):
                verdict[fits[:, len(host_rules) + k]] = globs[k].verdict
            for k in reversed(longest):
                rule[fits[:, k]], verdict[fits[:, k]] = host_rules[k].name, host_rules[k].verdict
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(verdicts, "page_id long, host string, path string, rule string, verdict string")

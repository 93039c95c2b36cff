"""Best-fit packing: documents' tokens into as few sequences as can be, by best-two-fit.

Defined results: a null or empty text is the end token alone; an empty table gives no rows; repeated rows are packed
each, as are rows with a null doc_id, whose pieces carry it; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.llm.arrow import slices, utf8
from weftmine.llm.shingles import stretches, words
from weftmine.operators.prefix import prefix_sums
from weftmine.session import cut

LENGTH, END = 4096, 1
#: Words whose ids a worker keeps.
KNOWN = 1_000_000
_BLANK = np.isin(np.arange(256), (0x20, 0x0A))
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class WordIds:
    """Ids of whole texts. The tokenizer never joins what spaces or line ends part, so that a word's ids are found once and kept, under the word's hash and with its bytes, which every later one is compared with."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.letters, self.begin, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each has. Letters with punctuation after them are two runs at most for the tokenizer, so that many such words are encoded as one text and parted at the ends of runs."""
        simple, runs, odd = [], np.zeros(len(words), np.int64), []
        for i, word in enumerate(words):
            core = word.rstrip(_PUNCTUATION)
            if core == word and core.isalpha():
                simple.append(word)
                runs[i] = 1
            elif not core or core.isalpha():
                simple += [core, word[len(core) :]] if core else [word]
                runs[i] = 2 if core else bool(word)
            else:
                odd.append(i)
        ids = self._plain(" ".join(simple))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != runs.sum():  # letters that become something else in lower case
            each = [self._plain(w) for w in words]
            return np.concatenate([ids[:0], *each]), np.array([*map(len, each)], np.int64)
        n = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(runs)])])
        if odd:
            each = {i: np.array(e.ids, np.uint32) for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True)}
            parts, at = [], 0
            for i, got in each.items():
                upto = int(n[:i].sum()) if not at else int(upto + n[last:i].sum())
                parts += [ids[at:upto], got]
                at, last = upto, i
            ids = np.concatenate([*parts, ids[at:]])
            n[odd] = [*map(len, each.values())]
        return ids, n

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        written = [w.encode() for w in words]
        size = np.array([*map(len, written)], np.int64)
        self.begin = np.concatenate([self.begin, len(self.letters) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(written), np.uint8)])
        for i in range(0, len(words), 20_000):
            ids, n = self._of_words(words[i : i + 20_000])
            self.at = np.concatenate([self.at, (len(self.pool) + np.cumsum(n) - n).astype(np.int32)])
            self.n = np.concatenate([self.n, n.astype(np.int32)])
            self.pool = np.concatenate([self.pool, ids])
        self.hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at, self.n, self.begin, self.size = (x[order] for x in (self.hashes, self.at, self.n, self.begin, self.size))

    def _each(self, whole: bytes, offsets: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Text by text; those with a special token in them, or all of them if apart, without what was learnt."""
        texts = [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = [self._plain(t.decode()) if apart or any(s in t.lower() for s in self.special) else self.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
        return np.concatenate([self.pool[:0], *each]), np.cumsum([0, *map(len, each)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin and the last's end."""
        whole = data.tobytes()
        if len(offsets) > 1 and any(s in whole.lower() for s in self.special):
            return self._each(whole, offsets)
        lower, begins, ends, hashes, starts = words(data, offsets, _BLANK)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(kinds) > KNOWN:
            self._forget()
        at = np.searchsorted(self.hashes, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != kinds[inside]
        if new.any():
            text = lower.tobytes()
            self._learn(kinds[new], [text[a:b].decode() for a, b in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, kinds)
        its = at[which]
        sizes = ends - begins
        if (sizes != self.size[its]).any() or (lower[stretches(begins, sizes)] != self.letters[stretches(self.begin[its], sizes)]).any():
            # Two words with one hash: neither is looked up.
            return self._each(whole, offsets, apart=True)
        n = self.n[at][which].astype(np.int64)
        upto = np.cumsum(n)
        ids = self.pool[np.arange(upto[-1] if len(n) else 0) + np.repeat(self.at[at][which] - (upto - n), n)]
        return ids, np.concatenate([[0], upto])[starts]


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id after them, cut where they are more than ``length``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out = []
            all_texts, at = ids.encode(*utf8(batch.column("text")))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                all_ids = all_texts[a:b].astype("<u4").tobytes() + last
                for piece, at in enumerate(range(0, len(all_ids), 4 * length)):
                    part = all_ids[at : at + 4 * length]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """How often each filling of a sequence is used: (times, {piece length: how many}).

    counts: pieces by length. A filling starts with the longest piece left and takes the longest that fits, again
    and again. Then its smallest piece gives way to the two unpacked ones that fill the widened gap best, where
    they fill it better. A filling is used as often as the pieces suffice: each exhausts a length or
    lowers how many of it a later one takes, so there are length * H(length) fillings at most.
    """
    left = counts.copy()
    sizes = np.arange(length + 1)
    fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest left up to each size
    out = []

    def take(filling: dict[int, int], size: int, n: int = 1) -> None:
        filling[size] = filling.get(size, 0) + n
        if not filling[size]:
            del filling[size]

    while fits[length]:
        filling: dict[int, int] = {}
        gap = length
        while gap:
            size = int(fits[gap])
            while size and left[size] <= filling.get(size, 0):
                size = int(fits[size - 1])
            if not size:
                break
            n = int(min(gap // size, left[size] - filling.get(size, 0)))
            take(filling, size, n)
            gap -= n * size
        small = min(filling)
        wide = gap + small
        spare = left[: wide + 1].copy()
        for size, n in filling.items():
            if size <= wide:
                spare[size] -= n
        if gap and spare.any():
            best = np.maximum.accumulate(np.where(spare > 0, sizes[: wide + 1], 0))
            one = np.flatnonzero(spare > 0)
            two = np.where((best[wide - one] == one) & (spare[one] < 2), best[np.maximum(one - 1, 0)], best[wide - one])
            both = np.where(two > 0, one + two, 0)
            if (k := int(np.argmax(both))) is not None and both[k] > small:
                take(filling, small, -1)
                take(filling, int(one[k]))
                take(filling, int(two[k]))
        times = int(min(left[size] // n for size, n in filling.items()))
        for size, n in filling.items():
            left[size] -= n * times
        if any(not left[size] for size in filling):
            fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        out.append((times, filling))
    return out


def pack(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Only the counts of pieces by length, ``length`` numbers at most, reach the driver, and the fillings planned from
    them go back. Pieces of one length are numbered across all tasks; its number gives each its place.
    """
    numbered = prefix_sums(cut_pieces.withColumn("__one", F.lit(1)), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "__one", "__no").drop("__one")
    counts = np.zeros(length + 1, np.int64)
    for size, n in cut_pieces.groupBy("length").count().collect():
        counts[size] = n
    bits = 44
    starts, bases, uses, offsets = [], [], [], []
    given, sequence = np.zeros(length + 1, np.int64), 0
    for times, filling in plan(counts, length):
        offset = 0
        for size, n in sorted(filling.items(), reverse=True):
            starts.append(size << bits | int(given[size]))
            bases.append(sequence)
            uses.append(n)
            offsets.append(offset)
            given[size] += n * times
            offset += n * size
        sequence += times
    starts, bases, uses, offsets = (np.array(x, np.int64) for x in (starts, bases, uses, offsets))
    order = np.argsort(starts)
    starts, bases, uses, offsets = starts[order], bases[order], uses[order], offsets[order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, no = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__no"))
            at = np.searchsorted(starts, size << bits | no, side="right") - 1
            j = no - (starts[at] & (1 << bits) - 1)
            placed = bases[at] + j // uses[at], offsets[at] + j % uses[at] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pc.cast(pa.array(x), pa.int64()) for x in placed)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*names, "__no").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer, length, end)), length)

"""Suffix-array dedup by a logarithmic family of indexes: every byte that a repeated string of ``length`` bytes covers goes.

Of a text's suffixes, those are kept that start at an anchor: for each string of ``length`` bytes, the place within it whose
``GRAM`` following bytes have the smallest hash (the last of equal ones). Equal strings have their anchors at the same
place in them, so that repeats meet at anchors, and about one suffix in 50 is enough. A level is a sorted run of
suffixes: by their first eight letters, then by hashes of the gram and of the block, which is all bytes of the strings that have this anchor.

A new batch is merge-scanned against all levels: the rows of both are dealt out by ranges of the order, and neighbours in it are
compared. Equal blocks hold the same strings, all of which repeat; different blocks with an equal gram meet at the edge of a long match and
are compared string by string afterwards. Only neighbours matter, so that a passage of any number of copies may be spread over
any number of ranges; the first and the last row of each range are compared once more with those of the others. Levels of equal size
merge with the batch, so that n batches leave at most log2(n) + 1 levels. They stay as tables, and later batches may be added.

Defined results: texts shorter than ``length``, empty or null lose nothing; equal texts of that length or more go whole; an
empty table gives no rows; repeated rows are copies of each other; rows with the same doc_id and text have the same result; a null doc_id stands
for no other row; other columns are not read by ``marks`` and kept by ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmine.llm.arrow import slices, utf8
from weftmine.llm.shingles import mixed, stretches
from weftmine.session import drop, partitions, release, reopened, stored

LENGTH, GRAM, BATCHES = 200, 100, 3
#: Kinds of blocks around a gram from which on their strings are dealt out singly; bytes of blocks that meet in a task.
CROWD, TOGETHER = 1000, 2 << 20
#: Starts of strings that are looked at together; with the bytes of the last ones fewer than 2**24.
PIECE = 1 << 20
PRIME = np.uint64((1 << 31) - 1)
_RANDOM = np.random.default_rng(77)
_LETTERS = _RANDOM.integers(1, int(PRIME), (4, 256), np.uint64)
_BASES = tuple(int(x) for x in _RANDOM.integers(1 << 20, int(PRIME), 4))
_WIDE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return x - PRIME * (x >= PRIME)


def _power(base: int, n: int, modulus: int) -> np.ndarray:
    """base**0 ... base**(n-1)."""
    have = _powers.get((base, modulus))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            step = np.uint64(pow(base, len(have), modulus))
            have = np.concatenate([have, _rest(have * step) if modulus == PRIME else have * step])
        _powers[base, modulus] = have
    return have[:n]


class Hashes:
    """Hashes of any stretches of some bytes, from running sums of two polynomials modulo PRIME."""

    def __init__(self, data: np.ndarray, which: int):
        self.parts = []
        n = len(data) + 1
        for i in (2 * which, 2 * which + 1):
            sums = np.zeros(n, np.uint64)
            np.cumsum(_rest(_LETTERS[i][data] * _power(_BASES[i], n - 1, int(PRIME))), out=sums[1:])
            self.parts.append((sums, _power(pow(_BASES[i], -1, int(PRIME)), n, int(PRIME))))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (_rest(_rest(sums[end] - sums[begin]) * inverse[begin]) for sums, inverse in self.parts)
        return mixed((a << np.uint64(31) | b) + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lots(data: np.ndarray, gram: int) -> np.ndarray:
    """A number for each gram, which only chooses anchors: equal grams have equal ones."""
    base, n = 0xD1B54A32D192ED03, len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_WIDE[data] * _power(base, n, 1 << 64), out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * _power(pow(base, -1, 1 << 64), n + 1 - gram, 1 << 64))


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of all texts' blocks: text number, first and last start of its strings in the text, the anchor's first eight letters, gram hash, block hash.

    Strings are looked at by pieces of ``piece`` starts, so that a long text needs no more memory than a short one; a block ends where a piece does.
    """
    found = []
    for begin in range(0, max(1, len(data) - length + 1), piece):
        part = data[begin : begin + piece + length - 1]
        text, first, last, *hashes = _blocks(part, np.clip(offsets - begin, 0, len(part)), length, gram)
        found.append((text, first + begin - offsets[text], last + begin - offsets[text], *hashes))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Like blocks, with starts counted from the first of all bytes, of which there are fewer than 2**24."""
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    n = len(data) - length + 1
    sizes = np.diff(offsets)
    if n <= 0 or sizes.max(initial=0) < length:
        return nothing
    low = np.uint64(0xFFFFFF)
    best = _lots(data, gram) & ~low
    best |= low - np.arange(len(best), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    anchor = (low - (best & low)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    valid = np.arange(n) + length <= offsets[text + 1]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return nothing
    anchor, text = anchor[starts], text[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = starts[new]
    last = starts[np.concatenate([new[1:], [True]])]
    anchor, text = anchor[new], text[new]
    hashes = Hashes(data, 0)
    shape = ((anchor - first) << 32 | (last - first)).astype(np.uint64)
    whole = mixed(hashes.of(first, last + length) + shape * np.uint64(0x9E3779B97F4A7C15))
    letters = np.ascontiguousarray(data[anchor[:, None] + np.arange(min(8, gram))]) if gram >= 8 else np.pad(data[anchor[:, None] + np.arange(gram)], ((0, 0), (0, 8 - gram)))
    return text, first, last, letters.view(">u8")[:, 0].astype(np.uint64), hashes.of(anchor, anchor + gram), whole


def strings(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all strings that start at first..last: block number, start, and two hashes."""
    counts = last - first + 1
    block = np.repeat(np.arange(len(first)), counts)
    start = stretches(first, counts)
    return block, start, *(Hashes(data, i).of(start, start + length) for i in (0, 1))


def identity() -> list[Column]:
    """What stands for a document: its id and a hash of its text, which tells apart rows that share an id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text")).alias("doc"), F.xxhash64("text").alias("hash")]


#: The order of suffixes.
ORDER = ["letters", "gram", "block", "doc", "hash", "span"]
KNOWN, KIND, EDGE = 1, 2, 4


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The suffixes of each text: letters, gram, block, doc, hash, span (first start << 8 | further starts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            text, first, last, letters, grams, whole = blocks(*utf8(batch.column("text")), length, gram)
            letters = letters ^ np.uint64(1 << 63)  # signed numbers in the letters' order
            doc, its_hash = (batch.column(c).to_numpy()[text] for c in ("doc", "hash"))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (letters, grams, whole, doc, its_hash, first << 8 | last - first)], names=ORDER)

    if length - gram + 1 > 256:
        raise ValueError("a gram is too short for its strings")
    return docs.filter(F.length("text") > 0).select(*identity(), "text").mapInArrow(rows, ", ".join(f"{c} long" for c in ORDER))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``met`` to sorted rows: KNOWN next to an equal block, KIND next to another block of its gram, EDGE where a range begins or ends."""
    held: pa.RecordBatch | None = None  # the row before, with what is met so far
    for batch in batches:
        if not batch.num_rows:
            continue
        met = np.zeros(batch.num_rows, np.int32)
        if held is None:
            met[0] |= EDGE
        else:
            batch = pa.concat_batches([held.select(batch.schema.names), batch])
            met = np.concatenate([held.column("met").to_numpy(), met])
        letters, gram, block = (batch.column(c).to_numpy() for c in ORDER[:3])
        near = (letters[1:] == letters[:-1]) & (gram[1:] == gram[:-1])
        same = block[1:] == block[:-1]
        step = np.where(near, np.where(same, KNOWN, KIND), 0).astype(np.int32)
        met[1:] |= step
        met[:-1] |= step
        out = batch.append_column("met", pa.array(met))
        yield out.slice(0, out.num_rows - 1)
        held = out.slice(out.num_rows - 1)
    if held is not None:
        at = held.schema.get_field_index("met")
        yield held.set_column(at, "met", pa.array(held.column("met").to_numpy() | np.int32(EDGE)))


class Family:
    """Levels of sorted suffixes, each (number of batches, table); ``paths`` names their tables, from which a family can be opened again."""

    def __init__(self, spark: SparkSession, paths: list[tuple[int, str]] = ()):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = [(n, reopened(spark, path)) for n, path in paths]

    @property
    def paths(self) -> list[tuple[int, str]]:
        return [(n, level.inputFiles()[0].rsplit("/", 1)[0]) for n, level in self.levels if level.inputFiles()]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of suffixes. What its scan against the levels met and hadn't been told before: doc, hash, span, gram, block, met.

        The batch and the levels of equal size become one level, whose rows are those of this scan.
        """
        size, keep = 1, len(self.levels)
        while keep and self.levels[keep - 1][0] == size:
            size, keep = 2 * size, keep - 1
        rows = batch.select(*ORDER, F.lit(0).alias("told"), F.lit(True).alias("own"))
        for i, (_, level) in enumerate(self.levels):
            rows = rows.union(level.filter("own").select(*ORDER, "told", F.lit(i >= keep).alias("own")))
        dealt = rows.repartitionByRange(partitions(self.spark), *ORDER).sortWithinPartitions(*ORDER)
        scanned = dealt.mapInArrow(_neighbours, ", ".join(f"{c} long" for c in ORDER) + ", told int, own boolean, met int")
        new = F.col("met").bitwiseAND(F.bitwise_not("told"))
        run = scanned.select(*ORDER, "own", F.col("told").bitwiseOR(F.col("met").bitwiseAND(KNOWN | KIND)).alias("told"), new.alias("new"))
        run = stored(run.filter("own OR new > 0"))
        # The last row of a range and the first of the next: at most two rows for each range come together here.
        edges = run.filter(F.col("new") >= EDGE)
        order = Window.orderBy(*ORDER)
        facts = []
        for to in (F.lag, F.lead):
            near = F.struct("letters", "gram") == F.struct(to("letters").over(order), to("gram").over(order))
            facts.append(F.when(near, F.when(F.col("block") == to("block").over(order), KNOWN).otherwise(KIND)).otherwise(0))
        joined = edges.withColumn("new", facts[0].bitwiseOR(facts[1])).filter("new > 0")
        columns = ["doc", "hash", "span", "gram", "block", F.col("new").bitwiseAND(KNOWN | KIND).alias("met")]
        found = stored(run.filter(F.col("new") % EDGE > 0).select(columns).union(joined.select(columns)))
        for _, level in self.levels[keep:]:
            drop(level)
        self.levels[keep:] = [(size, run)]
        release(self.spark)
        return found

    def clear(self) -> None:
        for _, level in self.levels:
            drop(level)
        self.levels = []


def _repeats(first: np.ndarray, more: np.ndarray, data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks (their first start and further ones; each one's bytes lie between two ``begins`` in data): number of the block and span of each string that more than one of them holds, or one more than once."""
    parts, i = [], 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + (1 << 18), side="right")) - 1)
        low = begins[i]
        block, start, h1, h2 = strings(data[low : begins[j]], begins[i:j] - low, begins[i:j] - low + more[i:j], length)
        parts.append((block + i, start + low, h1, h2))
        i = j
    block, start, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    repeated = np.zeros(len(block), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    its = block[repeated]
    return its, first[its] + start[repeated] - begins[its] << 8


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """doc, hash, spans: of each document that has any, the starts of strings that occur more than once (first << 8 | further starts)."""
    spark = docs.sparkSession
    family, met = Family(spark), []
    for i in range(batches):
        part = docs if batches == 1 else docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(batches)) == i)
        batch = stored(suffixes(part, length, gram))
        met.append(family.add(batch))
        drop(batch)
    family.clear()
    release(spark)
    found = met[0]
    for more in met[1:]:
        found = found.union(more)

    known = found.filter(F.col("met").bitwiseAND(KNOWN) > 0).select("doc", "hash", "span")
    # Of blocks that differ around a gram, one place of each kind is looked at.
    kinds = found.filter(F.col("met").bitwiseAND(KIND) > 0).groupBy("gram", "block").agg(F.min(F.struct("doc", "hash", "span")).alias("at"))
    kinds = stored(kinds.select("gram", "at.*"))
    crowds = kinds.groupBy("gram").count().filter(F.col("count") > crowd).select("gram", F.lit(True).alias("crowded"))
    each = kinds.join(crowds, "gram", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    looked = each.groupBy("doc", "hash").agg(F.collect_list(F.struct("span", "gram", "crowded")).alias("looked"))

    schema = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("span", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bytes", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("looked")
            flat = lists.flatten()
            spans, grams, crowded = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            doc, its_hash = (batch.column(c).to_numpy()[text] for c in ("doc", "hash"))
            first, more = offsets[text] + (spans >> 8), spans & 255
            calm = np.flatnonzero(~crowded)
            whole = data.tobytes()
            content = [whole[a:b] for a, b in zip(first[calm].tolist(), (first + more + length)[calm].tolist(), strict=True)]
            nothing = pa.nulls(len(calm), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc[calm]), pa.array(its_hash[calm]), pa.array(spans[calm]), pa.array(grams[calm]), nothing, pa.array(content, pa.binary())], schema=schema)
            busy = np.flatnonzero(crowded)
            for i in range(0, len(busy), 20_000):
                part = busy[i : i + 20_000]
                ends = np.cumsum(more[part] + length)
                begins = ends - (more[part] + length)
                joined = np.frombuffer(b"".join([whole[a : a + n] for a, n in zip(first[part].tolist(), (more[part] + length).tolist(), strict=True)]), np.uint8)
                block, start, h1, h2 = strings(joined, begins, begins + more[part], length)
                its = part[block]
                columns = (doc[its], its_hash[its], (start - begins[block] + first[its] - offsets[text[its]]) << 8, h1.view(np.int64), h2.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(len(its), pa.binary())], schema=schema)

    texts = docs.select(*identity(), "text").join(looked, ["doc", "hash"]).dropDuplicates(["doc", "hash"]).select("doc", "hash", "text", "looked")
    each = stored(texts.mapInArrow(rows, "doc long, hash long, span long, h1 long, h2 long, bytes binary"))
    release(spark)

    # The blocks of a gram that has few kinds meet in one task, and many such grams with them.
    calm = each.filter("bytes IS NOT NULL")
    groups = max(partitions(spark), int((calm.agg(F.sum(F.length("bytes"))).first()[0] or 0) // TOGETHER))

    def meet(table: pa.Table) -> pa.Table:
        data, begins = utf8(table.column("bytes").combine_chunks())
        spans = table.column("span").to_numpy()
        its, span = _repeats(spans >> 8, spans & 255, data, begins, length)
        return pa.table({"doc": table.column("doc").to_numpy()[its], "hash": table.column("hash").to_numpy()[its], "span": span})

    dealt = calm.select("doc", "hash", "span", "bytes", F.pmod(F.xxhash64("h1"), F.lit(groups)).alias("g"))
    near = dealt.groupBy("g").applyInArrow(meet, "doc long, hash long, span long")
    # The strings of a gram that many share are dealt out one by one.
    busy = each.filter("bytes IS NULL")
    often = busy.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    far = busy.join(often, ["h1", "h2"]).select("doc", "hash", "span")
    out = stored(known.union(near).union(far).groupBy("doc", "hash").agg(F.collect_set("span").alias("spans")))
    drop(*met, kinds, each)
    release(spark)
    return out


def covered(spans: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of covered bytes begin and end."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, spans >> 8, 1)
    np.add.at(change, (spans >> 8) + (spans & 255) + length, -1)
    inside = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def _marked(docs: DataFrame, columns: list[str], options: dict) -> DataFrame:
    found = marks(docs, **options).select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("spans").alias("__spans"))
    doc, its_hash = identity()
    return docs.join(found, (doc == F.col("__doc")) & (its_hash == F.col("__hash")), "left").select(*columns, "__spans")


def _kept(text: bytes, spans, length: int) -> tuple[bytes, int, int]:
    if spans is None:
        return text, 0, 0
    begin, end = covered(np.asarray(spans, np.int64), len(text), length)
    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(text) - len(kept), len(begin)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    length = options.get("length", LENGTH)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            out = [_kept(t, s.values.to_numpy() if s.is_valid else None, length) for t, s in zip(texts, batch.column("__spans"), strict=True)]
            columns = [pa.array([*map(len, texts)], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in out])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs, ["doc_id", "text"], options).mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents with what is left of their texts; bytes of a character cut in two go with it, and so do texts of which nothing is left. n_chars, where there is one, counts anew."""
    length = options.get("length", LENGTH)

    touched = F.col("__spans").isNotNull()
    marked = _marked(docs, docs.columns, options)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = [t.as_py() if not s.is_valid else _kept((t.as_py() or "").encode(), s.values.to_numpy(), length)[0].decode(errors="ignore") for t, s in zip(batch.column("text"), batch.column("__spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    rows = marked.mapInArrow(rest, marked.schema)
    rows = rows.filter(~touched | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(docs.columns)

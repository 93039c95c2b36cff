"""MinHash near-dedup by min-max hashing: groups of documents linked by the similarity of their word shingles.

Both the minimum and the maximum under each permutation are kept, so that one evaluation of a hash gives two
signature values. Bands of signature values find which documents to compare; full shingle sets decide.

Texts with the same shingle set form a class, and one document stands for it. Classes that share a band's values are
joined into clusters, and each cluster's classes are compared in blocks of bounded size, large clusters' after exact cuts. Only as many links as join a block's linked
documents leave it, so that neither pairs of copies nor pairs within a large group are ever written out.

Defined results: a text without words, empty or null has no shingles, no links and stays; equal texts are linked;
an empty table gives no rows; repeated rows get the same result; rows that share a doc_id count as one document where links
are followed; a null doc_id stands for no other document; other columns are not read by ``near_duplicates`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmine.llm.arrow import slices, utf8
from weftmine.llm.shingles import mixed, shingle_sets, stretches
from weftmine.operators.components import components
from weftmine.operators.prefix import prefix_sums
from weftmine.session import cut, drop, partitions, stored

#: Bands of three permutations' minima and maxima: a pair at similarity 0.8 shares none with a chance of 6e-6, one at 0.85 of 6e-9.
BANDS, PERMUTATIONS = 40, 3
#: Bytes of text in a block of classes.
BLOCK = 2 << 20
#: What a row of a block counts for besides its bytes, so that a block of very short texts has few rows too.
ROW = 1024
#: Blocks from which on a cluster is cut before its blocks meet.
HOT = 8


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(907)
    return r.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, np.uint64)


def band_keys(sets: list[np.ndarray], bands: int = BANDS, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A key for each set (none empty) and band, made of the band's minima and maxima."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    values = np.concatenate(sets)
    a, b = _permutations(bands * permutations)
    out = np.zeros((len(sets), bands), np.uint64)
    h = np.empty_like(values)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for p in range(band * permutations, (band + 1) * permutations):
            np.multiply(values, a[p], out=h)
            h += b[p]
            key = mixed(key * np.uint64(31) + np.minimum.reduceat(h, starts))
            key = mixed(key * np.uint64(31) + np.maximum.reduceat(h, starts))
        out[:, band] = key
    return out


def signatures(docs: DataFrame, k: int, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, n_bytes, f1 and f2 (a fingerprint of the set), keys (none without shingles)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = utf8(batch.column("text"))
            sets = shingle_sets(data, offsets, k)
            n = np.array([*map(len, sets)], np.int64)
            full = [s for s in sets if len(s)]
            f = np.zeros((2, len(sets)), np.uint64)
            keys = np.zeros((0, bands), np.uint64)
            if full:
                values, starts = np.concatenate(full), np.cumsum([0, *map(len, full)])[:-1]
                f[0, n > 0] = np.add.reduceat(mixed(values + np.uint64(1)), starts)
                f[1, n > 0] = np.add.reduceat(mixed(values ^ np.uint64(0x5DEECE66D)), starts)
                keys = band_keys(full, bands, permutations)
            ends = np.cumsum(np.concatenate([[0], np.where(n > 0, bands, 0)])).astype(np.int32)
            columns = [batch.column("doc_id"), batch.column("row"), n, np.diff(offsets), *f.view(np.int64)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), lists], names=["doc_id", "row", "n_shingles", "n_bytes", "f1", "f2", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(rows, "doc_id long, row long, n_shingles long, n_bytes long, f1 long, f2 long, keys array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all classes (id, keys) sharing a band's key: each to the smallest id with that key."""
    keyed = classes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    shared = cut(shared)
    more = shared.filter("n > 2").select("key", "a").join(keyed, "key").select("a", F.col("id").alias("b"))
    return shared.select("a", "b").union(more).filter("a < b").distinct()


def prefixes(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of a set of each size to look for, and how many of them to look in.

    Sets of n >= m shingles that are linked have at least percent of n in common, and at least 2 percent / (100 + percent) of m. So their first common
    shingle, in any order of all shingles, is among the first n - ceil(percent of n) + 1 of the larger one and among the fewer
    first m - ceil(2 percent / (100 + percent) of m) + 1 of the smaller one.
    """
    return (100 - percent) * sizes // 100 + 1, (100 - percent) * sizes // (100 + percent) + 1


def forest_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (larger place, smaller place) that join what is linked. Pairs within a side other than 0 are left to another block.

    Sets stand by size, each set's shingles by the number of sets that hold them. A set is compared with those before it only where its ``prefixes`` and
    theirs meet, and only while they aren't joined yet.
    """
    n = len(sets)
    by = np.argsort([*map(len, sets)], kind="stable")
    sets, side = [sets[i] for i in by], side[by]
    sizes = np.array([*map(len, sets)])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(ids)
    ids = ids[np.lexsort((ids, frequency[ids], owner))]
    first, looked_in = prefixes(sizes, percent)
    place = np.arange(len(ids)) - starts[owner]
    kept = (place < looked_in[owner]) & (frequency[ids] > 1)
    order = np.argsort(ids[kept], kind="stable")
    holders, held = owner[kept][order], np.bincount(ids[kept], minlength=len(frequency))
    begin = np.cumsum(held) - held
    mark = np.zeros(len(frequency), bool)
    label = np.arange(n)
    out = []
    for i in np.unique(owner[(place < first[owner]) & (held[ids] > 0)]).tolist():
        own = ids[starts[i] : starts[i] + sizes[i]]
        some = own[: first[i]]
        met = np.unique(holders[stretches(begin[some], held[some])])
        met = met[(met < i) & (100 * sizes[met] >= percent * sizes[i])]
        if side[i]:
            met = met[side[met] != side[i]]
        mark[own] = True
        step = 32
        while len(met := met[label[met] != label[i]]):
            now, met = met[:step], met[step:]
            step = 4096
            common = np.add.reduceat(mark[ids[stretches(starts[now], sizes[now])]], np.cumsum(sizes[now]) - sizes[now], dtype=np.int64)
            for j in now[100 * common >= percent * (sizes[i] + sizes[now] - common)].tolist():
                if label[i] != label[j]:
                    out.append((int(max(by[i], by[j])), int(min(by[i], by[j]))))
                    label[label == label[j]] = label[i]
        mark[own] = False
    return out


def refined(docs: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """Clusters (id, cluster, n_shingles, n_bytes) cut into smaller ones, so that all that is linked stays together.

    A cluster's shingles stand by the number of its classes that hold them. Linked sets meet where ``prefixes`` says, so that
    of the classes that look in a shingle the smallest one is joined to all that look for it and aren't smaller. What no other class of the
    cluster holds stands first and joins nothing; a class with so many of these that nothing else is among its first ones goes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            sets = shingle_sets(*utf8(batch.column("text")), k)
            sizes = np.array([*map(len, sets)], np.int64)
            columns = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("cluster", "id", "row")]
            columns += [np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["cluster", "id", "row", "size", "shingle"])

    # Rows that share a doc_id may have several texts.
    texts = clusters.select("id", "cluster").distinct().join(docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("row")), "id")
    shingles = stored(texts.select("cluster", "id", "row", "text").mapInArrow(rows, "cluster long, id long, row long, size long, shingle long"))
    held = shingles.groupBy("cluster", "shingle").agg(F.count("*").alias("n")).filter("n > 1")
    shared = shingles.join(held, ["cluster", "shingle"]).groupBy("cluster", "id", "row", "size").agg(F.sort_array(F.collect_set(F.struct("n", "shingle"))).alias("shared"))
    # The first ones, less those that no other class holds.
    first, looked_in = (f"((100 - {percent}) * size DIV {n}) + 1 - (size - size(shared))" for n in (100, 100 + percent))
    some = shared.select("cluster", "id", "size", F.expr(looked_in).alias("looked_in"), F.posexplode(F.slice("shared", F.lit(1), F.expr(f"greatest(0, {first})").cast("int"))).alias("place", "held"))
    some = cut(some.select("cluster", "held.shingle", "id", "size", F.expr("place < looked_in").alias("kept")))
    smallest = some.filter("kept").groupBy("cluster", "shingle").agg(F.min(F.struct("size", "id")).alias("least"))
    edges = some.join(smallest, ["cluster", "shingle"]).filter("size >= least.size AND id != least.id").select(F.col("least.id").alias("a"), F.col("id").alias("b"))
    finer = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    out = cut(clusters.drop("cluster").join(finer, "id").select(clusters.columns))
    drop(shingles)
    return out


def _placed(clusters: DataFrame, by: list[str], block: int) -> DataFrame:
    placed = prefix_sums(clusters, by, ["n_shingles", "id"], "n_bytes", "__before")
    return placed.withColumn("block", F.floor(F.col("__before") / block)).drop("__before")


def _met(docs: DataFrame, placed: DataFrame, which: str, k: int, percent: int, block: int) -> DataFrame:
    """Links of the blocks (of classes id, cluster, block, n_shingles, n_bytes) that meet by the condition ``which``, unless their sizes rule links out."""
    blocks = cut(placed.groupBy("cluster", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.sum("n_bytes").alias("bytes")))
    other = blocks.select("cluster", *(F.col(c).alias(f"{c}2") for c in ("block", "least", "most", "bytes")))
    near = f"100 * most >= {percent} * least2 AND 100 * most2 >= {percent} * least"
    meet = cut(blocks.join(other, "cluster").filter(f"block <= block2 AND ({which}) AND {near}").select("cluster", "block", "block2", "bytes", "bytes2"))
    # Each block's texts are copied into each meeting, so that the meetings' bytes are what is dealt out.
    total = meet.agg(F.sum(F.expr("bytes + IF(block = block2, 0, bytes2)"))).first()[0] or 0
    groups = max(partitions(docs.sparkSession), int(total // block))
    each = meet.select("*", F.explode(F.array_distinct(F.array("block", "block2"))).alias("__block"))
    sides = each.select("cluster", F.col("__block").alias("block"), F.struct(F.col("block").alias("b1"), F.col("block2").alias("b2")).alias("pair"))
    rows = placed.join(sides, ["cluster", "block"]).select("id", "cluster", "block", "pair")
    rows = rows.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("cluster", "pair"), F.lit(groups)))

    def solve(table: pa.Table) -> pa.Table:
        a, b = [], []
        frame = {c: table.column(c).to_pylist() for c in ("id", "cluster", "block", "b1", "b2")}
        by: dict[tuple, list[int]] = {}
        for row, key in enumerate(zip(frame["cluster"], frame["b1"], frame["b2"], strict=True)):
            by.setdefault(key, []).append(row)
        for (_, b1, b2), members in by.items():
            if len(members) < 2:
                continue
            data, offsets = utf8(table.column("text").take(pa.array(members)).combine_chunks())
            side = np.array([0 if b1 == b2 else 1 + (frame["block"][m] == b2) for m in members])
            for i, j in forest_links(shingle_sets(data, offsets, k), side, percent):
                a.append(frame["id"][members[i]])
                b.append(frame["id"][members[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = rows.select("g", "id", "cluster", "block", "pair.b1", "pair.b2", "text")
    return rows.groupBy("g").applyInArrow(solve, "a long, b long")


def links(docs: DataFrame, clusters: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what is linked among classes (id, cluster, n_shingles, n_bytes), whose texts are in docs.

    A cluster's classes stand by set size, in blocks of about ``block`` bytes; two blocks meet unless their sizes rule links out.
    A cluster of more than ``HOT`` blocks is cut by ``refined`` first. In what is as large after that, each block meets itself and
    the next one, and what that joins to the cluster's largest group needs no more links within it: all others, in blocks of their own, meet
    each other and the blocks of that group.
    """

    def hot(table: DataFrame) -> DataFrame:
        return cut(table.groupBy("cluster").agg(F.sum("n_bytes").alias("n")).filter(F.col("n") > HOT * block).select("cluster"))

    clusters = clusters.withColumn("n_bytes", F.col("n_bytes") + ROW)
    large = hot(clusters)
    if large.isEmpty():
        return _met(docs, cut(_placed(clusters, ["cluster"], block)), "true", k, percent, block)
    clusters = cut(clusters.join(large, "cluster", "left_anti").unionByName(refined(docs, clusters.join(large, "cluster"), k, percent)))
    large = hot(clusters)
    out = _met(docs, cut(_placed(clusters.join(large, "cluster", "left_anti"), ["cluster"], block)), "true", k, percent, block)
    if large.isEmpty():
        return out
    crowded = cut(clusters.join(large, "cluster"))
    near = cut(_met(docs, cut(_placed(crowded, ["cluster"], block)), "block2 - block <= 1", k, percent, block))
    groups = cut(crowded.join(components(near).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    sizes = groups.groupBy("cluster", "component").agg(F.sum("n_bytes").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("__most")).select("cluster", "__most.component", F.lit(True).alias("within"))
    parts = groups.join(largest, ["cluster", "component"], "left").withColumn("within", F.coalesce("within", F.lit(False))).drop("component")
    # The largest group's blocks are counted below zero.
    placed = cut(_placed(parts, ["cluster", "within"], block).withColumn("block", F.when(F.col("within"), -1 - F.col("block")).otherwise(F.col("block"))))
    return out.union(near).union(_met(docs, placed, "block2 >= 0", k, percent, block))


def judged(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row, n_shingles, f1, f2, component_id, kept of each document; row is a hash of its text, f1 and f2 one of its set."""
    signed = cut(signatures(docs, k))
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "f1", "f2"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("id"), F.min("n_bytes").alias("n_bytes"), F.first("keys").alias("keys"))
    classes = cut(classes)
    edges = candidates(classes.select("id", "keys"))
    clusters = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    members = classes.drop("keys").join(clusters, "id")
    joined = components(links(docs, members, k, percent))
    roots = classes.drop("keys", "n_bytes").join(joined.withColumnRenamed("node", "id"), "id", "left")
    roots = roots.select(*same, F.coalesce("component", "id").alias("__root"))
    found = signed.drop("keys", "n_bytes").join(roots, same, "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("__root", "doc_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "row", *same, "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where their sets' similarity is ``percent`` of 100 or more."""
    return judged(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep(docs: DataFrame, **options) -> DataFrame:
    """One document for each group, with its own columns, and all without a doc_id. Of rows that share the kept doc_id, those with unlike sets of shingles all stay, and of those with one set the one whose text has the smallest hash."""
    found = judged(docs, **options).filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc"), "n_shingles", "f1", "f2").agg(F.min("row").alias("__row")).select("__doc", "__row")
    rows = docs.filter("doc_id IS NOT NULL").withColumn("__text", F.xxhash64("text")).join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("__text") == F.col("__row"))).dropDuplicates(["doc_id", "__text"])
    return rows.select(docs.columns).union(docs.filter("doc_id IS NULL"))

import random
import re
from itertools import combinations

import numpy as np
import pytest

from llm.cases import DOCUMENTS, documents, empty, texts
from weftmine.llm import neardup
from weftmine.llm.shingles import shingle_sets
from weftmine.operators.components import components


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(rows, k, percent):
    """Brute force: doc_id -> (set size, smallest linked id)."""
    sets = [plain_set(t, k) for t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def found(df):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    return out


def copies(n, seed, edits):
    """One text and n copies of it, each with up to ``edits`` words changed."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(n):
        words = base.copy()
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, k, percent):
    rows = texts()
    assert found(neardup.near_duplicates(documents(spark), k=k, percent=percent)) == groups(rows, k, percent)


def test_a_large_group_of_near_copies_in_many_blocks(spark, monkeypatch):
    rows = copies(150, 3, 9)
    want = groups(rows, 3, 85)
    assert len({root for _, root in want.values()}) > 5
    monkeypatch.setattr(neardup.links, "__defaults__", (3000,))
    monkeypatch.setattr(neardup, "ROW", 0)
    assert found(neardup.near_duplicates(documents(spark, rows), k=3, percent=85)) == want


def templates(n, seed):
    """n texts that share two thirds of their words, every tenth with a near copy; chained by bands, not linked."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(80)]
    out = []
    for i in range(n):
        words = base + [f"o{i}x{j}" for j in range(40)]
        out.append(" ".join(words))
        if i % 10 == 0:
            out.append(" ".join([*words[:-2], "other", "end"]))
    return out


@pytest.mark.parametrize("rows", [templates(140, 4), copies(150, 3, 3)], ids=["templates", "near copies"])
def test_tasks_of_a_hot_cluster_hold_bounded_texts(spark, monkeypatch, rows):
    from pyspark.sql import functions as F

    kind, dealt = type(spark.range(1).groupBy("id")), []
    real = kind.applyInArrow

    def seen(self, func, schema):
        dealt.extend(r[1] for r in self._df.groupBy("g").agg(F.sum(F.length("text"))).collect())
        return real(self, func, schema)

    monkeypatch.setattr(kind, "applyInArrow", seen)
    monkeypatch.setattr(neardup.links, "__defaults__", (3000,))
    monkeypatch.setattr(neardup, "ROW", 0)
    assert found(neardup.near_duplicates(documents(spark, rows), k=3, percent=80)) == groups(rows, 3, 80)
    size = sum(map(len, rows))
    assert size > 20 * 3000
    assert max(dealt) < size / 2 and sum(dealt) < 8 * size


def test_many_short_texts_with_one_key(spark):
    """Short texts that share most words: all in one cluster, many in one bucket, linked two by two."""
    rows = [f"all of these share the first few words {i // 2} {'x' * (i % 2)}" for i in range(20_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(8)
    # Nine or ten words; the seven shingles of the one are among the eight of the other.
    assert found(neardup.near_duplicates(docs, k=3, percent=85)) == {i: (7 + i % 2, i - i % 2) for i in range(20_000)}


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_linked_sets_meet_within_prefixes(percent):
    for n in range(1, 60):
        for m in range(1, n + 1):
            # The fewest shingles that linked sets of n and m have in common.
            common = -(-percent * (n + m) // (100 + percent))
            if common <= m:
                looked_for, looked_in = int(neardup.prefixes(np.array([n]), percent)[0][0]), int(neardup.prefixes(np.array([m]), percent)[1][0])
                assert looked_for >= n - common + 1 and looked_in >= m - common + 1


def test_cuts_of_a_cluster_keep_links_together(spark):
    """One cluster of texts around one text: linked ones stay together, those just below the threshold don't."""
    r = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = [" ".join(base + [f"o{i}x{j}" for j in range(12)]) for i in range(40)]
    rows += [" ".join(base[: r.randint(50, 60)] + [f"o{i}x{j}" for j in range(r.randint(0, 12))]) for i in range(40) for _ in range(2)]
    want = groups(rows, 3, 85)
    sets = [plain_set(t, 3) for t in rows]
    docs = documents(spark, rows, clash=False)
    clusters = spark.createDataFrame([(i, 7, len(s), len(t)) for i, (s, t) in enumerate(zip(sets, rows, strict=True))], "id long, cluster long, n_shingles long, n_bytes long")
    cut = {x.id: x.cluster for x in neardup.refined(docs, clusters, 3, 85).collect()}
    for i, (_, root) in want.items():
        assert i == root or cut[i] == cut[root]
    apart = spark.createDataFrame([(i, 7, len(sets[i]), len(rows[i])) for i in range(40)], "id long, cluster long, n_shingles long, n_bytes long")
    assert neardup.refined(docs, apart, 3, 85).collect() == []


def test_links_of_a_block_join_what_is_linked():
    r = np.random.default_rng(8)
    for percent in (50, 80, 85, 100):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(120)]
        sets += [np.unique(np.concatenate([s[: r.integers(1, len(s) + 1)], r.integers(0, 60, 2).astype(np.uint64)])) for s in sets[:60]]
        for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2 + 1):
            def joined(links):
                label = list(range(len(sets)))
                for i, j in links:
                    label = [label[i] if x == label[j] else x for x in label]
                return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

            linked = [(i, j) for i, j in combinations(range(len(sets)), 2) if (not side[i] or side[i] != side[j]) and 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - both)]
            got = neardup.forest_links(sets, side, percent)
            assert set(got) <= {(j, i) for i, j in linked} and joined(got) == joined(linked)


def test_words_with_one_polynomial_hash(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert found(neardup.near_duplicates(documents(spark, [a, b, f"{a} {b}"], clash=False), k=3, percent=85)) == {0: (1, 0), 1: (1, 1), 2: (1, 2)}


def test_sets_of_odd_texts():
    rows = ["", " \t", "a", "A", "a b", "a b c", "a\x0bb\x0cc", "a b c", "É é", "a b c a b c a b c", "x" * 5000]
    data = "".join(rows).encode()
    offsets = np.cumsum([0, *(len(r.encode()) for r in rows)])
    for k in (1, 3, 5):
        sets = shingle_sets(np.frombuffer(data, np.uint8), offsets, k)
        assert [len(s) for s in sets] == [len(plain_set(r, k)) for r in rows]
        for (i, a), (j, b) in combinations(enumerate(sets), 2):
            assert len(np.intersect1d(a, b)) == len(plain_set(rows[i], k) & plain_set(rows[j], k))


def test_minima_and_maxima_estimate_similarity():
    r = np.random.default_rng(5)
    shared, own = r.integers(0, 2**63, 800, np.uint64), r.integers(0, 2**63, 200, np.uint64)
    sets = [np.unique(np.concatenate([shared, own[:100]])), np.unique(np.concatenate([shared, own[100:]]))]
    keys = neardup.band_keys(sets, bands=2000, permutations=1)
    assert abs((keys[0] == keys[1]).mean() - 0.8**2) < 0.05


def test_one_document_of_each_group_stays(spark):
    rows = texts()
    docs = documents(spark)
    kept = neardup.keep(docs.union(docs), k=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, root) in groups(rows, 3, 85).items() if i == root)


def test_unlike_texts_with_one_id_all_stay(spark):
    prose, other = "one two three four five six seven eight", "quite another text with words of its own"
    docs = spark.createDataFrame([(1, prose, "a", None, 1), (5, prose, "b", None, 2), (5, other, "c", None, 3), (5, other.upper(), "d", None, 4), (5, "a third one, longer than the others are", "e", None, 5)], DOCUMENTS)
    for n in (1, 4):
        kept = sorted((r.doc_id, r.text.lower()) for r in neardup.keep(docs.repartition(n), k=3, percent=85).collect())
        assert kept == [(1, prose), (5, "a third one, longer than the others are"), (5, other)]
    assert len({neardup.keep(docs.repartition(n), k=3, percent=85).filter("lang IN ('c', 'd')").first().lang for n in (1, 3)}) == 1


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d", None, None, None), (3, "a b c d", None, None, None), (None, None, None, None, None)], DOCUMENTS)
    rows = neardup.near_duplicates(docs, k=3).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in rows) == [("3", 2), ("None", 0), ("None", 2)]
    assert neardup.keep(docs, k=3).count() == 3
    assert neardup.near_duplicates(empty(spark)).collect() == []


def test_components_of_long_paths(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100 != 99] + [(1000, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(order[i // 100 * 100 : i // 100 * 100 + 100]) for i, x in enumerate(order)}

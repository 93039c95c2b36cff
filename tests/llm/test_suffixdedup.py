import hashlib
import random
from collections import Counter

import pytest

from llm.cases import DOCUMENTS, documents, empty, texts
from weftmine.llm import suffixdedup


def plain(rows, length):
    """Brute force: of each text its length, bytes removed, runs, digest of the rest."""
    data = [(t or "").encode() for t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return [tuple(r[1:]) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("batches", [1, 2, 3, 5])
def test_removed_bytes_are_those_of_all_strings(spark, batches):
    assert found(suffixdedup.digests(documents(spark), batches=batches)) == plain(texts(), 200)


def odd_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (12, 20, 40, 90)]
    out = []
    for _ in range(40):
        parts = [prose(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            parts += [s[a : r.randint(a + 10, len(s))], prose(r.randint(0, 12))]
        out.append("".join(parts))
    return [*out, "a" * 700, "ab" * 400, out[3], out[4] + "x", "y" + out[5], None, ""]


@pytest.mark.parametrize(("seed", "crowd"), [(0, 1000), (1, 1000), (2, 3), (3, 1), (4, 0)])
def test_edges_of_matches(spark, seed, crowd):
    rows = odd_texts(seed)
    assert found(suffixdedup.digests(documents(spark, rows), length=40, gram=20, crowd=crowd)) == plain(rows, 40)


def test_strings_of_exactly_the_length(spark):
    r = random.Random(9)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = prose(200)
    rows = [prose(50) + passage + prose(50), passage, prose(10) + passage[:199] + "#", passage[1:] + "!"]
    assert found(suffixdedup.digests(documents(spark, rows))) == plain(rows, 200)


def test_a_repeat_near_the_end_of_a_very_long_text(spark):
    import numpy as np

    letters = lambda n, seed: np.random.default_rng(seed).integers(97, 123, n, np.uint8).tobytes().decode()
    passage = letters(250, 1)
    rows = [letters((16 << 20) + 5000, 2) + "-" + passage + "-" + letters(300, 3), letters(400, 4) + "+" + passage + "+"]
    got = found(suffixdedup.digests(documents(spark, rows, clash=False)))
    want = [r.replace(passage, "") for r in rows]
    assert got == [(len(r), 250, 1, hashlib.sha256(w.encode()).hexdigest()) for r, w in zip(rows, want, strict=True)]


@pytest.mark.parametrize("piece", [1, 37, 500])
def test_pieces_hold_all_strings(piece):
    import numpy as np

    texts = [t.encode() for t in odd_texts(5) if t]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    text, first, last, *_ = suffixdedup.blocks(data, offsets, 40, 20, piece)
    starts = [(t, i) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)]
    assert sorted(starts) == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 39)]


def split(spark, rows, n):
    docs = documents(spark, rows, clash=False)
    return [docs.filter(docs.doc_id % n == i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_batches_added_one_by_one(spark, n):
    """After each batch, the spans told so far are those of equal blocks, and all blocks that differ around a gram are told of."""
    rows = odd_texts(6)
    family, sizes, known, kinds = suffixdedup.Family(spark), [], set(), set()
    for part in split(spark, rows, n):
        found = family.add(suffixdedup.suffixes(part, 40, 20)).collect()
        known |= {(r.doc, r.span) for r in found if r.met & suffixdedup.KNOWN}
        kinds |= {(r.gram, r.block) for r in found if r.met & suffixdedup.KIND}
        sizes.append([k for k, _ in family.levels])
        family = suffixdedup.Family(spark, family.paths)  # as another session would
    assert sizes[-1] == {1: [1], 2: [2], 3: [2, 1], 5: [4, 1]}[n]
    every = suffixdedup.suffixes(documents(spark, rows, clash=False), 40, 20).collect()
    blocks, grams = Counter((r.gram, r.block) for r in every), Counter(g for g, _ in {(r.gram, r.block) for r in every})
    assert known == {(r.doc, r.span) for r in every if blocks[r.gram, r.block] > 1}
    assert kinds == {k for k in blocks if grams[k[0]] > 1}
    family.clear()


def test_levels_stand_in_the_order_of_letters(spark):
    rows = [t for t in odd_texts(7) if t]
    family = suffixdedup.Family(spark)
    family.add(suffixdedup.suffixes(documents(spark, rows, clash=False), 40, 20))
    runs = [r.letters for r in family.levels[0][1].collect()]
    assert sum(a > b for a, b in zip(runs[:-1], runs[1:], strict=True)) < 4  # ranges may be read in any order
    r = family.levels[0][1].first()
    text = rows[r.doc].encode()
    grams = [text[i : i + 8] for i in range(len(text) - 7)]
    assert (r.letters ^ -(1 << 63)) & ((1 << 64) - 1) in {int.from_bytes(g) for g in grams}
    family.clear()


def test_words_that_a_plain_polynomial_takes_for_equal(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [a, a.translate(str.maketrans("ab", "ba")), "x" + a + "y"]
    assert found(suffixdedup.digests(documents(spark, rows, clash=False), length=2048, gram=1948, batches=2)) == plain(rows, 2048)


def test_kept_texts(spark):
    docs = documents(spark)
    kept = suffixdedup.keep(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in kept.collect()}
    for i, (text, (_, removed, _, digest)) in enumerate(zip(texts(), plain(texts(), 200), strict=True)):
        if not removed:
            assert rows[i].text == text
        elif i not in rows:
            assert hashlib.sha256(b"").hexdigest() == digest
        else:
            assert rows[i].n_chars == len(rows[i].text) < len(text)


def test_rows_with_one_id_null_ids_and_empty_table(spark):
    rows = ["p" + "abcdefghij" * 3 + str(i) * 30 + "q" * i for i in range(3)]
    docs = spark.createDataFrame([(1, rows[0]), (1, rows[0]), (1, rows[1]), (None, rows[2]), (None, rows[2])], "doc_id long, text string")
    got = sorted(tuple(r[1:]) for r in suffixdedup.digests(docs, length=40, gram=20).collect())
    assert got == sorted(plain([rows[0], rows[0], rows[1], rows[2], rows[2]], 40))
    assert suffixdedup.digests(spark.createDataFrame([], DOCUMENTS)).collect() == [] == suffixdedup.keep(empty(spark)).collect()

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm.cases import DOCUMENTS, documents, empty, texts
from weftmine.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_by_word_ids_are_those_of_whole_texts(monkeypatch):
    odd = ["", " ", "a  b\n\nc", "Don't DO it's", "é ́a ΑΣ ΑΣ Σ", "tab\there\x1c\x85 z", "12 345,6 !!*** 日本語 한국", "가 ᅡ", "x…! y!… ..,. &&& It's, 'quoted' a.b. c-d- İstanbul, ß", "<|Startoftext|> <|endoftext"]
    special = ["x<|endoftext|>y <|startoftext|>", "Plain Text, too."]
    t = Tokenizer.from_file(PATH)
    ids = packing.WordIds(PATH)
    rows = odd + [x or "" for x in texts()]
    for limit in (10**6, 50):
        monkeypatch.setattr(packing, "KNOWN", limit)
        for batch in (rows, rows[::-1], odd[:3], odd[4:8], special, odd, [""]):
            data = "".join(batch).encode()
            got, at = ids.encode(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(x.encode()) for x in batch)]))
            for i, text in enumerate(batch):
                assert got[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_plan_uses_each_piece_once_and_fills_well():
    r = random.Random(1)
    for _ in range(30):
        n, length = r.randint(1, 300), r.choice([10, 50, 4096])
        counts = np.zeros(length + 1, np.int64)
        for _ in range(n):
            counts[r.randint(1, length) if r.random() < 0.5 else r.randint(1, max(1, length // 8))] += 1
        used, bins = np.zeros_like(counts), 0
        for times, filling in packing.plan(counts, length):
            assert times > 0 and sum(s * k for s, k in filling.items()) <= length
            bins += times
            for s, k in filling.items():
                used[s] += times * k
        assert (used == counts).all()
        total = int((counts * np.arange(length + 1)).sum())
        assert bins <= 11 / 9 * max(-(-total // length), (counts[length // 2 + 1 :]).sum()) + 1


def test_the_smallest_piece_gives_way_to_two_that_fit_better():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 25, 14]] = 1
    assert packing.plan(counts, 100)[0][1] == {60: 1, 25: 1, 14: 1}


def test_pieces_and_places(spark):
    t = Tokenizer.from_file(PATH)
    for length in (4096, 50):
        rows = packing.packed(documents(spark), PATH, length=length).collect()
        want = {}
        for i, text in enumerate(texts()):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            for p, at in enumerate(range(0, len(ids), length)):
                part = ids[at : at + length]
                want[i, p] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= length
        assert len(bins) <= sum(r.length for r in rows) / length * 1.05 + 1


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "one two", None, None, None), (None, None, None, None, None), (4, "", None, None, None)], DOCUMENTS)
    rows = packing.packed(docs, PATH).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "None", "None"] and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert {r.piece for r in rows} == {0} and min(r.length for r in rows) == 1


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["same text", "other"]).limit(1)
    rows = packing.packed(docs.union(docs).union(docs), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert packing.packed(empty(spark), PATH).collect() == []

"""The trie of turns against a plain one, whole and taken apart."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftmine.llm import turntrie

FORM = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, splice):
    """Nodes of all conversations, from sets of members."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        whole[c] = tuple((own.get(c - int(math.fmod(c, 100)), [])[:h] if splice else []) + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[:-1] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ended = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(path)))
        out[path] = (min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def rows_of(seed=3, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        prefix = [("system", "be brief"), ("user", "hello"), ("assistant", "hello, how are you?")][: r.choice([0, 1, 2, 3, 3, 3])]
        turns = prefix + [(r.choice(["user", "assistant", None]), r.choice(["a", "bb", "çé", "", None, "long " * 9])) for _ in range(r.randint(0, 4))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(100 + c, i, "user", "copy") for c in range(30) for i in range(12)]
    rows += [(200, i, "user", str(i)) for i in range(300)] + [(201, i, "user", str(i)) for i in range(150)] + [(202, i, "user", str(i)) for i in range(150)]
    rows += [(None, 0, "user", "nobody"), (7, None, "user", "first"), (300, 0, None, None), (-5, 1, "user", "below"), (-5, 1, "user", "below"), (-5, 0, "", "")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("floor", "splice"), [(10**9, True), (40, True), (1, False)])
def test_same_as_plain(spark, floor, splice):
    rows = rows_of()
    df = spark.createDataFrame(rows, FORM).withColumn("keys", F.lit(1)).withColumn("at", F.lit("x"))
    found = turntrie.sequences(df)
    got = turntrie.trie(turntrie.spliced(found) if splice else found, floor=floor, task=50 if floor < 100 else turntrie.TASK)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, splice)


def test_conversations_that_leave_a_chain_one_by_one(spark):
    rows = [(c, i, "user", f"t{i}" if i < c else f"own {c}") for c in range(1, 8) for i in range(c + 1)]
    got = turntrie.trie(turntrie.sequences(spark.createDataFrame(rows, FORM)), floor=1, task=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, False)


def test_ends_of_many_copies_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "PIECE", 50)
    ids = list(range(-40, 900, 3))
    rows = spark.createDataFrame([("p", c) for c in ids] + [("q", 5)], "path string, conv_id long")
    got = {r.path: r.ends for r in turntrie.ends(rows).collect()}
    assert got == {"p": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "q": hashlib.sha256(b"5").hexdigest()}


def test_empty_and_without_turns(spark):
    assert turntrie.trie(turntrie.sequences(spark.createDataFrame([], FORM))).count() == 0
    one = spark.createDataFrame([(5, [], []), (3, [], [])], "conv_id long, keys array<binary>, lens array<long>")
    assert [tuple(r) for r in turntrie.trie(one).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, None, None)]
    df = spark.createDataFrame(rows, FORM)
    got = turntrie.texts(turntrie.trie(turntrie.sequences(df)), df).select("conv_id", "depth", "role", "text").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, None, None), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 2, "", "")]

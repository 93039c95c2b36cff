"""A trie of conversations' turns: which conversations begin alike, how often, and what sharing their beginnings saves.

A turn is known by the SHA-256 of its role and text, so that texts never move. Equal conversations become one weighted row before anything is
grouped. The rows are dealt out by the digest of their first turn, and each task builds a dictionary trie with pointers to parents and sums it up from
the last node made to the first, so that every node comes after all below it. A first turn with more turns below it than a task's fair share
is taken apart first: its conversations' common beginning becomes a chain of nodes by itself, and what follows is dealt out by the next turn, again and
again until the parts are small. The parts' sums then go up, from the last taken apart to the root.

Defined results: null roles and texts are empty; turns stand by their number, null first, those of one number by their digests, and
repeated rows are turns of their own; rows with a null conv_id take no part; a conversation without turns ends at the root; an empty table has no root and gives no rows; other
columns are not read. A conversation's turns come together in a task as digests, 40 bytes each, and one conversation is never taken apart. What ends at a
node is hashed in one pass over its ids in order, since a SHA-256 can't be put together from parts; the ids come in packed pieces, of which a task holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmine.session import cut, drop, partitions, stored

#: Turns below one first turn that never count as too many, and turns that a task gets at most on average.
FLOOR, TASK = 1000, 1 << 17
#: Bytes of packed ids that travel as one row.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, keys, lens: each conversation's turns in order as digests and numbers of code points."""
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256))
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("key"), F.char_length(what).cast("long").alias("len"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "len")))
    return turns.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda t: t["key"]).alias("keys"), F.transform("t", lambda t: t["len"]).alias("lens"))


def spliced(found: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The same columns, where a conversation's first h turns are those of the conversation c - c % every (the remainder has the sign of c); h is the CRC-32 of its id in decimal, modulo ``most``."""
    base, h = F.col("conv_id") - F.col("conv_id") % every, (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = found.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("keys", "lens")))
    rows = found.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")

    def put(c: str) -> Column:
        head = F.coalesce(F.col(f"head_{c}"), F.slice(c, 1, 0))
        return F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return rows.select("conv_id", put("keys"), put("lens"))


def _path(keys: Column) -> Column:
    return F.sha2(F.array_join(F.transform(keys, lambda k: F.hex(k)), ""), 256)


def ends(rows: DataFrame) -> DataFrame:
    """path, ends: the SHA-256 of each path's ids in rows (path, conv_id) in rising order, comma-joined. Rows are dealt by ranges of both, packed there, and only the packed pieces of a path meet."""
    n = partitions(rows.sparkSession)
    packed_form = pa.schema([("path", pa.string()), ("first", pa.int64()), ("ids", pa.binary())])
    hashed_form = pa.schema([("path", pa.string()), ("ends", pa.string())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, ids, size, out = None, 0, [], 0, []
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (p != path or size > PIECE):
                    out.append((path, first, ",".join(ids).encode()))
                    ids, size = [], 0
                if not ids:
                    path, first = p, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(packed_form.names, x, strict=True)) for x in out], schema=packed_form)
            out = []
        if ids:
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "ids": ",".join(ids).encode()}], schema=packed_form)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state, out = None, None, []
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != path:
                    if path is not None:
                        out.append({"path": path, "ends": state.hexdigest()})
                    path, state = p, hashlib.sha256(x)
                else:
                    state.update(b",")
                    state.update(x)
            yield pa.RecordBatch.from_pylist(out, schema=hashed_form)
            out = []
        if path is not None:
            yield pa.RecordBatch.from_pylist([{"path": path, "ends": state.hexdigest()}], schema=hashed_form)

    dealt = rows.select("path", "conv_id").repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = dealt.mapInArrow(packed, "path string, first long, ids binary")
    return pieces.repartition(n, "path").sortWithinPartitions("path", "first").mapInArrow(hashed, "path string, ends string")


def built(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of some weighted sequences (keys, lens, n, conv, ends), from the turn after ``at`` on. ``top``: what stands above a node that has no parent here."""
    child: dict[tuple, int] = {}
    up, depth, size, n, conv, kids, leaves, saved, end, top, above = ([] for _ in range(11))
    for keys, lens, weight, smallest, ended, at, parent, parent_conv in zip(*(frame[c] for c in ("keys", "lens", "n", "conv", "ends", "at", "parent", "parent_conv")), strict=True):
        node: object = parent  # a name above the first turn here, then the place of a node
        for d in range(at, len(keys)):
            place = child.get((node, keys[d]))
            if place is None:
                place = child[node, keys[d]] = len(up)
                inner = d > at
                up.append(node if inner else -1)
                top.append(None if inner else parent)
                above.append(None if inner else parent_conv)
                depth.append(d + 1)
                size.append(int(lens[d]))
                n.append(0)
                conv.append(smallest)
                kids.append(0)
                leaves.append(0)
                saved.append(0)
                end.append(NOTHING)
                if inner:
                    kids[node] += 1
            node = place
            n[node] += weight
            conv[node] = min(conv[node], smallest)
        end[node] = ended
    for node in range(len(up) - 1, -1, -1):
        leaves[node] += not kids[node]
        saved[node] += (n[node] - 1) * size[node]
        if up[node] >= 0:
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    parent_conv = [conv[u] if u >= 0 else a for u, a in zip(up, above, strict=True)]
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parent_conv, "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": end, "top": top})


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share: all rows between them in order share as many."""
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(same > 0, same - 1).otherwise(F.size(a)).cast("int")


def trie(found: DataFrame, floor: int = FLOOR, task: int = TASK) -> DataFrame:
    """The nodes of a table of sequences (conv_id, keys, lens) with one row for each conv_id: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = found.sparkSession
    rows = stored(found.select("conv_id", "keys", "lens", _path(F.col("keys")).alias("path")))
    weighted = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.max(F.struct("keys", "lens")).alias("s"))
    weighted = stored(weighted.join(ends(rows), "path").select("n", "conv", "s.keys", "s.lens", "ends"))
    whole = weighted.agg(F.sum("n"), F.min("conv"), F.sum(F.size("keys")), F.max(F.when(F.size("keys") == 0, F.col("ends")))).first()
    drop(rows)
    if whole[0] is None:
        return spark.createDataFrame([], NODE)
    tasks = max(partitions(spark), -(-whole[2] // task))
    share = max(floor, whole[2] // tasks)

    # From the root down: what is below one first turn and more than a task's share is taken apart, at most ``tasks`` such parts at a time.
    left = weighted.filter(F.size("keys") > 0).select("keys", "lens", "n", "conv", "ends", F.lit(0).alias("at"), F.lit("").alias("parent"), F.lit(whole[1]).cast("long").alias("parent_conv"), F.element_at("keys", 1).alias("next"))
    parts, groups, waste = [], [], [weighted]
    while True:
        sizes = left.groupBy("parent", "next").agg(F.sum(F.size("keys") - F.col("at")).alias("turns"), F.count("*").alias("rows"))
        heavy = cut(sizes.filter((F.col("turns") > share) & (F.col("rows") > 1)).select("parent", "next"))
        if heavy.isEmpty():
            parts.append(left)
            break
        parts.append(left.join(F.broadcast(heavy), ["parent", "next"], "left_anti").select(left.columns))
        inside = left.join(F.broadcast(heavy), ["parent", "next"], "left_semi")
        span = inside.groupBy("parent", "next").agg(F.min("keys").alias("low"), F.max(F.struct("keys", "lens")).alias("high"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("at").alias("at"), F.max("parent_conv").alias("parent_conv"))
        span = span.withColumn("to", _common(F.col("low"), F.col("high.keys")))
        span = cut(span.select("parent", "next", "n", "conv", "at", "to", "parent_conv", _path(F.slice("high.keys", F.lit(1), F.col("to"))).alias("id"), F.slice("high.lens", F.col("at") + 1, F.col("to") - F.col("at")).alias("lens")))
        on = F.broadcast(span.select("parent", "next", "to", "id", F.col("conv").alias("__conv")))
        inside = inside.join(on, ["parent", "next"])
        groups.append((span, cut(inside.filter(F.size("keys") == F.col("to")).select("id", "ends"))))
        left = stored(inside.filter(F.size("keys") > F.col("to")).select("keys", "lens", "n", "conv", "ends", F.col("to").alias("at"), F.col("id").alias("parent"), F.col("__conv").alias("parent_conv"), F.element_at("keys", F.col("to") + 1).alias("next")))
        waste.append(left)
    small = parts[0]
    for part in parts[1:]:
        small = small.union(part)
    dealt = small.withColumn("bucket", F.pmod(F.xxhash64("parent", "next"), F.lit(tasks))).drop("next")
    nodes = stored(dealt.groupBy("bucket").applyInPandas(built, f"{NODE}, top string"))
    drop(*waste)

    # And up again: the sums of the parts are those of what stands above them.
    below = nodes.filter("top IS NOT NULL").groupBy("top").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    below = cut(below)
    out = nodes.select(*(x.split()[0] for x in NODE.split(", ")))
    total = lambda df: df.groupBy("top").agg(F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    for span, ended in reversed(groups):
        each = span.join(below, span["id"] == below["top"]).join(ended, "id", "left").select(span["*"], "kids", "leaves", "saved", F.coalesce("ends", F.lit(NOTHING)).alias("ends"))
        each = each.select("*", F.posexplode("lens").alias("i", "len")).withColumn("depth", F.col("at") + F.col("i") + 1)
        after = Window.partitionBy("id").orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
        last, first = F.col("depth") == F.col("to"), F.col("i") == 0
        each = each.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.sum("len").over(after))
        each = cut(each.select("conv", F.col("depth").cast("long").alias("depth"), F.when(first, F.col("parent_conv")).otherwise(F.col("conv")).alias("above"), "n", F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("kids"), "leaves", "saved", F.when(last, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends"), F.when(first, F.col("parent")).alias("parent")))
        out = out.union(each.drop("parent"))
        up = each.filter("parent IS NOT NULL").select(F.col("parent").alias("top"), F.lit(1).cast("long").alias("kids"), "leaves", "saved")
        below = cut(total(below.union(up)))
    sums = below.filter("top = ''").first()
    root = (whole[1], 0, None, whole[0], sums.kids if sums else 0, sums.leaves if sums else 1, sums.saved if sums else 0, whole[3] or NOTHING)
    return out.union(spark.createDataFrame([root], NODE))


def texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes of trie(sequences(conversations)) with the role and text of their last turn, null at the root."""
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), digest)
    return nodes.join(rows.withColumn("depth", F.row_number().over(order).cast("long")).drop("turn"), ["conv_id", "depth"], "left")

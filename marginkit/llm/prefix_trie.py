r"""The trie of conversation prefixes: what conversations share, and what sharing saves.

A turn is a role and a text (null: empty). A conversation is its turns in the order of the
turn number, null first (ties: by role, the first ``TIE`` characters of the text, then a
digest of both). A node of depth d is a distinct sequence of d first turns; its members are
the conversations that begin so.

1. A turn becomes 16 bytes of its SHA-256, so a conversation is one binary key and
   conversations that share a prefix are neighbours in the order of the keys. Texts are not
   shuffled beyond the characters that order ties.
2. Equal conversations become one row with their number, smallest id and the hash of their
   ids. Ids meet in pieces of ``PIECE`` ids; the pieces of one node are hashed as a stream.
3. The distinct keys are range-partitioned, sorted and cut into shards of about
   ``SHARD_TURNS`` turns: a shard holds all conversations between two keys, so a shared prefix of any
   size is split. Each shard numbers its turns, packs a double-array trie and walks it.
4. A node that a shard shares with another lies on the path of the shard's first or last
   conversation. Only the nodes of these two paths are merged over all shards; the others
   are whole. Subtree sums of merged nodes run up their tree by pointer doubling, in as many rounds as the
   logarithm of the depth.

A conversation is one row of 20 bytes a turn; its texts are never together.

Edge cases: rows with a null id belong to no conversation; null and empty texts are equal;
repeated rows are turns of their own; texts of any length take 16 bytes; an empty table has no nodes, not even
the root, as it would have no member; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .double_array import build, by_first_use

TIE = 64
PIECE = 1 << 10
SHARD_TURNS = 1 << 19
SALTS = 16
WIDTH = 16
SHARD_ROWS = ("node binary, parent binary, turn binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
              "n_children long, n_leaves long, saved long, size long, ends binary")


def turn_rows(talk: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, head, digest, size): one row per turn, without its whole text."""
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    whole = F.concat(F.length(of(role)).cast("string"), F.lit(":"), of(role), of(text))
    return talk.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), of(role).alias("role"),
        F.substring(of(text), 1, TIE).alias("head"), F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 2 * WIDTH).alias("digest"),
        F.length(of(text)).cast("int").alias("size"))


def conversations(talk: DataFrame, **columns) -> DataFrame:
    """(conv_id, key, sizes): the turns' digests as one binary, and the texts' lengths in code points."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("_known"), "turn", "role", "head", "digest", "size"))),
                           lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size")))
    grouped = turn_rows(talk, **columns).groupBy("conv_id").agg(in_order.alias("_t"))
    return grouped.select("conv_id", F.unhex(F.array_join("_t.digest", "")).alias("key"), F.col("_t.size").alias("sizes"))


def with_common_head(talk: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations as if branched off: each takes the first h turns of the conversation
    whose id is its own rounded towards zero to a multiple of ``every``, and its own turns after its first
    h; h is the crc32 of the id as text, modulo ``most``."""
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    first = talk.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_from"), F.expr(f"substring(key, 1, {WIDTH * most})").alias("_key"), F.slice("sizes", 1, most).alias("_sizes"))
    both = talk.withColumn("_h", h).withColumn("_from", F.col("conv_id") - F.col("conv_id") % every).join(first, "_from", "left")
    own = F.expr(f"substring(key, {WIDTH} * _h + 1)")
    head = F.expr(f"substring(_key, 1, {WIDTH} * _h)")
    return both.select("conv_id", F.concat(F.coalesce(head, F.unhex(F.lit(""))), own).alias("key"),
                       F.concat(F.coalesce(F.expr("slice(_sizes, 1, _h)"), F.expr("array()").cast("array<int>")),
                                F.expr("slice(sizes, _h + 1, greatest(size(sizes), 1))")).alias("sizes"))


def _streamed_hashes(batches):
    """(key, ends) from the pieces (key, ids as text), which come sorted by key and piece."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if state is not None:
                    done.append((key, state.digest()))
                key, state = k, hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], type=pa.binary()) for i in (0, 1)], names=["key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], type=pa.binary()), pa.array([state.digest()], type=pa.binary())], names=["key", "ends"])


def distinct_conversations(talk: DataFrame) -> DataFrame:
    """(key, sizes, n, first, ends): each distinct conversation once, with how many there
    are, their smallest id, and the SHA-256 of their sorted ids, comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = materialise(talk.groupBy("key", F.shiftright("conv_id", PIECE.bit_length() - 1).alias("piece")).agg(
        ids.alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")), "pieces")
    found = pieces.groupBy("key").agg(F.first("sizes").alias("sizes"), F.sum("n").alias("n"), F.min("first").alias("first"),
                                      F.min("ids").alias("ids"), F.count(F.lit(1)).alias("_pieces"))
    found = materialise(found.withColumn("ids", F.when(F.col("_pieces") == 1, F.col("ids"))), "distinct")
    one = found.where("_pieces = 1").select("key", "sizes", "n", "first", F.unhex(F.sha2(F.encode("ids", "UTF-8"), 256)).alias("ends"))
    several = found.where("_pieces > 1")
    if several.isEmpty():
        return one
    long = pieces.join(several.select("key"), "key").select("key", "piece", "ids").repartition("key").sortWithinPartitions("key", "piece")
    hashed = long.select("key", "ids").mapInArrow(_streamed_hashes, "key binary, ends binary")
    return one.unionByName(several.drop("ids", "_pieces").join(hashed, "key"))


def _shards(batches):
    """Node rows of every shard of a partition of (key, sizes, n, first, ends), sorted by key."""
    held, turns = [], 0
    for batch in batches:
        lengths = np.diff(batch.column("sizes").offsets.to_numpy())
        begin = 0
        for i, n in enumerate(lengths):
            turns += int(n)
            if turns >= SHARD_TURNS:
                held.append(batch.slice(begin, i + 1 - begin))
                yield _shard(pa.Table.from_batches(held).combine_chunks())
                held, turns, begin = [], 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield _shard(pa.Table.from_batches(held).combine_chunks())


def _flat(table, name):
    """The only chunk of a column."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], type=column.type)


def _shard(table) -> "pa.RecordBatch":
    """The nodes of one shard. A node on the path of the shard's first or last conversation
    has its digest in ``node`` and only what whole nodes below it add up to; of any other node all
    is known but for the id of a parent on these paths, given by its digest in ``parent``."""
    sizes, keys = _flat(table, "sizes"), _flat(table, "key").to_pylist()
    length = np.diff(sizes.offsets.to_numpy()).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(length)])
    size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weight, smallest = _flat(table, "n").to_numpy(), _flat(table, "first").to_numpy()
    raw = b"".join(keys)
    halves = np.frombuffer(raw, dtype=">u8").reshape(-1, 2)
    level = np.arange(len(size)) - np.repeat(offset[:-1], length)
    label = by_first_use(_numbers(halves), level)
    trie = build(label, offset)

    paths = {}                                                # slot -> digest of the path, for the two outer paths
    for i in {0, len(keys) - 1}:
        state, slot = hashlib.sha256(), 0
        paths[0] = state.digest()
        for d in range(length[i]):
            state.update(keys[i][d * WIDTH:(d + 1) * WIDTH])
            slot = int(trie.step(np.array([slot]), label[offset[i] + d:offset[i] + d + 1])[0])
            paths[slot] = state.digest()

    # walk down: a level's nodes are runs of the live sequences
    levels = [dict(slot=np.zeros(1, dtype=np.int64), parent=np.full(1, -1), n=np.array([weight.sum()]), low=np.array([smallest.min()]),
                   size=np.zeros(1, dtype=np.int64), end=np.where(length[:1] == 0, 0, -1), at=np.full(1, -1))]
    at_slot = np.zeros(len(length), dtype=np.int64)
    above = np.zeros(len(length), dtype=np.int64)              # the number, in its level, of the node a sequence is at
    live, depth = np.flatnonzero(length > 0), 0
    while len(live):
        place = offset[live] + depth
        slot = trie.step(at_slot[live], label[place])
        assert (slot >= 0).all()
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        depth += 1
        levels.append(dict(slot=slot[first], parent=above[live[first]], n=np.add.reduceat(weight[live], first),
                           low=np.minimum.reduceat(smallest[live], first), size=size[place[first]],
                           end=np.where(length[live[first]] == depth, live[first], -1), at=place[first]))
        above[live] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slot))))
        at_slot[live] = slot
        live = live[length[live] > depth]

    # and up again: what whole nodes add to their parents
    outer = np.array(sorted(paths))
    for x in levels:
        x["outer"] = np.isin(x["slot"], outer)
        x["children"], x["leaves"], x["saved"] = (np.zeros(len(x["slot"]), dtype=np.int64) for _ in range(3))
    for x, up in zip(levels[:0:-1], levels[-2::-1]):
        whole = ~x["outer"]
        x["leaves"] += whole & (x["children"] == 0)
        x["saved"] += np.where(whole, (x["n"] - 1) * x["size"], 0)
        parent = x["parent"][whole]
        for name, value in (("children", np.ones(len(parent), dtype=np.int64)), ("leaves", x["leaves"][whole]), ("saved", x["saved"][whole])):
            np.add.at(up[name], parent, value)

    ends = _flat(table, "ends")
    columns = {name: [] for name in ("node", "parent", "turn", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "size", "ends")}
    for depth, x in enumerate(levels):
        up = levels[depth - 1] if depth else None
        m = len(x["slot"])
        columns["node"] += [paths.get(s) for s in x["slot"].tolist()]
        columns["parent"] += [paths.get(s) for s in up["slot"][x["parent"]].tolist()] if depth else [None]
        columns["turn"] += [raw[WIDTH * p:WIDTH * (p + 1)] for p in x["at"].tolist()] if depth else [None]
        columns["parent_conv_id"].append(up["low"][x["parent"]] if depth else np.zeros(1, dtype=np.int64))
        columns["depth"].append(np.full(m, depth))
        columns["ends"].append(x["end"])
        for name, of in (("conv_id", "low"), ("n_convs", "n"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved", "saved"), ("size", "size")):
            columns[name].append(x[of])
    for name in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "size", "ends"):
        columns[name] = np.concatenate(columns[name]).astype(np.int64)
    binary = {name: pa.array(columns[name], type=pa.binary()) for name in ("node", "parent", "turn")}
    known = pa.array(columns["parent_conv_id"], mask=binary["parent"].is_valid().to_numpy(zero_copy_only=False) | (columns["depth"] == 0))
    picked = ends.take(pa.array(columns["ends"], mask=columns["ends"] < 0))
    return pa.RecordBatch.from_arrays(
        [binary["node"], binary["parent"], binary["turn"], pa.array(columns["conv_id"]), pa.array(columns["depth"]), known,
         *(pa.array(columns[name]) for name in ("n_convs", "n_children", "n_leaves", "saved", "size")), picked.cast(pa.binary())],
        names=[c.split()[0] for c in SHARD_ROWS.split(", ")])


def _numbers(halves: np.ndarray) -> np.ndarray:
    """Equal rows of two unsigned words get equal numbers."""
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    rows = halves[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[:len(rows)]
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _merged_paths(rows: DataFrame) -> DataFrame:
    """The nodes that shards may share, each once, with the sums over its whole subtree."""
    met = rows.where("node is not null").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("turn").alias("turn"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("size").alias("size"), F.max("ends").alias("ends"))
    met = materialise(met, "paths")
    more = met.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_more"))
    n_children = F.col("n_children") + F.coalesce("_more", F.lit(0))
    met = materialise(met.join(more, "node", "left").withColumn("n_children", n_children).drop("_more")
                      .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
                      .withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
                      .withColumn("_up", F.col("parent")), "paths")
    deepest = met.agg(F.max("depth")).first()[0] or 0
    reach = 1                                 # sums hold what lies less than ``reach`` below; _up is the node ``reach`` above
    while reach <= deepest:
        add = met.where("_up is not null").groupBy(F.col("_up").alias("node")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s"))
        up = met.select(F.col("node").alias("_up"), F.col("_up").alias("_next"))
        far = F.when(F.col("depth") >= 2 * reach, F.col("_up"))
        summed = (met.withColumn("_up", far).join(add, "node", "left").join(up, "_up", "left")
                  .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("_l", F.lit(0)))
                  .withColumn("saved", F.col("saved") + F.coalesce("_s", F.lit(0))))
        met = materialise(summed.drop("_up", "_l", "_s").withColumnRenamed("_next", "_up"), "paths")
        reach *= 2
    return met.drop("_up")


def prefix_nodes(talk: DataFrame) -> DataFrame:
    """All nodes of the trie of (conv_id, key, sizes): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (SHA-256 of the ids of the members that
    end there) and turn (the digest of its last turn, see ``turn_rows``)."""
    known = materialise(distinct_conversations(talk), "known")
    rows = known.repartitionByRange("key").sortWithinPartitions("key").select("key", "sizes", "n", "first", "ends")
    rows = materialise(rows.mapInArrow(_shards, SHARD_ROWS), "shards")
    met = materialise(_merged_paths(rows), "paths")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "turn"]
    whole = rows.where("node is null")
    open_ = whole.where("parent is not null").unionByName(met.withColumn("parent_conv_id", F.lit(None).cast("long")))
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS))
    ids = met.select(F.col("node").alias("parent"), F.col("conv_id").alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_salt"))
    closed = open_.withColumn("_salt", salt).join(ids, ["parent", "_salt"], "left").withColumn("parent_conv_id", F.col("_id"))
    out = whole.where("parent is null").select(*names).unionByName(closed.select(*names))
    none = hashlib.sha256(b"").hexdigest()
    return out.withColumn("ends", F.coalesce(F.lower(F.hex("ends")), F.lit(none))).withColumnRenamed("saved", "saved_tokens")


def with_turns(nodes: DataFrame, talk: DataFrame, **columns) -> DataFrame:
    """Nodes with the ``role`` and the whole ``text`` of their last turn (root: null)."""
    role, text = (columns.get(c, c) for c in ("role", "text"))
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    whole = F.concat(F.length(of(role)).cast("string"), F.lit(":"), of(role), of(text))
    digest = F.unhex(F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 2 * WIDTH))
    conv = columns.get("conv", "conv_id")
    texts = (talk.where(F.col(f"`{conv}`").isNotNull()).select(digest.alias("turn"), of(role).alias("role"), of(text).alias("text"))
             .groupBy("turn").agg(F.min("role").alias("role"), F.min("text").alias("text")))
    return nodes.join(texts, "turn", "left")

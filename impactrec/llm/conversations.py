"""Prefix trie of conversations: which beginnings they share, and what sharing them would save.

Turns become digests and word counts, and a conversation the array of its turns. The conversations
are range-sorted by that array, so that a shard holds a contiguous part of the trie in preorder. A
shard's trie is written as balanced parentheses: findclose delimits the subtree of a node, the rank
of leaf pairs counts its leaves, and cumulative arrays give sums over it. Only the nodes on the
paths of a shard's first and last conversation, its spines, can go on in other shards; equal spine
nodes are merged, and the tree of the spines is summed in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from impactrec.llm.parentheses import Parentheses, subtree_sums
from impactrec.llm.tables import small
from impactrec.staging import stage, staged

WORDS = r"[^\x20\x09-\x0D]+"
#: Fixed values of the contract: conversations in a family, and the modulus of the shared turns.
FAMILY, HEADS = 20, 4

_NODE, _SPINE, _END = 0, 1, 2
_SHARD = (
    "kind int, key binary, parent_key binary, shard int, pos long, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, words long, sha string"
)
_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: the turns of each conversation in order as ``d1, d2, n``, two digests and the words.

    Turns go by ``turn``, null first, those of equal ``turn`` by digest. A null role or text counts as
    empty. Rows without ``conv_id`` belong to no conversation and are left out. Texts are not shuffled;
    a conversation's digests, 24 bytes a turn, meet in one task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    digests = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"),
            F.xxhash64(F.lit(1), role, text).alias("d1"), F.xxhash64(text, F.lit(2), role).alias("d2"),
            F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n"),
        ).alias("t"),
    )
    ordered = digests.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["d1"], t["d2"], t["n"])).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation after the first ``h`` turns of the first of its family: ``h`` is the checksum of its
    number modulo 4, and as many of its own first turns are left out."""
    own = stage(own)
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(first == F.col("conv_id")).select(
        F.col("conv_id").alias("_first"), F.slice("path", 1, HEADS - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.join(heads, first == F.col("_first"), "left")
    return joined.select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("_head", F.slice("path", 1, 0)), F.lit(1), h),
            F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0))),
        ).alias("path"),
    )


def _shared_with_last(lengths: np.ndarray, offsets: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """How many turns each conversation shares with the one before it; 0 for the first."""
    out = np.zeros(len(lengths), np.int64)
    both = np.minimum(lengths[1:], lengths[:-1])
    rows = np.flatnonzero(both) + 1
    size = both[rows - 1]
    if not len(rows):
        return out
    begin = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(begin, size)
    one, two = np.repeat(offsets[rows], size) + step, np.repeat(offsets[rows - 1], size) + step
    differ = np.where((d1[one] != d1[two]) | (d2[one] != d2[two]), step, np.repeat(size, size))
    out[rows] = np.minimum.reduceat(differ, begin)
    return out


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


class _Shard:
    """The trie of sorted conversations, as arrays over its nodes in preorder."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, d1: np.ndarray, d2: np.ndarray, n: np.ndarray):
        lengths = np.diff(offsets)
        shared = _shared_with_last(lengths, offsets, d1, d2)
        new = lengths - shared
        # The root comes first and belongs to the first conversation.
        total = int(new.sum()) + 1
        self.depth, self.start = np.zeros(total, np.int64), np.zeros(total, np.int64)
        begin = np.cumsum(new) - new
        step = np.arange(total - 1) - np.repeat(begin, new)
        self.start[1:] = np.repeat(np.arange(len(ids)), new)
        self.depth[1:] = np.repeat(shared, new) + step + 1
        #: Where the last turn of a node is, -1 for the root.
        self.turn = np.concatenate([[-1], np.repeat(offsets[:-1] + shared, new) + step])
        self.words = np.concatenate([[0], n[self.turn[1:]]])
        self.parent, self.end_node = np.arange(total) - 1, np.zeros(len(ids), np.int64)
        path = [0]
        for i, (at, common, more) in enumerate(zip((begin + 1).tolist(), shared.tolist(), new.tolist())):
            del path[common + 1 :]
            if more:
                self.parent[at] = path[-1]
                path.extend(range(at, at + more))
            self.end_node[i] = path[-1]
        self.ends, self.leaves = Parentheses(self.depth).subtrees()
        past = np.append(self.start, len(ids))[self.ends]
        self.n_convs = past - self.start
        self.children = np.bincount(self.parent[1:], minlength=total)
        pairs = np.stack([self.start, past], 1).ravel()
        self.least = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), pairs)[::2]
        self.spine = np.zeros(total, bool)
        self.spine[: lengths[0] + 1] = True
        self.spine[path] = True


def _keys(shard: _Shard, nodes: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> dict[int, bytes]:
    """A key of each spine node that depends on its path alone."""
    keys = {0: b""}
    for j in nodes[1:].tolist():
        turn = shard.turn[j]
        keys[j] = hashlib.blake2b(keys[int(shard.parent[j])] + d1[turn].tobytes() + d2[turn].tobytes(), digest_size=16).digest()
    return keys


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard that end in it, its spine nodes, and which conversations end at these."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    ids = table.column("conv_id").to_numpy()
    column = table.column("path").combine_chunks()
    turns = column.flatten()
    d1, d2, n = (turns.field(k).to_numpy(zero_copy_only=False) for k in ("d1", "d2", "n"))
    offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    t = _Shard(ids, offsets, d1, d2, n)
    number = TaskContext.get().partitionId()
    saved = (t.n_convs - 1) * t.words
    nodes, spines = np.flatnonzero(~t.spine), np.flatnonzero(t.spine)
    keys = _keys(t, spines, d1, d2)

    by_end = np.argsort(t.end_node, kind="stable")
    first = np.searchsorted(t.end_node[by_end], np.arange(t.spine.size + 1))
    sha = [_sha(ids[by_end[first[j] : first[j + 1]]]) for j in nodes.tolist()]
    parent = t.parent[nodes]
    inner = ~t.spine[parent]
    yield _shard_rows(
        _NODE, number, len(nodes), conv_id=t.least[nodes], depth=t.depth[nodes], n_convs=t.n_convs[nodes],
        n_children=t.children[nodes], n_leaves=t.leaves[nodes], saved=subtree_sums(saved, t.ends)[nodes], sha=pa.array(sha, pa.string()),
        parent_key=pa.array([None if own else keys[p] for p, own in zip(parent.tolist(), inner.tolist())], pa.binary()),
        parent_conv_id=pa.array(t.least[parent], mask=~inner),
    )

    # Of spine nodes what lies in the shard: the sums over their subtrees leave spine nodes out.
    own = ~t.spine
    up = t.parent[spines]
    yield _shard_rows(
        _SPINE, number, len(spines), key=pa.array([keys[j] for j in spines.tolist()], pa.binary()),
        parent_key=pa.array([None if p < 0 else keys[p] for p in up.tolist()], pa.binary()), pos=spines,
        conv_id=t.least[spines], depth=t.depth[spines], words=t.words[spines], n_convs=t.n_convs[spines],
        n_children=np.bincount(t.parent[nodes], minlength=t.spine.size)[spines],
        n_leaves=subtree_sums((t.children == 0) & own, t.ends)[spines], saved=subtree_sums(saved * own, t.ends)[spines],
    )
    ending = np.flatnonzero(t.spine[t.end_node])
    yield _shard_rows(
        _END, number, len(ending), key=pa.array([keys[j] for j in t.end_node[ending].tolist()], pa.binary()), conv_id=ids[ending]
    )


_TYPES = {"key": pa.binary(), "parent_key": pa.binary(), "sha": pa.string()}
_COLUMNS = [c.split()[0] for c in _SHARD.split(", ")]


def _shard_rows(kind: int, shard: int, rows: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": np.full(rows, kind, np.int32), "shard": np.full(rows, shard, np.int32)}
    arrays = []
    for name in _COLUMNS:
        value = columns.get(name)
        if value is None:
            value = pa.nulls(rows, _TYPES.get(name, pa.int64()))
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value))
    return pa.RecordBatch.from_arrays(arrays, names=_COLUMNS)


def _spine_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to each spine node what the spine nodes below it have; the rows are in preorder."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    c = {name: table.column(name).to_numpy() for name in ("depth", "n_convs", "words", "n_children", "n_leaves", "saved")}
    ends, _ = Parentheses(c["depth"]).subtrees()
    leaves = c["n_leaves"] + subtree_sums(c["n_children"] == 0, ends)
    saved = c["saved"] + subtree_sums((c["n_convs"] - 1) * c["words"], ends)
    table = table.set_column(table.schema.get_field_index("n_leaves"), "n_leaves", pa.array(leaves.astype(np.int64)))
    table = table.set_column(table.schema.get_field_index("saved"), "saved", pa.array(saved.astype(np.int64)))
    yield from table.combine_chunks().to_batches()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each run of rows with one key: a running digest, whatever the number of rows."""
    key, running = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_numpy()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        done = []
        for a, b in zip(cuts, cuts[1:]):
            text = ",".join(map(str, ids[a:b].tolist())).encode()
            if running is not None and keys[a] == key:
                running.update(b"," + text)
            else:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = keys[a], hashlib.sha256(text)
        yield _hashed(done)
    if running is not None:
        yield _hashed([(key, running.hexdigest())])


def _hashed(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.string())], names=["key", "sha"]
    )


def _merged_spines(parts: DataFrame) -> DataFrame:
    """One row per spine node: its shards' counts added up, and how many children it has in all."""
    spines = parts.where(F.col("kind") == _SPINE)
    sums = ("n_convs", "n_children", "n_leaves", "saved")
    merged = stage(
        spines.groupBy("key").agg(
            F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("words").alias("words"),
            F.min("conv_id").alias("conv_id"), F.min(F.struct("shard", "pos")).alias("place"),
            *[F.sum(c).alias(c) for c in sums],
        )
    )
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key"))
    counted = merged.join(below.agg(F.count(F.lit(1)).alias("_below")), "key", "left")
    counted = counted.withColumn("n_children", F.col("n_children") + F.coalesce("_below", F.lit(0))).drop("_below")
    # Two paths per shard: a table of paths, not of conversations.
    return counted.repartition(1).sortWithinPartitions("place").mapInArrow(_spine_sums, counted.schema)


def _trie(paths: DataFrame) -> DataFrame:
    sorted_ = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = stage(sorted_.mapInArrow(_shard_nodes, _SHARD))
    spines = stage(_merged_spines(parts))
    ends = parts.where(F.col("kind") == _END).select("key", "conv_id")
    hashed = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hash_ends, "key binary, sha string")
    known = small(spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above")), spines.count())
    shown = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    of_spine = spines.join(hashed, "key", "left").withColumn("parent_conv_id", F.lit(None).cast("long"))
    of_spine = of_spine.withColumn("sha", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    nodes = parts.where(F.col("kind") == _NODE).select(*shown).unionByName(of_spine.select(*shown))
    parent: Column = F.coalesce("parent_conv_id", "_above").alias("parent_conv_id")
    result = nodes.join(known, "parent_key", "left").select(
        "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.col("sha").alias("ends_sha256"),
    )
    return result.select(*_RESULT)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``conv_id, path`` rows, one for each distinct beginning.

    ``conv_id`` is the smallest member and ``parent_conv_id`` that of the parent (null at the root),
    ``n_convs`` counts the members, and ``n_leaves`` and ``saved_tokens`` cover the subtree: of every
    node, its members but one, times the words of its last turn. ``ends_sha256`` is the hash of the ids of
    the members that end there. Without conversations there are no rows.

    Conversations of one path are dealt to several shards if they are many, and their ids are hashed as a
    stream, so that a path of a third of all conversations is never held by one task.
    """
    with staged(paths.sparkSession):
        return stage(_trie(paths), result=True)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text`` rows; see ``trie`` and ``rebuilt``."""
    with staged(turns.sparkSession):
        return stage(_trie(stage(rebuilt(paths(turns)))), result=True)

"""Near duplicates by an exact Jaccard join of n-gram sets with a prefix tree.

1. Every text becomes the set of its word n-grams, as 64-bit hashes; equal sets are one class.
2. Grams are put in one global order, rare ones first. Two sets that reach the threshold share one of
   the first grams of each (prefix filter). Sets that share such a gram and have similar lengths are
   strung together, by links linear in number, and the components of these links are blocks: every
   pair that can reach the threshold is in one block. A block is divided by length: a set goes with
   the sets of its own length band and of the next.
   The order has three parts, so that not all grams need to be shuffled to be counted: a quarter of
   all grams, chosen by hash and ordered by their exact counts; the other grams, by hash; and the
   grams that are most frequent within tasks, a table of bounded size. Nearly all prefixes lie in the
   first part, and a gram that only one set has is dropped there.
3. The sets of a part go to one task and into a prefix tree in which sets with the same beginning
   share nodes. The sets walk down the tree, until all are connected: overlaps are counted once per shared node, and a
   subtree is left as soon as its lengths, or the grams left in both sets, can't reach the
   threshold. A part too large for a task is cut into chunks, and every two chunks meet in a task.
4. The links found, no more than one per set and task, give the components.

No pair is emitted that is not a link, and no step has a limit beyond which pairs are lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from impactrec.llm.components import components
from impactrec.llm.tables import small
from impactrec.llm.words import Texts, Words, as_long, gram_hashes, mix, slices
from impactrec.staging import stage

#: Grams of a task that are counted at a time.
COUNTED_GRAMS = 2_000_000
#: Grams that come last in the order: the most frequent ones, as far as tasks can tell by themselves.
FREQUENT = 1_000_000
#: Grams of the sets that a task holds at once; of more, two chunks of half as many.
BLOCK_GRAMS = 4_000_000
#: And how many sets, whatever their size.
BLOCK_SETS = 20_000
#: Sets that may share a first gram in one task; more are salted.
SHARERS = 100_000

#: Grams with a hash below are counted exactly: a quarter of all.
COUNTED = np.uint64(1 << 62)
#: Cells of the table by which a task looks up the grams of the probes that go down a tree together.
_HELD = 1 << 25
_SALT = np.uint64(0xA24BAED4963EE407)


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gram hashes of some texts, ordered by text and hash: text, hash, and each text's number.

    A text with fewer than ``n`` words has its whole sequence as the only gram, one without words none.
    """
    texts = Texts(column).lowered()
    words = Words(texts)
    hashes, at = words.grams(n)
    owners, grams = [words.text[at]], [hashes]
    for length in range(1, n):
        short = np.flatnonzero(words.counts == length)
        owners.append(short)
        grams.append(gram_hashes(words.hash, words.first[short], length))
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, gram = owner[new], gram[new]
    return owner, gram, np.bincount(owner, minlength=texts.n).astype(np.int64)


def _digests(gram: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; equal sets have equal ones."""
    ends = np.cumsum(sizes)
    out = []
    for spread in (mix(gram), mix(gram ^ _SALT)):
        sums = np.zeros(len(gram) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(spread, out=sums[1:])
            out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def _needed(sizes, percent: int, whole: int = 100):
    """The least overlap with which a set of this size can reach the threshold; with ``whole`` of 100 and
    ``percent`` more, with which two sets of this size together do."""
    return -(-(sizes * percent) // whole)


def _band_width(percent: int) -> float:
    """Of the logarithm of sizes: sets that can reach the threshold are in one band or in neighbouring ones."""
    return float(np.log(100 / min(percent, 99)) * (1 + 1e-9))


def _describe(n: int):
    """One row per text, and rows ``gram, count`` of grams that several sets of a task share."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["is_set", "doc_id", "n", "d1", "d2"]
        done: set[int] = set()
        waiting, held, kind = [], 0, pa.int64()
        for batch in slices(batches, "text"):
            kind = batch.column("doc_id").type
            owner, gram, sizes = gram_sets(batch.column("text"), n)
            d1, d2 = _digests(gram, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(sizes), bool)), batch.column("doc_id"), pa.array(sizes),
                    pa.array(as_long(d1)), pa.array(as_long(d2)),
                ],
                names=names,
            )
            waiting.append(gram[_fresh(d1, sizes, done)[owner]])
            held += len(waiting[-1])
            if held > COUNTED_GRAMS:
                yield _shared(waiting, kind, names)
                waiting, held = [], 0
        if held:
            yield _shared(waiting, kind, names)

    return describe


def _fresh(d1: np.ndarray, sizes: np.ndarray, done: set[int]) -> np.ndarray:
    """Which sets haven't been seen in this task, empty ones left out; notes them as seen."""
    fresh = np.zeros(len(sizes), bool)
    for i in np.flatnonzero(sizes).tolist():
        key = int(d1[i])
        if key not in done:
            done.add(key)
            fresh[i] = True
    return fresh


def _shared(waiting: list[np.ndarray], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    gram, counts = np.unique(np.concatenate(waiting), return_counts=True)
    gram, counts = as_long(gram[counts > 1]), counts[counts > 1]
    zero = np.zeros(len(gram), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(zero.astype(bool)), pa.nulls(len(gram), kind), pa.array(counts), pa.array(gram), pa.array(zero)],
        names=names,
    )


def frequent_grams(described: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams (sorted hashes) and their counts, at most ``most``.

    Counts come from all sets by lossy counting: a gram that is alone among some millions of grams of a
    task is not counted there. Any order of the grams gives the same result.
    """
    counted = described.where("not is_set").groupBy(F.col("d1").alias("gram")).agg(F.sum("n").alias("n"))
    # The least power of two that at most so many counts reach.
    steps = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().collect()
    above, least = 0, 0
    for step, number in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        above += number
        if above > most:
            least = 1 << (step + 1)
            break
    found = counted.where(F.col("n") >= max(least, 8)).toArrow()
    gram = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], found.column("n").to_numpy()[order]


_FRONT = "gram long, d1 long, band int, ahead int, first int, often long"


def _fronts(n: int, percent: int, known):
    """The grams of each distinct set of a task that can be among its first ones.

    ``first`` is the length of the prefix and ``ahead`` the number of the set's grams in the first part
    of the order. If that part is too short, what follows is given too, and all of it is in the prefix
    (``first`` is the largest integer then). Sizes that can reach the threshold together are in the same
    length band or in the next. ``often`` is the known count of a frequent gram.
    """
    width, whole = _band_width(percent), np.iinfo(np.int32).max

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = known.value
        done: set[int] = set()
        for batch in slices(batches, "text"):
            owner, gram, sizes = gram_sets(batch.column("text"), n)
            d1, _ = _digests(gram, sizes)
            kept = _fresh(d1, sizes, done)[owner]
            owner, gram = owner[kept], gram[kept]
            often = np.zeros(len(gram), np.int64)
            if len(frequent):
                place = np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)
                often = np.where(frequent[place] == gram, counts[place], 0)
            chosen = (gram < COUNTED) & (often == 0)
            ahead = np.bincount(owner[chosen], minlength=len(sizes))
            first = sizes - _needed(sizes, percent) + 1
            short = ahead < first
            # Sets with a short first part: the rest of their grams in order.
            more = np.flatnonzero(~chosen & short[owner])
            more = more[np.lexsort((gram[more], often[more], owner[more]))]
            own = owner[more]
            place = np.arange(len(more)) - np.searchsorted(own, own)
            at = np.concatenate([np.flatnonzero(chosen), more[place < (first - ahead)[own]]])
            owner = owner[at]
            band = np.floor(np.log(sizes[owner]) / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(gram[at])), pa.array(as_long(d1[owner])), pa.array(band),
                    pa.array(ahead[owner].astype(np.int32)),
                    pa.array(np.where(short, whole, first)[owner].astype(np.int32)), pa.array(often[at]),
                ],
                names=["gram", "d1", "band", "ahead", "first", "often"],
            )

    return fronts


def _string_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link each posting to the first of its run: postings of a gram whose length bands follow closely.

    The rows are sorted by gram, salt and band. Of a salted gram the first posting of each band is
    handed on (``b`` is null), to be strung together with those of the other salts.
    """
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, salt, band, d1 = (batch.column(c).to_numpy() for c in ("gram", "salt", "band", "d1"))
        salted = batch.column("salted").to_numpy(zero_copy_only=False)
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1])
        step = np.diff(band, prepend=band[:1])
        head = d1.copy()
        if last is not None and last[:2] == (gram[0], salt[0]):
            same[0], step[0] = True, band[0] - last[2]
        start = ~same | (step > 1)
        run = np.maximum.accumulate(np.where(start, np.arange(len(gram)), -1))
        head = np.where(run >= 0, d1[np.maximum(run, 0)], last[3] if last is not None else 0)
        linked = np.flatnonzero(head != d1)
        if len(linked):  # most grams of a pair of sets give the same link
            linked = linked[np.unique(np.stack([head[linked], d1[linked]]), axis=1, return_index=True)[1]]
        band_head = salted & (~same | (step > 0))
        last = (gram[-1], salt[-1], band[-1], head[-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([head[linked], d1[band_head]])),
                pa.array(
                    np.concatenate([d1[linked], d1[band_head]]),
                    mask=np.concatenate([np.zeros(len(linked), bool), np.ones(band_head.sum(), bool)]),
                ),
                pa.array(np.concatenate([gram[linked], gram[band_head]])),
                pa.array(np.concatenate([band[linked], band[band_head]])),
            ],
            names=["a", "b", "gram", "band"],
        )


def _strung(postings: DataFrame) -> DataFrame:
    dealt = postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "band", "d1")
    return dealt.mapInArrow(_string_together, "a long, b long, gram long, band int")


def _sets_of(n: int):
    """Adds to each row the hashes ``d1, d2``, the ``digest`` made of them, and the grams of its text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, gram, sizes = gram_sets(batch.column("text"), n)
            d1, d2 = _digests(gram, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(gram.tobytes())]
            ).cast(pa.binary())
            digest = pa.array([a + b for a, b in zip(map(_bytes, d1.tolist()), map(_bytes, d2.tolist()))], pa.binary())
            kept = [c for c in batch.schema.names if c != "text"]
            added = [pa.array(as_long(d1)), pa.array(as_long(d2)), digest, packed]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *added], names=[*kept, "d1", "d2", "digest", "grams"]
            )

    return sets


def _bytes(x: int) -> bytes:
    return x.to_bytes(8, "big")


class PrefixTree:
    """Sets as sorted sequences in a compressed prefix tree.

    Nodes hold runs of grams (``node_at:node_at + node_size`` of ``grams``) and stand in the order of
    their level, the children of a node together (``child_at:child_end``). ``low`` and ``high`` bound the sizes of
    the sets below a node, ``depth`` is the number of grams down to its end.
    """

    def __init__(self, sets: list[np.ndarray], size: int):
        lengths = np.array([len(s) for s in sets])
        order = sorted(range(len(sets)), key=lambda r: sets[r].astype(">u4").tobytes())
        shared = [0]
        for one, two in zip(order, order[1:]):
            m = min(lengths[one], lengths[two])
            differ = sets[one][:m] != sets[two][:m]
            shared.append(int(differ.argmax()) if differ.any() else int(m))
        # Nodes as [parent, set, from depth, to depth]; the stack is the path to the last set.
        nodes: list[list[int]] = []
        stack: list[int] = []
        leaf = np.zeros(len(sets), np.int64)
        for r, common in zip(order, shared):
            while stack and nodes[stack[-1]][2] >= common:
                stack.pop()
            if stack and nodes[stack[-1]][3] > common:  # cut the node at the branch
                old = stack[-1]
                parent, owner, start, end = nodes[old]
                nodes.append([parent, owner, start, common])
                upper = len(nodes) - 1
                nodes[old][0], nodes[old][2] = upper, common
                stack[-1] = upper
            if lengths[r] > common or not stack:
                nodes.append([stack[-1] if stack else -1, r, common, int(lengths[r])])
                stack.append(len(nodes) - 1)
            leaf[r] = stack[-1]
        table = np.array(nodes).reshape(-1, 4)
        level = np.zeros(len(table), np.int64)
        for i in np.argsort(table[:, 2], kind="stable").tolist():
            if table[i, 0] >= 0:
                level[i] = level[table[i, 0]] + 1
        first_gram = np.array([sets[r][a] if b > a else -1 for _, r, a, b in table.tolist()], np.int64)
        # By level, parent and first gram: the children of a node are neighbours, in the order of their grams.
        place = np.zeros(len(table), np.int64)
        rank, at = np.empty(len(table), np.int64), 0
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(level.max() + 2))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            nodes = by_level[a:b]
            above = np.where(table[nodes, 0] >= 0, place[table[nodes, 0]], -1)
            nodes = nodes[np.lexsort((first_gram[nodes], above))]
            place[nodes] = np.arange(at, at + len(nodes))
            rank[at : at + len(nodes)] = nodes
            at += len(nodes)
        table = table[rank]
        self.parent = np.where(table[:, 0] >= 0, place[table[:, 0]], -1)
        self.depth = table[:, 3]
        self.node_size = table[:, 3] - table[:, 2]
        self.node_at = np.cumsum(self.node_size) - self.node_size
        self.grams = np.concatenate([sets[r][a:b] for _, r, a, b in table.tolist()])
        self.first_gram = first_gram[rank]
        leaf = place[leaf]
        self.lengths = lengths
        levels = np.searchsorted(level[rank], np.arange(level.max() + 2))
        self.roots = int(levels[1])
        inner = np.arange(len(table))
        self.child_at = np.searchsorted(self.parent[self.roots :], inner) + self.roots
        self.child_end = np.searchsorted(self.parent[self.roots :], inner, side="right") + self.roots
        #: Which sets end at a node: ``ends[end_at[i]:end_at[i + 1]]``.
        self.ends = np.argsort(leaf, kind="stable")
        self.end_at = np.searchsorted(leaf[self.ends], np.arange(len(table) + 1))
        self.low = np.full(len(table), np.iinfo(np.int64).max)
        self.high = np.zeros(len(table), np.int64)
        np.minimum.at(self.low, leaf, lengths)
        np.maximum.at(self.high, leaf, lengths)
        for l in range(len(levels) - 2, 0, -1):
            at = slice(levels[l], levels[l + 1])
            np.minimum.at(self.low, self.parent[at], self.low[at])
            np.maximum.at(self.high, self.parent[at], self.high[at])
        self._size = size

    def walk(self, probes: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """For some probes the sets whose Jaccard similarity with them reaches the threshold, as pairs of
        the probe's place and the set.

        The probes go down together. Only nodes below those that can still reach the threshold are looked
        at; where no gram may be missed any more, only those that go on with a gram of the probe.
        """
        held = np.zeros((len(probes), self._size), bool)
        for i, probe in enumerate(probes):
            held[i, probe] = True
        held = held.ravel()
        lengths, both = np.array([len(p) for p in probes]), 100 + percent
        who, nodes = np.repeat(np.arange(len(probes)), self.roots), np.tile(np.arange(self.roots), len(probes))
        before, missed = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        out = []
        while len(nodes):
            n = lengths[who]
            # The sizes below must allow the threshold; of a set of s grams it allows so many to be missed.
            longest = np.minimum(self.high[nodes], 100 * n // percent)
            spare = longest - _needed(n + longest, percent, both) - missed
            fit = (100 * self.high[nodes] >= percent * n) & (100 * n >= percent * self.low[nodes]) & (spare >= 0)
            fit &= (spare > 0) | held[who * self._size + self.first_gram[nodes]]
            who, nodes, before, n = who[fit], nodes[fit], before[fit], n[fit]
            sizes = self.node_size[nodes]
            begin = np.cumsum(sizes) - sizes
            at = np.repeat(self.node_at[nodes] - begin, sizes) + np.arange(sizes.sum())
            hits = np.zeros(len(at) + 1, np.int64)
            np.cumsum(held[np.repeat(who * self._size, sizes) + self.grams[at]], out=hits[1:])
            found = before + hits[begin + sizes] - hits[begin]
            # At most the rest of the probe, or of the longest set below, can still be shared.
            most = found + np.minimum(n - found, self.high[nodes] - self.depth[nodes])
            alive = both * most >= percent * (n + self.low[nodes])
            who, nodes, found = who[alive], nodes[alive], found[alive]
            ended = self.end_at[nodes + 1] - self.end_at[nodes]
            sets = self.ends[_ranges(self.end_at[nodes], ended)]
            of = np.repeat(who, ended)
            near = both * np.repeat(found, ended) >= percent * (lengths[of] + self.lengths[sets])
            out.append((of[near], sets[near]))
            below = self.child_end[nodes] - self.child_at[nodes]
            missed = np.repeat(self.depth[nodes] - found, below)
            who, before, nodes = np.repeat(who, below), np.repeat(found, below), _ranges(self.child_at[nodes], below)
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers of each range, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_sets(
    sets: list[np.ndarray], percent: int, probes: Sequence[int] | None = None
) -> list[tuple[int, int]]:
    """Links between sets of gram hashes, as a forest: two sets are in one tree of it if and only if
    links lead from one to the other. With ``probes``, only links of these sets count."""
    whole = np.concatenate(sets)
    known, local, counts = np.unique(whole, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, -counts))] = np.arange(len(known))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(s) for s in np.split(rank[local], cuts)]
    tree = PrefixTree(ordered, len(known))
    parent, forest = list(range(len(sets))), []
    component = np.arange(len(sets))
    order = list(range(len(sets)) if probes is None else probes)
    most = max(1, min(64, _HELD // max(1, len(known))))
    at, batch = 0, 1
    # Once all sets are connected no further link adds anything.
    while at < len(order) and len(forest) < len(sets) - 1:
        asking = order[at : at + batch]
        place, other = tree.walk([ordered[r] for r in asking], percent)
        one = np.array(asking)[place]
        new = component[one] != component[other]
        for r, o in zip(one[new].tolist(), other[new].tolist()):
            a, b = _find(parent, r), _find(parent, o)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((r, o))
        if new.any():
            component = np.array([_find(parent, x) for x in range(len(sets))])
        at, batch = at + batch, min(most, 2 * batch)
    return forest


def _block_links(percent: int):
    def links(rows: pa.Table) -> pa.Table:
        # A chunk meets itself in one task with each other chunk: equal sets come once.
        digests = rows.column("digest").to_pylist()
        first = {d: i for i, d in reversed(list(enumerate(digests)))}
        kept = sorted(first.values())
        packed = rows.column("grams").combine_chunks()
        sets = [np.frombuffer(packed[i].as_buffer(), np.uint64) for i in kept]
        own = rows.column("own").to_pylist()
        probes = [place for place, i in enumerate(kept) if own[i]]
        forest = linked_sets(sets, percent, probes) if len(sets) > 1 and probes else []
        return pa.table(
            {
                "a": pa.array([digests[kept[a]] for a, _ in forest], pa.binary()),
                "b": pa.array([digests[kept[b]] for _, b in forest], pa.binary()),
            }
        )

    return links


def _candidate_links(docs: DataFrame, described: DataFrame, n: int, percent: int, sharers: int) -> DataFrame:
    """Links ``a, b`` between hashes of sets whose components hold every pair that can be similar."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_grams(described, FREQUENT))
    fronts = docs.select("text").mapInArrow(_fronts(n, percent, known), _FRONT)
    of_gram, of_set = Window.partitionBy("gram", "deal"), Window.partitionBy("d1")
    # The sets of a gram known to be frequent are dealt out; all of them go by its known count.
    deal = F.pmod(F.xxhash64("d1"), 1 + F.floor(F.col("often") / sharers)).cast("int")
    shared = (
        fronts.withColumn("deal", deal)
        .repartition("gram", "deal")
        .dropDuplicates(["gram", "deal", "d1"])
        .withColumn("count", F.when(F.col("often") < sharers, F.count(F.lit(1)).over(of_gram)).otherwise(F.col("often")))
        .where("count > 1")
    )
    # Grams that no other set has come first in a set; they were dropped, but they count for the place.
    place = F.col("ahead") - F.count(F.lit(1)).over(of_set) + F.row_number().over(of_set.orderBy("count", "gram")) - 1
    prefixes = shared.withColumn("place", place).where("place < first")
    many = F.greatest("often", "count")
    ways = F.lit(1) + F.floor(many / sharers)
    postings = prefixes.select(
        "gram", F.pmod(F.xxhash64("d1"), ways).cast("int").alias("salt"), (ways > 1).alias("salted"), "band", "d1"
    )
    strung = stage(_strung(postings))
    # Postings of a salted gram: the heads of its bands, in one task.
    heads = strung.where("b is null").select(
        "gram", F.lit(0).alias("salt"), F.lit(False).alias("salted"), "band", F.col("a").alias("d1")
    )
    found = strung.where("b is not null").select("a", "b")
    return found.unionByName(_strung(heads).select("a", "b"))


def near_duplicates(
    docs: DataFrame, n: int = 4, percent: int = 85, block_grams: int = BLOCK_GRAMS, sharers: int = SHARERS
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Texts are lower-cased (A to Z) and cut into words at white space; a text's set holds its distinct
    runs of ``n`` words, or all its words as one if there are fewer. Two texts link if their sets have
    a Jaccard similarity of at least ``percent`` in a hundred. ``component_id`` is the smallest
    ``doc_id`` that links lead to, the text's own included. Texts that are null or without words have
    no shingles and link with nothing. Equal texts, and repeated rows, have the same component. A row
    without ``doc_id`` takes part like others; a component in which no row has an id is null.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    described = stage(
        texts.mapInArrow(_describe(n), f"is_set boolean, doc_id {kind}, n long, d1 long, d2 long")
    )
    rows = described.where("is_set").select("doc_id", "n", "d1", "d2")
    sets = stage(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))

    blocks = components(_candidate_links(texts, described, n, percent, sharers))
    blocked = blocks.select(F.col("node").alias("d1"), F.col("root").alias("block"))
    band = F.floor(F.log("n") / _band_width(percent)).cast("int")
    # Slot k holds the sets of band k, its own, and those of band k - 1.
    members = sets.join(blocked, "d1").select("*", band.alias("band"))
    members = stage(
        members.withColumn("slot", F.explode(F.array("band", F.col("band") + 1))).withColumn("own", F.expr("slot = band"))
    )
    sizes = members.groupBy("block", "slot").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets"), F.count_if("own").alias("owned")
    )
    # Of a part in chunks, two meet in a task.
    filled = F.greatest(F.col("total") / block_grams, F.col("sets") / BLOCK_SETS)
    ways = F.when(filled <= 1, 1).otherwise(F.ceil(2 * filled)).cast("int")
    sizes = sizes.where("sets > 1 and owned > 0").select("block", "slot", ways.alias("chunks"))
    to_send = stage(
        members.join(sizes, ["block", "slot"]).select(
            F.col("rep").alias("doc_id"), F.col("d1").alias("k1"), F.col("d2").alias("k2"), "block", "slot", "own",
            "chunks", F.pmod(F.xxhash64("d2"), F.col("chunks")).cast("int").alias("chunk"),
        )
    )
    sent = "block long, slot int, own boolean, chunks int, chunk int, d1 long, d2 long, digest binary, grams binary"
    place = ["block", "slot", "own", "chunks", "chunk"]
    # Ids may repeat with other texts: the hashes say which text is meant.
    claimed = texts.join(small(to_send, to_send.count()), "doc_id")
    by_id = claimed.select("text", "k1", "k2", *place).mapInArrow(
        _sets_of(n), "k1 long, k2 long, " + sent
    )
    unnamed = texts.where("doc_id is null").select("text").mapInArrow(
        _sets_of(n), "d1 long, d2 long, digest binary, grams binary"
    )
    by_hash = to_send.where("doc_id is null").select("k1", "k2", *place)
    by_hash = unnamed.join(by_hash, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")))
    packed = by_id.where("d1 = k1 and d2 = k2").unionByName(by_hash)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = packed.select("block", "slot", "own", "chunk", other.alias("other"), "digest", "grams").select(
        "block", "slot", "own", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        "digest", "grams",
    )
    links = stage(pairs.groupBy("block", "slot", "i", "j").applyInArrow(_block_links(percent), "a binary, b binary"))

    digest = F.unhex(F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0")))
    roots = components(links).withColumnRenamed("node", "digest")
    named = roots.join(sets.select(digest.alias("digest"), "rep"), "digest")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = named.join(smallest, "root").select("digest", "component_id")
    # Written, so that the join below deals both sides anew and Spark can split a large group of copies.
    final = stage(
        sets.withColumn("digest", digest)
        .join(linked, "digest", "left")
        .select("n", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    )
    full = rows.where("n > 0").join(final, ["n", "d1", "d2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)

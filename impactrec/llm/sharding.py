"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

Groups come in order of falling size; each enters the open shard with the least room that
still holds it, found in a balanced tree (a treap keyed by remaining room). Groups of the
same size are interchangeable, so the tree sees the histogram of sizes and not the groups:
it places as many groups of a size as fit into the tightest shard in one step, and shards of
consecutive numbers with the same room are one entry of the tree, filled in one step, too. The histogram
has at most ``4096 + 2048 * 51`` sizes, as those above 4096 are rounded up to 12 significant
bits, which makes it small enough for the driver whatever the number of groups; a rounded
size is less than 0.05 % above the true one. Groups are ranked within their size, and rows
numbered within their shard, by distributed running totals, so no size, group or shard has to
fit into a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from impactrec.functions.ordering import running_totals
from impactrec.llm.tables import small
from impactrec.staging import stage

EXACT_SIZES = 4096
SIGNIFICANT_BITS = 12


def rounded_up(size: int) -> int:
    """``size`` up to 4096, the next number with 12 significant bits above."""
    if size <= EXACT_SIZES:
        return size
    shift = size.bit_length() - SIGNIFICANT_BITS
    return -(-size >> shift) << shift


def rounded_up_column(size: Column) -> Column:
    """``rounded_up`` of a long column."""
    bits = F.length(F.bin(size))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bits - SIGNIFICANT_BITS, F.lit(0)))
    return F.when(size <= EXACT_SIZES, size).otherwise(F.expr("0L") + F.floor((size + step - 1) / step).cast("long") * step)


class Treap:
    """A balanced search tree of distinct tuples; nodes are ``[key, priority, left, right]``."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _priority(key) -> int:
        return hash((key, 0x9E3779B97F4A7C15))

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = self._merge(left[3], right)
            return left
        right[2] = self._merge(left, right[2])
        return right

    def insert(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self._priority(key), None, None]), right)

    def remove(self, key) -> None:
        left, rest = self._split(self.root, key)
        _, right = self._split(rest, (*key[:-1], key[-1] + 1))
        self.root = self._merge(left, right)

    def ceiling(self, key):
        """The smallest key that is at least ``key``, or None."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= key:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found


@dataclass
class Packing:
    """``ranges`` holds ``(size, first, last, bin, each)``: the groups of a size of rank ``first`` (from 0) to
    ``last`` go into consecutive bins from ``bin`` on, ``each`` into one."""

    capacity: int
    bins: int = 0
    ranges: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    @property
    def runs(self) -> list[tuple[int, int, int, int]]:
        """The ranges bin by bin: ``(size, first, last, bin)``."""
        return [
            (size, at, min(at + each - 1, last), number + k)
            for size, first, last, number, each in self.ranges
            for k, at in enumerate(range(first, last + 1, each))
        ]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> Packing | None:
    """Pack ``(size, groups)``; a group above the capacity has a bin of its own.

    With ``most``, None as soon as more bins are needed. Time and memory go with the number of sizes,
    not with that of bins or groups.
    """
    open_bins, out = Treap(), Packing(capacity)

    def leave_open(room: int, number: int, count: int) -> None:
        if room > 0 and count > 0:
            open_bins.insert((room, number, count))

    for size, groups in sorted(sizes, reverse=True):
        placed = 0
        while placed < groups:
            found = open_bins.ceiling((size, -1)) if size <= capacity else None
            if found is None:
                room, number = max(capacity, size), out.bins
                each = room // size
                count = -(-(groups - placed) // each)
                out.bins += count
                if most is not None and out.bins > most:
                    return None
            else:
                open_bins.remove(found)
                room, number, count = found
                each = room // size
            full = min(count, (groups - placed) // each)
            if full:
                out.ranges.append((size, placed, placed + full * each - 1, number, each))
                placed += full * each
                leave_open(room - each * size, number, full)
            if full < count:
                if rest := groups - placed:
                    out.ranges.append((size, placed, groups - 1, number + full, rest))
                    placed = groups
                    leave_open(room - rest * size, number + full, 1)
                    full += 1
                leave_open(room, number + full, count - full)
    return out


def by_parts(ranges: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """``(size, width)``, and each range once for every part of ``width`` ranks that it touches.

    The width is the mean length of a size's ranges, so that there are at most three times as many rows as
    ranges, and groups that look only at the rows of their own part meet three each on average.
    """
    lengths: dict[int, list[int]] = {}
    for size, first, last, _, _ in ranges:
        entry = lengths.setdefault(size, [0, 0])
        entry[0] += last - first + 1
        entry[1] += 1
    widths = {size: -(-ranks // n) for size, (ranks, n) in lengths.items()}
    rows = [(r[0], part, *r[1:]) for r in ranges for part in range(r[1] // widths[r[0]], r[2] // widths[r[0]] + 1)]
    return list(widths.items()), rows


def even_packing(sizes: list[tuple[int, int]], bins: int) -> Packing:
    """The packing into at most ``bins`` bins with the least capacity that a binary search finds."""
    total = sum(s * n for s, n in sizes)
    low, high = -(-total // bins) // 2, max(1, total)
    best = best_fit_decreasing(sizes, high, bins)
    while low < high:
        middle = (low + high) // 2
        if found := best_fit_decreasing(sizes, middle, bins):
            best, high = found, middle
        else:
            low = middle + 1
    return best


def size_classes(df: DataFrame, group: list[str], size: str) -> DataFrame:
    """One row per group: its key, ``class`` (the rounded sum of ``size``) and ``one``, 1."""
    total = F.sum(F.col(size)).cast("long")
    return df.groupBy(*group).agg(rounded_up_column(total).alias("class"), F.lit(1).cast("long").alias("one"))


def pack(
    df: DataFrame, group: list[str], size: str, *, bins: int | None = None, capacity: int | None = None
) -> DataFrame:
    """One row per group with its ``shard``, from 0.

    Give ``capacity`` for as few shards of that capacity as best fit needs, or ``bins`` for that
    many shards of near equal size. ``size`` is a positive long; the group columns must not be
    null, and may have any name but ``shard``. A group above the capacity has a shard of its own. An
    empty table has no shards.
    """
    spark = df.sparkSession
    keys = [f"_group{i}" for i in range(len(group))]
    named = df.select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(size).alias("_size"))
    groups = stage(size_classes(named, keys, "_size"))
    histogram = [(r["class"], r["count"]) for r in groups.groupBy("class").count().toLocalIterator()]
    packing = even_packing(histogram, bins) if bins else best_fit_decreasing(histogram, capacity)
    ranked = running_totals(groups, by=["class"], order=[F.col(k) for k in keys], sums=["one"], keep=keys)
    ranked = ranked.select(*keys, "class", (F.col("cum_one") - 1).alias("_rank"))
    widths, rows = by_parts(packing.ranges)
    widths = small(spark.createDataFrame(widths, "class long, _width long"), len(widths))
    schema = "class long, _part long, _first long, _last long, _bin int, _each long"
    ranges = small(spark.createDataFrame(rows, schema), len(rows))
    parted = ranked.join(widths, "class").withColumn("_part", F.expr("_rank div _width"))
    joined = parted.join(ranges, ["class", "_part"]).where("_rank between _first and _last")
    shard = F.expr("cast(_bin + (_rank - _first) div _each as int)").alias("shard")
    return joined.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], shard)


def number_rows(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: numbers from 0 without gaps within ``by``, in the given order."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(counted, by=[by], order=[F.col(c) for c in order], sums=["_one"])
    return out.select(*df.columns, (F.col("cum__one") - 1).alias(name))


def shard_documents(docs: DataFrame, bins: int, overhead: int = 16) -> DataFrame:
    """All documents in ``bins`` shards of near equal bytes; equal texts stay together.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The size is the UTF-8
    bytes of the text plus ``overhead``; a null text has no bytes and the checksum of an empty
    one, and null texts are one group, apart from empty texts. Repeated rows are each placed.
    A group larger than the mean shard has a shard of its own, and the others share the rest.
    The checksum and the key of a text are computed once and written; only they are shuffled.
    """
    raw = F.encode(F.col("text"), "UTF-8")
    keys = stage(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(raw)), F.lit(b"")).alias("_text"),
        )
    )
    # Written, so that the join deals both sides anew and Spark can split a large group of copies.
    shards = stage(pack(keys, ["_text"], "size", bins=bins))
    placed = keys.join(shards, "_text").select("doc_id", "size", "text_crc32", "shard")
    numbered = number_rows(placed, "shard", ["doc_id", "text_crc32"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Variable-capacity best-fit packing.

Documents are packed whole into bins of several permitted lengths at once; one longer than the longest is
split without loss, and its full pieces get bins of their own. Pieces go largest first: each into the open
bin that it leaves least room in; where it fits none, a bin is opened. A bin's price is its length, a part
for attention that grows with the square of it, and a fixed part. The bin that is opened has the length
whose price per token is least when it is packed on trial with what is left. At the end every bin is
downsized to the shortest permitted length that holds its contents. Packings that open one length
throughout are tried too, and the cheapest of all is taken.

Packing runs in blocks of ``block_rows`` documents, dealt by a hash of id, size and number among
equal rows: an id that holds a third of all rows is spread like any other. A task holds the sizes of a
block, no texts.
A null or empty document has no piece: it is listed with bin_id null, length 0 and capacity 0. Repeated
rows are packed each on their own, and pieces of one size in the order of a hash. A very long document is
split into any number of pieces. An empty table gives an empty result. Columns other than the id and what
``size`` reads are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, numbered_copies, word_count

LENGTHS = (256, 512, 1024, 2048, 4096, 8192)
#: The fixed part of a bin's price in tokens, and the length at which attention costs as much as the tokens.
BIN_PRICE, SPAN = 64, 16_384
BLOCK_ROWS = 8000
RESULT = "piece long, start long, length long, bin_id long, capacity long, offset long, n_pieces long"


def price(length: int, bin_price: int = BIN_PRICE, span: int = SPAN) -> float:
    """What a bin of this length costs: its room, attention over it, and a fixed part."""
    return length + length * length / span + bin_price


class Opener:
    """Chooses the length of a new bin. ``sizes`` fall; all pieces behind a place are still to be packed."""

    def __init__(self, sizes: Sequence[int], lengths: Sequence[int], bin_price: int, span: int):
        self.falling = [-n for n in sizes]
        self.sums = [0, *accumulate(sizes)]
        self.lengths, self.price = lengths, [price(n, bin_price, span) for n in lengths]

    def filled(self, at: int, length: int) -> int:
        """What a bin of this length would hold: the piece, then the largest of the rest that fit, run by run."""
        used, j = -self.falling[at], at + 1
        while used < length:
            j = bisect_left(self.falling, used - length, j)
            if j == len(self.falling):
                break
            k = bisect_right(self.sums, self.sums[j] + length - used) - 1
            used += self.sums[k] - self.sums[j]
            j = k
        return used

    def __call__(self, at: int, least: int = 0) -> int:
        """The length whose bin, packed on trial and downsized, has the least price for each token it holds."""
        best = None
        for length in self.lengths:
            if length >= max(least, -self.falling[at]) or length == self.lengths[-1]:
                used = self.filled(at, length)
                found = self.price[bisect_left(self.lengths, used)] / used
                if best is None or found < best[0]:
                    best = found, length
        return best[1]


def best_fit(sizes: Sequence[int], opened: Callable[[int], int]) -> tuple[list[int], list[int], list[int]]:
    """(bin and offset of each of the falling sizes, what each bin holds); ``opened`` is the length of a new bin."""
    bin_of, offset, used = [0] * len(sizes), [0] * len(sizes), []
    open_bins: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i, n in enumerate(sizes):
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = opened(i), len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if left > n:
            insort(open_bins, (left - n, b))
    return bin_of, offset, used


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_price: int = BIN_PRICE, span: int = SPAN) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, capacity of each bin); no size is above the longest length.

    The cheapest of several packings: each new bin of the length that trial packing favours, and, for each
    length, each new bin of that length or the next that holds the piece. So no single length does better."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    ways: list[Callable[[int], int]] = [Opener(falling, lengths, bin_price, span)]
    ways += [lambda i, n=n: lengths[bisect_left(lengths, max(n, falling[i]))] for n in lengths]
    best = None
    for way in ways:
        bins, offsets, used = best_fit(falling, way)
        capacity = [lengths[bisect_left(lengths, u)] for u in used]
        total = sum(price(c, bin_price, span) for c in capacity)
        if best is None or total < best[0]:
            best = total, bins, offsets, capacity
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    for place, b, o in zip(order, best[1], best[2], strict=True):
        bin_of[place], offset[place] = b, o
    return bin_of, offset, best[3]


def pack_blocks(df: DataFrame, id_col: str = "doc_id", size: Column | None = None, lengths: Sequence[int] = LENGTHS, bin_price: int = BIN_PRICE, span: int = SPAN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each piece: id, piece number and its tokens [start, start + length), bin_id, the bin's
    final capacity, the offset in the bin and how many pieces the document has."""
    lengths, longest = tuple(sorted(lengths)), max(lengths)
    size = word_count(F.col("text")) if size is None else size
    rows = materialise(numbered_copies(df.select(F.col(f"`{id_col}`").alias("_id"), size.cast("long").alias("_size"))), "lengths")
    blocks = max(1, -(-rows.count() // block_rows))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["_h", "_size"], kind="stable")
        out, todo = [], []
        number = 0
        for i, n in zip(own["_id"], own["_size"], strict=True):
            full, tail = divmod(int(n), longest)
            pieces = full + (tail > 0)
            for k in range(full):
                out.append((i, k, k * longest, longest, number, longest, 0, pieces))
                number += 1
            if tail:
                todo.append((i, full, full * longest, tail, pieces))
            elif not full:
                out.append((i, 0, 0, 0, None, 0, 0, 0))
        bins, offsets, capacity = pack([t[3] for t in todo], lengths, bin_price, span)
        out += [(i, k, s, n, number + b, capacity[b], o, p) for (i, k, s, n, p), b, o in zip(todo, bins, offsets, strict=True)]
        made = pd.DataFrame(out, columns=["_id", "piece", "start", "length", "bin_id", "capacity", "offset", "n_pieces"])
        made["bin_id"] = made["bin_id"].astype("Int64") + (int(key[0]) << 32)
        made["_id"] = made["_id"].astype(own["_id"].dtype)
        return made

    dealt = rows.withColumn("_h", F.xxhash64("_id", "_size", "_row")).withColumn("_block", F.pmod("_h", F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, f"_id {kind}, {RESULT}").withColumnRenamed("_id", id_col)

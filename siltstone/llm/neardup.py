"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text gets its distinct ``width``-word shingles, a 128-bit key of that set and a signature of
   ``COORDINATES`` minima. Equal sets form one class: exact copies meet in an aggregate, not in pairs.
2. Classes are posted under each (coordinate, value). A class that shares fewer than ``match`` coordinates
   with any other can have no partner. Prefix: of the others, ordered from the rarest value on, only the
   first shared - match + 1 postings are kept, since two classes that agree on ``match`` coordinates meet
   in both prefixes. Skip: the frequent values, behind the prefix, are never merged.
3. Lists of at most ``SMALL`` classes give pairs, and their collisions are counted on whole signatures.
   Longer lists are not expanded: those that share classes form one group, cut into blocks. A task
   compares a block within and with a few pivots of the group by counting shared shingles; it returns
   spanning links only. What then hangs outside the largest part of its group is compared with all of it.
4. Links are confirmed on the full sets, and connected components give each document its class.

``match`` lies 4.5 standard deviations below what the similarity threshold leads one to expect, so a pair
at the threshold is missed with a probability below 1e-5; no list, group or number of partners is capped.

Documents without words have an empty set and link with nothing. A null id counts after all others as a
smallest id. Repeated rows have equal sets. Of equal texts with one id each row is listed. A very long text
is taken apart whole, by itself. Ids are whole numbers; a table with others raises. Columns other than id and
text are ignored, whatever their names; ``representatives`` gives them back. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, row_key, slices, split_words, take_copies
from siltstone.operators.components import components

COORDINATES = 64
SMALL = 48
#: Classes and bytes of text of a block, and the members of a group that all its blocks are compared with.
BLOCK, BLOCK_BYTES, PIVOTS = 500, 16 << 20, 4
#: Texts that are taken apart at a time: their arrays need about ten times that.
SLICE_BYTES = 6 << 20
_RANDOM = np.random.default_rng(6)
FACTORS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_FACTORS = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(percent: int, coordinates: int = COORDINATES) -> int:
    p = percent / 100
    return max(1, math.floor(coordinates * p - 4.5 * math.sqrt(coordinates * p * (1 - p))))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; fewer than ``width`` words are one shingle."""
    for a, b in slices(texts):
        words, codes, starts = split_words(texts.slice(a, b))
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        own = hashed[codes] if len(words) else np.zeros(0, np.uint64)
        n = max(0, len(own) - width + 1)
        mixed = np.zeros(n, np.uint64)
        for k in range(width):
            mixed += own[k : k + n] * WORD_FACTORS[k]
        mixed = finished(mixed)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s >= width:
                yield np.unique(mixed[s : e - width + 1])
            elif e > s:
                yield finished((own[s:e] * WORD_FACTORS[: e - s]).sum(keepdims=True) + WORD_FACTORS[15:] * np.uint64(e - s))
            else:
                yield np.zeros(0, np.uint64)


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set under every coordinate's hash, as signed 32-bit numbers; no set is empty."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
        for j, factor in enumerate(FACTORS):
            out[:, j] = np.minimum.reduceat((flat * factor >> np.uint64(32)).astype(np.uint32), starts)
    return out.view(np.int32)


def described(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(_id, _text_hash, row key, n_shingles, key, signature) of every row; key is null for an empty set."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text"), *row_key(df))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(a, b)
                sets = list(shingle_sets(part.column(2), width))
                full = [s for s in sets if len(s)]
                found = pa.FixedSizeListArray.from_arrays(pa.array(signatures(full).reshape(-1)), COORDINATES).cast(pa.list_(pa.int32()))
                at = np.cumsum([len(s) > 0 for s in sets]) - 1
                place = pa.array(at, mask=np.array([not len(s) for s in sets], bool))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [part.column(0), part.column(1), part.column(3), part.column(4), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), found.take(place)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_text_hash", "_k1", "_k2", "n_shingles", "key", "signature"])

    return rows.mapInArrow(run, "_id long, _text_hash long, _k1 long, _k2 long, n_shingles long, key binary, signature array<int>")


def confirmed(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def links_of_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            left, right = shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)
            good = pa.array([confirmed(x, y, percent) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    a, b = texts.select(F.col("node").alias("a"), F.col("_text").alias("_ta")), texts.select(F.col("node").alias("b"), F.col("_text").alias("_tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


class Postings:
    """Which of the sets hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        by = np.argsort(ids, kind="stable")
        self.posted = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[by]
        self.bounds, self.n = np.searchsorted(ids[by], np.arange(len(self.names) + 1)), len(sets)

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many shingles of ``own`` each set has."""
        at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
        at = at[self.names[at] == own]
        lows, lengths = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        places = np.arange(lengths.sum()) + np.repeat(lows - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        return np.bincount(self.posted[places], minlength=self.n)


def links_of_blocks(nodes: np.ndarray, sets: list[np.ndarray], root: np.ndarray, percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among the sets of one block, or between those ``left`` and the others.

    Sets are taken by size, so that those that can be similar enough stand together. One that is known
    (``root``: what it hangs together with) to hang together with all that it could meet is not counted."""
    by = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(nodes[i])))
    posted = by if left is None else [i for i in by if left[i]]
    if not posted:
        return []
    index, sizes = Postings([sets[i] for i in posted]), np.array([len(sets[i]) for i in posted])
    root, at, out = np.unique(root, return_inverse=True)[1], np.array(posted), []
    for place, i in enumerate(by if left is None else [i for i in by if not left[i]]):
        own = len(sets[i])
        low = np.searchsorted(sizes, -(-percent * own // 100))
        high = place if left is None else np.searchsorted(sizes, 100 * own // percent, "right")
        others = np.arange(low, high)
        if not len(others) or (root[at[others]] == root[i]).all():
            continue
        shared = index.shared(sets[i])[others]
        for k in at[others[100 * shared >= percent * (sizes[others] + own - shared)]]:
            if root[k] != root[i]:
                root[root == root[i]] = root[k]
                out.append((int(nodes[k]), int(nodes[i])))
    return out


def blocks_of(block: int) -> Column:
    """Blocks by group that hold ``block`` rows and BLOCK_BYTES of text, more only by chance or by one long text."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("_bytes") / BLOCK_BYTES)).cast("long")


def links_of_groups(long: DataFrame, texts: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``long``: (token, node) of the long lists. Lists with a class in common form one group.

    First, each block of a group is compared within and with the group's PIVOTS, a few members that go to
    all its blocks: work that grows with the group. Copies of one text hang together by then. What is left
    outside the largest part of a group is compared with the whole group, block by block."""
    first = long.groupBy("node").agg(F.min("token").alias("b"))
    tokens = components(long.join(first, "node").select(F.col("token").alias("a"), "b"))
    members = first.join(tokens, first["b"] == tokens["node"]).select(first["node"], F.col("root").alias("group"))
    members = materialise(members.join(texts.select("node", F.octet_length("_text").alias("_bytes")), "node"), "members")
    if members.isEmpty():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    least = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node"))["node"] for i in range(PIVOTS)]
    groups = members.groupBy("group").agg(blocks_of(block).alias("_n"), F.array_distinct(F.array(*least)).alias("_pivots"))
    groups = materialise(groups, "groups")
    dealt = members.join(groups.select("group", "_n"), "group").select("group", F.pmod(F.xxhash64("node"), "_n").alias("_b"), "node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_b")
    pivots = groups.filter("_n > 1").select("group", "_pivots", every).select("group", "_b", F.explode("_pivots").alias("node"))

    def within(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates("node")
        sets = list(shingle_sets(pa.array(own["_text"], pa.string()), width))
        return pd.DataFrame(links_of_blocks(own["node"].to_numpy(), sets, np.arange(len(own)), percent), columns=["a", "b"], dtype="int64")

    near = dealt.union(pivots).join(texts, "node").groupBy("group", "_b").applyInPandas(within, "a long, b long")
    near = materialise(near, "near_links")

    hung = components(near).select("node", "root")
    placed = members.join(hung, "node", "left").select("group", "node", "_bytes", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed, "placed")
    largest = placed.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "root"))["root"].alias("_main"))
    rest = materialise(placed.join(largest, "group").filter("root <> _main").drop("_main"), "rest")
    if rest.isEmpty():
        return near
    open_ = rest.groupBy("group").agg(blocks_of(block).alias("_m")).join(groups.select("group", "_n"), "group")
    held = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_x")
    ours = rest.join(open_, "group").select("group", F.pmod(F.xxhash64("node"), "_m").alias("_x"), every, "node", "root", F.lit(True).alias("_left"))
    theirs = placed.join(open_, "group").select("group", held, F.pmod(F.xxhash64("node"), "_n").alias("_b"), "node", "root", F.lit(False).alias("_left"))

    def between(own: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(pa.array(own["_text"], pa.string()), width))
        found = links_of_blocks(own["node"].to_numpy(), sets, own["root"].to_numpy(), percent, own["_left"].to_numpy())
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return near.union(ours.unionByName(theirs).join(texts, "node").groupBy("group", "_x", "_b").applyInPandas(between, "a long, b long"))


def links(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between classes that span every connected component."""
    match = least_matches(percent)
    token = F.transform("signature", lambda v, j: F.shiftleft(j.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    posted = classes.select("node", F.explode(token).alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posted.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    prefix = F.slice("held", 1, F.size("held") - match + 1)
    postings = materialise(shared.filter(F.size("held") >= match).select("node", F.explode(prefix).alias("p")).select("node", "p.token"), "postings")
    lengths = postings.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    lists = materialise(postings.join(lengths, "token"), "lists")

    nodes = lists.select("node").distinct().join(classes, "node").select("node", "_id", "_text_hash")
    text = docs.select(F.col("_id").alias("_i"), F.xxhash64("_text").alias("_h"), "_text")
    texts = nodes.join(text, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_hash") == F.col("_h"))).select("node", "_text").dropDuplicates(["node"])
    texts = materialise(texts, "texts")

    small = lists.filter(F.col("n") <= SMALL)
    pairs = small.select("token", F.col("node").alias("a")).join(small.select("token", F.col("node").alias("b")), "token").filter("a < b").select("a", "b").distinct()
    of = classes.select("node", "signature")
    counted = pairs.join(of.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    collisions = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda e: e))
    likely = materialise(counted.filter(collisions >= match).select("a", "b"), "pairs")
    found = links_of_pairs(likely, texts, width, percent)
    return materialise(found.union(links_of_groups(lists.filter(F.col("n") > SMALL).select("token", "node"), texts, width, percent)), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row, with its class and row key."""
    rows = materialise(described(df, id_col, text_col, width), "described")
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text_hash")).alias("m")
    classes = rows.filter("key is not null").groupBy("key").agg(least, F.min("signature").alias("signature"))
    classes = materialise(classes.select("key", "m._id", "m._text_hash", "signature", F.monotonically_increasing_id().alias("node")), "classes")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    member = components(links(classes, docs, width, percent)).join(classes.select("node", "key", "_id"), "node")
    member = materialise(member.select("root", "key", "_id"), "member")
    linked = member.join(member.groupBy("root").agg(F.min("_id").alias("least")), "root").select("key", "least", "root")
    of_key = classes.select("key", "_id", "node").join(linked, "key", "left")
    of_key = of_key.select("key", F.coalesce("least", "_id").alias("component_id"), F.coalesce("root", "node").alias("_class"))
    out = rows.join(materialise(of_key, "of_key"), "key", "left")  # a plain join, which can be split where a key is hot
    component = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"), "_class", "_k1", "_k2")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: one of each component, the one with the smallest id; rows without words all stay."""
    found = near_duplicates(df, id_col, text_col, width, percent).filter("kept")
    grouped = found.filter("_class is not null").groupBy("_class").agg(F.min(F.struct("_k1", "_k2")).alias("k")).select("k.*", F.lit(1).alias("copies"))
    wordless = found.filter("_class is null").select("_k1", "_k2", F.lit(1).alias("copies"))
    return take_copies(df, grouped.unionByName(wordless))

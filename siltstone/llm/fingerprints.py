"""Document fingerprints by Order MinHash (Marcais et al. 2019), with DataFrame functions only.

A text's k-mers are its runs of ``K`` words (fewer words are one k-mer), each numbered by occurrence, so
that repeats count. Each of ``BINS`` hashes goes over all (k-mer, occurrence), selects the ``PICKED`` of
minimal hash, puts them back in text order and hashes that tuple: moving words about changes it even where
the set of k-mers stays. Likeness is the share of the hashes in which the tuples agree. BASES hashes are
computed for each k-mer, and each gives several orders by turning its highest bits, so that each order
begins in another part of its range: in any of them every k-mer is as likely to be the least as any other.

All of it is built-in functions over arrays of one row. The successor in id order comes from one exchange
of the texts: ids are cut into ranges, each range is ordered on its own, and a copy of its first row is
dealt to the range before it. Ranges grow in number with the rows: CUTS quantiles come to the driver, ids
between two of them are cut evenly, and an id that many rows have is cut by the hash of the text. The table
of the ranges' first rows, at most two for each of MAX_RANGES, is all that is broadcast.

A null text is empty; an empty text has one empty k-mer, and two of them are alike (1.0). Null ids come
last; rows with equal ids, or null ones, go by the hash of the text. Repeated rows have equal fingerprints;
those with one id stay in one range. Of a very long text all k-mers take part. Ids are whole numbers; a
table with others raises. Other columns are ignored, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import materialise

#: A hash is one of BASES hashes of the numbered k-mer with a pattern of its own on the bits from ORDER_SHIFT on.
K, PICKED, BINS, BASES, ORDER_SHIFT = 3, 2, 64, 8, 61
ROWS_A_RANGE, MAX_RANGES, CUTS = 400, 1 << 18, 512
#: An entry of a fingerprint has 32 bits, the number of its hash in the highest ones.
#: A packed long holds a hash above and a place in the text in its PLACE lowest bits.
PLACE = 28
ID = (1 << (64 - PLACE)) - 1
LIKELY = 8
LOW = (1 << PLACE) - 1
HIGH = -1 - LOW
BIN_SHIFT = 64 - (BINS - 1).bit_length()
SPACE = r"[\\x20\\x09-\\x0D]+"


def numbered_kmers(text: str, out: str) -> tuple[tuple[str, str], ...]:
    """Columns of the words, of the k-mers in the order of their hash, equal ones in text order, and of where each new one starts."""
    words, kmers, starts = (f"_{name}_{out}" for name in ("words", "kmers", "starts"))
    grams = ", ".join(f"get({words}, i + {k})" for k in range(K))
    return (
        (words, f"split({text}, '{SPACE}')"),
        (kmers, f"sort_array(transform(sequence(0, greatest(size({words}) - {K}, 0)), i -> (xxhash64({grams}) & {HIGH}) | cast(i as bigint)))"),
        (starts, f"filter(sequence(0, size({kmers}) - 1), i -> i = 0 or shiftright(get({kmers}, i), {PLACE}) <> shiftright(get({kmers}, i - 1), {PLACE}))"),
    )


def numbered(kmers: str, starts: str) -> str:
    """(hash of k-mer and occurrence, place in the text), packed."""
    return f"flatten(transform({starts}, (a, r) -> transform(slice({kmers}, a + 1, coalesce(get({starts}, r + 1), size({kmers})) - a), (x, n) -> (xxhash64(shiftright(x, {PLACE}), n) & {HIGH}) | (x & {LOW}))))"


def order_minhash(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, an array<bigint> with an entry for each of ``BINS`` hashes over all k-mers of the column ``text``."""
    kmers, starts, ids = (f"_{name}_{out}" for name in ("kmers", "starts", "ids"))
    ordered = "if(array_position(t, a) < array_position(t, b), xxhash64(a, b), xxhash64(b, a))"
    pair = f"get(transform(array(array_min(t)), a -> get(transform(array(array_min(array_remove(t, a))), b -> {ordered}), 0)), 0)"
    # LIKELY of the hashes that an order begins with are expected below ``c``; where there are too few, all are
    # compared: minima do not depend on it. The highest bit is turned too, as longs have a sign.
    own = f"transform(array(filter(f, x -> shiftrightunsigned(x, {ORDER_SHIFT}) = i)), s -> transform(if(size(s) < {PICKED}, h, s), x -> x ^ shiftleft(cast(i ^ {BINS // BASES // 2} as bigint), {ORDER_SHIFT})))"
    chosen = f"get(transform({own}, t -> {pair}), 0)"
    entry = f"shiftleft(cast({BINS // BASES} * j + i as bigint), {BIN_SHIFT - 32}) | shiftrightunsigned({chosen}, {96 - BIN_SHIFT})"
    low = f"get(transform(array(filter(h, x -> (x & {(1 << ORDER_SHIFT) - 1}) < c)), f -> transform(sequence(0, {BINS // BASES - 1}), i -> {entry})), 0)"
    entries = f"flatten(transform(sequence(0, {BASES - 1}), j -> get(transform(array(transform(d, x -> xxhash64(x, j))), h -> {low}), 0)))"
    keep = [c for c in df.columns]
    steps = (
        *numbered_kmers(text, out),
        # in text order
        (ids, f"transform(sort_array(transform({numbered(kmers, starts)}, x -> shiftleft(x & {LOW}, {64 - PLACE}) | shiftrightunsigned(x, {PLACE}))), x -> x & {ID})"),
        # bound outside of the coordinates' lambda: the optimizer would put the array's expression into it
        (out, f"get(transform(array({ids}), d -> get(transform(array(cast(least({LIKELY * (BINS // BASES) * 2.0**ORDER_SHIFT} / size(d), {2.0**ORDER_SHIFT}) as bigint)), c -> {entries}), 0)), 0)"),
    )
    for name, how in steps:
        df = df.withColumn(name, F.expr(how))
    return df.select(*[F.col(f"`{c}`") for c in keep], out)


def likeness(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.lit(float(BINS))


def as_text(a: str) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def range_of(id_: Column, hash_: Column, cuts: list[int], least: int, most: int, ranges: int) -> Column:
    """A number that never falls from a row to the next in order of id (null last), then hash.

    Between two cuts ids are dealt evenly to pieces; a cut that comes several times among the quantiles is
    an id of many rows, whose own rows are dealt by their hash, as those without an id are."""
    bounds = sorted(set(cuts))
    hot = [b for b in bounds if cuts.count(b) > 1]
    pieces = max(1, -(-ranges // (len(cuts) + 1)))
    held = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    at = F.size(F.filter(held, lambda b: b <= id_))
    below = F.get(F.array(*[F.lit(float(b)) for b in [least, *bounds]]), at)
    above = F.get(F.array(*[F.lit(float(b)) for b in [*bounds, most]]), at)
    evenly = F.floor((id_.cast("double") - below) / F.greatest(above - below, F.lit(1.0)) * pieces).cast("long")
    by_hash = F.floor((hash_.cast("double") / 2.0**64 + 0.5) * F.lit(pieces * max([1, *map(cuts.count, hot)]))).cast("long")
    width = pieces * max([1, *map(cuts.count, hot)])
    clipped = lambda c, n: F.greatest(F.lit(0).cast("long"), F.least(c, F.lit(n - 1).cast("long")))
    own = F.when(id_.isin(*hot), at * 2 * width + clipped(by_hash, width)) if hot else F.when(F.lit(False), F.lit(0).cast("long"))
    return F.when(id_.isNull(), F.lit(2 * (len(bounds) + 1) * width).cast("long") + clipped(by_hash, width)).otherwise(F.coalesce(own, (at * 2 + 1) * width + clipped(evenly, pieces))).cast("long")


def with_next(df: DataFrame, rows_a_range: int = ROWS_A_RANGE, max_ranges: int = MAX_RANGES, most_cuts: int = CUTS) -> tuple[DataFrame, Window]:
    """``df`` (_id, _text) with its range, copies of first rows marked _copy, and the window that orders a range."""
    n, least, most = df.agg(F.count("*"), F.min("_id"), F.max("_id")).first()
    ranges = min(max_ranges, max(1, -(-n // rows_a_range)))
    parts = min(ranges, most_cuts + 1)
    cuts = df.agg(F.percentile_approx("_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    hashed = df.withColumn("_hash", F.xxhash64("_text"))
    own = hashed.withColumn("_range", range_of(F.col("_id"), F.col("_hash"), list(cuts or []), least or 0, (most or 0) + 1, ranges))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")
    first = materialise(own.groupBy("_range").agg(F.min(order).alias("_first")), "firsts")
    # the range before, in a circle: over the ranges, of which there are no more than about two for each of max_ranges
    around = Window.orderBy("_range")
    last = first.agg(F.max("_range")).first()[0]
    prior = first.select("_range", "_first", F.coalesce(F.lag("_range").over(around), F.lit(last).cast("long")).alias("_prior"))
    joined = own.join(F.broadcast(materialise(prior, "ranges")), "_range")
    stays = F.struct(F.col("_range"), F.lit(False).alias("_copy"))
    both = F.when(order.eqNullSafe(F.col("_first")), F.array(stays, F.struct(F.col("_prior").alias("_range"), F.lit(True).alias("_copy"))))
    dealt = joined.withColumn("_to", F.explode(F.coalesce(both, F.array(stays)))).select("_id", "_text", "_hash", "_to.*")
    return dealt, Window.partitionBy("_range").orderBy("_copy", F.col("_id").asc_nulls_last(), "_hash")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (its latter half replaced by as much of the next
    document's beginning) and their likeness."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    dealt, window = with_next(docs)
    rows = dealt.withColumn("_next", F.coalesce(F.lead("_text").over(window), F.lit(""))).withColumn("_n", F.char_length("_text"))
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("_n") - half), F.substring("_next", F.lit(1), half))
    rows = rows.withColumn("_edited", edited).drop("_next")
    rows = order_minhash(order_minhash(rows, "_text", "_own"), "_edited", "_other")
    rows = rows.select("_id", "_range", "_copy", "_hash", "_n", "_own", "_other", F.sha2("_edited", 256).alias("edited_sha256"))
    rows = rows.withColumn("_after", F.lead("_own").over(window)).filter("not _copy")
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_chars"), "edited_sha256", as_text("_own").alias("fingerprint"), as_text("_other").alias("edited_fingerprint"),
        likeness("_own", "_other").alias("near_edited"), likeness("_own", "_after").alias("near_next"),
    )

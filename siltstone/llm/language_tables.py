"""The language model as tables, for more grams than should go to every executor.

The same model as ``language.Model``: types, discounts, shares and back-off weights are aggregates over the
counted grams, and what comes to the driver is a few numbers for each language. Texts are scored through
their distinct words: each distinct gram of the words gets its probabilities order by order, from joins with
the shares of its own order and with the result of the order below; words sum their grams, texts their
words. A gram of one order continues at most as many of the next as there are characters, so no key of
these joins grows with the rows. Frequent words do: their join is a plain one, which adaptive execution
splits where it is skewed. Equal texts are scored once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, slices, split_words
from siltstone.llm.language import LEAST_ROOM, RESULT, as_matrix, decided, excess, hashes, in_order, is_held, rooms, symbols, top_grams

KEYS = "keys array<long>, contexts array<long>, length int"


def keyed(grams: np.ndarray) -> list[pa.Array]:
    """The KEYS of gram rows: hashes of their last 1, 2, ... symbols, the same without the last symbol, and how many they have."""
    order = grams.shape[1]
    keys = np.stack([hashes(grams[:, order - k :]) for k in range(1, order + 1)], axis=1)
    contexts = np.stack([hashes(grams[:, order - k : order - 1]) for k in range(1, order + 1)], axis=1)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), order).cast(pa.list_(pa.int64())) for x in (keys, contexts)]
    return [*lists, pa.array((grams > 0).sum(axis=1).astype(np.int32))]


def with_keys(counted: DataFrame, order: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *keyed(as_matrix(batch.column(3), order))], names=["lang", "n", "held", "keys", "contexts", "length"])

    return counted.select("lang", "n", "held", "gram").mapInArrow(run, f"lang int, n long, held long, {KEYS}")


def place(values: str, k: int) -> Column:
    return F.element_at(values, k)


class TableModel:
    def __init__(self, langs: list[str], counted: DataFrame, order: int, count: str = "n"):
        """``counted``: (lang: its number, keys, contexts, length) with the counts in ``count``; 0 is not seen."""
        self.langs, self.order = langs, order
        seen = counted.filter(F.col(count) > 0)
        self.floor = 1.0 / (seen.select(place("keys", 1)).distinct().count() + 1)
        shares, backoffs, types = [], [], None
        for k in range(order, 0, -1):
            # those that start a word have raw counts, the others the number of grams that they end
            starts = seen.filter(F.col("length") == k).select("lang", "keys", "contexts", F.col(count).cast("double").alias("value"))
            if types is not None:
                ended = types.groupBy("lang", place("keys", k).alias("_key")).agg(F.first("keys").alias("keys"), F.first("contexts").alias("contexts"), F.count("*").cast("double").alias("value"))
                starts = ended.drop("_key").unionByName(starts)
            types = materialise(starts, f"types{k}")
            ones = types.groupBy("lang").agg(F.count_if(F.col("value") == 1).alias("one"), F.count_if(F.col("value") == 2).alias("two")).collect()  # a row a language
            held = [0.5] * len(langs)
            for r in ones:
                held[r["lang"]] = min(0.95, max(0.1, r["one"] / (r["one"] + 2 * r["two"]))) if r["one"] else 0.5
            discount = F.get(F.array(*map(F.lit, held)), F.col("lang"))
            own = types.select("lang", place("keys", k).alias("key"), place("contexts", k).alias("context"), "value")
            of_context = materialise(own.groupBy("lang", "context").agg(F.sum("value").alias("total"), F.count("*").alias("types")), f"contexts{k}")
            shares.append(own.join(of_context, ["lang", "context"]).select("key", "lang", (F.greatest(F.col("value") - discount, F.lit(0.0)) / F.col("total")).cast("float").alias("v")))
            backoffs.append(of_context.select(F.col("context").alias("key"), "lang", (discount * F.col("types") / F.col("total")).cast("float").alias("v")))
        self.shares = self.by_key(shares, 0.0, "shares")
        self.backoffs = self.by_key(backoffs, 1.0, "backoffs")
        self.mean, self.deviation, self.room = np.zeros(len(langs)), np.ones(len(langs)), np.full(len(langs), LEAST_ROOM)

    def by_key(self, parts: list[DataFrame], default: float, name: str) -> DataFrame:
        """(key, v): the values of all languages as one array."""
        held = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "v"))).alias("m"))
        values = [F.coalesce(F.try_element_at("m", F.lit(i)).cast("double"), F.lit(default)) for i in range(len(self.langs))]
        return materialise(held.select("key", F.array(*values).alias("v")), name)

    def probabilities(self, tops: DataFrame) -> DataFrame:
        """(key, p) of the grams of KEYS and of all that they end in: the probability in each language."""
        found, below = [], None
        for k in range(1, self.order + 1):
            own = tops.filter(F.col("length") >= k).select(place("keys", k).alias("key"), place("contexts", k).alias("context"), (place("keys", k - 1) if k > 1 else F.lit(0).cast("long")).alias("below")).distinct()
            share = self.shares.select("key", F.col("v").alias("s"))
            backoff = self.backoffs.select(F.col("key").alias("context"), F.col("v").alias("b"))
            joined = own.join(share, "key", "left").join(backoff, "context", "left")
            joined = joined.join(below.select(F.col("key").alias("below"), "p"), "below") if k > 1 else joined.withColumn("p", F.array_repeat(F.lit(self.floor), len(self.langs)))
            values = [F.coalesce(F.get("s", F.lit(i)), F.lit(0.0)) + F.coalesce(F.get("b", F.lit(i)), F.lit(1.0)) * F.get("p", F.lit(i)) for i in range(len(self.langs))]
            below = materialise(joined.select("key", F.array(*values).alias("p")), f"order{k}")
            found.append(below)
        return reduce(DataFrame.unionByName, found)

    def cost(self, i: int) -> Column:
        return -F.log(F.greatest(F.get("p", F.lit(i)), F.lit(1e-12)))

    def measured(self, counted: DataFrame, count: str) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation per character of the counted grams of each language."""
        mean, deviation = np.zeros(len(self.langs)), np.ones(len(self.langs))
        own = counted.filter(F.col(count) > 0)
        cost = reduce(lambda c, i: c.when(F.col("lang") == i, self.cost(i)), range(1, len(self.langs)), F.when(F.col("lang") == 0, self.cost(0)))
        joined = own.withColumn("key", F.element_at("keys", F.col("length"))).join(self.probabilities(own), "key").select("lang", F.col(count).alias("n"), cost.alias("c"))
        joined = materialise(joined, "costs")
        for r in joined.groupBy("lang").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("mean")).collect():
            mean[r["lang"]] = r["mean"]
        apart = F.pow(F.col("c") - F.get(F.array(*map(F.lit, mean.tolist())), F.col("lang")), 2)
        for r in joined.groupBy("lang").agg(F.sqrt(F.sum(apart * F.col("n")) / F.sum("n")).alias("d")).collect():
            deviation[r["lang"]] = r["d"]
        return mean, deviation

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(h1, h2, n, e) of the texts (h1, h2, _text) with words: their characters and cross-entropies."""

        order = self.order

        def words_of(batches):
            for batch in batches:
                for a, b in slices(batch.column(2)):
                    words, codes, starts = split_words(batch.column(2).slice(a, b), letters=True)
                    if len(words):
                        row = np.repeat(np.arange(b), np.diff(starts))
                        key, n = np.unique(row * len(words) + codes, return_counts=True)
                        at = pa.array(key // len(words) + a)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words.take(pa.array(key % len(words))), pa.array(n)], names=["h1", "h2", "word", "n"])

        def places_of(batches):
            for batch in batches:
                words = batch.column(0)
                out, where, starts = symbols(words)
                at, grams, keys = top_grams(out, where, order)
                word = words.take(pa.array(np.searchsorted(starts, at, "right") - 1))
                yield pa.RecordBatch.from_arrays([word, pa.array(keys.view(np.int64)), *keyed(grams)], names=["word", "key", "keys", "contexts", "length"])

        held = materialise(texts.dropDuplicates(["h1", "h2"]).mapInArrow(words_of, "h1 long, h2 long, word string, n long"), "words")
        places = materialise(held.select("word").distinct().mapInArrow(places_of, f"word string, key long, {KEYS}"), "places")
        costs = places.select("word", "key").join(self.probabilities(places), "key")
        langs = range(len(self.langs))
        of_word = materialise(costs.groupBy("word").agg(F.count("*").alias("chars"), *[F.sum(self.cost(i)).alias(f"c{i}") for i in langs]), "word_costs")
        joined = held.join(of_word, "word").groupBy("h1", "h2").agg(F.sum(F.col("n") * F.col("chars")).alias("n"), *[F.sum(F.col("n") * F.col(f"c{i}")).alias(f"c{i}") for i in langs])
        return joined.select("h1", "h2", "n", F.array(*[F.col(f"c{i}") / F.col("n") for i in langs]).alias("e"))

    def numbers(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropies, characters) of a batch whose last columns are n and e."""
        n = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(float)
        return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), len(self.langs)).copy(), n

    def predicted(self, df: DataFrame, text_col: str) -> DataFrame:
        """(_row, _found): the rows of ``df`` and their result columns."""
        keys = text_keys(f"`{text_col}`")
        own = Frozen(self)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *decided(own, *own.numbers(batch))], names=["h1", "h2", *RESULT])

        texts = df.select(*keys, F.col(f"`{text_col}`").alias("_text")).filter("_text is not null")
        found = materialise(self.entropies(texts).mapInArrow(run, "h1 long, h2 long, " + ", ".join(f"{k} {v}" for k, v in RESULT.items())), "found")
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *keys)
        none = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)}
        known = F.col("lang_pred").isNotNull()
        values = [F.when(known, F.col(c)).otherwise(none[c]).alias(c) for c in RESULT]
        return rows.join(found, ["h1", "h2"], "left").select("_row", F.struct(*values).alias("_found"))


class Frozen:
    """What the executors need of a model to decide: no tables."""

    def __init__(self, model: TableModel):
        self.langs, self.mean, self.deviation, self.room = model.langs, model.mean, model.deviation, model.room

    numbers = TableModel.numbers


def text_keys(text: str) -> list[Column]:
    return [F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def train_tables(rows: DataFrame, counted: DataFrame, order: int) -> TableModel:
    """``rows`` (_lang, _text); ``counted`` as from ``count_grams``. Calibrated as the model in arrays is."""
    langs = in_order(r[0] for r in counted.select("lang").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    grams = materialise(with_keys(counted.withColumn("lang", number), order), "keyed").withColumn("seen", F.col("n") - F.col("held"))
    model = TableModel(langs, grams, order)
    has_seen, has_held = ({r[0] for r in grams.filter(F.col(c) > 0).select("lang").distinct().collect()} for c in ("seen", "held"))
    inside = model.measured(grams, "n")
    if not has_seen or not has_held:
        model.mean, model.deviation = inside
        return model
    part = TableModel(langs, grams, order, "seen")
    within = part.measured(grams, "seen")
    outside = part.measured(grams, "held")
    for i in range(len(langs)):
        own = outside if i in has_held and i in has_seen else inside
        model.mean[i], model.deviation[i] = own[0][i], own[1][i]
        own = outside if i in has_held else within
        part.mean[i], part.deviation[i] = own[0][i], own[1][i]
    known, frozen = sorted(has_seen), Frozen(part)
    texts = rows.filter(is_held()).select(*text_keys("_text"), "_text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                entropy, n = frozen.numbers(batch)
                entropy[:, [i for i in range(entropy.shape[1]) if i not in known]] = np.inf
                best, over = excess(frozen, entropy, n)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(over)], names=["h1", "h2", "lang", "over"])

    found = materialise(part.entropies(texts).mapInArrow(run, "h1 long, h2 long, lang int, over double"), "excess")
    model.room = rooms(texts.select("h1", "h2").join(found, ["h1", "h2"]), langs)
    return model

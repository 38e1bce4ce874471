"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of order ``ORDER`` over its words: runs of letters in lower case with a
start and an end mark. Counts come from all training rows. Grams that start a word keep raw counts, as do
those of the highest order; all others count the distinct characters before them. Each order keeps, for
each language, two sorted arrays of 64-bit hashes: grams with their discounted share, and contexts with
the weight that they leave to the next lower order. A text gets the language of the lowest cross-entropy
per character.

Rejection is calibrated on training rows that a second model has not seen: one in HELD_OUT, by a hash of
the text. Mean and deviation per character of each language come from these rows, and so does the room
beyond chance that whole texts of the language need: all but REJECT_SHARE of them are within it. A text
is rejected where its cross-entropy lies above mean, chance and room.

All counted grams are in the model. Up to ``broadcast_grams`` of them, its arrays go to all executors; beyond,
the model stays in tables and texts are scored by joins (``language_tables``), with equal results.

A null text, or one without letters, is ``und`` with score 0 and is rejected; so is every text where no
row could be learned from, as on an empty table. Marks without a letter are no word. A very long text is
scored whole. Ties go to the first language by code point. Repeated rows get equal results. Result columns
of ``predict`` replace input columns of the same name; other columns pass through. ``accepted`` adds none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batches_with, materialise, segment_sums, slices, split_words, text_place

ORDER = 5
START, END = 1, 2
#: Deviations of the mean of n characters that chance may take a text above its language.
REJECT_MEAN = 6.0
#: The share of held-out texts that rejection may take, and the least room beyond chance, in deviations of a
#: single character, where fewer than 1 / REJECT_SHARE texts of a language were held out.
REJECT_SHARE, LEAST_ROOM, HELD_OUT = 1e-4, 0.5, 5
#: Grams of all languages up to which the model goes to all executors: about 25 bytes each.
BROADCAST_GRAMS = 8_000_000
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(raw: np.ndarray, tag: int) -> np.ndarray:
    x = raw + MULTIPLIERS[63] * np.uint64(tag)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all words with marks, place in its word of each, first symbol of each word and the end)."""
    lengths = np.asarray(pa.compute.utf8_length(words)).astype(np.int64)
    text = "".join(words.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])
    out = np.zeros(starts[-1], np.uint32)
    out[starts[:-1]] = START
    out[starts[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[inner] = codes
    return out, np.arange(len(out)) - np.repeat(starts[:-1], lengths + 2), starts


def top_grams(out: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places that are predicted, gram of each: its last ``order`` symbols in the word, 0 where the word is shorter; its hash)."""
    at = np.flatnonzero(place > 0)
    grams = np.zeros((len(at), order), np.uint32)
    for k in range(order):
        fits = place[at] >= k
        grams[fits, order - 1 - k] = out[at[fits] - k]
    return at, grams, hashes(grams)


def hashes(grams: np.ndarray) -> np.ndarray:
    """Hash of each row; zeros in front do not count, so a gram has one hash at any width."""
    raw = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        raw += grams[:, grams.shape[1] - 1 - k].astype(np.uint64) * MULTIPLIERS[k]
    return mixed(raw, 1)


@dataclass
class Order:
    """One language's arrays for one order."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def in_order(langs) -> list[str]:
    return sorted(langs, key=lambda s: s.encode("utf-32-be"))


class Model:
    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], counts: dict[str, np.ndarray], order: int = ORDER):
        self.order, self.langs = order, in_order(langs)
        alphabet = len(np.unique(np.concatenate([g[:, -1] for g in grams.values()]))) if langs else 1
        self.floor = 1.0 / (alphabet + 1)
        self.orders = {lang: self._fit(grams[lang], counts[lang]) for lang in self.langs}
        self.mean, self.deviation, self.room = np.zeros(len(self.langs)), np.ones(len(self.langs)), np.full(len(self.langs), LEAST_ROOM)
        self.measure(grams, counts)

    def measure(self, grams: dict[str, np.ndarray], counts: dict[str, np.ndarray], by: Model | None = None) -> None:
        """Mean and deviation per character of the counted grams, as this model, or ``by``, sees them."""
        for i, lang in enumerate(self.langs):
            n = counts.get(lang, np.zeros(0))
            if n.sum() > 0 and (by is None or lang in by.langs):
                cost = -(by or self).log_probs(grams[lang], [lang])[:, 0]
                self.mean[i] = (cost * n).sum() / n.sum()
                self.deviation[i] = np.sqrt((np.square(cost - self.mean[i]) * n).sum() / n.sum())

    def _fit(self, grams: np.ndarray, counts: np.ndarray) -> list[Order]:
        n, out = self.order, []
        length = (grams > 0).sum(axis=1)
        rows, value = grams[length == n], counts[length == n].astype(float)
        while True:
            out.append(self._order(rows, value))
            if n == 1:
                return out[::-1]
            n -= 1
            # grams of n: those that start a word have raw counts, the others the number of grams that they end
            keys, first, number = np.unique(hashes(rows[:, 1:]), return_index=True, return_counts=True)
            starts, raw = grams[length == n][:, self.order - n :], counts[length == n].astype(float)
            rows = np.concatenate([rows[first][:, 1:], starts])
            value = np.concatenate([number.astype(float), raw])

    @staticmethod
    def _order(rows: np.ndarray, value: np.ndarray) -> Order:
        one, two = (value == 1).sum(), (value == 2).sum()
        discount = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
        keys, context = hashes(rows), hashes(rows[:, :-1]) if rows.shape[1] > 1 else np.zeros(len(rows), np.uint64)
        names, inverse, types = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, value, len(names))
        share = np.maximum(value - discount, 0) / total[inverse] if len(rows) else value
        by = np.argsort(keys)
        return Order(keys[by], share[by].astype(np.float32), names, (discount * types / np.maximum(total, 1e-9)).astype(np.float32))

    def log_probs(self, grams: np.ndarray, langs: list[str] | None = None) -> np.ndarray:
        """Natural log of each gram's last symbol given those before it, for each language."""
        langs = self.langs if langs is None else langs
        length, prob = (grams > 0).sum(axis=1), np.full((len(grams), len(langs)), self.floor)
        for n in range(1, self.order + 1):
            use = np.flatnonzero(length >= n)
            own = grams[use, self.order - n :]
            keys, context = hashes(own), hashes(own[:, :-1]) if n > 1 else np.zeros(len(use), np.uint64)
            for i, lang in enumerate(langs):
                o = self.orders[lang][n - 1]
                prob[use, i] = looked_up(o.grams, o.share, keys, 0.0) + looked_up(o.contexts, o.backoff, context, 1.0) * prob[use, i]
        return np.log(np.maximum(prob, 1e-12))

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character for each text and language, number of characters)."""
        words, codes, rows = split_words(texts, letters=True)
        if not len(words):
            return np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        out, place, starts = symbols(words)
        at, grams, keys = top_grams(out, place, self.order)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        costs = -self.log_probs(grams[first])
        ends = starts - np.arange(len(starts))  # the start marks are not predicted
        lengths = np.diff(ends)
        n = segment_sums(lengths[codes], rows)
        total = np.stack([segment_sums(segment_sums(costs[inverse, i], ends)[codes], rows) for i in range(len(self.langs))], axis=1)
        return total / np.maximum(n, 1)[:, None], n


RESULT = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}


def decided(model, entropy: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """The result columns of texts by their cross-entropies and numbers of characters (0: no words)."""
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(best)), best]
    odds = np.exp(-np.minimum(50, (entropy - low[:, None]) * np.sqrt(n)[:, None])).sum(axis=1)
    limit = model.mean[best] + model.deviation[best] * (REJECT_MEAN / np.sqrt(np.maximum(n, 1)) + model.room[best])
    none = n == 0
    langs = np.array(model.langs, object)[best]
    langs[none] = "und"
    return [pa.array(langs, pa.string()), pa.array(np.where(none, 0.0, 1 / odds)), pa.array(low, mask=none), pa.array(none | (low > limit))]


def excess(model, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, deviations beyond chance that each text lies above it) of the texts with words."""
    entropy, n = entropy[n > 0], n[n > 0]
    best = entropy.argmin(axis=1)
    over = (entropy[np.arange(len(best)), best] - model.mean[best]) / np.maximum(model.deviation[best], 1e-9)
    return best, np.maximum(over - REJECT_MEAN / np.sqrt(n), 0)


def rooms(found: DataFrame, langs: list[str]) -> np.ndarray:
    """The room of each language by the ``excess`` (lang: its number, over) of held-out texts: a row a language comes to the driver."""
    out = np.full(len(langs), LEAST_ROOM)
    for r in found.groupBy("lang").agg(F.percentile_approx("over", 1 - REJECT_SHARE, 100_000).alias("over"), F.count("*").alias("n")).collect():
        out[r["lang"]] = r["over"] if r["n"] >= 1 / REJECT_SHARE else max(LEAST_ROOM, r["over"])
    return out


def classify(model: Model | None, texts: pa.Array) -> list[pa.Array]:
    if model is None or not model.langs:
        n = len(texts)
        return [pa.array(["und"] * n, pa.string()), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array([True] * n)]
    pieces = [model.entropies(texts.slice(a, b)) for a, b in slices(texts)] or [model.entropies(texts)]
    return decided(model, np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))


class Tally:
    """Counts of top grams by language, merged whenever they have doubled."""

    def __init__(self, order: int):
        self.order, self.held, self.size = order, [], 1 << 18

    def add(self, lang: str, grams: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.append((lang, grams, keys, n))
        if sum(len(x[2]) for x in self.held) > 2 * self.size:
            self.held = list(self.merged())
            self.size = max(self.size, sum(len(x[2]) for x in self.held))

    def merged(self):
        for lang in sorted({x[0] for x in self.held}):
            own = [x for x in self.held if x[0] == lang]
            keys = np.concatenate([x[2] for x in own])
            keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            yield lang, np.concatenate([x[1] for x in own])[first], keys, np.bincount(inverse, np.concatenate([x[3] for x in own]))


def is_held(text: str = "_text") -> Column:
    """Whether a training row is held out of the model that rejection is calibrated by."""
    return F.pmod(F.xxhash64(text, F.lit(3)), F.lit(HELD_OUT)) == 0


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n, held) of all rows of (_lang, _text): one row for each language and gram, with the
    count over all rows and over those held out, counted in each partition before they are shuffled."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])

    def run(batches):
        tally = Tally(order)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, codes, starts = split_words(batch.column(1).slice(a, b), letters=True)
                if not len(words):
                    continue
                enc = batch.column(0).slice(a, b).dictionary_encode()
                of_word = np.repeat(np.asarray(enc.indices), np.diff(starts))
                out, place, bounds = symbols(words)
                at, grams, keys = top_grams(out, place, order)
                keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                grams = grams[first]
                word_of = np.repeat(np.arange(len(words)), np.diff(bounds))[at]
                for i, lang in enumerate(enc.dictionary.to_pylist()):
                    seen = np.bincount(codes[of_word == i], minlength=len(words))
                    n = np.bincount(inverse, seen[word_of])
                    tally.add(lang, grams[n > 0], keys[n > 0], n[n > 0])
        for lang, grams, _, n in tally.merged():
            for k in range(0, len(n), 50_000):
                part = np.ascontiguousarray(grams[k : k + 50_000])
                offsets = np.arange(len(part) + 1, dtype=np.int32) * 4 * order
                gram = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(part)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), gram, pa.array(n[k : k + 50_000].astype(np.int64))], schema=schema)

    marked = rows.select(F.concat(is_held().cast("int").cast("string"), F.col("_lang")), "_text")
    found = marked.mapInArrow(run, "lang string, gram binary, n long").withColumn("_held", F.when(F.col("lang").startswith("1"), F.col("n")).otherwise(0))
    lang = F.expr("substring(lang, 2)").alias("lang")
    return found.groupBy(lang, "gram").agg(F.sum("n").alias("n"), F.sum("_held").alias("held"))


def as_matrix(grams: pa.ChunkedArray | pa.Array, order: int) -> np.ndarray:
    chunks = grams.chunks if isinstance(grams, pa.ChunkedArray) else [grams]
    return np.concatenate([np.frombuffer(c.buffers()[2], np.uint32, len(c) * order, 4 * order * c.offset) for c in chunks if len(c)]).reshape(-1, order)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS):
    """The model of all rows with a language and a text, in arrays or tables; None where there are none."""
    rows = df.select(F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text")).filter("_lang is not null and _text is not null")
    counted = materialise(count_grams(rows, order), "grams")
    size = counted.count()
    if not size:
        return None
    if size > broadcast_grams:
        from siltstone.llm.language_tables import train_tables

        return train_tables(rows, counted, order)
    found = counted.toArrow()
    grams, counts, held = {}, {}, {}
    for lang in found["lang"].unique().to_pylist():
        own = found.filter(pa.compute.equal(found["lang"], lang))
        matrix = as_matrix(own["gram"], order)
        by = np.argsort(hashes(matrix), kind="stable")
        grams[lang], counts[lang], held[lang] = matrix[by], own["n"].to_numpy()[by], own["held"].to_numpy()[by]
    model = Model(list(grams), grams, counts, order)
    seen = {lang: counts[lang] > held[lang] for lang in grams if (counts[lang] > held[lang]).any()}
    if seen and any(h.any() for h in held.values()):
        part = Model(list(seen), {k: grams[k][v] for k, v in seen.items()}, {k: (counts[k] - held[k])[v] for k, v in seen.items()}, order)
        out = {lang: held[lang] > 0 for lang in held}
        unseen = {k: grams[k][v] for k, v in out.items()}, {k: held[k][v] for k, v in out.items()}
        model.measure(*unseen, by=part)
        part.measure(*unseen)
        room = dict(zip(part.langs, held_out_rooms(rows, part), strict=True))
        model.room = np.array([room.get(lang, LEAST_ROOM) for lang in model.langs])
    return model


def held_out_rooms(rows: DataFrame, part: Model) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                best, over = excess(shared.value, *shared.value.entropies(batch.column(0).slice(a, b)))
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(over)], names=["lang", "over"])

    found = rooms(rows.filter(is_held()).select("_text").mapInArrow(run, "lang int, over double"), part.langs)
    shared.destroy()
    return found


def predict(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy and rejected."""
    lowered = {c.lower() for c in RESULT}
    kept = [f for f in df.schema.fields if f.name.lower() not in lowered]
    place = text_place(df, text_col)
    if model is not None and not isinstance(model, Model):
        return model.predicted(df, text_col).select(*[F.col(f"_row.`{f.name}`") for f in kept], *[F.col(f"_found.{c}").alias(c) for c in RESULT])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{k} {v}" for k, v in RESULT.items()])

    def run(batches):
        for batch in batches:
            yield batches_with(batch, dict(zip(RESULT, classify(shared.value, batch.column(place)), strict=True)))

    return df.mapInArrow(run, schema)


def accepted(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not rejected, with its own columns only, whatever their names."""
    place = text_place(df, text_col)
    if model is not None and not isinstance(model, Model):
        return model.predicted(df, text_col).filter("not _found.rejected").select("_row.*")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.compute.invert(classify(shared.value, batch.column(place))[3]))

    return df.mapInArrow(run, df.schema)


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(divisor).cast("long"))

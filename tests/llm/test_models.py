import math
import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import language, toxicity
from siltstone.llm.common import slices, split_words
from tests.llm.cases import awkward, empty

SYLLABLES = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["kro", "gen", "sch", "tz"], "cc": ["ion", "eau", "que", "ai"]}


def sentence(lang, draw, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=300, seed=1):
    draw = random.Random(seed)
    rows = [(i, sentence(lang := draw.choice(sorted(SYLLABLES)), draw, draw.randrange(1, 60)), lang) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_split_words():
    words, codes, starts = split_words(pa.array([" A b\tb ", None, "", "É b\x0bx"]))
    assert [words[int(c)].as_py() for c in codes] == ["a", "b", "b", "É", "b", "x"] and starts.tolist() == [0, 3, 3, 3, 6]
    words, codes, starts = split_words(pa.array(["Don't stop2go", "ÉÀ"]), letters=True)
    assert [words[int(c)].as_py() for c in codes] == ["don", "t", "stop", "go", "éà"] and starts.tolist() == [0, 4, 5]


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (5, 0, 30, 1, 1, 1)] + [None])
    found = list(slices(texts, 10))
    assert [a for a, _ in found] == np.cumsum([0, *[b for _, b in found]])[:-1].tolist() and sum(b for _, b in found) == 7
    assert list(slices(pa.array([], pa.string()))) == []


def brute_probability(counts, order, gram, floor):
    """Interpolated Kneser-Ney of a gram (a string; its first character may be the start mark), by its definition."""

    def table(n):
        if n == order:
            return {g: float(c) for g, c in counts.items() if len(g) == n}
        out = {g: float(c) for g, c in counts.items() if len(g) == n}
        for g in table(n + 1):
            if g[1:] not in out or not g[1:].startswith(chr(language.START)):
                out[g[1:]] = out.get(g[1:], 0.0) + 1.0
        return out

    p = floor
    for n in range(1, len(gram) + 1):
        own, g = table(n), gram[-n:]
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        same = {k: v for k, v in own.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if total:
            p = max(own.get(g, 0.0) - d, 0) / total + d * len(same) / total * p
    return p


def test_kneser_ney_against_its_definition(spark):
    df = corpus(spark, 40)
    model = language.train(df, order=3)
    counts = {}
    for r in df.filter("lang = 'aa'").collect():
        for w in r.text.split():
            marked = chr(language.START) + w + chr(language.END)
            for i in range(1, len(marked)):
                g = marked[max(0, i - 2) : i + 1]
                counts[g] = counts.get(g, 0) + 1
    grams = [*list(counts)[:40], chr(1) + "zz", "xyz", "baz"]
    arrays = np.array([[0] * (3 - len(g)) + [ord(c) for c in g] for g in grams], np.uint32)
    got = np.exp(model.log_probs(arrays, ["aa"])[:, 0])
    want = [brute_probability(counts, 3, g, model.floor) for g in grams]
    assert got == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_at_most_one(spark):
    model = language.train(corpus(spark, 60), order=3)
    symbols = sorted({ord(c) for c in "abcdefghijklmnopqrstuvwxyz"} | {language.END})
    for context in ((1, 98), (98, 97), (97, 108)):
        total = sum(math.exp(model.log_probs(np.array([[*context, s]], np.uint32), ["aa"])[0, 0]) for s in symbols)
        assert 0.5 < total < 1.05


def test_counts_do_not_depend_on_partitions(spark):
    df = corpus(spark).selectExpr("lang as _lang", "text as _text")
    a, b = ({(r.lang, bytes(r.gram)): r.n for r in language.count_grams(df.repartition(k)).collect()} for k in (1, 7))
    assert a == b and len(a) > 20


def test_held_out_accuracy_and_rejection(spark):
    df = corpus(spark, 600)
    rest = language.remainder(df["doc_id"], 5)
    model = language.train(df.filter(rest != 0))
    got = language.predict(df.filter(rest == 0), model).toPandas()
    assert len(got) > 60 and (got.lang == got.lang_pred).mean() > 0.99 and got.rejected.mean() < 0.02 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, "xqzvw jjkwx " * 30), (2, "Ελληνικά κείμενα είναι αυτά " * 10)], "doc_id long, text string")
    assert language.predict(odd, model).select("rejected").toPandas().rejected.all()


def noisy_corpus(spark):
    draw = random.Random(12)
    rows = [(i, " ".join(sentence(draw.choice(["aa", "aa", lang]), draw, 3) for _ in range(draw.randrange(1, 12))), lang) for i in range(400) for lang in [draw.choice(sorted(SYLLABLES))]]
    rows += [(900, "ba lo 12 \u0301 mi", "aa"), (901, None, "aa"), (902, "kro", None), (903, "solo", "dd")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_tables_give_what_arrays_give(spark):
    df = noisy_corpus(spark)
    arrays, tables = language.train(df), language.train(df, broadcast_grams=10)
    assert arrays.langs == tables.langs == ["aa", "bb", "cc", "dd"]
    for of in ("mean", "deviation", "room"):
        assert getattr(tables, of) == pytest.approx(getattr(arrays, of), rel=1e-5)
    texts = awkward(spark).select("doc_id", "text", "score").union(df.selectExpr("doc_id", "concat(text, ' qu')", "-1.0")).union(df.limit(5).selectExpr("doc_id", "text", "-1.0"))
    a, b = ([tuple(r) for r in language.predict(texts, m).sort("doc_id", "text").collect()] for m in (arrays, tables))
    assert len(a) == len(b) == texts.count() and language.predict(texts, arrays).columns == language.predict(texts, tables).columns
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-5) and (x[4] == y[4] or x[4] == pytest.approx(y[4], rel=1e-5)) and x[5] == y[5]
    kept = [language.accepted(texts, m) for m in (arrays, tables)]
    assert kept[0].columns == kept[1].columns == texts.columns and kept[0].count() == kept[1].count() == sum(not x[5] for x in a)
    assert language.accepted(empty(spark), tables).count() == 0 and language.accepted(awkward(spark), None).count() == 0


def test_rejection_is_calibrated_on_rows_held_out(spark):
    df = noisy_corpus(spark)
    model = language.train(df)
    held = df.selectExpr("lang as _lang", "text as _text").filter("_text is not null and _lang = 'aa'").filter(language.is_held())
    assert held.count() > 5
    # as held out: mean and deviation of characters that the other rows' model has not seen
    rest = df.join(held, df["text"] == held["_text"], "left_anti").filter("lang = 'aa' and text is not null")
    alone = language.train(rest)
    grams = {r.gram: r.n for r in language.count_grams(held).collect()}
    matrix = language.as_matrix(pa.array(list(grams), pa.binary()), language.ORDER)
    cost, n = -alone.log_probs(matrix, ["aa"])[:, 0], np.array(list(grams.values()))
    assert model.mean[0] == pytest.approx((cost * n).sum() / n.sum(), rel=0.02)  # the floor differs: it counts all languages' characters
    assert (model.room >= language.LEAST_ROOM).all()


@pytest.mark.parametrize("text", ["\U0001f44d\ufe0f", "\ufe0f", "12\u0301 \u0301\u0302", "\u0301", "3\ufe0f\u20e3"])
def test_marks_without_a_letter_are_no_language(spark, text):
    model = language.train(corpus(spark, 60))
    got = language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()[0]
    assert got.lang_pred == "und" and got.score == 0 and got.rejected


def test_all_grams_are_kept(spark):
    draw = random.Random(4)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(1000)) for _ in range(110)]
    model = language.train(spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string"))
    grams = {w[i : i + 5] for t in texts for m in t.split() for w in [chr(language.START) + m + chr(language.END)] for i in range(len(w) - 4)}
    assert len(grams) > 1_000_000 and len(model.orders["aa"][-1].grams) == len(grams)


def test_language_awkward(spark):
    got = language.predict(awkward(spark), language.train(awkward(spark))).toPandas()
    assert len(got) == 13 and (got.lang_pred[got.doc_id.isin([2, 3, 4, 5])] == "und").all() and (got.score[got.doc_id.isin([2, 3, 4, 5])] == 0).all()
    assert set(got[got.doc_id.isin([1, 6, 8])].lang_pred) <= {"en", "fr"} and got.columns.tolist().count("score") == 1
    assert got[got.doc_id == 8].lang_pred.nunique() == 1
    assert language.train(empty(spark)) is None
    none = language.predict(awkward(spark), None).toPandas()
    assert (none.lang_pred == "und").all() and none.rejected.all()
    assert language.predict(empty(spark), None).count() == 0


# toxicity

BAD = ["blorg", "fnarg", "zwick", "quatt"]


def toxic_corpus(spark, n=1500, seed=3):
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text, bad = sentence(draw.choice(sorted(SYLLABLES)), draw, draw.randrange(5, 80)).split(), draw.random() < 0.15
        if bad:
            for _ in range(draw.randrange(2, 6)):
                text.insert(draw.randrange(len(text)), draw.choice(BAD))
        rows.append((i, " ".join(text)))
        if draw.random() < 0.5:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), {r[0]: any(b in r[1] for b in BAD) for r in rows}


def test_held_out_toxicity(spark):
    docs, labels, truth = toxic_corpus(spark)
    rest = lambda df: language.remainder(df["doc_id"], 4)
    model = toxicity.train(docs.filter(rest(docs) != 2), labels.filter(rest(labels) != 2))
    got = toxicity.score(docs.filter(rest(docs) == 2), model).toPandas()
    real = got.doc_id.map(truth)
    assert ((got.predicted == 1) == real).mean() > 0.98 and got.score.between(0, 1).all()
    assert got.score[real].min() > got.score[~real].median()


def test_unlabelled_toxic_texts_do_not_teach_that_they_are_clean(spark):
    docs, labels, truth = toxic_corpus(spark, 800)
    few = labels.filter("toxic = 1").limit(40).union(labels.filter("toxic = 0"))  # most toxic texts are not confirmed
    model = toxicity.train(docs, few, prior=0.15)
    got = toxicity.score(docs, model).toPandas()
    real = got.doc_id.map(truth)
    assert got.predicted[real].mean() > 0.85 and got.predicted[~real].mean() < 0.05


def test_the_risk_is_kept_from_going_negative():
    draw = np.random.default_rng(1)
    positive = [np.unique(np.array([5, 6, *draw.integers(100, 2000, 9)], np.uint32)) for _ in range(30)]
    unlabelled = [np.unique(draw.integers(100, 2000, 9).astype(np.uint32)) for _ in range(200)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    assert {5, 6} <= set(model.features.tolist()) and (model.weights[:2] > 0).all() and np.isfinite(model.bias) and model.scores(pa.array(["", None])).max() < 0.3


def test_calibration_is_stable():
    z = np.array([-8.0] * 200 + [1.0, 2.0, 3.0] * 20)
    slope, shift = toxicity.calibrated(z, (z > 0).astype(float))
    assert 0 < slope < 20 and 1 / (1 + math.exp(-(slope * -8 + shift))) < 0.05 and 1 / (1 + math.exp(-(slope + shift))) > 0.6
    noisy = np.array([0, 1] * 130, float)
    slope, shift = toxicity.calibrated(z, noisy)
    assert np.isfinite([slope, shift]).all()


def test_copies_teach_once():
    draw = np.random.default_rng(2)
    fresh = lambda n, *more: np.unique(np.array([*more, *draw.integers(1000, 90_000, n)], np.uint32))
    copied = fresh(60, 7)
    near = [np.unique(np.append(copied[1:], np.uint32(k))) for k in range(200, 240)]
    positive = [fresh(60, 7) for _ in range(60)] + [copied] * 40 + near
    assert len(toxicity.without_copies(positive)) < 75
    model = toxicity.fit(positive, [fresh(60) for _ in range(400)], 0.1)
    assert model.features.tolist() == [7]


def test_beginnings_of_words_are_features(spark):
    draw, rows, labels = random.Random(8), [], []
    for i in range(800):
        text, bad = sentence("aa", draw, 30).split(), draw.random() < 0.2
        if bad:
            text += [f"kwoff{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(3)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.filter("doc_id < 400"), marks.filter("doc_id < 400"))
    got = toxicity.score(docs.filter("doc_id >= 400"), model).join(marks, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.99


def test_fast_scores_against_plain_ones(spark):
    texts = ["kwoffing the kwoffs", "", None, "nothing", "the kwoff kwoff kwoffing", "the " + "x " * 300 + "the", "the the x"]
    base = toxicity.word_features(pa.array(["kwoffing", "the"]))
    held = sorted({int(base[0, 2]): 1.5, int(base[1, 0]): 2.0, int(toxicity.dense(base)[1, 0]): -0.7, int(toxicity.dense(base)[0, 1]): 0.4}.items())
    model = toxicity.Model(np.array([f for f, _ in held], np.uint32), np.array([w for _, w in held]), -1.0)
    cols, starts = toxicity.row_features(pa.array(texts))
    sets = [set(cols[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    want = [1 / (1 + math.exp(1.0 - sum(w for f, w in held if f in h))) for h in sets]
    assert model.scores(pa.array(texts)) == pytest.approx(want)
    assert int(toxicity.dense(base)[1, 0]) in sets[6] and int(toxicity.dense(base)[1, 0]) not in sets[5] and int(toxicity.dense(base)[1, 0]) not in sets[0]


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward(spark), labels)
    got = toxicity.score(awkward(spark), model).toPandas()
    assert len(got) == 13 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1} and got.columns.tolist().count("score") == 1
    for no in (labels.filter("toxic = 0"), labels.limit(0)):
        assert toxicity.train(awkward(spark), no) is None
    assert toxicity.score(awkward(spark), None).toPandas().score.max() == 0
    assert toxicity.train(empty(spark), labels) is None and toxicity.score(empty(spark), model).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    df, labels, _ = toxic_corpus(spark, 400)
    model = toxicity.train(df, labels)
    odd = df.selectExpr("doc_id", "text", "7.0 as score", "'x' as predicted")
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns and kept.filter("score <> 7.0 or predicted <> 'x'").count() == 0
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in toxicity.score(df, model).filter("predicted = 0").collect())
    assert toxicity.clean(awkward(spark), None).count() == 13 and toxicity.clean(empty(spark), model).count() == 0


def test_an_id_that_many_rows_share_teaches_once(spark):
    df, labels, _ = toxic_corpus(spark, 400)
    many = df.union(spark.createDataFrame(df.filter("doc_id = 3").collect() * 500, df.schema))
    a, b = toxicity.train(df, labels), toxicity.train(many, labels)
    assert (a.features == b.features).all() and a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import vectors as V


def values(spark, make, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_path_parts(spark):
    paths = ("a/b/report.v2.PDF", "top.txt", "a/.hidden", "no_suffix", "a/b/")
    assert values(spark, X.file_name, *paths) == ["report.v2.PDF", "top.txt", ".hidden", "no_suffix", ""]
    assert values(spark, X.suffix, *paths) == [".pdf", ".txt", "", "", ""]
    assert values(spark, X.stem, *paths) == ["report.v2", "top", ".hidden", "no_suffix", ""]
    assert values(spark, X.folder, *paths) == ["a/b", "", "a", "", "a/b"]


def test_safe_paths(spark):
    good, bad = ("a.txt", "a/b c/d.txt", "..a/b"), ("", "../outside.txt", "/abs", "a/../b", "C:/x", "a//b", "a\\b", "./a")
    assert values(spark, X.is_safe, *good) == [True] * 3 and values(spark, X.is_safe, *bad, None) == [False] * 9


def test_names_and_labels(spark):
    assert values(spark, X.name_key, "Отчёт годовой 2025.pdf", "b/Годовой отчёт 2025.docx") == ["2025 годовой отчет"] * 2
    assert values(spark, X.normalize_udf, "ﬁle № Ёж", None) == ["file no еж", None]
    assert values(spark, lambda c: X.word_features(c), "a copy report 12 x1") == [["report", "12", "x1"]]
    assert sorted(values(spark, X.gram_features, "abcd 1234 ab")[0]) == ["abc", "abcd", "bcd"]
    assert sorted(values(spark, X.label_terms, "Акт приёмки №12 v2 final скан-копия")[0]) == ["акт", "акт_приемки", "приемки", "скан_копия"]


def test_natural_order(spark):
    names = ["#10", "#2", "#30", "#1", "#002b"]
    keys = values(spark, X.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names, strict=True))] == ["#1", "#2", "#002b", "#10", "#30"]


def test_values_and_persons_disappear(spark):
    same = ["Отчёт 2024-05-01", "Отчёт №15 от 12.03.2025", "Отчёт_7", "Отчёт 3 марта 2025 года"]
    assert values(spark, X.without_values, *same) == ["отчет", "отчет от", "отчет", "отчет"]
    assert values(spark, X.replace_people, "Иванов И. И. договор") == [" персона  договор"]
    assert values(spark, X.replace_people, "договор Петров Пётр Петрович") == ["договор  персона "]
    assert values(spark, X.replace_people, "Новый Большой Дом") == ["Новый Большой Дом"]
    assert values(spark, X.anonymize, "Акт № 12 от 01.02.2024,  сумма 1 500.50") == ["акт число от дата , сумма число число"]
    row = values(spark, lambda c: X.metadata_features(F.array(c)), "Договоры/Иванов И.И./Акт №5 2024.pdf")[0]
    assert row.title == "акт" and row.folders == "договоры персона" and row.entities == "имя или фамилия" and row.entity_counts.person == 1


def test_composed_names(spark):
    make = lambda **k: values(spark, lambda c: X.composed_name(c, "Корень", **k), "Первый уровень/Второй уровень/Отчёт.pdf")[0]
    assert make(parents=2) == "Первый_уровень_Второй_уровень_Отчёт.pdf"
    assert make(parents=3) == "Корень_Первый_уровень_Второй_уровень_Отчёт.pdf" and make(parents=1, at_end=True) == "Отчёт_Второй_уровень.pdf"
    assert make(text="new ") == "new_Отчёт.pdf" and make(text="") is None and make(text="a:b") is None
    with pytest.raises(ValueError):
        make(parents=4)


def test_windows_names_and_units(spark):
    assert values(spark, X.is_valid_name, "a.txt", "CON.txt", "com1", ".a", "a ", "a.", "x" * 256, "a?b") == [True] + [False] * 7
    assert values(spark, X.units, "a", "\U0001f600") == [1, 2]
    assert values(spark, lambda c: X.trim_units_udf(c, F.lit(3)), "\U0001f600ab", "\U0001f600\U0001f600") == ["\U0001f600a", "\U0001f600"]


def test_cells_previews_and_labels(spark):
    cells = ("=formula", "'quoted", "  +1", "plain", "-x", "@y", "")
    assert values(spark, X.encode_cell, *cells) == ["'=formula", "''quoted", "'  +1", "plain", "'-x", "'@y", ""]
    assert values(spark, lambda c: X.decode_cell(X.encode_cell(c)), *cells) == list(cells)
    assert values(spark, lambda c: X.limited_text(c, 2, 10), "a\r\nb", "a\nb\nc", "x" * 20) == ["a\nb", "a\nb\n…", "x" * 10 + "\n…"]
    assert len(values(spark, X.progress_label, "y" * 200)[0]) == 85
    assert values(spark, X.sanitize, "failed 'C:\\Users\\x y\\file.txt' now\x07") == ["failed '<path>' now?"]
    assert values(spark, X.sanitize, "at C:\\a b\\c.txt gone\nhttp://a/b\u00a0c\td") == ["at <path>\nhttp://a/b?c\td"]


def test_series_numbers(spark):
    assert values(spark, lambda c: X.series_number(c, "Base (x)"), "d/base (x) #07.txt", "Base (x) №12.pdf", "Base (x).txt", "Base (x) #1a.txt") == [7, 12, None, None]


def test_folder_tags_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(["B/x.txt", "a/y.txt"],), (["a/z.txt", "b/x.txt", "a/q.txt"],)], "o array<string>")
    tags = {r.t for r in df.select(X.folder_tag(X.folder_key(F.col("o"))).alias("t")).collect()}
    assert len(tags) == 1


def test_packed_vectors():
    vector = np.random.default_rng(1).normal(size=384)
    assert np.abs(V.unpack(V.pack(vector)) - vector / np.linalg.norm(vector)).max() < 1e-3
    for bad in ("", "!!", base64.b64encode(b"junk").decode(), base64.b64encode(zlib.compress(b"ab")).decode(), V.pack(np.zeros(384))):
        with pytest.raises(ValueError):
            V.unpack(bad)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(V.dot(F.col("a"), F.col("b")), V.unit(F.col("a")), V.unit(F.col("z")), V.refreshed(F.col("b"), F.lit(1.0), F.col("z"))).first()
    assert r[0] == 3 and r[1] == pytest.approx([0.6, 0.8]) and r[2] is None and r[3] == pytest.approx([1, 0])
    score = lambda s, l, k, g: spark.range(1).select(V.pair_score(F.lit(s), F.lit(l), F.lit(k), F.lit(g).cast("double"))).first()[0]  # noqa: E731, E741
    assert score(0.5, 1.0, True, None) == pytest.approx(0.7) and score(0.5, 1.0, False, None) == 0.5
    assert score(0.5, 0.5, True, 1.0) == pytest.approx(0.725) and score(0.9, 0.9, True, 0.1) == pytest.approx(0.9)


def test_unpack_udf_leaves_damage_unmatched(spark):
    df = spark.createDataFrame([(V.pack(np.ones(384)),), ("broken",), (None,)], "p string")
    assert [r.v is None for r in df.select(V.unpack_udf("p").alias("v")).collect()] == [False, True, True]

"""Awkward rows that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, shard int, _id string, _n int, _row string, _text string, _k1 long"
LONG = " ".join(f"w{i % 977} and" for i in range(60_000))


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text or ""), -1, -1.0, None, -1, "x", 5, "r", "t", 9)


def awkward(spark):
    rows = [
        row(1, "the quick brown fox jumps over the lazy dog and runs away into the woods"),
        row(2, None), row(3, ""), row(4, "   \n\t "), row(5, "1234 5678 !!!"), row(6, LONG),
        row(7, "the quick brown fox jumps over the lazy dog and runs away into the woods", "fr", None),
        row(8, "le renard brun saute par dessus le chien paresseux", "fr", "s2"), row(8, "le renard brun saute par dessus le chien paresseux", "fr", "s2"),
        row(None, "a text without an id", None, None), row(None, None, None, None), row(9, "one", "en", "\U0001f600"), row(10, "two words", "en", "s3"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(seed, n, vocabulary=400, prefix="w"):
    import random

    draw = random.Random(seed)
    return " ".join(f"{prefix}{draw.randrange(vocabulary)}" for _ in range(n))

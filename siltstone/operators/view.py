"""The table view: columns, rules, search, order and totals, all as one lazy chain."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X

TEXT_COLUMNS = ("name", "folder", "origin", "type")
NUMBER_COLUMNS = ("number", "size", "duplicate", "pages", "figures", "tables")
WORD_SUFFIXES = (".doc", ".docx", ".rtf")
LARGE = 128 * 1024 * 1024
# Suffixes of images and of office documents.
IMAGE_SUFFIXES = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
OFFICE_SUFFIXES = (".doc", ".docx", ".ppt", ".pptx", ".rtf", ".xls", ".xlsx")


def with_columns(catalog: DataFrame) -> DataFrame:
    """The view's columns over a catalog with path, origin, origins?, size, duplicate and statistics."""
    origin = F.when(F.size("origins") > 0, F.array_join("origins", " | ")).otherwise(F.col("origin")) if "origins" in catalog.columns else F.col("origin")
    return catalog.withColumns({"name": X.file_name(F.col("path")), "folder": X.folder(F.col("path")), "type": X.suffix(F.col("path")), "origin": origin})


@dataclass(frozen=True)
class NumberRule:
    """Inclusive bounds; what is unknown never matches."""

    least: int | None = None
    most: int | None = None

    def __post_init__(self):
        given = [n for n in (self.least, self.most) if n is not None]
        if any(not isinstance(n, int) or isinstance(n, bool) or n < 0 for n in given):
            raise ValueError("bounds are whole numbers from 0 on")
        if len(given) == 2 and given[0] > given[1]:
            raise ValueError("the lower bound is above the upper one")

    def column(self, value: Column) -> Column:
        known = value.isNotNull()
        if self.least is not None:
            known = known & (value >= self.least)
        return known & (value <= self.most) if self.most is not None else known


@dataclass(frozen=True)
class TextRule:
    """All words of ``include`` (or ``any``), as substrings or ``whole`` words, and none of ``exclude``.

    ``compatible`` levels compatibility forms and folds case in full, on both sides, in a pandas UDF; without
    it the text is lowered by built-in functions."""

    include: str = ""
    exclude: str = ""
    whole: bool = False
    any: bool = False
    compatible: bool = False

    def column(self, value: Column) -> Column:
        level = X.normalize_udf if self.compatible else X.normalize
        text = level(F.coalesce(value, F.lit("")))
        words = X.tokens(text)
        has = (lambda w: F.array_contains(words, w)) if self.whole else (lambda w: F.contains(text, F.lit(w)))
        folded = lambda s: (unicodedata.normalize("NFKC", s).casefold() if self.compatible else s.lower()).replace("ё", "е").split()
        wanted, banned = [has(w) for w in folded(self.include)], [has(w) for w in folded(self.exclude)]
        good = reduce(Column.__or__ if self.any else Column.__and__, wanted) if wanted else F.lit(True)
        return reduce(lambda a, b: a & ~b, banned, good)


def matching(view: DataFrame, rules: dict[str, NumberRule | TextRule]) -> DataFrame:
    for column, rule in rules.items():
        view = view.filter(rule.column(F.col(column)))
    return view


def search(view: DataFrame, words: str) -> DataFrame:
    """Rows whose path or origins hold the text, in any case."""
    return view.filter(F.contains(F.lower(F.concat_ws(" ", "path", "origin")), F.lit(words.lower())))


def sort_keys(orders: Sequence[tuple[str, bool]], number: str = "number", group: str | None = None) -> list[tuple[Column, bool]]:
    """(key, descending) for (column, descending), the first one the most significant; the ordinal keeps it stable.

    Unknown statistics sort as -1, sizes and duplicates as 0, names by natural order. A grouping, where
    one is active, comes first, rows without a group last."""
    keys = [(F.coalesce(F.col(group).cast("long"), F.lit((1 << 63) - 1)), False)] if group else []
    for column, descending in orders:
        if column in ("pages", "figures", "tables", "quality", "toxic"):
            key = F.coalesce(F.col(column), F.lit(-1))
        elif column in ("size", "duplicate"):
            key = F.coalesce(F.col(column), F.lit(0))
        elif column in ("name",):
            key = X.natural_key(F.col(column))
        else:
            key = F.lower(F.col(column)) if column in TEXT_COLUMNS else F.col(column)
        keys.append((key, descending))
    return [*keys, (F.col(number), False)]


def ordered(view: DataFrame, orders: Sequence[tuple[str, bool]], number: str = "number", group: str | None = None) -> DataFrame:
    keys = sort_keys(orders, number, group)
    return view.orderBy(*[k.desc() if down else k.asc() for k, down in keys])


def metric(value: Column, estimated: Column | None = None) -> Column:
    shown = value.cast("string")
    if estimated is not None:
        shown = F.when(F.coalesce(estimated, F.lit(False)), F.concat(F.lit("≈"), shown)).otherwise(shown)
    return F.coalesce(shown, F.lit("—"))


def duplicate_label(duplicate: Column, hash_: Column) -> Column:
    return F.when(duplicate > 0, F.concat(F.lit("#"), duplicate.cast("string"))).when(F.coalesce(hash_, F.lit("")) == "", "Не проверен").otherwise("—")


def totals(view: DataFrame, metrics: Sequence[str], word_only: Sequence[str] = ("figures", "tables")) -> DataFrame:
    """One row: files, bytes and for each metric its sum (null where none is known), how many are known,
    and whether it is incomplete or estimated."""
    word = F.coalesce(F.bool_and(X.suffix(F.col("path")).isin(*WORD_SUFFIXES)), F.lit(False))
    out = [F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")]
    for m in metrics:
        out += [F.sum(m).cast("long").alias(m), F.count(m).alias(f"{m}_known")]
        incomplete = F.count(m) < F.count("*")
        out.append((incomplete | ~word if m in word_only else incomplete).alias(f"{m}_incomplete"))
        if f"{m}_estimated" in view.columns:
            out.append(F.coalesce(F.bool_or(F.when(F.col(m).isNotNull(), F.col(f"{m}_estimated"))), F.lit(False)).alias(f"{m}_estimated"))
    return view.agg(*out)


# The words and signs of the totals line.
TOTALS_ALL, TOTALS_SELECTED, TOTALS_FILES, TOTALS_BYTES = "Весь каталог, включая копии: ", "Выбрано: ", "Файлов: ", "Байт: "
TOTALS_BETWEEN, TOTALS_UNKNOWN, TOTALS_INCOMPLETE, TOTALS_ESTIMATED = " · ", "—", ">", "≈"


def totals_line(totals: DataFrame, metrics: dict[str, str], selected: bool = False) -> DataFrame:
    """(line): the totals line of the row of ``totals``. ``metrics``: the label of each."""
    shown = [F.concat(F.lit(TOTALS_FILES), F.col("files")), F.concat(F.lit(TOTALS_BYTES), F.translate(F.format_number("bytes", 0), ",", " "))]
    for m, label in metrics.items():
        sign = F.when(F.col(f"{m}_incomplete"), TOTALS_INCOMPLETE).otherwise("")
        if f"{m}_estimated" in totals.columns:
            sign = F.concat(sign, F.when(F.col(f"{m}_estimated"), TOTALS_ESTIMATED).otherwise(""))
        known = F.format_string("%s%d (%d/%d)", sign, F.col(m), F.col(f"{m}_known"), F.col("files"))
        shown.append(F.concat(F.lit(f"{label}: "), F.when(F.col(f"{m}_known") > 0, known).otherwise(TOTALS_UNKNOWN)))
    start = TOTALS_SELECTED if selected else TOTALS_ALL
    return totals.select(F.concat(F.lit(start), F.concat_ws(TOTALS_BETWEEN, *shown)).alias("line"))


def scope(view: DataFrame, selected: DataFrame | None) -> DataFrame:
    """The selected rows, or all of them where nothing is selected."""
    if selected is None or selected.isEmpty():
        return view
    return view.join(selected.select("path"), "path", "left_semi")


def size_only(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) > LARGE


def is_transient(name: Column) -> Column:
    return name.startswith("~$")


def is_office(name: Column) -> Column:
    """A preview of it takes an office program, one at a time."""
    return ~is_transient(name) & X.suffix(name).isin(*OFFICE_SUFFIXES)


def is_parallel(name: Column) -> Column:
    """Previews of such files can be made side by side."""
    return ~is_transient(name) & X.suffix(name).isin(*IMAGE_SUFFIXES, ".pdf")


def is_cacheable(name: Column) -> Column:
    return is_parallel(name) | is_office(name)


def first_rows(view: DataFrame, orders: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order that tells all apart: the examples or errors that a report shows."""
    return view.orderBy(*orders).limit(n)


def status(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("files"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))


def next_after(view: DataFrame, removed: DataFrame, number: str = "number") -> DataFrame:
    """The row to select once ``removed`` (path) are gone: the first after the last of them, else the last before the first."""
    last = view.join(removed.select("path"), "path", "left_semi").agg(F.max(number)).first()[0]
    kept = view.join(removed.select("path"), "path", "left_anti")
    after = F.min_by("path", F.when(F.col(number) > F.lit(last), F.col(number)))
    return kept.agg(F.coalesce(after, F.max_by("path", number)).alias("path"))

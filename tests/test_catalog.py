import pytest
from pyspark.sql import functions as F

from siltstone.operators import catalog as C
from siltstone.operators import view as W
from siltstone.operators.components import components
from siltstone.operators.ranking import numbered
from siltstone.sources import manifest as M

ROWS = "path string, hash string, size long"


def put(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_txt", ".txt")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_scan_and_exact_duplicates(spark, tmp_path):
    put(tmp_path, a__report_txt="2025: 15", b__copy_txt="2025: 15", c__report_txt="2026: 17")
    found = C.with_duplicates(C.scan_files(spark, str(tmp_path)))
    assert {r.path: r.duplicate for r in found.collect()} == {"a/report.txt": 1, "b/copy.txt": 1, "c/report.txt": 0}


@pytest.mark.parametrize("paths, keep", [(["root.txt", "a/nested.txt", "b/copy.txt"], "root.txt"), (["z.txt", "nested/a.txt"], "z.txt"), (["B.txt", "a.txt"], "a.txt")])
def test_keep_rule(spark, paths, keep):
    df = spark.createDataFrame([(p, "h", 1) for p in paths] + [("unique.txt", "u", 1), ("none.txt", "", 1), ("none2.txt", "", 1)], ROWS)
    plan = C.duplicate_plan(df).collect()
    assert {r.keep for r in plan} == {keep} and {r.remove for r in plan} == set(paths) - {keep}
    only = spark.createDataFrame([(paths[-1],), ("other",)], "path string")
    assert {r.remove for r in C.duplicate_plan(df, only).collect()} == {paths[-1]} - {keep}


def test_duplicate_ids_rank_repeated_hashes(spark):
    df = spark.createDataFrame([("1", "ff", 1), ("2", "ff", 1), ("3", "aa", 1), ("4", "aa", 2), ("5", "bb", 1), ("6", "", 1), ("7", "", 1)], ROWS)
    assert {r.path: r.duplicate for r in C.with_duplicates(df).collect()} == {"1": 2, "2": 2, "3": 1, "4": 1, "5": 0, "6": 0, "7": 0}
    assert C.duplicate_summary(df).first() == (7, 5, 2, 2, 2)


def test_changed_keeper_is_not_removed(spark):
    plan = C.duplicate_plan(spark.createDataFrame([("a.txt", "h", 1), ("b.txt", "h", 1)], ROWS))
    now = spark.createDataFrame([("a.txt", "new"), ("b.txt", "h")], "path string, hash string")
    assert [r.ok for r in C.verified_removals(plan, now).collect()] == [False]


def test_walk_order(spark):
    paths = ["b.txt", "a/x.txt", "a/b/c.txt", "a.txt", "a1/q.txt", "a/z.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.orderBy(C.walk_key(F.col("path"))).collect()] == ["a.txt", "b.txt", "a/x.txt", "a/z.txt", "a/b/c.txt", "a1/q.txt"]


def identity(ino, size=1, mtime=1):
    return (1, ino, size, mtime)


def test_refresh(spark):
    schema = f"path string, origin string, identity {C.IDENTITY}, hash string, note string, error string"
    old = spark.createDataFrame(
        [("same.txt", "o1", identity(1), "h1", "n1", "e"), ("gone.txt", "o2", identity(2), "h2", "n2", ""), ("edited.txt", "o3", identity(3), "h3", "n3", ""), ("x.txt", "o4", identity(4), "h4", "", ""), ("y.txt", "o5", identity(4), "h5", "", ""), ("no_inode.txt", "o6", identity(0), "h6", "", "")], schema
    )
    listing = spark.createDataFrame([("same.txt", identity(1)), ("renamed.txt", identity(2)), ("edited.txt", identity(3, 9)), ("z.txt", identity(4)), ("fresh.txt", identity(7)), ("zero.txt", identity(0)), ("moved.txt", identity(8))], f"path string, identity {C.IDENTITY}")
    moves = spark.createDataFrame([("s", "moved.txt", "first.txt", identity(8)), ("s", "fresh.txt", "no.txt", identity(99))], f"source string, destination string, origin string, identity {C.IDENTITY}")
    got = {r.path: r for r in C.refresh(old, listing, moves).collect()}
    assert got["same.txt"].hash == "h1" and got["same.txt"].note == "n1" and got["same.txt"].error == ""
    assert got["renamed.txt"].origin == "o2" and got["renamed.txt"].hash == "h2"
    assert got["edited.txt"].origin == "o3" and got["edited.txt"].hash == ""
    assert got["z.txt"].origin == "z.txt" and got["fresh.txt"].origin == "fresh.txt" and got["zero.txt"].origin == "zero.txt" and got["moved.txt"].origin == "first.txt"
    filled = C.fill_hashes(C.refresh(old, listing), spark.createDataFrame([("edited.txt", "h3"), ("fresh.txt", "q")], "path string, hash string"), old)
    notes = {r.path: (r.hash, r.note) for r in filled.collect()}
    assert notes["edited.txt"] == ("h3", "n3") and notes["fresh.txt"] == ("q", "")


# view rules


@pytest.mark.parametrize("value, rule, want", [
    ("001_Отчёт по испытаниям насоса.docx", W.TextRule("отчет насос"), True), ("001_Отчёт по испытаниям насоса.docx", W.TextRule("отчет насос", whole=True), False),
    ("001_Отчёт по испытаниям насоса.docx", W.TextRule("отчет насоса", whole=True), True), ("001_Отчёт по испытаниям насоса.docx", W.TextRule("отчет", "испытания"), False),
    ("001_Отчёт по испытаниям насоса.docx", W.TextRule("акт отчет", any=True), True), ("001_Отчёт по испытаниям насоса.docx", W.TextRule("акт отчет"), False),
    (None, W.TextRule("", "x"), True),
    ("ﬁle №５ STRASSE", W.TextRule("file 5 straße", compatible=True), True), ("ﬁle", W.TextRule("file"), False), (None, W.TextRule("x", compatible=True), False),
])
def test_text_rules(spark, value, rule, want):
    df = spark.createDataFrame([(value,)], "name string")
    assert (W.matching(df, {"name": rule}).count() == 1) == want


@pytest.mark.parametrize("value, rule, want", [(100, W.NumberRule(100, 100), True), (0, W.NumberRule(most=0), True), (None, W.NumberRule(0), False), (101, W.NumberRule(most=100), False)])
def test_number_rules(spark, value, rule, want):
    assert (W.matching(spark.createDataFrame([(value,)], "size long"), {"size": rule}).count() == 1) == want


def test_wrong_bounds():
    for a, b in ((-1, None), (5, 4), (True, None), (1.5, None)):
        with pytest.raises(ValueError):
            W.NumberRule(a, b)


def test_totals(spark):
    schema = "path string, size long, pages long, pages_estimated boolean, figures long, tables long"
    names = {"pages": "Стр.", "figures": "Рис.", "tables": "Табл."}
    both = spark.createDataFrame([("a.docx", 10, 2, True, 3, 1), ("b.pdf", 20, 4, None, None, None)], schema)
    line = W.totals_line(W.totals(both, list(names)), names).first().line
    assert "Рис.: >3" in line and "Стр.: ≈6" in line and "Байт: 30" in line
    assert "Рис.: 3" in W.totals_line(W.totals(both.filter("size = 10"), list(names)), names, True).first().line
    assert "Стр.: —" in W.totals_line(W.totals(both.limit(0), list(names)), names).first().line


def test_order_labels_and_selection(spark):
    df = spark.createDataFrame([(1, "b #10", None, 0, "h"), (2, "b #2", 5, 2, "h"), (3, "a", 5, 0, "")], "number long, name string, size long, duplicate int, hash string").withColumn("path", F.col("name"))
    order = lambda *o, **k: [r.number for r in W.ordered(df, o, **k).collect()]
    assert order(("name", False)) == [3, 2, 1] and order(("size", True)) == [2, 3, 1] and order(("size", False), ("name", True)) == [1, 2, 3]
    assert [r.number for r in W.ordered(df.withColumn("group", F.when(F.col("number") > 1, 7 - F.col("number"))), [("name", False)], group="group").collect()] == [3, 2, 1]
    labels = [r[0] for r in df.orderBy("number").select(W.duplicate_label(F.col("duplicate"), F.col("hash"))).collect()]
    assert labels == ["—", "#2", "Не проверен"]
    gone = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert W.next_after(df, gone("b #10")).first()[0] == "b #2" and W.next_after(df, gone("a")).first()[0] == "b #2"
    assert W.scope(df, None).count() == 3 and W.scope(df, gone("a")).count() == 1 and W.search(df.withColumn("origin", F.lit("Src/X")), "src/x").count() == 3


def test_numbered_without_one_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id").repartition(5)
    assert all(r.number == r.v + 1 for r in numbered(df, [(F.col("v"), False)]).collect())
    assert all(r.number == 1000 - r.v for r in numbered(df, [(F.col("v"), True)]).collect())
    assert numbered(df.limit(0), [(F.col("v"), False)]).count() == 0


def test_components(spark):
    import random

    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(150)] + [(900, 900), (5, 5)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in label}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_table_that_fits_a_task_need_no_round(spark, monkeypatch):
    from siltstone.operators import components as module

    written, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: (written.append(name), write(df, name))[1])
    edges = [(i, i + 1) for i in range(60)] + [(80 + 7 * i % 60, 200) for i in range(60)] + [(200, 300), (7, 7)]
    want = {x: 0 if x <= 60 else 80 for e in edges for x in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(frame).collect()} == want and written == ["edges"]
    monkeypatch.setattr(module, "HELD_EDGES", 1)  # each batch by itself, so that rounds have to follow
    with_conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {r.node: r.root for r in components(frame).collect()} == want and "small" in written
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_conf)
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.root for r in components(named).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_stars():
    import numpy as np

    from siltstone.operators.components import stars

    draw = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 400):
        u, v = draw.integers(-30, 300, (2, n))
        label = {int(x): int(x) for x in (*u, *v)}
        for _ in label:
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                label[a] = label[b] = min(label[a], label[b])
        got = dict(zip(*(x.tolist() for x in stars(u, v)), strict=True))
        assert got == {x: r for x, r in label.items() if x != r}


# manifest


def backup(spark, rows):
    return spark.createDataFrame(rows, "path string, origin string, size long, hash string")


def test_manifest_round_trip(spark, tmp_path):
    h = lambda c: c * 64
    rows = [("reports/2025/a.txt", "reports/2025/a.txt", 5, h("a")), ("letters/b.txt", "letters/b.txt", 6, h("b")), ("=formula.txt", "=formula.txt", 1, h("c")), ("'quoted;\".txt", "'quoted;\".txt", 1, h("d"))]
    M.write_manifest(backup(spark, rows), str(tmp_path / "m"))
    raw = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "m").glob("part-*")))
    assert raw.startswith('"' + M.BOM) or M.BOM in raw
    read = M.read_manifest(spark, str(tmp_path / "m"))
    files = {r.current_path for r in read.filter("kind = 'file'").collect()}
    assert files == {r[0] for r in rows} and {r.original_path for r in read.filter("kind = 'directory'").collect()} == {"reports", "reports/2025", "letters"}
    flat = backup(spark, [("renamed.txt", "renamed.txt", 5, h("a")), ("b.txt", "b.txt", 6, h("b")), ("new.txt", "new.txt", 6, h("f")), ("size.txt", "size.txt", 7, h("a"))])
    found = {r.path: r for r in M.reconcile(flat, read).collect()}
    assert found["renamed.txt"].origin == "reports/2025/a.txt" and found["new.txt"].origin_match == "unmatched" and found["size.txt"].origin_match == "unmatched"
    assert M.reconcile_summary(M.reconcile(flat, read)).first() == (2, 0, 2)


def test_ambiguous_origins(spark):
    manifest = spark.createDataFrame([("file", "one/a.txt", 3, "h", ["one/a.txt"]), ("file", "two/b.txt", 3, "h", ["two/b.txt"])], "kind string, original_path string, size long, sha256 string, origins array<string>")
    got = M.reconcile(backup(spark, [("unknown.txt", "unknown.txt", 3, "h")]), manifest).first()
    assert got.origin == "unknown.txt" and got.origins == ["one/a.txt", "two/b.txt"] and got.origin_match == "ambiguous"


@pytest.mark.parametrize("line", [
    "x;file;a.txt;a.txt;1;;[]", "corpus-structure-v1;thing;a.txt;a.txt;1;;[]", "corpus-structure-v1;file;a.txt;../escape;1;;[]", "corpus-structure-v1;file;a.txt;a.txt;-1;;[]",
    "corpus-structure-v1;file;a.txt;a.txt;1;zz;[]", "corpus-structure-v1;file;a.txt;a.txt;1;;nolist", 'corpus-structure-v1;file;a.txt;a.txt;1;;"[""../up""]"',
])
def test_manifest_refuses_wrong_rows(spark, tmp_path, line):
    (tmp_path / "m.csv").write_text(";".join(M.NAMES) + "\n" + line + "\n")
    with pytest.raises(Exception, match="manifest"):
        M.read_manifest(spark, str(tmp_path / "m.csv")).collect()


def test_torn_journal(spark):
    moves = spark.createDataFrame([("1", False), ("2", False), ("3", False)], "id string, done boolean")
    journal = spark.createDataFrame([('{"id": "1"}',), ('{"id": "3"}',), ('{"id": "2',)], "value string")
    assert {r.id for r in M.replay(moves, journal).filter("done").collect()} == {"1", "3"}


def test_manifest_of_other_shape(spark, tmp_path):
    h = "a" * 64
    (tmp_path / "m.csv").write_text(M.BOM + "origin_candidates;more;sha256;size;original_path;current_path;kind;schema\n" + f'"[""x/a.txt"",""y/a.txt""]";;{h};;orig.txt;../anywhere;file;corpus-structure-v1\n;;;;folder;;directory;corpus-structure-v1\n;;{"b" * 64};7;only.txt;;file;corpus-structure-v1\n', "utf-8")
    rows = {r.original_path: r for r in M.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows["orig.txt"].origins == ["x/a.txt", "y/a.txt"] and rows["orig.txt"].size is None and rows["folder"].kind == "directory" and rows["only.txt"].origins == ["only.txt"]
    (tmp_path / "n.csv").write_text("schema;kind\ncorpus-structure-v1;file\n")
    with pytest.raises(ValueError, match="no column"):
        M.read_manifest(spark, str(tmp_path / "n.csv"))
    for bad in (f'"[1]";{"a" * 64};1', f'[];{"A" * 64};1'):
        (tmp_path / "b.csv").write_text("origin_candidates;sha256;size;original_path;current_path;kind;schema\n" + bad + ";a.txt;a.txt;file;corpus-structure-v1\n")
        with pytest.raises(Exception, match="manifest"):
            M.read_manifest(spark, str(tmp_path / "b.csv")).collect()
        (tmp_path / "b.csv").unlink()


def test_rows_that_no_manifest_knows_keep_their_origins(spark):
    manifest = spark.createDataFrame([("file", "o.txt", None, "h", ["p.txt"])], "kind string, original_path string, size long, sha256 string, origins array<string>")
    rows = spark.createDataFrame([("a.txt", "first.txt", 3, "x", ["first.txt", "other.txt"]), ("b.txt", "b.txt", None, "h", ["b.txt"])], "path string, origin string, size long, hash string, origins array<string>")
    got = {r.path: r for r in M.reconcile(rows, manifest).collect()}
    assert got["a.txt"].origins == ["first.txt", "other.txt"] and got["a.txt"].origin == "first.txt" and got["a.txt"].origin_match == "unmatched"
    assert got["b.txt"].origins == ["p.txt"] and got["b.txt"].origin == "p.txt"


def test_only_verified_copies_go(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    plan = spark.createDataFrame([("b", True), ("c", False)], "remove string, ok boolean")
    assert sorted(r.path for r in C.without(rows, plan).collect()) == ["a", "c"]


def test_a_version_counts_once_it_is_whole(spark, tmp_path):
    from siltstone.sources.state import load_state, save_state, versions

    path = str(tmp_path / "state")
    assert versions(spark, path) == []
    with pytest.raises(ValueError, match="no such version"):
        load_state(spark, path)
    assert [save_state(spark.range(n), path) for n in (3, 5)] == [1, 2]
    assert load_state(spark, path).count() == 5 and load_state(spark, path, 1).count() == 3
    (tmp_path / "state" / "v000002" / "_SUCCESS").unlink()
    assert load_state(spark, path).count() == 3 and save_state(spark.range(7), path) == 2 and load_state(spark, path).count() == 7

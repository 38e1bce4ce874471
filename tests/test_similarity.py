import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import images
from siltstone.operators import encode as E
from siltstone.operators import grouping as G
from siltstone.operators import labels as L
from siltstone.operators import linkage
from siltstone.operators import names as N
from siltstone.operators import ordering as O
from siltstone.operators import sketch as K


def words(seed, n):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


# sketches


@pytest.mark.parametrize("n", [4096, 32768, 150_000])
def test_byte_fingerprints_see_small_changes(n):
    data = random.Random(n).randbytes(n)
    flipped, inserted, other = bytearray(data), data[: n // 2] + b"!" + data[n // 2 :], random.Random(n + 1).randbytes(n)
    flipped[n // 2] ^= 1

    def likeness(a, b):
        x, y = K.bytes_fingerprint(a), K.bytes_fingerprint(bytes(b))
        def share(p, q):
            both = sorted(set(p) | set(q))[:256]
            return sum(v in p and v in q for v in both) / len(both) if len(both) >= 8 else 0.0
        return max(share(x["chunks"], y["chunks"]), share(x["binary"], y["binary"]) if x["binary_method"] == y["binary_method"] else 0)

    assert likeness(data, flipped) > 0.8 and likeness(data, inserted) > 0.8 and likeness(data, other) < 0.1
    assert b"".join(K.chunks(data)) == data and all(len(c) <= K.CHUNK_MOST for c in K.chunks(data))


def test_overlap_needs_a_sample(spark):
    df = spark.createDataFrame([(list("abcdefghij"), list("abcdefghij")), (list("abc"), list("abc")), ([str(i) for i in range(100, 200)], [str(i) for i in range(150, 250)])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(K.overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_text_matches(spark):
    base = words(1, 80)
    near, cut = base.replace(base.split()[40], "changed"), " ".join(base.split()[:50])
    rows = [(1, base), (2, base.upper()), (3, near), (4, cut), (5, words(2, 80)), (6, "too few words"), (7, None)]
    found = K.text_sketch(spark.createDataFrame(rows, "id long, text string"))
    classes = K.text_classes(found)
    assert {r.id: r.n for r in classes.collect()} == {1: 2, 3: 1, 4: 1, 5: 1}
    assert {(r.a, r.b) for r in K.text_matches(classes).collect()} == {(1, 3)}
    other = K.text_classes(K.text_sketch(spark.createDataFrame([(90, base), (91, words(2, 80))], "id long, text string")))
    assert {(r.a, r.b) for r in K.text_matches(classes, other).collect()} == {(1, 90), (3, 90), (5, 91)}


def sampled(spark, hashes):
    """Text classes with the samples given as numbers."""
    rows = [(i, f"c{i}", n, sorted(f"{h:016x}" for h in held)) for i, (n, held) in enumerate(hashes)]
    return spark.createDataFrame(rows, "id long, class string, words long, sample array<string>")


def drawn_classes(n=90):
    """Families of near copies; half of the classes share hash 7, and sizes differ."""
    draw, out = random.Random(11), []
    for i in range(n):
        family = random.Random(i % 9)
        held = {family.randrange(1, 2**64) for _ in range(40)}
        held = set(sorted(held)[draw.randrange(3) :]) | {draw.randrange(1, 2**64) for _ in range(draw.randrange(4))} | ({7} if i % 2 else set())
        out.append((40 + draw.randrange(20), held))
    return out


def plain_matches(hashes, least, left, right):
    out = {}
    for i in left:
        for j in right:
            (na, a), (nb, b) = hashes[i], hashes[j]
            union = sorted(a | b)[:256]
            if (i < j or left != right) and na >= nb * 0.8 and nb >= na * 0.8 and (score := len(set(union) & a & b) / len(union)) >= least:
                out[i, j] = score
    return out


def test_matches_meet_by_rare_hashes_only(spark, monkeypatch):
    """A hash that many classes share makes no pairs, and the matches are those of all pairs."""
    hashes = drawn_classes()
    seen = []
    plain = K.sample_scores
    monkeypatch.setattr(K, "sample_scores", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    assert {(r.a, r.b): r.score for r in K.text_matches(sampled(spark, hashes)).collect()} == plain_matches(hashes, K.TEXT_LEAST, range(90), range(90)) != {}
    lone = [(50, {7, *range(100 * i, 100 * i + 20)}) for i in range(1, 60)]
    assert K.text_matches(sampled(spark, lone)).count() == 0 and seen[-1] == 0 < seen[0] < 90 * 89 / 2


def test_matches_of_two_corpora_meet_by_rare_hashes_only(spark, monkeypatch):
    hashes = drawn_classes()
    whole = sampled(spark, hashes)
    seen, plain = [], K.sample_scores
    monkeypatch.setattr(K, "sample_scores", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    left, right = list(range(0, 50)), list(range(50, 90))
    got = {(r.a, r.b): r.score for r in K.text_matches(whole.filter("id < 50"), whole.filter("id >= 50")).collect()}
    assert got == plain_matches(hashes, K.TEXT_LEAST, left, right) != {} and seen[-1] < 50 * 40 / 2


def test_shared_hashes_are_counted_by_blocks(spark, monkeypatch):
    """Several blocks with frequent and rare hashes, and strips of few cells, count what all pairs give."""
    hashes = drawn_classes()
    monkeypatch.setattr(K, "BLOCK_LEAST", 20)
    want = {(i, j): n for i in range(90) for j in range(i + 1, 90) if hashes[i][0] >= hashes[j][0] * 0.8 and hashes[j][0] >= hashes[i][0] * 0.8 and (n := len(hashes[i][1] & hashes[j][1]))}
    assert {(r.a, r.b): r.shared for r in K.candidate_pairs(sampled(spark, hashes)).collect()} == want
    rows = [{"id": i, "words": n, "mine": True, "hashes": sorted(h % 2**62 for h in held)} for i, (n, held) in enumerate(hashes)]
    block = K.Block(pa.Table.from_pylist(rows))
    assert {(*sorted((int(block.ids[i]), int(block.ids[j]))), int(n)) for x in K.shared_counts(block, block, True, cells=100) for i, j, n in zip(*x)} == {(*k, n) for k, n in want.items()}


CONTENT = "struct<sha256:string,text_sha256:string,words:bigint,bytes:bigint,binary_method:string,binary:array<string>,chunks:array<string>,text:array<string>,visual:array<struct<slot:string,hash:string,tone:int,aspect:double>>,visual_pages:int,failed:boolean>"


def content(sha, text=None, n=0, size=100, visual=(), pages=0, failed=False, chunks=()):
    return (sha, "t" + sha if text is None else text, n, size, "chunks", list(chunks), list(chunks), [], list(visual), pages, failed)


def test_content_match(spark):
    image = lambda h, tone=100, aspect=1.0, slot="first": (slot, h, tone, aspect)
    a, flip = "0" * 128, "f" + "0" * 127
    pairs = [
        (content("x"), content("x"), "exact"), (content("x", failed=True), content("x"), None), (content("x", "t", 20), content("y", "t", 20), "text"), (content("x", "t", 5), content("y", "t", 5), None),
        (content("x", visual=[image(a)], pages=1), content("y", visual=[image(flip)], pages=1), "visual"), (content("x", visual=[image(a)], pages=1), content("y", visual=[image(flip, tone=150)], pages=1), None),
        (content("x", visual=[image(a)], pages=10), content("y", visual=[image(a)], pages=7), None), (content("x", chunks="abcdefghij"), content("y", chunks="abcdefghij"), "bytes"),
        (content("x", chunks="abcdefghij"), content("y", chunks="abcdefghij", size=70), None),
    ]
    df = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(pairs)], f"i int, a {CONTENT}, b {CONTENT}")
    got = [r.m.reason if r.m else None for r in df.select("i", K.content_match("a", "b").alias("m")).orderBy("i").collect()]
    assert got == [w for _, _, w in pairs]


def test_content_order_puts_matches_first(spark):
    same = content("s1", chunks=[f"c{i}" for i in range(20)])
    rows = [("a/x.pdf", 100, same), ("b/y.pdf", 100, same), ("c/near.pdf", 99, content("s2", size=99, chunks=[f"c{i}" for i in range(19)])), ("annual plan draft.txt", 50, content("s3")), ("annual plan drafts.txt", 60, content("s4")), ("zebra.txt", 5000, content("s5")), ("broken.txt", 5100, content("", failed=True)), ("other.bin", 1, content("s6"))]
    got = {r.path: r for r in O.content_order(spark.createDataFrame(rows, f"path string, size long, content {CONTENT}")).collect()}
    assert {got[p].group for p in ("a/x.pdf", "b/y.pdf", "c/near.pdf")} == {0} and got["a/x.pdf"].stage == "content"
    assert got["annual plan draft.txt"].group == got["annual plan drafts.txt"].group == 1 and got["zebra.txt"].stage == "size"
    assert got["zebra.txt"].group == got["broken.txt"].group and sorted(r.rank for r in got.values()) == list(range(8))


# names


def test_complete_link_of_names(spark):
    df = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    chain = {r.name: r.cluster for r in N.name_groups(df("alpha beta", "alpha beta gamma", "beta gamma"), 0.62).collect()}
    assert chain["alpha beta"] == chain["alpha beta gamma"] != chain["beta gamma"] or chain["beta gamma"] == chain["alpha beta gamma"] != chain["alpha beta"]
    typo = {r.name: r.cluster for r in N.greedy_groups(df("задание насосы техническое", "заданеи насосы техническое", "совсем другое")).collect()}
    assert typo["задание насосы техническое"] == typo["заданеи насосы техническое"] != typo["совсем другое"]
    with pytest.raises(ValueError):
        N.scored_pairs(N.features(df("a b")), 0.2)


def test_pairs_against_all_pairs(spark):
    draw, parts = random.Random(4), ["pump", "valve", "report", "annual", "2024", "2025", "test", "draft", "x1"]
    names = sorted({" ".join(sorted(draw.sample(parts, draw.randrange(1, 5)))) for _ in range(60)})
    weighted = N.features(spark.createDataFrame([(n,) for n in names], "name string"))
    vectors: dict = {}
    for r in weighted.collect():
        vectors.setdefault(r.name, {})[r.kind, r.feature] = r.weight * (0.65 if r.kind == "w" else 0.35) ** 0.5
    for least in (0.4, 0.62, 0.9):
        want = {(a, b): s for a in names for b in names if a < b and (s := sum(v * vectors.get(b, {}).get(k, 0) for k, v in vectors.get(a, {}).items())) >= least}
        got = {(r.a, r.b): r.score for r in N.scored_pairs(weighted, least).collect()}
        assert got == pytest.approx(want)


def test_pairs_are_scored_in_blocks_of_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 5)
    test_pairs_against_all_pairs(spark)


def test_arrays_of_edges_are_linked_as_tuples():
    draw = np.random.default_rng(2)
    for _ in range(20):
        edges = [(i, k, round(float(draw.random()), 1)) for i in range(12) for k in range(i) if draw.random() < 0.7]
        assert linkage.complete_link(12, tuple(map(np.array, zip(*edges, strict=True)))) == linkage.complete_link(12, edges)


def test_names_alike_but_for_a_number_make_no_pairs(spark, monkeypatch):
    """Names that differ in a number of their own are one unit, and cluster as they do pair by pair."""
    kinds = ["blue bolt", "blue ring", "old plate", "item"]
    rows = [(f"x/{kinds[i % 4]} {1000 + i}.txt", 10 + i % 3 * 40) for i in range(120)] + [("x/item.txt", 10), ("x/blue.txt", 50)]
    files = spark.createDataFrame(rows, "path string, size long")
    seen, plain = [], N.pairs_of_lists
    monkeypatch.setattr(N, "pairs_of_lists", lambda rows, least: seen.append(rows.count()) or plain(rows, least))
    got = {r.path: (r.band, r.cluster) for r in G.residual_name_groups(files).collect()}
    assert seen == [6]
    keyed = {r.path: r for r in G.bands(files, G.NAME_BAND).withColumn("name", N.X.name_key(F.col("path"))).collect()}
    score = {(r.a, r.b): round(r.score, 9) for r in N.scored_pairs(N.features(spark.createDataFrame([(r.name,) for r in keyed.values()], "name string")), 0.4).collect()}
    for band in {r.band for r in keyed.values()}:
        names = sorted(r.name for r in keyed.values() if r.band == band)
        label = linkage.complete_link(len(names), [(i, j, score[names[i], names[j]]) for j in range(len(names)) for i in range(j) if (names[i], names[j]) in score])
        want = {n: names[k] for n, k in zip(names, label, strict=True)}
        assert all(got[p][1].split("\1")[1] == want[r.name] for p, r in keyed.items() if r.band == band)


def test_linkage_against_a_plain_version():
    draw = np.random.default_rng(7)
    for _ in range(30):
        x = draw.normal(size=(14, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - x @ x.T
        clusters = [[i] for i in range(14)]
        while len(clusters) > 1:
            best = min(((np.mean([d[i, j] for i in a for j in b]), p, q) for p, a in enumerate(clusters) for q, b in enumerate(clusters) if p < q))
            if best[0] >= 0.5:
                break
            clusters[best[1]] += clusters.pop(best[2])
        want = sorted(sorted(c) for c in clusters)
        label = linkage.average_link(d, 0.5)
        assert sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label)) == want


def test_complete_link_takes_the_strongest_first():
    assert linkage.complete_link(3, [(0, 1, 0.9), (0, 2, 0.97)]) == [0, 1, 0]
    edges = [(i, k, 0.9) for i in range(4) for k in range(i)] + [(4, 3, 0.95)]
    assert linkage.complete_link(5, edges) == [0, 0, 0, 3, 3]


def test_anchored_bands():
    assert linkage.anchored_bands([("pdf", 56451), ("pdf", 56585), ("pdf", 56591), ("pdf", 120000), ("xlsx", 94537), ("zip", 0), ("zip", 1)], 0.95) == [0, 0, 0, 1, 2, 3, 4]
    assert linkage.anchored_bands([(".rst", 200), (".rst", 208), (".rst", 216), (".zip", 200)], 0.95) == [0, 0, 1, 2]


# groups


def vec(*x):
    return [float(v) for v in (*x, *[0] * (8 - len(x)))]


def test_copies_are_linked_as_one_unit(spark, monkeypatch):
    """Copies beyond the bound of a component give what the rows give one by one."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6)) + np.repeat(rng.normal(size=(3, 6)) * 2, 4, axis=0)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, base[i % 12].tolist()) for i in range(60)] + [(60, [0.0] * 6), (61, [0.0] * 6), (62, None)]
    df = spark.createDataFrame(rows, "id long, semantic array<double>")
    held = np.array([base[i % 12] for i in range(60)])
    label = linkage.average_link(1 - np.clip(held @ held.T, -1, 1), 0.35)
    monkeypatch.setattr(G, "COMPONENT_ROWS", 12)
    got = {r.id: r for r in G.average_groups(df, 0.35).collect()}
    assert [got[i].cluster for i in range(60)] == label.tolist()
    for i in range(60):
        peers = [j for j in range(60) if j != i and label[j] == label[i]]
        assert abs(got[i].confidence - np.mean([held[i] @ held[j] for j in peers])) < 1e-9
    assert all(got[i].cluster == i and got[i].confidence is None for i in (60, 61, 62))


def test_average_groups(spark):
    df = spark.createDataFrame([(1, vec(1)), (2, vec(0.9987, 0.05)), (3, vec(0, 0, 1)), (4, vec(0, 0.75, 0.66144))], "id long, semantic array<double>")
    got = {r.id: r for r in G.average_groups(df, 0.35).collect()}
    assert got[1].cluster == got[2].cluster == 1 and got[3].cluster == 3 != got[4].cluster or got[3].cluster == got[4].cluster == 3
    assert got[1].confidence == pytest.approx(0.9987, abs=1e-3)
    pair = spark.createDataFrame([(1, vec(1)), (2, vec(0.75, 0.66144))], "id long, semantic array<double>")
    assert {r.cluster for r in G.average_groups(pair, 0.20).collect()} == {1, 2} and {r.cluster for r in G.average_groups(pair, 0.30).collect()} == {1}


def test_vectors_are_sent_to_a_fixed_number_of_blocks(spark, monkeypatch):
    """Four times the rows are not sent to four times the blocks, and the pairs are those of all products."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 8)
    monkeypatch.setattr(G, "STRIP_ROWS", 5)
    for n in (200, 800):
        x = np.random.default_rng(n).normal(size=(n, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = G.near_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, semantic array<double>"), 0.8)
        got = {(r.a, r.b): r.score for r in found.collect()}
        score = x @ x.T
        assert got == pytest.approx({(i, j): score[i, j] for i in range(n) for j in range(i + 1, n) if score[i, j] >= 0.8})
    assert -(-800 // max(-(-800 // G.BLOCKS), G.BLOCK_ROWS)) == G.BLOCKS and G.arrow_blocks(pa.table({"semantic": [[1.0], None]}), ["semantic"])["semantic"].tolist() == [[1.0], [0.0]]


def test_cuts_share_one_search(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, semantic array<double>")
    calls, plain = [], G.near_pairs
    monkeypatch.setattr(G, "near_pairs", lambda *a: calls.append(a[1]) or plain(*a))
    both = [{r.id: (r.cluster, r.confidence) for r in g.collect()} for g in G.average_groups_at(df, [0.45, 0.2])]
    assert len(calls) == 1 and both == [{r.id: (r.cluster, r.confidence) for r in G.average_groups(df, c).collect()} for c in (0.45, 0.2)]


def test_layout_can_join_but_not_alone(spark):
    rows = [(1, vec(1), vec(1)), (2, vec(0.6, 0.8), vec(1)), (3, vec(0.6, -0.8), vec(0, 1)), (4, vec(0.6, 0, 0.8), None)]
    got = {(r.a, r.b): r.score for r in G.near_pairs(spark.createDataFrame(rows, "id long, semantic array<double>, layout array<double>"), -1.0, kinds=("semantic", "layout"), block_rows=2).collect()}
    assert got[1, 2] == pytest.approx(0.55 * 0.6 + 0.45) and got[1, 3] == pytest.approx(0.6) and got[1, 4] == pytest.approx(0.6) and len(got) == 6


def test_stable_ids_and_carried_groups(spark):
    old = spark.createDataFrame([(i, i // 4) for i in range(12)], "id long, cluster long")
    new = spark.createDataFrame([(i, {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}.get(i, 5 if i < 9 else 9)) for i in range(12)], "id long, cluster long")
    got = {r.id: r.group for r in G.stable_ids(old, new).collect()}
    assert got[0] == 0 and got[5] == 1 and got[9] == 2 and got[3] == 3
    identity = "struct<dev:bigint,ino:bigint,size:bigint,mtime_ns:bigint>"
    before = spark.createDataFrame([("a", (1, 1, 1, 1), 5), ("b", (1, 2, 1, 1), 5), ("c", (1, 3, 1, 1), 6)], f"path string, identity {identity}, group long")
    after = spark.createDataFrame([("moved", (1, 1, 1, 1)), ("b", (1, 2, 9, 1)), ("c", (1, 3, 1, 1)), ("new", (1, 8, 1, 1))], f"path string, identity {identity}")
    assert {r.path: (r.group, r.stale) for r in G.carried_groups(before, after).collect()} == {"moved": (5, True), "b": (None, False), "c": (6, False), "new": (None, False)}


def test_ranked_groups(spark):
    df = spark.createDataFrame([("B", 1), ("a", 1), ("c", 2), ("d", 3), ("E", 3), ("f", 3), ("A0", 9)], "path string, cluster long")
    got = {r.path: (r.group, r.rank) for r in G.ranked_groups(df).collect()}
    assert got == {"d": (0, 0), "E": (0, 1), "f": (0, 2), "a": (1, 3), "B": (1, 4), "A0": (2, 5), "c": (3, 6)}


# labels


def test_weak_labels(spark):
    rows = [(f"d/акт приёмки {i}.pdf",) for i in range(5)] + [(f"d/дс соглашение {i}.pdf",) for i in range(5)] + [(f"d/персона{i}.pdf",) for i in range(6)] + [("d/акт приёмки дс соглашение.pdf",)]
    df = spark.createDataFrame(rows, "path string").withColumn("origin", F.col("path"))
    labels, support = L.weak_labels(df)
    got = {r.id: r.labels for r in labels.collect()}
    assert got["d/акт приёмки 1.pdf"] == ["акт_приемки"] and got["d/дс соглашение 2.pdf"] == ["дс_соглашение"] and got["d/персона1.pdf"] == []
    assert got["d/акт приёмки дс соглашение.pdf"] == ["акт_приемки", "дс_соглашение"] and {r.label: r.support for r in support.collect()} == {"акт_приемки": 6, "дс_соглашение": 6}


def test_registered_name_groups_use_the_operators_bound(spark, monkeypatch):
    from siltstone import catalog_queries as C

    pairs = {"name": ["red widget", "red gadget"], "brand": ["Brand#1", "Brand#2"]}
    rows = [(k, n, b, "STANDARD TIN", 5) for k, (n, b) in enumerate(zip(pairs["name"], pairs["brand"], strict=True))] + [(9, "zzz qqq", "Brand#7", "PROMO COPPER", 5)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    monkeypatch.setattr(C, "read", lambda *_: parts)
    names = C.part_names(spark, "")
    score = N.scored_pairs(N.features(names), 0.4).agg(F.max("score")).first()[0]
    assert 0.4 <= score < 0.8
    assert C.QUERIES["name_groups"](spark, "").select("cluster").distinct().count() == 2


def test_labels_outside_the_sample_are_kept(spark):
    draw = np.random.default_rng(8)
    base = np.eye(8)
    rows, labels = [], []
    for i in range(400):
        k = 2 if i in (7, 133, 291) else i % 2
        v = base[k] + draw.normal(0, 0.4, 8)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)]))
        labels.append((i, [f"c{k}"] if k == 2 or i % 4 < 2 else []))
    v, lab = spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(labels, "id long, labels array<string>")
    got = {r.id: r for r in L.open_set_classes(v, lab, sample_rows=30).collect()}
    known = {i: x[0] for i, x in labels if x}
    assert {i: got[i]["class"] for i in known if i in got} == known and all(got[i].confidence == 1.0 for i in known)


def test_open_set_classes(spark):
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(45):
        v = np.eye(8)[i % 3] + draw.normal(size=8) * 0.05
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
        labels.append((i, [f"class{i % 3}"] if i % 3 < 2 and i < 30 else []))
    far = np.eye(8)[7]
    rows.append((99, far.tolist()))
    got = {r.id: r["class"] for r in L.open_set_classes(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(labels, "id long, labels array<string>")).collect()}
    assert all(got.get(i) == f"class{i % 3}" for i in range(45) if i % 3 < 2 and i < 30) and got[2].startswith("other_") and 99 not in got
    assert L.density_clusters(np.zeros((3, 2))).tolist() == [-1] * 3


# images and encoding


def test_image_features():
    page = np.full((600, 800, 3), 255, np.uint8)
    page[100:120, 100:700] = 0
    one, two = images.perceptual_hash(page), images.perceptual_hash(np.clip(page.astype(int) - 5, 0, 255).astype(np.uint8))
    assert len(one["hash"]) == 128 and one["aspect"] == 1.333 and bin(int(one["hash"], 16) ^ int(two["hash"], 16)).count("1") < 16
    layout = images.layout(page, [[(100, 100), (700, 100), (700, 120), (100, 120)], [(100, 300), (300, 320)]])
    assert layout.shape == (128,) and np.linalg.norm(layout) == pytest.approx(1, abs=1e-5)


def test_gradient_bits_are_set_where_brightness_falls():
    falls = np.repeat(np.linspace(255, 0, 170)[None, :], 160, axis=0)
    bits = lambda g: bin(int(images.perceptual_hash(np.repeat(g[:, :, None], 3, axis=2).astype(np.uint8))["hash"][64:], 16)).count("1")
    assert bits(falls) == 256 and bits(falls[:, ::-1]) == 0


def test_layout_counts_boxes_by_cell():
    page = np.full((80, 80, 3), 255, np.uint8)
    got = images.layout(page, [[(0, 0), (25, 15)], [(20, 5)], [], [(200, 200), (90, 90)]])[:64].reshape(8, 8)
    want = np.zeros((8, 8))
    want[0:2, 0:3] += 1
    want[0, 2] += 1
    want[7, 7] += 1
    assert got / got[0, 0] == pytest.approx(np.log1p(want) / np.log(2), abs=1e-6) and np.isfinite(images.layout(page, [])).all()


def test_encoding_and_refresh(spark):
    from siltstone.functions import vectors as V

    def encoder():
        def run(texts):
            out = np.array([np.random.default_rng(sum(map(ord, t))).normal(size=16) for t in texts])
            return out / np.linalg.norm(out, axis=1, keepdims=True)

        return run

    df = spark.createDataFrame([("a", ["one text", "two"], ["x/Отчёт.pdf"]), ("b", [], ["x/Акт.pdf"]), ("c", None, [])], "path string, samples array<string>, paths array<string>")
    made = E.passages(df)
    for r in made.filter("size(passages) > 0").collect():
        assert sum(p.weight for p in r.passages) == pytest.approx(1)
    got = {r.path: r for r in E.encode(made, encoder).collect()}
    assert np.linalg.norm(got["a"].embedding) == pytest.approx(1, abs=1e-5) and got["b"].content_embedding is None and got["c"].failed
    parts = {r.path: r.passages for r in made.collect()}["a"]
    vectors = encoder()([p.text for p in parts])
    scale = (0.23 + 0.12 + 0.60)  # what the weights were divided by
    meta = sum(p.weight * scale * v for p, v in zip(parts, vectors, strict=True) if not p.content)
    one = spark.createDataFrame([(list(map(float, got["a"].content_embedding)), got["a"].content_embedding_norm, meta.tolist())], "c array<double>, n double, m array<double>")
    again = one.select(V.refreshed(F.col("c"), F.col("n"), F.col("m"))).first()[0]
    assert np.abs(np.array(again) - np.array(got["a"].embedding)).max() < 1e-3

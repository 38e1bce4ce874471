import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import neardup
from tests.llm.cases import awkward, empty, words

SCHEMA = "doc_id long, text string"


def brute(rows, width, percent):
    """Smallest reachable id of each row, by comparing all pairs of full shingle sets."""
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k]:
                same = len(sets[i] & sets[k])
                if 100 * same >= percent * (len(sets[i]) + len(sets[k]) - same):
                    a, b = root(i), root(k)
                    label[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def edited(text, draw, n):
    w = text.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
    return " ".join(w)


def groups(seed, families=12, size=8, most_edits=6):
    draw, texts = random.Random(seed), []
    for f in range(families):
        base = words(seed * 100 + f, draw.randrange(8, 160), 5000)
        texts += [base, base.upper()] + [edited(base, draw, draw.randrange(1, most_edits)) for _ in range(size)]
    texts += ["", None, "one", "ONE", "two words", "two  words", "a b c"]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_classes_against_brute_force(spark, seed, width, percent):
    rows = groups(seed)
    want = brute(rows, width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, percent=percent).collect()}
    assert got == want


def test_long_lists_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    draw, base = random.Random(5), words(9, 120, 5000)
    texts = [base] + [edited(base, draw, draw.randrange(1, 9)) for _ in range(150)] + [words(i, 90, 5000) for i in range(20)]
    rows = list(enumerate(texts))
    want = brute(rows, 3, 85)
    inner = neardup.links_of_groups
    monkeypatch.setattr(neardup, "links_of_groups", lambda *a: inner(*a, block=40))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect()}
    assert got == want and len({c for _, c in got.values()}) > 20


def test_groups_of_many_parts(spark, monkeypatch):
    """Long lists of texts that share passages but are no copies: parts that no pivot brings together."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    draw, shared = random.Random(6), words(1, 70, 5000)
    texts = []
    for f in range(9):
        base = shared + " " + words(50 + f, 30, 5000)
        texts += [base] + [edited(base, draw, draw.randrange(0, 4)) for _ in range(9)]
    rows = list(enumerate(texts))
    want = brute(rows, 3, 85)
    inner = neardup.links_of_groups
    monkeypatch.setattr(neardup, "links_of_groups", lambda *a: inner(*a, block=7))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect()}
    assert got == want and len({c for _, c in got.values()}) > 5


def test_blocks_return_spanning_links():
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in range(0, 40, 2)]
    nodes, side = np.arange(20), np.arange(20) % 2
    reach = lambda links: _classes(20, links)
    for left in (None, side == 0):
        found = neardup.links_of_blocks(nodes, sets, np.arange(20), 85, left)
        allowed = [(i, k) for i in range(20) for k in range(i) if (left is None or side[i] != side[k]) and len(np.intersect1d(sets[i], sets[k])) * 100 >= 85 * len(np.union1d(sets[i], sets[k]))]
        assert reach(found) == reach(allowed) and len(found) < 20
        assert neardup.links_of_blocks(nodes, sets, np.zeros(20), 85, left) == []


def _classes(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_exact_threshold(spark):
    w = [f"w{i}" for i in range(102)]  # 100 shingles
    rows = [(1, " ".join(w)), (2, " ".join(w[: 87])), (3, " ".join(w[: 86]))]  # 85 and 84 of 100
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows[:2], SCHEMA), width=3, percent=85).collect()}
    assert got == {1: 1, 2: 1}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([rows[0], rows[2]], SCHEMA), width=3, percent=85).collect()}
    assert got == {1: 1, 3: 3}


def test_signature_agreement_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    x, y = neardup.signatures([neardup.finished(a), neardup.finished(b)])
    assert abs((x == y).mean() - 900 / 1100) < 0.2 and neardup.least_matches(85) < 0.85 * 64 - 9


def test_shingles_of_short_texts():
    sets = list(neardup.shingle_sets(pa.array(["a b", "A  B", "a", "", None, "a b c", "b a"]), 3))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 1, 1] and sets[0] == sets[1] and len({int(s[0]) for s in sets if len(s)}) == 4


def test_near_duplicates_awkward(spark):
    got = neardup.near_duplicates(awkward(spark), width=3, percent=85).toPandas()
    assert len(got) == 13
    by = got.set_index(got.doc_id.fillna(-1)).component_id
    assert by[7] == 1 and by[1] == 1 and (by[8] == 8).all() and by[2] == 2 and by[3] == 3
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_representatives_keep_one_of_each_group(spark):
    df = awkward(spark)
    kept = neardup.representatives(df, width=3, percent=85)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and 1 in ids and 7 not in ids and ids.count(8) == 1 and {2, 3, 4, 6, 9, 10} <= set(ids) and ids.count(None) == 2
    assert neardup.representatives(empty(spark)).count() == 0

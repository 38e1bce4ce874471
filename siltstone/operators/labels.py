"""Weak labels from names and folders, and an open-set classifier that extends them over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.components import components
from siltstone.sources.scratch import materialise

# Bounds of a label's documents, of two labels' overlap, and of the open set.
LEAST_DOCUMENTS, MOST_SHARE, ALIAS_OVERLAP, ALIAS_RATIO = 5, 0.8, 0.85, 1.25
MARGIN, CENTROID_LEAST, CENTROID_SLACK, MERGE, MERGE_SHARED, SVM_C = 0.15, 0.12, 0.12, 0.97, 0.90, 0.25


def terms(catalog: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, term, in_name): the label terms of every name a document has or had, and of its folders."""
    paths = F.array_distinct(F.array_compact(F.array(F.col("path"), F.col("origin") if "origin" in catalog.columns else F.col("path"))))
    each = catalog.select(F.col(id_col).alias("id"), F.explode(paths).alias("_p"))
    names = each.select("id", F.explode(X.label_terms(X.stem(F.col("_p")))).alias("term"), F.lit(True).alias("in_name"))
    parts = each.select("id", F.explode(F.split(X.folder(F.col("_p")), "/")).alias("part"))
    folders = parts.select("id", F.explode(X.label_terms(F.col("part"))).alias("term"), F.lit(False).alias("in_name"))
    return names.unionByName(folders).groupBy("id", "term").agg(F.max("in_name").alias("in_name"), F.max(~F.col("in_name")).alias("in_folder"))


def usable_terms(found: DataFrame, n: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(term, df) of the terms that enough, and not too many, documents have."""
    limit = max(least, int(n * MOST_SHARE) + 1)
    return found.groupBy("term").agg(F.count_distinct("id").alias("df")).filter((F.col("df") >= least) & (F.col("df") < limit))


def aliases(found: DataFrame, usable: DataFrame) -> DataFrame:
    """(term, label): terms that nearly the same documents have are one label, named by a pair of words if
    there is one, then by the shortest, then by the first."""
    held = found.select("id", "term").distinct().join(usable, "term")
    both = held.alias("x").join(held.alias("y"), F.expr("x.id = y.id and x.term < y.term")).groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b"), F.col("x.df").alias("da"), F.col("y.df").alias("db")).agg(F.count("*").alias("n"))
    near = (F.col("n") / F.least("da", "db") >= ALIAS_OVERLAP) & (F.greatest("da", "db") / F.least("da", "db") <= ALIAS_RATIO)
    member = components(both.filter(near).select("a", "b"))
    rooted = usable.join(member, usable["term"] == member["node"], "left").select("term", F.coalesce("root", "term").alias("root"))
    best = F.min(F.struct((~F.contains(F.col("term"), F.lit("_"))).alias("single"), F.length("term").alias("n"), F.col("term").alias("term")))["term"]
    return rooted.join(rooted.groupBy("root").agg(best.alias("label")), "root").select("term", "label")


def weak_labels(catalog: DataFrame, id_col: str = "path", least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """((id, labels), (label, support)). One label in the name outweighs those of the folders."""
    found = materialise(terms(catalog, id_col), "terms")
    usable = materialise(usable_terms(found, catalog.count(), least), "usable")
    named = materialise(aliases(found, usable), "aliases")
    held = found.join(named, "term")
    grouped = held.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("in_name"), F.col("label")))).alias("_n"), F.array_sort(F.collect_set(F.when(F.col("in_folder"), F.col("label")))).alias("_f"))
    labels = F.when(F.size("_n") == 1, F.col("_n")).otherwise(F.array_sort(F.array_union("_n", "_f")))
    ids = catalog.select(F.col(id_col).alias("id"))
    support = held.groupBy("label").agg(F.count_distinct("id").alias("support"))
    return ids.join(grouped, "id", "left").select("id", F.coalesce(labels, F.array().cast("array<string>")).alias("labels")), support


def density_clusters(vectors: np.ndarray, least: int = 5, neighbours: int = 2) -> np.ndarray:
    """Labels of dense clusters, -1 for noise, by mutual reachability and excess of mass; all rows may be one cluster."""
    n = len(vectors)
    if n < least:
        return np.full(n, -1)
    squares, nth = (vectors**2).sum(1), min(neighbours, n) - 1

    def distances(a: int, b: int) -> np.ndarray:
        """Of rows a to b from all rows; the whole table would grow with the square of the rows."""
        own = vectors[a:b]
        return np.sqrt(np.maximum(((own[:, None] - vectors[None]) ** 2).sum(axis=2) if n <= 512 else squares[a:b, None] + squares[None] - 2 * own @ vectors.T, 0))

    core = np.concatenate([np.partition(distances(a, min(a + 256, n)), nth, axis=1)[:, nth] for a in range(0, n, 256)])
    # minimum spanning tree, then its edges in order build the hierarchy
    inside, best, via = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(distances(at, at + 1)[0], np.maximum(core[at], core))
        closer = reach < best
        best[closer], via[closer] = reach[closer], at
        best[inside] = np.inf
        at = int(best.argmin())
        edges.append((float(best[at]), int(via[at]), at))
    parent, size, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), [0.0] * (2 * n - 1)
    children: dict[int, tuple[int, int]] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (h, a, b) in enumerate(sorted(edges)):
        x, y, new = root(a), root(b), n + k
        parent[x] = parent[y] = new
        children[new], height[new], size[new] = (x, y), h, size[x] + size[y]

    def leaves(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += children[j]
        return out

    density = lambda h: 1 / max(h, 1e-12)

    def walk(top: int, birth: float) -> tuple[float, list[int]]:
        """(stability, clusters) of the best choice at or below the cluster that begins at ``top``."""
        mass, node = 0.0, top
        while node >= n:
            x, y = children[node]
            level = density(height[node])
            big = [c for c in (x, y) if size[c] >= least]
            if len(big) == 2:
                mass += size[node] * (level - birth)
                parts = [walk(c, level) for c in big]
                below = sum(p[0] for p in parts)
                return (below, [c for p in parts for c in p[1]]) if below > mass else (mass, [top])
            if not big:
                mass += size[node] * (level - birth)
                break
            mass += (size[node] - size[big[0]]) * (level - birth)
            node = big[0]
        return mass, [top]

    top = 2 * n - 2
    _, found = walk(top, density(height[top]))
    out = np.full(n, -1)
    for label, c in enumerate(sorted(found, key=lambda c: min(leaves(c)))):
        out[leaves(c)] = label
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = SVM_C, steps: int = 400) -> np.ndarray:
    """Squared-hinge linear classifiers, one against the rest: (classes, dimensions + 1) by accelerated gradient."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    classes = np.unique(y)
    out = np.zeros((len(classes), xb.shape[1]))
    count = np.array([weight[y == k].sum() for k in classes])
    for row, k in enumerate(classes):
        sign = np.where(y == k, 1.0, -1.0)
        balanced = weight * np.where(y == k, weight.sum() / (2 * count[row]), weight.sum() / (2 * max(weight.sum() - count[row], 1e-9)))
        rate = 1 / (1 + 2 * c * np.linalg.norm(xb * np.sqrt(balanced)[:, None], 2) ** 2)
        w = z = np.zeros(xb.shape[1])
        t = 1.0
        for _ in range(steps):
            slack = np.maximum(0, 1 - sign * (xb @ z))
            new = z - rate * (z - 2 * c * ((balanced * slack * sign) @ xb))
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            w, z, t = new, new + (t - 1) / t2 * (new - w), t2
        out[row] = w
    return out


def open_set_classes(vectors: DataFrame, labels: DataFrame, id_col: str = "id", sample_rows: int = 20000) -> DataFrame:
    """(id, class, confidence): labelled rows keep their label, unlabelled dense clusters become other_1, ...,
    and a linear classifier extends both; a row of low margin, or far from its class, gets none.

    Fitting takes the ``sample_rows`` rows of the least hashes, and two rows of each label that has fewer than two
    among them; all rows are classified. Which labels count, and how many rows a label has, is taken from all
    rows. Unlabelled dense clusters are searched in the sample.
    ``vectors``: (id, vector of length 1). ``labels``: (id, labels)."""
    joined = vectors.select(F.col(id_col).alias("id"), F.col("vector")).join(labels.select("id", "labels"), "id", "left")
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    single = joined.filter("vector is not null and size(labels) = 1").withColumn("label", F.concat(F.lit("label:"), F.element_at("labels", 1)))
    support = single.groupBy("label").agg(F.count("*").alias("n"), F.min(order)["id"].alias("low"), F.max(order)["id"].alias("high")).toPandas()
    total = {k: int(n) for k, n in zip(support["label"], support["n"], strict=True) if n >= 2}
    sample = joined.filter("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    seen = pd.Series(["label:" + v[0] for v in sample["labels"] if v is not None and len(v) == 1], dtype=object).value_counts()
    rare = [r for r in support.itertuples() if r.label in total and seen.get(r.label, 0) < 2]
    if rare:
        ids = sorted({i for r in rare for i in (r.low, r.high)} - set(sample["id"]))
        wanted = vectors.sparkSession.createDataFrame([(i,) for i in ids], f"id {joined.schema['id'].dataType.simpleString()}")
        sample = pd.concat([sample, joined.join(wanted, "id", "left_semi").toPandas()])
    sample = sample.sort_values("id")
    x = np.array([np.asarray(v, float) for v in sample["vector"]]).reshape(len(sample), -1)
    held = [list(v) if v is not None else [] for v in sample["labels"]]
    y = np.array(["label:" + v[0] if len(v) == 1 else "" for v in held], object)
    free = np.array([not v for v in held], bool)
    if free.sum() >= 5:
        found = density_clusters(x[free])
        y[np.flatnonzero(free)[found >= 0]] = [f"other_{k + 1}" for k in found[found >= 0]]
    for name in set(y) - {""}:
        if name not in total and (y == name).sum() < 2:
            y[y == name] = ""
    classes = sorted(set(y) - {""})
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, class string, confidence double"
    if not classes or len(sample) < 5:
        return vectors.sparkSession.createDataFrame([], schema)
    train = y != ""
    other = train & free
    given = dict(zip(sample["id"][other], y[other], strict=True))
    centroids = np.array([x[y == k].mean(axis=0) for k in classes])
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    limit = np.array([max(CENTROID_LEAST, np.quantile(x[y == k] @ centroids[i], 0.1) - CENTROID_SLACK) for i, k in enumerate(classes)])
    number = np.array([classes.index(k) for k in y[train]])
    weights = linear_svm(x[train], number, np.ones(train.sum())) if len(classes) > 1 else None
    merged = list(range(len(classes)))
    for i, a in enumerate(classes):
        for j in range(i + 1, len(classes)):
            b = classes[j]
            words = set(a.removeprefix("label:").split("_")) & set(b.removeprefix("label:").split("_"))
            bound = MERGE_SHARED if a.startswith("label:") and b.startswith("label:") and words else MERGE
            if centroids[i] @ centroids[j] >= bound:
                low, high = sorted((merged[i], merged[j]))
                merged = [low if m == high else m for m in merged]
    total |= {k: int((y == k).sum()) for k in classes if k not in total}
    shown = [max((classes[j] for j in range(len(classes)) if merged[j] == merged[i]), key=lambda k: (total[k], -len(k), k)).removeprefix("label:") for i in range(len(classes))]

    at = {k: i for i, k in enumerate(classes)}

    def run(batches):
        for rows in batches:
            out = []
            m = np.array([np.asarray(v, float) for v in rows["vector"]]).reshape(len(rows), -1)
            scores = np.hstack([m, np.ones((len(m), 1))]) @ weights.T if weights is not None else None
            for k, (i, label) in enumerate(zip(rows["id"], rows["label"], strict=True)):
                known = label if label in at else given.get(i)
                if known is not None:
                    out.append((i, shown[at[known]], 1.0))
                elif scores is not None:
                    order = np.argsort(scores[k])
                    best, margin = order[-1], scores[k, order[-1]] - scores[k, order[-2]]
                    near = float(m[k] @ centroids[best])
                    if margin >= MARGIN and near >= limit[best]:
                        out.append((i, shown[best], float(min(0.99, max(0.51, 0.55 + 0.2 * margin + 0.2 * near)))))
            yield pd.DataFrame(out, columns=["id", "class", "confidence"])

    label = F.when(F.size("labels") == 1, F.concat(F.lit("label:"), F.element_at("labels", 1)))
    return joined.select("id", "vector", label.alias("label")).filter("vector is not null").mapInPandas(run, schema)

"""Hard negatives of anchors among labelled vectors of whole numbers, by bounds along a spanning tree of the anchors.

Vectors are dealt to stripes and anchors to tiles, both of bounded size; each tile meets each stripe in one task.  There the
anchors of a tile are cut into blocks of neighbours, each with a minimum spanning tree.  A candidate's score at an anchor
lies within its score (or bounds) at the parent plus or minus the edge's length times the candidate's norm; only
candidates whose bounds overlap the wanted scores are scored anew.  Two passes: the best of the anchor's own label, then the
best of other labels in the window that each of those opens.  What leaves a task is a few rows for each anchor.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchstats.llm.shared import table

#: Positives of an anchor and negatives of each of them; a negative has between LOW and HIGH hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Components that a tile or a stripe holds at most; rows of a step; anchors of a spanning tree; least rows of a stripe.
VALUES, STEP, BLOCK, LEAST = 4_000_000, 4096, 256, 2048
#: Rows with a longer vector take no part: their scores need not fit a long.
LARGEST = float(1 << 62)


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): the rows with an id, a label and a vector of finite components, which become floor(scale * x)."""
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(good)
    rows = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.floor(v * scale).cast("double") * F.floor(v * scale)) < LARGEST)
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: rows in the order in which they join it, the row each is tied to
    (itself for the first), and their distance."""
    n, norms = len(x), np.einsum("ij,ij->i", x, x)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    far, tied, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    now = int(np.argmin(norms))
    parent[now] = now
    for k in range(n):
        order[k], out[now] = now, False
        if k:
            parent[now] = tied[now]
            edge[now] = math.sqrt(max(float(((x[now] - x[tied[now]]) ** 2).sum()), 0.0))
        d = norms + norms[now] - 2 * (x @ x[now])
        closer = out & (d < far)
        far[closer], tied[closer] = d[closer], now
        if k + 1 < n:
            now = int(np.argmin(np.where(out, far, np.inf)))
    return order, parent, edge


def blocks(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows cut in halves along the line between two far ones until BLOCK are left."""
    out, todo = [], [rows]
    while todo:
        own = todo.pop()
        if len(own) <= BLOCK:
            out.append(own)
            continue
        a = x[own[np.argmax(((x[own] - x[own[0]]) ** 2).sum(1))]]
        b = x[own[np.argmax(((x[own] - a) ** 2).sum(1))]]
        half = np.argsort(x[own] @ (b - a), kind="stable")
        todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores; of equal ones those with the smaller ids."""
    if len(score) > 4 * k:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


class Wanted:
    """What an anchor still looks for: ranges of scores, and the k best found in each.  A full range's lower end rises to
    the worst score kept."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)

    def overlaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for a, b in zip(self.low, self.high):
            out |= (high >= a) & (low <= b)
        return out

    def narrow(self, low: np.ndarray, high: np.ndarray) -> None:
        """Raises the lower ends by bounds alone: k candidates that are sure to lie in a range, with scores of at least the
        k-th highest of their lower bounds."""
        for i, (a, b) in enumerate(zip(self.low, self.high)):
            sure = low[(low >= a) & (high <= b)]
            if len(sure) >= self.k:
                self.low[i] = max(a, math.floor(np.partition(sure, len(sure) - self.k)[len(sure) - self.k]))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        for i, (a, b) in enumerate(zip(self.low, self.high)):
            keep = (score >= a) & (score <= b)
            if keep.any():
                s, d = self.found[i]
                s, d = self.found[i] = best(np.concatenate([s, score[keep]]), np.concatenate([d, ids[keep]]), self.k)
                if len(s) == self.k:
                    self.low[i] = max(self.low[i], s[-1])


def search(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, anchor_labels: np.ndarray, wanted: list[Wanted], same: bool) -> int:
    """Fills wanted with the candidates of each anchor's own label (same) or of others; the number of scores worked out."""
    norm, own = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)), np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    small = norm.max(initial=0) * own.max(initial=0) < float(1 << 52)  # sums of doubles are exact
    x, a = (v.astype(np.float64) if small else v for v in (vectors, anchors))
    plain, scored = anchors.astype(np.float64), 0
    for block in blocks(plain, np.arange(len(anchors))):
        order, parent, edge = spanning_tree(plain[block])
        last = np.zeros(len(block), np.int64)  # after which step of the order a row's bounds are needed no more
        for step, i in enumerate(order):
            last[parent[i]] = step
        for at in range(0, len(x), STEP):
            part, part_ids, part_labels, part_norm = x[at : at + STEP], ids[at : at + STEP], labels[at : at + STEP], norm[at : at + STEP]
            bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for step, i in enumerate(order):
                row, up = block[i], parent[i]
                if up == i:
                    score = (part @ a[row]).astype(np.float64)
                    slack = part_norm * (own[row] * 1e-12) + 1
                    bounds[i] = score - slack, score + slack
                    scored += len(part)
                else:
                    slack = part_norm * (edge[i] * (1 + 1e-9) + own[row] * 1e-12) + 1
                    bounds[i] = bounds[up][0] - slack, bounds[up][1] + slack
                side = np.flatnonzero((part_labels == anchor_labels[row]) if same else (part_labels != anchor_labels[row]))
                low, high = bounds[i][0][side], bounds[i][1][side]
                wanted[row].narrow(low, high)
                need = side[wanted[row].overlaps(low, high)]
                if len(need):
                    score = part[need] @ a[row]
                    scored += len(need)
                    bounds[i][0][need] = bounds[i][1][need] = score
                    wanted[row].add(score.astype(np.int64), part_ids[need])
                for j in (up, i):
                    if last[j] <= step and j in bounds:
                        del bounds[j]
    return scored


def _matrix(group: pa.Table, dim: int) -> np.ndarray:
    flat = group.column("q").combine_chunks()
    return np.asarray(flat.flatten() if len(flat) else pa.array([], pa.int64()), np.int64).reshape(len(flat), dim)


def _meet(rows: DataFrame, anchors: DataFrame, stripes: int, tiles: int, same: bool, k: int) -> DataFrame:
    """(a, j, score, id): from each stripe, the k best candidates of each anchor (named a) in its j-th range."""
    grid = ["dim", "stripe", "tile"]
    left = rows.select("id", "label", "q", "dim", "stripe", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    right = anchors.select("a", "label", "q", "low", "high", "dim", "tile", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))

    def run(key, left, right):
        dim, low, high = key[0].as_py(), right.column("low").to_pylist(), right.column("high").to_pylist()
        wanted = [Wanted(np.array(x, np.int64), np.array(y, np.int64), k) for x, y in zip(low, high)]
        if len(left) and len(right):
            search(
                _matrix(left, dim), np.asarray(left.column("id"), np.int64), np.asarray(left.column("label"), np.int64),
                _matrix(right, dim), np.asarray(right.column("label"), np.int64), wanted, same,
            )
        a, j, score, ids = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, w in zip(right.column("a").to_pylist(), wanted):
            for i, (s, d) in enumerate(w.found):
                a += [name] * len(s)
                j += [i] * len(s)
                score.append(s)
                ids.append(d)
        return pa.table({"a": pa.array(a, pa.int64()), "j": pa.array(j, pa.int32()), "score": np.concatenate(score), "id": np.concatenate(ids)})

    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(run, "a long, j int, score long, id long")


def _first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn(name, at).where(F.col(name) <= k)


def mine(vectors: DataFrame, is_anchor) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among the vectors.

    vectors has vec_id (a whole number), label and q (a list of whole numbers); is_anchor is a condition on them.  An
    anchor's positives are its POSITIVES highest-scoring other rows of its label, a positive's negatives the NEGATIVES
    highest-scoring rows of other labels with LOW to HIGH hundredths of the positive's score; ties go to the smaller vec_id.
    Each row is a candidate of its own, also where rows repeat; an anchor that repeats as a whole is one anchor (and its
    repetition may be its positive).  Rows only meet rows with as many components.  Labels may be any whole numbers; an
    empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "q", F.size("q").alias("dim"), F.monotonically_increasing_id().alias("a"), is_anchor.alias("anchor"))
    rows = table(rows, "vectors")
    n, anchors, most = rows.agg(F.count("*"), F.count_if("anchor"), F.max("dim")).first()
    each = max(1, VALUES // max(1, most or 1))
    stripes = max(1, math.ceil(n / each), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))
    tiles = max(1, math.ceil(anchors / each))
    rows = rows.withColumn("stripe", F.pmod(F.xxhash64("a"), F.lit(stripes)).cast("int"))
    heads = rows.where("anchor").groupBy("id", "label", "q", "dim").agg(F.min("a").alias("a")).withColumn("tile", F.pmod(F.xxhash64("a"), F.lit(tiles)).cast("int"))
    heads = table(heads.withColumn("self", F.expr("aggregate(q, 0L, (s, v) -> s + v * v)")), "anchors")
    ends = F.array(F.lit(-(1 << 63)).cast("long")), F.array(F.lit((1 << 63) - 1).cast("long"))
    found = _meet(rows, heads.withColumns({"low": ends[0], "high": ends[1]}), stripes, tiles, True, POSITIVES + 1)
    # Among the best there may be the anchor itself: one row with its id and its score with itself is no other row.
    top = _first(found, ["a"], POSITIVES + 1, "k").join(heads.select("a", F.col("id").alias("own"), "self"), "a")
    own = (F.col("id") == F.col("own")) & (F.col("score") == F.col("self"))
    top = top.withColumn("itself", own & (F.sum(own.cast("int")).over(Window.partitionBy("a").orderBy("k")) == 1)).where("not itself")
    top = _first(top.drop("k"), ["a"], POSITIVES, "k").select("a", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    top = table(top, "positives")
    # With a positive's score s, whole numbers from ceil(LOW s / 100) to floor(HIGH s / 100); none for s < 0.
    share = lambda part, up: F.expr(f"(positive_score div 100) * {part} + ((positive_score % 100) * {part} + {up}) div 100")
    ranges = top.where("positive_score >= 0").select("a", F.struct("k", share(LOW, 99).alias("low"), share(HIGH, 0).alias("high")).alias("r"))
    ranges = ranges.groupBy("a").agg(F.array_sort(F.collect_list("r")).alias("r")).select("a", F.col("r.low").alias("low"), F.col("r.high").alias("high"), F.col("r.k").alias("ks"))
    asked = table(heads.join(ranges, "a"), "ranges")
    found = _meet(rows, asked, stripes, tiles, False, NEGATIVES).join(asked.select("a", F.col("id").alias("anchor_id"), "ks"), "a")
    found = _first(found.select("a", "anchor_id", F.expr("ks[j]").alias("k"), "score", "id"), ["a", "k"], NEGATIVES, "rank")
    return found.join(top, ["a", "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

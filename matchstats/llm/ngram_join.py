"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles, and documents of equal sets are one class.  A path is a list of chosen
min-hash coordinates with their values: at a node of the path tree each coordinate is chosen with a chance of
1 / (similarity * coordinates), and the classes there split by their value of it, so a class goes on along about
1 / similarity paths.  Buckets of few classes are compared by brute force, larger ones split again; a bucket that is
still large at the last level holds classes that agree almost everywhere and is compared in blocks.  Runs with new
choices are added until the chance that a pair at the threshold meets in none of them is below 1 - recall.

A pair meets in several buckets but counts in one only: the smallest of the buckets both classes reached.  So link
counts and a spanning star of each bucket leave it, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.llm.shared import components, gram_hashes, lists, mix, signed, steps, table, whole_groups

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Min-hash coordinates of a class.
COORDINATES = 64
#: Classes of a bucket that is not split again; levels of splits; classes and shingles of a block of a bucket that is
#: still larger (or has very long texts).
SMALL, LEVELS, BLOCK, BLOCK_SHINGLES = 100, 3, 1000, 4_000_000
#: Pairs with a lower estimate are not compared in full: four and a half standard errors below the similarity.
SLACK = 4.5


def shingle_sets(h: np.ndarray, sizes: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of some texts, sorted within each, and their numbers.

    A text of fewer than k words is one shingle, one without words has none.
    """
    g = gram_hashes(h, k)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero((at + k <= np.repeat(sizes, sizes))[: len(g)])
    text, g = text[whole], g[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    first = np.cumsum(sizes) - sizes
    few = np.array([_short(h[first[i] : first[i] + sizes[i]]) for i in short], np.uint64)
    text, g = np.concatenate([text, short]), np.concatenate([g, few])
    order = np.lexsort((g, text))
    text, g = text[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (text[1:] != text[:-1]) | (g[1:] != g[:-1])
    return g[new], np.bincount(text[new], minlength=len(sizes)).astype(np.int64)


def _short(words: np.ndarray) -> int:
    total = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            total = total * np.uint64(0x9E3779B97F4A7C15) + w
    return int(mix(np.array([total]))[0])


def seeds(n: int = COORDINATES) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, size, mh) for each row with words: a 128-bit name of its shingle set, its size, its min-hashes."""

    def run(batches):
        salts = seeds()
        for batch, h, sizes in steps(batches):
            g, n = shingle_sets(h, sizes)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            first = (np.cumsum(n) - n)[some]
            a, b = names(g, n[some], first)
            low = np.stack([np.minimum.reduceat(mix(g ^ s), first) for s in salts], axis=1)
            mh = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some)), pa.array(signed(a)), pa.array(signed(b)), pa.array(n[some]), lists(mh.ravel(), np.full(len(some), len(salts)), pa.int32())],
                ["doc_id", "a", "b", "size", "mh"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, a long, b long, size long, mh array<int>")


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with a chance of `recall`.

    At each level a pair follows a Poisson number of common paths with mean 1; the chance q of no meeting below a node
    obeys q = exp(q' - 1), q' being that of its children, and q' = 0 at a leaf.  The deepest tree is assumed.  This is an
    average over draws at the root; root_runs() reckons with the one draw there is.
    """
    q = 0.0
    for _ in range(levels):
        q = math.exp(q - 1.0)
    return math.ceil(math.log(1 - recall) / math.log(q))


def chosen(names: np.ndarray, similarity: float) -> np.ndarray:
    """Which coordinates (columns) are chosen at some nodes (rows)."""
    at = np.arange(COORDINATES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (mix(names[:, None] ^ (at + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) < int(2**32 / (similarity * COORDINATES))


def run_names(node: np.ndarray, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(node + np.uint64(r * 0x9E37 + 1))


def least_estimate(similarity: float) -> float:
    return similarity - SLACK * math.sqrt(similarity * (1 - similarity) / COORDINATES)


def missed(times: np.ndarray, similarity: float = SIMILARITY, levels: int = LEVELS) -> float:
    """The chance that a pair at the threshold is not found, if times[c] runs choose coordinate c at the root.

    The root's choices are the same for all pairs.  A pair agrees on k coordinates, which is binomial, and along each of
    them that is chosen it fails to meet with a chance of q, by what is chosen further down; the mean over all sets of k
    coordinates is that of the products of q ** times.  Pairs below the least estimate are not found at all.
    """
    total, chance = 0.0, 1 / (similarity * COORDINATES)
    for k in range(COORDINATES + 1):
        weight = math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)
        if k / COORDINATES >= least_estimate(similarity):
            q = 0.0
            for _ in range(levels - 1):
                q = (1 - chance * (1 - q)) ** k
            sums = np.zeros(COORDINATES + 1)
            sums[0] = 1
            for n in times:
                sums[1:] = sums[1:] + sums[:-1] * q ** int(n)
            weight *= sums[k] / math.comb(COORDINATES, k)
        total += weight
    return total


def root_runs(recall: float = RECALL, similarity: float = SIMILARITY, levels: int = LEVELS) -> list[int]:
    """The numbers of the runs that are made: those that choose something at the root, at least as many run numbers as
    runs_for() and more until the choices really drawn reach the recall."""
    if missed(np.full(COORDINATES, 10**6), similarity, levels) > 1 - recall:
        raise ValueError("the estimate from min-hashes alone misses more pairs than the recall allows")
    times, runs, r = np.zeros(COORDINATES, np.int64), [], 0
    while r < runs_for(recall, similarity, levels) or missed(times, similarity, levels) > 1 - recall:
        own = chosen(run_names(np.zeros(1, np.uint64), r), similarity)[0]
        times += own
        runs += [r] * bool(own.any())
        r += 1
    return runs


def children(rows: DataFrame, level: int, runs: list[int], similarity: float) -> DataFrame:
    """(path, rep, size) rows one level down: each class along the coordinates chosen at its node."""

    def run(batches):
        at = np.arange(COORDINATES, dtype=np.uint64)
        for batch in batches:
            mh = np.asarray(batch.column("mh").flatten()).reshape(-1, COORDINATES).view(np.uint32).astype(np.uint64)
            node = np.asarray(batch.column("path")).view(np.uint64)
            for r in runs if level == 0 else [0]:
                name = run_names(node, r) if level == 0 else node
                row, coordinate = np.nonzero(chosen(name, similarity))
                with np.errstate(over="ignore"):
                    path = mix(mix(name[row] + at[coordinate] + np.uint64(7)) ^ (mh[row, coordinate] * np.uint64(0x94D049BB133111EB)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(signed(path)), batch.column("rep").take(take), batch.column("size").take(take)], ["path", "rep", "size"])

    return rows.select("path", "rep", "size", "mh").mapInArrow(run, "path long, rep long, size long")


def buckets(reps: DataFrame, runs: list[int], similarity: float) -> DataFrame:
    """(path, rep, n, shingles) of all leaf buckets of at least two classes; the last two are sums over the bucket."""
    if "size" not in reps.columns:  # of no account but for the blocks
        reps = reps.withColumn("size", F.lit(1).cast("long"))
    done, now = None, reps.select(F.lit(0).cast("long").alias("path"), "rep", "size", "mh")
    for level in range(LEVELS):
        rows = table(children(now, level, runs, similarity).distinct(), "paths")
        counts = table(rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1"), "path-counts")
        rows = table(rows.join(counts, "path"), "buckets")
        last = level == LEVELS - 1
        leaf = rows if last else rows.where(F.col("n") <= SMALL)
        done = leaf if done is None else done.unionByName(leaf)
        if last or rows.where(F.col("n") > SMALL).isEmpty():
            return done
        now = rows.where(F.col("n") > SMALL).select("path", "rep", "size").join(reps.select("rep", "mh"), "rep")


def blocks(rows: DataFrame) -> DataFrame:
    """Gives each row its (i, j) block pairs: one for a small bucket, for a large one all pairs with the row's block.

    A bucket of b blocks is dealt to about b^2 / 2 tasks of at most two blocks each, whose classes and shingles are
    bounded (but for the deal by hash, and for a single longer text).
    """
    fits = (F.col("n") <= 2 * SMALL) & (F.col("shingles") <= 2 * BLOCK_SHINGLES)
    parts = F.when(fits, 1).otherwise(F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    own, other = F.pmod(F.xxhash64("rep"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(other))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def grid_of(paths: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of paths as rows of equal width, filled up with the largest number."""
    lengths = np.asarray(paths.combine_chunks().value_lengths() if isinstance(paths, pa.ChunkedArray) else paths.value_lengths())
    flat = paths.combine_chunks().flatten() if isinstance(paths, pa.ChunkedArray) else paths.flatten()
    grid = np.full((len(lengths), int(lengths.max(initial=0))), np.iinfo(np.int64).max)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = np.asarray(flat)
    return grid


def first_meetings(grid: np.ndarray, here: np.ndarray | int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs (x, y), those whose smallest common bucket is the one they are in (here, by row)."""
    none = np.iinfo(np.int64).max
    below = np.where(grid < (here[:, None] if isinstance(here, np.ndarray) else here), grid, none)
    out = np.ones(len(x), bool)
    for at in range(0, len(x), 20_000):
        left = np.arange(at, min(at + 20_000, len(x)))
        for c in range(grid.shape[1]):  # near copies share their smallest paths, so few pairs go on
            column = below[x[left], c]
            left, column = left[column != none], column[column != none]
            if not len(left):
                break
            same = (below[y[left]] == column[:, None]).any(axis=1)
            out[left[same]] = False
            left = left[~same]
    return out


def pair_steps(ends: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs x < y of rows of one group, about `most` at a time; ends[r] is the end of the group of row r."""
    counts = ends - np.arange(len(ends)) - 1
    before = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")) - 1)
        x = np.repeat(np.arange(at, to), counts[at:to])
        yield x, x + 1 + np.arange(len(x)) - np.repeat(before[at:to] - before[at], counts[at:to])
        at = to


def pairs_of(own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that block pair (i, j) compares: within i if i = j, else between i and j."""
    if i == j:
        return np.triu_indices(len(own), 1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def flag(rows: DataFrame, similarity: float) -> DataFrame:
    """(path, i, j, own, rep) of the classes that have a likely partner, by min-hash estimate, which they first meet there.

    Most buckets are small, so a task takes many of them at once.
    """
    least = math.ceil(least_estimate(similarity) * COORDINATES - 1e-9)
    keys = ("path", "i", "j")

    def run(batches):
        for group in whole_groups(batches, keys):
            path, i, j = (np.asarray(group.column(k)) for k in keys)
            own, mh = np.asarray(group.column("own")), np.asarray(group.column("mh").combine_chunks().flatten()).reshape(-1, COORDINATES)
            new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            ends = np.repeat(np.append(new[1:], len(path)), np.diff(np.append(new, len(path))))
            likely, grid = np.zeros(len(path), bool), None
            for x, y in pair_steps(ends):
                if (two := i[x] != j[x]).any():  # between two blocks, not within them
                    x, y = x[~two | (own[x] != own[y])], y[~two | (own[x] != own[y])]
                keep = np.zeros(len(x), bool)
                for at in range(0, len(x), 20_000):
                    keep[at : at + 20_000] = np.count_nonzero(mh[x[at : at + 20_000]] == mh[y[at : at + 20_000]], axis=1) >= least
                x, y = x[keep], y[keep]
                if len(x):
                    grid = grid_of(group.column("paths")) if grid is None else grid
                    keep = first_meetings(grid, path, x, y)
                    likely[x[keep]] = likely[y[keep]] = True
            if likely.any():
                yield from group.select(["path", "i", "j", "own", "rep"]).filter(pa.array(likely)).to_batches()

    dealt = rows.select(*keys, "own", "rep", "mh", "paths").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "path long, i int, j int, own int, rep long")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of common elements of each pair, by lists of the members that have an element."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[number] > 1
    _, number = np.unique(number[keep], return_inverse=True)
    owner = owner[keep]
    wide = int(number.max()) + 1 if len(number) else 0
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, wide, 8192):
        own = (number >= at) & (number < at + 8192)
        part = np.zeros((len(sets), min(8192, wide - at)), np.float32)
        part[owner[own], number[own] - at] = 1
        both += part @ part.T
    return both[left, right].astype(np.int64)


def verify(rows: DataFrame, similarity: float) -> DataFrame:
    """Exact comparison in each block pair: (rep, links) for every class linked there, and to (a linked smaller class).

    links sums the documents of the partners; `to` joins each linked class to the smallest of its part of the bucket.
    """

    def run(key, group):
        path, i, j = (k.as_py() for k in key)
        sets = [np.asarray(s.values) for s in group.column("shingles")]
        copies, rep = np.asarray(group.column("copies")), np.asarray(group.column("rep"))
        x, y = pairs_of(np.asarray(group.column("own")), i, j)
        sizes = np.array([*map(len, sets)])
        fit = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-9
        x, y = x[fit], y[fit]
        if len(x):
            keep = first_meetings(grid_of(group.column("paths")), path, x, y)
            x, y = x[keep], y[keep]
        if len(x):
            common = common_counts(sets, x, y)
            keep = common >= similarity * (sizes[x] + sizes[y] - common) - 1e-9
            x, y = x[keep], y[keep]
        links = np.bincount(x, copies[y], len(rep)) + np.bincount(y, copies[x], len(rep))
        low = np.arange(len(rep))
        while True:  # smallest member of each linked part
            before = low.copy()
            at = np.where(rep[low[x]] <= rep[low[y]], low[x], low[y])
            order = np.argsort(-rep[at], kind="stable")
            low[x[order]], low[y[order]] = at[order], at[order]
            low = np.where(rep[low[low]] < rep[low], low[low], low)
            if (low == before).all():
                break
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "to": rep[low[some]]})

    return rows.groupBy("path", "i", "j").applyInArrow(run, "rep long, links long, to long")


def names(g: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names (a, b) of some non-empty shingle sets that stand one after another in g."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(g), first) ^ n.astype(np.uint64), np.add.reduceat(mix(g ^ np.uint64(0xA0761D6478BD642F)), first)


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(rep, shingles) of the rows (rep, a, b, text) whose text has the shingle set named (a, b)."""

    def run(batches):
        for batch, h, sizes in steps(batches):
            g, n = shingle_sets(h, sizes)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            a, b = names(g, n[some], (np.cumsum(n) - n)[some])
            good = (signed(a) == np.asarray(batch.column("a"))[some]) & (signed(b) == np.asarray(batch.column("b"))[some])
            sets = lists(signed(g), n, pa.int64()).take(pa.array(some[good]))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(some[good])), sets], ["rep", "shingles"])

    return docs.select("rep", "a", "b", "text").mapInArrow(run, "rep long, shingles array<long>")


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links for every doc_id; only doc_id and text are read, texts may be of any length.

    class_id is the smallest doc_id that is reached by links of at least the similarity; n_links counts the other
    documents (rows) linked to this one directly, copies among them.  Texts without words, null ones too, have no links
    and are classes of their own.  Rows without a doc_id are left out.  Rows of one doc_id each count as a document for
    others; the doc_id itself has one row of results, with the smallest class_id and the largest n_links of its texts.
    An empty table gives an empty one.
    """
    own = table(sketches(docs.where("doc_id is not null")), "sketches")
    reps = own.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("mh").alias("mh"))
    # Numbered when written, so that a class has one number however often the table is read.
    reps = table(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    leaves = buckets(reps, root_runs(recall, similarity, LEVELS), similarity)
    paths = leaves.groupBy("rep").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    paths = table(paths.join(reps.select("rep", "mh", "copies"), "rep"), "class-paths")
    # Spark sizes the block pairs as the leaves that they are exploded from, and would send them all to the driver.
    likely = table(flag(blocks(leaves).join(paths.select("rep", "paths", "mh").hint("merge"), "rep"), similarity), "likely")
    needed = likely.select("rep").distinct().join(reps.select("rep", "a", "b", "doc_id"), "rep")
    # A doc_id may have several texts; those of other sets are passed over.
    sets = table(shingle_rows(docs.select("doc_id", "text").join(needed, "doc_id")).dropDuplicates(["rep"]), "shingles")
    found = table(verify(likely.join(paths.select("rep", "paths", "copies"), "rep").join(sets, "rep"), similarity), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    rooted = reps.select("rep", "a", "b", "doc_id", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = table(rooted.withColumn("root", F.coalesce("root", "rep")), "rooted")
    # Only classes of components of several get their label from a join; a component's smallest doc_id is one row.
    label = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    result = rooted.join(label, "root", "left")
    result = table(result.select("a", "b", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "results")
    all_rows = docs.where("doc_id is not null").select("doc_id").distinct()
    named = own.select("doc_id", "a", "b").join(result, ["a", "b"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return all_rows.join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

The index is stored in blocks of documents.  It holds the postings of the terms that a benchmark asks for, picked by a bit
map of fixed size, so it is built for the benchmark it serves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.llm.shared import lists, signed, steps, table

#: Words of a window.
WINDOW = 13
#: Postings are stored of the terms whose bit is set in a map of 2^TERM_BITS bits (8 MB, whatever the benchmark's size): all
#: terms of the benchmark and a few others.
TERM_BITS = 26
#: Parts of a term's rows where windows are weighed by their terms, and where they look up a term's blocks, so that common
#: words are spread.
SALTS = 16
#: Bytes of text of an index block.
BLOCK_BYTES = 4_000_000


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, terms) for each window of each item: `size` consecutive words, or all words of a shorter item.

    Terms are 64-bit word hashes.  Null or empty texts and rows without an item_id have no window.
    """

    def run(batches):
        for batch, h, sizes in steps(batches):
            ends = np.cumsum(sizes)
            for item, end, n in zip(batch.column("item_id"), ends, sizes):
                if not n:
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(signed(h[end - n : end]), min(size, n))
                for at in range(0, len(rows), 10_000):
                    own = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(own), item.type), lists(own.ravel(), np.full(len(own), own.shape[1]), pa.int64())], ["item_id", "terms"])

    items = benchmark.where("item_id is not null")
    return items.select("item_id", "text").mapInArrow(run, f"item_id {dict(items.dtypes)['item_id']}, terms array<long>")


def term_map(terms: DataFrame) -> np.ndarray:
    """The map of some terms as 64-bit words: at most 2^20 rows of two numbers reach the driver."""
    bit = F.expr("shiftleft(1L, cast(term & 63 AS int))")
    words = terms.groupBy(F.expr(f"(term & {(1 << TERM_BITS) - 1}) >> 6").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (TERM_BITS - 6), np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return out.view(np.uint64)


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: rows (block, term, docs, positions) and, with a null term, the block's documents.

    A block is a run of documents with at most BLOCK_BYTES bytes (or one longer document).  docs holds a document's
    number in the block once for each of its postings, positions the word number of each.  The row without a term has
    the doc_ids and the numbers of words.  The index serves searches for the given terms.
    """
    known = docs.sparkSession.sparkContext.broadcast(term_map(terms))  # 8 MB

    def run(batches):
        from pyspark import TaskContext

        part, number, wanted = TaskContext.get().partitionId(), 0, known.value
        for batch, h, sizes in steps(batches, size=BLOCK_BYTES):
            block = part << 32 | number
            number += 1
            term = signed(h)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bits = term.view(np.uint64)
            keep = (wanted[(bits & np.uint64((1 << TERM_BITS) - 1)) >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
            term, doc, at = term[keep], doc[keep], at[keep]
            order = np.argsort(term, kind="stable")
            term, doc, at = term[order], doc[order], at[order]
            own, counts = np.unique(term, return_counts=True)
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, block)), pa.array([None, *own.tolist()], pa.int64()),
                    lists(np.concatenate([np.zeros(len(sizes), np.int64), doc]).astype(np.int32), np.concatenate([[len(sizes)], counts]), pa.int32()),
                    lists(np.concatenate([sizes, at]).astype(np.int32), np.concatenate([[len(sizes)], counts]), pa.int32()),
                    pa.array([batch.column("doc_id").to_pylist()] + [None] * n, pa.list_(batch.schema.field("doc_id").type)),
                ],
                ["block", "term", "docs", "positions", "doc_ids"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(run, f"block long, term long, docs array<int>, positions array<int>, doc_ids array<{kind}>")
    return table(rows, "index")


def match(keys: list[np.ndarray], slop: int = 0) -> np.ndarray:
    """The keys that every list has, by the offset-adjusted lists, which are intersected from the shortest on.

    Lists are sorted.  With a slop, a list may have another key up to so far away (proximity match), and the keys are the
    shortest list's.
    """
    keys = sorted(keys, key=len)
    now = keys[0]
    for k in keys[1:]:
        if not len(now) or not len(k):
            return now[:0]
        i = np.searchsorted(k, now - slop)
        now = now[(i < len(k)) & (k[np.minimum(i, len(k) - 1)] <= now + slop)]
    return now


def places(keys: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """A row for each list of offset-adjusted keys: its key nearest to each start, of two as near the lower one, as a place
    in the text."""
    rows = []
    for i, k in enumerate(keys):
        right = np.minimum(np.searchsorted(k, starts), len(k) - 1)
        left = np.maximum(right - 1, 0)
        rows.append(np.where(np.abs(starts - k[left]) <= np.abs(k[right] - starts), k[left], k[right]) + i)
    return np.stack(rows)


def search(index: DataFrame, wins: DataFrame, slop: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside matching windows), and items (the distinct item_ids, sorted).

    A window is tried in the blocks that hold both of its two rarest terms (by postings over the whole index); the
    postings of a block and the windows to try there meet in one task.  With a slop, the hit words are those found, each
    nearest to its place, of windows whose words are found in one document.
    """
    salted = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt")
    keys = index.where("term is not null").select("block", "term", salted)
    weights = index.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("n"))
    weights = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = table(wins.select(F.monotonically_increasing_id().alias("w"), "item_id", "terms"), "windows")
    ranked = held.select("w", F.explode(F.array_distinct("terms")).alias("term"), F.pmod("w", F.lit(SALTS)).cast("int").alias("salt")).join(weights, ["term", "salt"], "left")
    ranked = ranked.groupBy("w").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("r"))
    # A window with a term without postings occurs nowhere.  A window of one distinct term has it as both.
    rare = ranked.where("r[0].n > 0").select("w", F.col("r")[0]["term"].alias("term"), F.coalesce(F.get("r", F.lit(1))["term"], F.col("r")[0]["term"]).alias("second"))
    # A term of all blocks would be one key with as many rows: its blocks are dealt to SALTS parts, each window to all of them.
    rare = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tried = rare.join(keys, ["term", "salt"]).select("w", "block", F.col("second").alias("term")).join(keys, ["block", "term"], "left_semi")
    tried = tried.select("w", "block").join(held, "w")
    item = dict(wins.dtypes)["item_id"]
    kind = dict(index.dtypes)["doc_ids"][6:-1]
    left = index.select("block", "term", "docs", "positions", "doc_ids", F.lit(None).cast(item).alias("item_id"), F.lit(None).cast("array<long>").alias("terms"))
    right = tried.select(
        "block", F.lit(None).cast("long").alias("term"), F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<int>").alias("positions"),
        F.lit(None).cast(f"array<{kind}>").alias("doc_ids"), "item_id", "terms",
    )

    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c) for c in group.column_names}
        at = next(i for i, v in enumerate(col["doc_ids"].is_valid().to_pylist()) if v)
        sizes = np.asarray(col["positions"][at].values, np.int64)
        gap = max([len(t) for t in col["terms"] if t.is_valid], default=0) + slop + 1
        first = np.cumsum(sizes + gap) - sizes - gap  # places documents so far apart that no window spans two
        postings = {
            t: first[np.asarray(d.values)] + np.asarray(p.values)
            for t, d, p in zip(col["term"].to_pylist(), col["docs"], col["positions"]) if t is not None
        }
        hits, found = np.zeros(int((sizes + gap).sum()) + 1, np.int64), [set() for _ in sizes]
        for item_id, terms in zip(col["item_id"].to_pylist(), col["terms"].to_pylist()):
            own = [postings.get(t) for t in terms or ()]
            if not own or any(p is None for p in own):
                continue
            adjusted = [p - i for i, p in enumerate(own)]
            starts = match(adjusted, slop)
            if slop:
                spots = places(adjusted, starts)
                one = np.searchsorted(first, spots, side="right") - 1
                spots = spots[:, (one == one[:1]).all(axis=0)]
                starts = spots[0]
                np.add.at(hits, spots.ravel(), 1)
                np.add.at(hits, spots.ravel() + 1, -1)
            else:
                np.add.at(hits, starts, 1)
                np.add.at(hits, starts + len(own), -1)
            for d in np.unique(np.searchsorted(first, starts, side="right") - 1):
                found[d].add(item_id)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(hits) > 0)])
        ids = col["doc_ids"][at].values
        return pa.table({"doc_id": ids, "n_words": sizes, "n_hit": hit[first + sizes] - hit[first], "items": pa.array([sorted(f) for f in found], pa.list_(col["item_id"].type))})

    return left.unionByName(right).groupBy("block").applyInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<{item}>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated (n_hit > 0 and at least a twentieth of the words) per document.

    Null texts have no words; repeated rows count each for itself; with an empty benchmark nothing is hit; an empty table
    of documents gives an empty one.  doc_id may be of any type and null; only doc_id and text, and item_id and text of
    the benchmark, are read, whole and of any length.
    """
    wins = table(windows(benchmark, size), "windows")
    terms = wins.select(F.explode("terms").alias("term"))
    found = search(build_index(docs, terms), wins, slop)
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def digest(found: DataFrame) -> DataFrame:
    """n_items and items_sha256 (of the item_ids sorted as strings, comma-joined) in place of items."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")

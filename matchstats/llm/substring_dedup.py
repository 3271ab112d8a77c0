"""Removal of passages that an earlier document has, by Aho-Corasick automata of confirmed recurring phrases.

Every run of 13 words holds a 4-word anchor: the one with the smallest hash.  Equal runs have equal anchors, so

1. anchors that occur in two different documents are found by a partially aggregated count,
2. documents that have such anchors are cut into segments, the stretches of windows of one recurring anchor,
3. segments are sharded by anchor; a shard confirms the windows that start in two documents, compiles them into an
   automaton, and streams its segments through it to locate every occurrence (words are 64-bit hashes; the automaton's
   letters number those of the phrases from 1, so it takes no two of them for one),
4. the places are gathered by document and its covered words are dropped.

The segments of an anchor that has very many are cut anew by 10-word anchors, which tell the contexts of common words
apart.  A finer anchor that still has very many segments stands in one passage: its few windows are confirmed by an
aggregation and then located in salted shards.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.llm.decontaminate import TERM_BITS, term_map
from matchstats.llm.shared import RAW, binaries, gram_hashes, lists, mix, raw_words_of, signed, steps, table

WINDOW, ANCHOR, FINER = 13, 4, 10
#: Segments of a shard, about; an anchor with more segments than HOT is confirmed and located in salted shards.
SHARD_ROWS, HOT = 20_000, 5_000


def anchors(h: np.ndarray, sizes: np.ndarray, length: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of some texts: (text number, first word in the text, anchor) of every window."""
    g = gram_hashes(h, length)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = g[:n].copy()
    for k in range(1, WINDOW - length + 1):
        np.minimum(low, g[k : k + n], out=low)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)[:n]
    whole = at + WINDOW <= sizes[text]
    return text[whole], at[whole], low[whole]


def anchor_rows(docs: DataFrame, bits=None) -> DataFrame:
    """(anchor, doc_id), once for each row of docs and anchor of its windows; with a map of bits only anchors in it."""

    def run(batches):
        known = bits.value if bits is not None else None
        for batch, h, sizes in steps(batches, kind=RAW):
            text, _, low = anchors(h, sizes)
            if len(low):
                order = np.lexsort((low, text))
                text, low = text[order], low[order]
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] != low[:-1])])
                if known is not None:
                    new &= (known[(low & np.uint64((1 << TERM_BITS) - 1)) >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(low[new])), batch.column("doc_id").take(pa.array(text[new]))], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"anchor long, doc_id {dict(docs.dtypes)['doc_id']}")


def segment_rows(found: DataFrame) -> DataFrame:
    """(anchor, doc_id, sig, at, words): the stretches of windows with one recurring anchor, as 64-bit word hashes.

    found has doc_id, sig, text and the document's recurring anchors.  A stretch has at most 64 windows.
    """

    def run(batches):
        for batch, h, sizes in steps(batches, kind=RAW):
            text, at, low = anchors(h, sizes)
            known = batch.column("anchors")
            wanted = [np.sort(np.asarray(a.values, np.int64)) for a in known]
            owner = np.repeat(np.arange(len(wanted)), [*map(len, wanted)])
            pairs = np.unique(_pair(owner, np.concatenate(wanted)))
            keep = np.isin(_pair(text, signed(low)), pairs)
            text, at, low = text[keep], at[keep], low[keep]
            if not len(low):
                continue
            start, first, length, place = stretches(text, at, low, sizes)
            words = signed(h[place])
            take = pa.array(text[start])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(low[start])), batch.column("doc_id").take(take), batch.column("sig").take(take), pa.array(at[start].astype(np.int32)), lists(words, length, pa.int64())],
                ["anchor", "doc_id", "sig", "at", "words"],
            )

    kind = dict(found.dtypes)["doc_id"]
    return found.select("doc_id", "sig", "text", "anchors").mapInArrow(run, f"anchor long, doc_id {kind}, sig long, at int, words array<long>")


def stretches(text: np.ndarray, at: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the windows (text, at, low), in order: the first of each stretch of one anchor (of at most 64 windows), its first
    word among all words, its number of words, and the places of all stretches' words."""
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
    start = np.flatnonzero(new)
    new |= (np.arange(len(new)) - start[np.cumsum(new) - 1]) % 64 == 0
    start = np.flatnonzero(new)
    first = (np.cumsum(sizes) - sizes)[text[start]] + at[start]
    length = np.diff(np.append(start, len(new))) + WINDOW - 1
    return start, first, length, np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


def finer_segments(segments: DataFrame, kind: str) -> DataFrame:
    """The windows of some segments as segments of finer anchors (which depend on the anchor before, too)."""

    def run(batches):
        for batch in batches:
            words = [np.asarray(w.values) for w in batch.column("words")]
            if not words:
                continue
            flat, sizes = np.concatenate(words), np.array([*map(len, words)], np.int64)
            row, at, low = anchors(mix(flat.astype(np.uint64)), sizes, FINER)
            start, _, length, place = stretches(row, at, low, sizes)
            take = pa.array(row[start])
            before = mix(np.asarray(batch.column("anchor"))[row[start]].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(mix(low[start] ^ before))), batch.column("doc_id").take(take), batch.column("sig").take(take),
                 pa.array((np.asarray(batch.column("at"))[row[start]] + at[start]).astype(np.int32)), lists(flat[place], length, pa.int64())],
                ["anchor", "doc_id", "sig", "at", "words"],
            )

    return segments.select("anchor", "doc_id", "sig", "at", "words").mapInArrow(run, f"anchor long, doc_id {kind}, sig long, at int, words array<long>")


def _pair(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One number for a text of the step and an anchor; texts of a step are few, so the anchor keeps over 40 bits."""
    return (anchor.astype(np.int64) >> np.int64(20)) | (text.astype(np.int64) << np.int64(44)) if len(text) else np.zeros(0, np.int64)


def window_matrix(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some word lists, each as 13 numbers, with its list and its place there."""
    sizes = np.array([*map(len, words)], np.int64) - WINDOW + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.concatenate(words)
    first = (np.cumsum(sizes + WINDOW - 1) - sizes - WINDOW + 1)[owner] + at
    return flat[first[:, None] + np.arange(WINDOW)], owner, at


def window_names(rows: np.ndarray) -> np.ndarray:
    """64-bit names of the windows of one task; the automaton afterwards compares all 13 words."""
    total = np.zeros(len(rows), np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64)
    return mix(total)


def extremes(number: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest doc_id of each of n groups."""
    order = np.argsort(number, kind="stable")
    at = np.searchsorted(number[order], np.arange(n))
    return np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at)


def confirm(words: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that start in two documents or more, the smallest doc_id of each, and which lists hold any."""
    rows, owner, _ = window_matrix(words)
    _, first, number = np.unique(window_names(rows), return_index=True, return_inverse=True)
    low, high = extremes(number, doc[owner], len(first))
    more = low < high
    holds = np.zeros(len(words), bool)
    holds[owner[more[number]]] = True
    return rows[first[more]], low[more], holds


def compile_phrases(phrases: np.ndarray) -> ahocorasick.Automaton:
    """An automaton over the phrases, rows of word numbers; a match tells the phrase's row."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, phrase in enumerate(phrases.tolist()):
        a.add_word(tuple(phrase), i)
    a.make_automaton()
    return a


def locate(words: list[np.ndarray], doc: np.ndarray, phrases: np.ndarray, low: np.ndarray, holds: np.ndarray | None = None) -> list[list[int]]:
    """For each word list, the starts of windows that are phrases of a document with a smaller doc_id.

    Lists that are known to hold no phrase (holds) are passed over.
    """
    if not len(phrases):
        return [[] for _ in words]
    letters, number = np.unique(phrases, return_inverse=True)
    machine, low = compile_phrases(number.reshape(phrases.shape) + 1), low.tolist()
    holds = [True] * len(words) if holds is None else holds.tolist()
    out: list[list[int]] = []
    for w, d, h in zip(words, doc.tolist(), holds):
        if not h:
            out.append([])
            continue
        at = np.minimum(np.searchsorted(letters, w), len(letters) - 1)
        w = np.where(letters[at] == w, at + 1, 0)  # 0: a word of no phrase
        out.append([end - WINDOW + 1 for end, i in machine.iter(tuple(w.tolist())) if low[i] < d])
    return out


def _located(group: pa.Table, words: list[np.ndarray], doc: np.ndarray, *found: np.ndarray) -> pa.Table:
    """The places found, as (doc_id, sig, start, n): n words from start on."""
    rows, start, n = [], [], []
    for i, (places, at) in enumerate(zip(locate(words, doc, *found), group.column("at").to_pylist())):
        last = None
        for p in places:
            if last is not None and p <= last + WINDOW:
                n[-1] = p + WINDOW + at - start[-1]
            else:
                rows.append(i), start.append(at + p), n.append(WINDOW)
            last = p
    return pa.table({"doc_id": group.column("doc_id").take(pa.array(rows, pa.int64())), "sig": group.column("sig").take(pa.array(rows, pa.int64())), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32())})


def _words(group: pa.Table, column: str = "words") -> list[np.ndarray]:
    return [np.asarray(w.values) for w in group.column(column)]


PLACES = "doc_id {kind}, sig long, start int, n int"


def cold_places(segments: DataFrame, kind: str) -> DataFrame:
    """Places in the segments of anchors that are not hot: a shard confirms, compiles and locates by itself."""

    def run(group: pa.Table) -> pa.Table:
        words, doc = _words(group), np.asarray(group.column("doc_id"))
        return _located(group, words, doc, *confirm(words, doc))

    return segments.groupBy("shard").applyInArrow(run, PLACES.format(kind=kind))


def seen_windows(segments: DataFrame, kind: str) -> DataFrame:
    """(anchor, phrase, salts, low, high): the windows of the segments, those of a batch once with their extreme doc_ids."""

    def run(batches):
        for batch in batches:
            words = [np.asarray(w.values) for w in batch.column("words")]
            if not words:
                continue
            rows, owner, _ = window_matrix(words)
            anchor, salts, doc = (np.asarray(batch.column(c))[owner] for c in ("anchor", "salts", "doc_id"))
            _, first, number = np.unique(window_names(rows) ^ mix(anchor.astype(np.uint64)), return_index=True, return_inverse=True)
            low, high = extremes(number, doc, len(first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first]), lists(rows[first].ravel(), np.full(len(first), WINDOW), pa.int64()), pa.array(salts[first]), pa.array(low), pa.array(high)], ["anchor", "phrase", "salts", "low", "high"]
            )

    return segments.select("anchor", "salts", "doc_id", "words").mapInArrow(run, f"anchor long, phrase array<long>, salts int, low {kind}, high {kind}")


def hot_places(segments: DataFrame, kind: str) -> DataFrame:
    """Places in the segments of hot anchors.

    Their windows are first reduced within each task and then grouped, so a phrase of a third of all documents is a few
    rows for each task; confirmed phrases then go to every salt of their anchor, whose number grows with its segments.
    """
    phrases = seen_windows(segments, kind).groupBy("anchor", "phrase").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("salts").alias("salts")).where("low < high")
    phrases = table(phrases, "hot-phrases").select("anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "phrase", "low")
    rows = segments.select("anchor", F.pmod(F.xxhash64("doc_id", "at"), F.col("salts")).cast("int").alias("salt"), "doc_id", "sig", "at", "words")

    def run(key, left, right):
        found = _words(right, "phrase")
        phrases = np.array(found) if found else np.zeros((0, WINDOW), np.int64)
        return _located(left, _words(left), np.asarray(left.column("doc_id")), phrases, np.asarray(right.column("low")))

    return rows.groupBy("anchor", "salt").cogroup(phrases.groupBy("anchor", "salt")).applyInArrow(run, PLACES.format(kind=kind))


def keep_words(marked: DataFrame) -> DataFrame:
    """doc_id, sig, n_words, n_removed, kept (text) from rows with text and places (start, n)."""

    def run(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept": []}
            for text, places, gone in zip(binaries(batch, "text"), batch.column("places").to_pylist(), batch.column("copy").to_pylist()):
                words = raw_words_of(text)
                keep = np.ones(len(words), bool)
                for p in places or ():
                    keep[p["start"] : p["start"] + p["n"]] = False
                if gone and len(words) >= WINDOW:
                    keep[:] = False
                out["n_words"].append(len(words))
                out["n_removed"].append(int((~keep).sum()))
                out["kept"].append(b" ".join([w for w, k in zip(words, keep.tolist()) if k] if not keep.all() else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary()).cast(pa.string())],
                ["doc_id", "sig", "n_words", "n_removed", "kept"],
            )

    kind = dict(marked.dtypes)["doc_id"]
    return marked.select("doc_id", "sig", "text", "copy", "places").mapInArrow(run, f"doc_id {kind}, sig long, n_words long, n_removed long, kept string")


def signature():
    return F.xxhash64(F.lit(13), F.coalesce(F.col("text"), F.lit("")))


def parted(segments: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The segments of anchors with at most HOT of them, and those of the others with the anchor's number of salts."""
    counts = segments.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = table(counts.where(F.col("n") > HOT).select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), name)
    return segments.join(hot, "anchor", "left_anti"), segments.join(hot, "anchor")


def sharded(segments: DataFrame, n: int, level: int) -> DataFrame:
    """Segments with their shard, about SHARD_ROWS in each; shards of different levels differ."""
    return segments.withColumn("shard", 2 * F.pmod("anchor", F.lit(max(1, n // SHARD_ROWS + 1))) + level)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, sig, n_words, n_removed and kept for every row: its words without those covered by a window of 13 words
    that also starts in a document with a smaller doc_id.

    Null texts have no words.  Rows with a null doc_id neither lose words nor take any.  Rows of equal doc_id never
    take words from each other; equal texts of larger doc_id lose all their windows at once, before any segment.  Only
    doc_id and text are read, texts of any length; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", "text", signature().alias("sig"), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("sig2"))
    some = rows.where("doc_id is not null")
    copies = some.select("doc_id", "sig", "sig2").groupBy("sig", "sig2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = table(copies, "copies")
    # Only texts that occur twice meet here; a hot text's rows are split by the adaptive join.
    copy_ids = table(some.select("doc_id", "sig", "sig2").join(copies, ["sig", "sig2"]).where("doc_id > low").select("doc_id", "sig").distinct(), "copy-ids")
    own = anchor_rows(some)
    recurring = table(own.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    # A map of fixed size (8 MB) drops most other anchors before they are joined.
    bits = docs.sparkSession.sparkContext.broadcast(term_map(recurring.select(F.col("anchor").alias("term"))))
    hits = anchor_rows(some, bits).join(recurring, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    flags = copy_ids.withColumn("copy", F.lit(True))
    # One row for each document that goes on; a list of anchors is no longer than its document.
    found = rows.drop("sig2").join(hits, "doc_id", "left").join(flags, ["doc_id", "sig"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    found = table(found.select("doc_id", "sig", "copy", F.when(~F.col("copy"), F.col("anchors")).alias("anchors"), "text"), "found")
    segments = table(segment_rows(found.where("anchors is not null")), "segments")
    kind = dict(docs.dtypes)["doc_id"]
    cold, hot = parted(segments, "hot-anchors")
    rows = sharded(cold, segments.count(), 0)
    if not hot.isEmpty():
        finer = table(finer_segments(hot, kind), "finer-segments")
        cold, hot = parted(finer, "hot-finer-anchors")
        rows = rows.unionByName(sharded(cold, finer.count(), 1))
    places = cold_places(rows, kind)
    if not hot.isEmpty():
        places = places.unionByName(hot_places(hot, kind))
    places = table(places.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "n")).alias("places")), "places")
    return keep_words(found.join(places, ["doc_id", "sig"], "left"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one blank) for every row."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

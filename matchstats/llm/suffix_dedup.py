"""Removal of byte passages that stand earlier in the corpus, by suffix arrays of the places where texts may repeat.

Every 100-byte window holds an anchor: the 24-byte string with the smallest hash in it.  Equal windows have equal anchors, so

1. anchors that stand at two places are found by a partially aggregated count of their hashes,
2. texts with such anchors are cut into segments, the stretches of windows of one recurring anchor,
3. equal segments are one entry, whose first place is known by an aggregation; all its other places lose it whole,
4. distinct segments are sharded by anchor; a shard builds the suffix array of its segments (matchstats.llm.suffixes), in
   which windows that are equal stand side by side, and marks all but the first of each,
5. the places are gathered by document and their bytes dropped.

An anchor with very many distinct segments doesn't go into one shard: its windows are grouped by an aggregation instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.llm.decontaminate import TERM_BITS, term_map
from matchstats.llm.shared import binaries, mix, signed, table
from matchstats.llm.suffixes import suffix_places

#: Bytes of a window and of its anchor; bytes that equal windows share on one side of the anchor at least.
WINDOW, ANCHOR = 100, 24
SIDE = (WINDOW - ANCHOR + 1) // 2
#: Windows that one numpy step looks at; bytes of text it holds at least; windows of a segment at most.
CHUNK, STEP_BYTES, LONGEST = 1 << 18, 1_000_000, 256
#: Bytes of the segments of a shard, about; an anchor with more distinct segments than HOT is left to an aggregation.
SHARD_BYTES, HOT = 1_500_000, 5_000
#: Copies of texts are broadcast up to so many rows (of two numbers each), and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
_MASK = np.uint64((1 << 20) - 1)
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0xD6E8FEB86659FD93


def string_hashes(data: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of k bytes, put together from those of half the length."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = (_P ^ salt << 8) | 1
    part, size, out, done = _LETTERS[data], 1, None, 0
    while True:
        if k & size:
            out = part if out is None else out[: len(data) - done - size + 1] * np.uint64(pow(power, size, 1 << 64)) + part[done : done + len(data) - done - size + 1]
            done += size
        if done == k:
            return mix(out[:n] + np.uint64(salt))
        part = part[:-size] * np.uint64(pow(power, size, 1 << 64)) + part[size:]
        size *= 2


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of each k neighbours."""
    low, span = x, 1
    while 2 * span <= k:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(x) - k + 1], low[k - span :]) if span < k else low


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor, place of the anchor, whether it stands there more than once) of the
    stretches of windows that share an anchor; data are texts one after another, which no window crosses."""
    out = []
    for a in range(0, len(data) - WINDOW + 1, CHUNK):
        part = data[a : a + CHUNK + WINDOW - 1]
        g, n = string_hashes(part, ANCHOR), len(part) - WINDOW + 1
        # The leftmost place of the smallest hash: its upper bits with the place below them.
        low = sliding_min((g & ~_MASK) | np.arange(len(g), dtype=np.uint64), WINDOW - ANCHOR + 1)
        ends = offsets[(offsets > a) & (offsets < a + len(part))] - a
        across = np.zeros(n + 1, np.int32)
        np.add.at(across, np.clip(ends - WINDOW + 1, 0, n), 1)
        np.add.at(across, np.clip(ends, 0, n), -1)
        whole = np.flatnonzero(np.cumsum(across[:n]) == 0)
        if not len(whole):
            continue
        low = low[whole]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (whole[1:] != whole[:-1] + 1)]))
        at = (low[new] & _MASK).astype(np.int64)
        start, count, anchor = whole[new], np.diff(np.append(new, len(whole))), g[at]
        more = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (start[1:] == start[:-1] + count[:-1])])
        head = np.flatnonzero(~more)
        times = np.diff(np.append(head, len(more)))
        out.append((start[head] + a, np.add.reduceat(count, head), anchor[head], at[head] + a, times > 1))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def _texts(batches):
    """(batch slice, its texts' bytes one after another, their borders)."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        if not len(texts):
            continue
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def anchor_counts(texts: DataFrame) -> DataFrame:
    """(anchor, n): how often the anchors stand in the texts of a step."""

    def run(batches):
        for _, data, offsets in _texts(batches):
            _, _, anchor, _, more = stretches(data, offsets)
            own, number = np.unique(anchor, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(np.bincount(number, 1 + more, len(own)).astype(np.int32))], ["anchor", "n"])

    return texts.select("text").mapInArrow(run, "anchor long, n int")


def anchor_texts(texts: DataFrame, bits) -> DataFrame:
    """(anchor, doc_id, sig) for the anchors of each text that may recur: those in a map of bits."""

    def run(batches):
        known = bits.value
        for batch, data, offsets in _texts(batches):
            start, _, anchor, _, _ = stretches(data, offsets)
            keep = (known[(anchor & np.uint64((1 << TERM_BITS) - 1)) >> np.uint64(6)] >> (anchor & np.uint64(63))) & np.uint64(1) == 1
            text, anchor = np.searchsorted(offsets, start[keep], side="right") - 1, anchor[keep]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
            take = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[new])), batch.column("doc_id").take(take), batch.column("sig").take(take)], ["anchor", "doc_id", "sig"])

    return texts.select("doc_id", "sig", "text").mapInArrow(run, "anchor long, doc_id long, sig long")


def segment_rows(found: DataFrame) -> DataFrame:
    """(anchor, doc_id, sig, at, bytes, place, more): the stretches of each text's recurring anchors.

    place is that of the anchor in bytes, more tells that it may stand there again.  A segment has at most LONGEST windows.
    """

    def run(batches):
        for batch, data, offsets in _texts(batches):
            start, count, anchor, place, more = stretches(data, offsets)
            text = np.searchsorted(offsets, start, side="right") - 1
            wanted = batch.column("anchors")
            owner = np.repeat(np.arange(len(batch)), np.diff(np.asarray(wanted.offsets)))
            values = np.asarray(wanted.flatten(), np.int64)
            both = lambda t, a: a ^ (t.astype(np.int64) << np.int64(43))  # noqa: E731  # a chance hit costs a needless segment
            keep = np.isin(both(text, signed(anchor)), both(owner, values))
            start, count, anchor, place, more, text = (x[keep] for x in (start, count, anchor, place, more, text))
            cuts = -(-count // LONGEST)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start, count, anchor, place, more, text = (np.repeat(x, cuts) for x in (start, count, anchor, place, more, text))
            start, count = start + nth * LONGEST, np.minimum(count - nth * LONGEST, LONGEST)
            flat = data.tobytes()
            pieces = [flat[a : a + n] for a, n in zip(start.tolist(), (count + WINDOW - 1).tolist())]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(anchor)), batch.column("doc_id").take(take), batch.column("sig").take(take), pa.array((start - offsets[text]).astype(np.int32)),
                    pa.array(pieces, pa.binary()), pa.array((place - start).astype(np.int32)), pa.array(more),
                ],
                ["anchor", "doc_id", "sig", "at", "bytes", "place", "more"],
            )

    return found.select("doc_id", "sig", "text", "anchors").mapInArrow(run, "anchor long, doc_id long, sig long, at int, bytes binary, place int, more boolean")


def _flat(pieces: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the borders of its rows."""
    col = pa.concat_arrays(pieces.chunks) if pieces.num_chunks != 1 else pieces.chunk(0)
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def meeting(anchor: np.ndarray, place: np.ndarray, more: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which segments may share a window with another (or with themselves): equal windows also share SIDE bytes before
    the anchor or SIDE bytes behind it."""
    keep = more.copy()
    h = string_hashes(data, ANCHOR + SIDE)
    first = offsets[:-1] + place
    for start, there in ((first - SIDE, place >= SIDE), (first, first + ANCHOR + SIDE <= offsets[1:])):
        rows = np.flatnonzero(there & ~more)
        names = mix(h[start[rows]] ^ anchor[rows].astype(np.uint64))
        _, number, times = np.unique(names, return_inverse=True, return_counts=True)
        keep[rows[times[number] > 1]] = True
    # A segment in which the anchor may stand again is compared with all of its anchor.
    return keep | np.isin(anchor, anchor[more])


def repeated_windows(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, number of windows) of the runs of windows that stand earlier, too.

    Segments are data[offsets[i] : offsets[i + 1]]; segment i stands in document doc[i] from at[i] on.
    """
    sizes = np.diff(offsets)
    counts = np.bincount(data, minlength=256)
    rank = np.zeros(256, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(1, 257)  # frequent bytes are high letters, which have few children of their own
    s = np.zeros(len(data) + len(sizes) + 1, np.int32)
    shift = 1 + np.repeat(np.arange(len(sizes)), sizes)
    s[np.arange(len(data)) + shift] = rank[data]
    windows = np.maximum(sizes - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offsets[owner] + inside
    order = np.argsort(suffix_places(s)[start + 1 + owner])
    eight = data.astype(np.uint64)
    for k in (1, 2, 4):
        eight = eight[:-k] | eight[k:] << np.uint64(8 * k)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        left = np.flatnonzero(same)
        same[left] = eight[start[order[left]] + k] == eight[start[order[left + 1]] + k]
    key = doc[owner] << np.int64(32) | (at[owner] + inside)
    head = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(key[order], head) if len(order) else key
    gone = np.zeros(len(order), bool)
    gone[order] = key[order] > np.repeat(low, np.diff(np.append(head, len(order))))
    rows = np.flatnonzero(gone)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1] + 1) | (owner[rows[1:]] != owner[rows[:-1]])]))
    return owner[rows[new]], inside[rows[new]], np.diff(np.append(new, len(rows)))


PLACES = "doc_id long, sig long, start int, n int"


def cold_places(classes: DataFrame) -> DataFrame:
    """The places of the distinct segments' windows that stand earlier; a shard builds one suffix array."""

    def run(group: pa.Table) -> pa.Table:
        anchor, place, more = (np.asarray(group.column(c)) for c in ("anchor", "place", "more"))
        group = group.filter(pa.array(meeting(anchor, place, more, *_flat(group.column("bytes")))))
        doc = np.stack([np.asarray(group.column(c), np.int64) for c in ("doc_id", "sig")], axis=1)
        _, number = np.unique(doc, axis=0, return_inverse=True)
        at = np.asarray(group.column("at"), np.int64)
        row, first, n = repeated_windows(*_flat(group.column("bytes")), number.ravel().astype(np.int64), at)
        take = pa.array(row)
        return pa.table({"doc_id": group.column("doc_id").take(take), "sig": group.column("sig").take(take), "start": pa.array((at[row] + first).astype(np.int32)), "n": pa.array((n + WINDOW - 1).astype(np.int32))})

    return classes.groupBy("shard").applyInArrow(run, PLACES)


def hot_places(classes: DataFrame) -> DataFrame:
    """The same for anchors with very many distinct segments: a grouping of all their windows by 128 bits."""

    def run(batches):
        for batch in batches:
            data, offsets = _flat(pa.chunked_array([batch.column("bytes")]))
            windows = np.diff(offsets) - WINDOW + 1
            owner = np.repeat(np.arange(len(windows)), windows)
            inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            take, start = pa.array(owner), offsets[owner] + inside
            names = [pa.array(signed(string_hashes(data, WINDOW, salt)[start])) for salt in (1, 2)]
            at = np.asarray(batch.column("at"))[owner] + inside
            yield pa.RecordBatch.from_arrays([*names, batch.column("doc_id").take(take), batch.column("sig").take(take), pa.array(at.astype(np.int32))], ["h1", "h2", "doc_id", "sig", "start"])

    windows = table(classes.select("bytes", "doc_id", "sig", "at").mapInArrow(run, "h1 long, h2 long, doc_id long, sig long, start int"), "hot-windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig", "start")).alias("low"), F.count("*").alias("times")).where("times > 1")
    gone = windows.join(first, ["h1", "h2"]).where(F.struct("doc_id", "sig", "start") > F.col("low"))
    return gone.select("doc_id", "sig", "start", F.lit(WINDOW).alias("n"))


def cut(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of rows with text and places (start, n)."""

    def run(batches):
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, places in zip(binaries(batch, "text"), batch.column("places").to_pylist()):
                text = text or b""
                end, spans = 0, []
                for p in sorted((p["start"], p["start"] + p["n"]) for p in places or ()):
                    if spans and p[0] <= end:
                        end = spans[-1][1] = max(end, p[1])
                    else:
                        spans.append([*p])
                        end = p[1]
                borders = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2])) if spans else text
                for c, x in zip(out, (len(text), len(text) - len(kept), len(spans), kept)):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], ["doc_id", *out])

    return rows.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row: its text's UTF-8 bytes without those covered by
    a 100-byte string that also starts earlier, that is in a document with a smaller doc_id or earlier in the same one.

    A null text has no bytes.  Rows without a doc_id neither lose bytes nor take any.  Of several texts with one doc_id
    that with the smaller hash is earlier; rows alike in doc_id and text are one document, and each gives what it keeps.
    Only doc_id (a whole number) and text are read, texts of any length; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(13), "text").alias("sig"))
    some = rows.where((F.col("doc_id").isNotNull()) & (F.octet_length("text") >= WINDOW))
    named = some.select("doc_id", "sig", F.xxhash64(F.lit(7), "text").alias("sig2"), F.octet_length("text").alias("n"))
    twice = table(named.groupBy("sig", "sig2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "copies")
    copies = table(named.join(twice, ["sig", "sig2"]).where("doc_id > low").select("doc_id", "sig", "n").distinct(), "copy-ids")
    keys = copies.select("doc_id", "sig")
    own = some.join(F.broadcast(keys) if copies.count() <= BROADCAST_ROWS else keys, ["doc_id", "sig"], "left_anti")
    recurring = table(anchor_counts(own).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    bits = docs.sparkSession.sparkContext.broadcast(term_map(recurring.select(F.col("anchor").alias("term"))))  # 8 MB
    hits = anchor_texts(own, bits).join(recurring, "anchor", "left_semi").groupBy("doc_id", "sig").agg(F.collect_list("anchor").alias("anchors"))
    segments = table(segment_rows(some.join(hits, ["doc_id", "sig"])).withColumn("digest", F.xxhash64("bytes")), "segments")
    first = F.min(F.struct("doc_id", "sig", "at")).alias("low")
    classes = segments.groupBy("anchor", "digest").agg(first, F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("bytes", "place", "more")))
    classes = table(classes.select("anchor", "digest", "low.*", "times", "bytes", "place", "more"), "classes")
    known = classes.where("times > 1").select("anchor", "digest", F.struct("doc_id", "sig", "at").alias("low"))
    later = segments.select("anchor", "digest", "doc_id", "sig", "at", F.octet_length("bytes").alias("n")).join(known, ["anchor", "digest"]).where(F.struct("doc_id", "sig", "at") != F.col("low"))
    places = copies.select("doc_id", "sig", F.lit(0).alias("start"), "n").unionByName(later.select("doc_id", "sig", F.col("at").alias("start"), "n"))
    # A single segment without its anchor again has nothing to be ordered against.
    several = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.max("more").alias("again"), F.sum(F.octet_length("bytes")).alias("size")).where("m > 1 or again")
    several = table(several, "several")
    size = several.agg(F.sum("size")).first()[0] or 0
    met = classes.join(several.select("anchor", "m"), "anchor")
    met = table(met.withColumn("shard", F.pmod("anchor", F.lit(max(1, -(-size // SHARD_BYTES))))), "met")
    places = places.unionByName(cold_places(met.where(F.col("m") <= HOT)))
    hot = met.where(F.col("m") > HOT)
    if not hot.isEmpty():
        places = places.unionByName(hot_places(hot))
    places = table(places.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "n")).alias("places")), "places")
    return cut(rows.join(places, ["doc_id", "sig"], "left"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes, concatenated) for every row."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

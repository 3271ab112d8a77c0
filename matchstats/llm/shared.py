"""Helpers of the corpus operators: shared folder, tables that cut lineage, word hashes, ordered buckets, components."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a word: 0-9, a-z (A-Z are lower-cased) and all bytes of non-ASCII characters.  Others become a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a local session gets a temporary one (as
    in tests); on a cluster no folder is guessed, as executors would not see the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _temporary(spark.sparkContext.applicationId)
    return where.rstrip("/")


@lru_cache(maxsize=None)
def _temporary(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one, which holds all it writes."""
    return f"{shared_dir(spark)}/matchstats-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables and files that this application's operators have written to the shared folder.  Results that
    have not been written elsewhere or read to the end can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case: the given ones with underscores behind them as needed."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows survives lost executors without recomputing df."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text; a null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def raw_words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged; a null has none.  bytes.split() splits at just these six characters."""
    return text.split() if text else []


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when it has grown to `most` words."""

    most = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit sums (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (len(words) - k + 1 of them), over document borders too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


#: Lower-cased byte of a word, or 0 between words, for the two kinds of words.
PLAIN = np.array([0 if b == 32 else b for b in WORD_BYTES], np.uint8)
RAW = np.array([0 if c == 32 or 9 <= c <= 13 else c for c in range(256)], np.uint8)
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, STEP_BYTES + 1)
        _POWERS.clear()
        for x in (_P, pow(_P, -1, 1 << 64)):
            factors = np.full(n, x, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts (bytes data[offsets[i]:offsets[i + 1]]), and their numbers of words.

    A word's hash is a polynomial of its bytes, read off differences of one running sum over the data.
    """
    data = kind[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * power[: len(data)], out=total[1:])
    h = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, offsets)).astype(np.int64)


#: Bytes of text that one numpy step of a task holds at once (or one longer text).
STEP_BYTES = 1_000_000


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", kind: np.ndarray = PLAIN, size: int = STEP_BYTES) -> Iterator[tuple]:
    """(batch slice, word hashes of all its texts one after another, their numbers of words); a null has no words."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).fill_null(b"")
        if not len(texts):
            continue
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at), *word_hashes(data, offsets[at : to + 1], kind)
            at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that come sorted by integer keys, in tables of many whole groups each."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [np.asarray(batch.column(k)) for k in keys]
        other = np.flatnonzero(np.any([v != v[-1] for v in values], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks()
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with counts[i] of the values in row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def ordered_buckets(df: DataFrame, key: str, rows_each: int, tie: Column, most: int = 100_000) -> tuple[Column, int]:
    """An expression that numbers ranges of (key, tie) in ascending order of key (nulls first), and how many there are.

    The borders are quantiles of the key (percentile_approx over all rows: some thousand numbers at most on the driver,
    never rows).  A key that is the border of several quantiles, and null, get that many ranges of their own, cut by the
    tie, a 64-bit hash, so a hot key fills no range above the others.  Rows that agree in key and tie stay together.  The
    borders are held in two levels, so that a row is compared with about 2 * sqrt(number) of them; beyond `most` quantiles
    ranges hold more rows.  The key must be a column of whole numbers.
    """
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a column of whole numbers, not {dict(df.dtypes)[key]}")
    n, known = df.agg(F.count("*"), F.count(key)).first()
    per = max(rows_each, n / most)
    parts, null_parts = max(1, int(known / per)), max(1, int((n - known) / per))
    if parts == null_parts == 1:
        return F.lit(0), 1
    found = []
    if parts > 1:
        found = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("q")).first()["q"]
    start, cells = null_parts, []  # number of the range that starts at border b, and how many ranges are b's alone
    for b, same in ((b, len([*group])) for b, group in groupby(sorted(found))):
        start += 1
        cells.append({"b": b, "own": same if same > 1 else 0, "start": start})
        start += cells[-1]["own"]
    width = max(1, int(len(cells) ** 0.5))
    groups = [cells[i : i + width] for i in range(0, len(cells), width)]
    col, kind = F.col(key), "array<struct<b: bigint, own: int, start: int>>"
    cut = lambda k: F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * k), k - 1)
    last = lambda xs: F.get(xs, F.size(F.filter(xs, lambda x: x["b"] <= col)) - 1)
    coarse = F.size(F.filter(F.from_json(F.lit(json.dumps([g[0] for g in groups])), kind), lambda x: x["b"] <= col))
    cell = last(F.get(F.from_json(F.lit(json.dumps(groups)), f"array<{kind}>"), coarse - 1))
    placed = F.when(cell["own"].isNull(), null_parts).when((cell["own"] > 0) & (cell["b"] == col), cell["start"] + cut(cell["own"])).otherwise(cell["start"] + cell["own"])
    return F.when(col.isNull(), cut(F.lit(null_parts))).otherwise(placed).cast("int"), start + 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the smallest of each component, which is the root.

    Alternating large-star and small-star rounds; each round is two joins with partially aggregated minima (a hub's
    rows are split by the adaptive skew join) and one written table, so no component is ever gathered in one place.
    """
    now = table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = table(large.where("a != b").distinct(), "large")
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = table(small.where("a != b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen

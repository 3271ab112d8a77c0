"""Token ids as files of fixed-width bit-packed blocks, readable as a whole or id by id."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchstats.llm.shared import fresh_path, ordered_buckets, table

MAGIC = b"TIDP"
HEADER = struct.Struct("<4sHHQQQ")  # magic, bits, zero, documents, ids, blocks
#: Ids of a block; each block starts at a whole byte.
BLOCK = 4096
#: Documents of a file, about.
ROWS_EACH = 2000
#: Ids of a file at most (or one longer document).
FILE_IDS = 8_000_000
#: Characters of text of a task's step (or one longer text).
STEP_CHARS = 2_000_000
#: Cached pieces of text of a worker, and their ids.
PIECES = 1_000_000


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest `bits` bits one after another, lowest bit first; the last byte is padded with zeros."""
    if bits in (8, 16, 32):  # the same bytes as below
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), BLOCK):  # a whole number of bytes each, but for the last
        planes = (ids[at : at + BLOCK].astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, n: int, bits: int, first: int = 0) -> np.ndarray:
    """n ids from number `first` on of one block: four or five bytes around each are shifted and masked."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenFile:
    """A token file: header, document numbers and their null flags, documents' first ids, block offsets, blocks."""

    @staticmethod
    def write(out, doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> tuple[int, int]:
        """Writes the documents in the given order; their number and the number of ids."""
        sizes = np.array([*map(len, ids)], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if len(flat) and int(flat.max()) >= 1 << bits:
            raise ValueError(f"an id does not fit {bits} bits")
        blocks = [pack(flat[i : i + BLOCK], bits) for i in range(0, len(flat), BLOCK)]
        out.write(HEADER.pack(MAGIC, bits, 0, len(ids), len(flat), len(blocks)))
        out.write(np.array([x or 0 for x in doc_ids], np.int64).tobytes())
        out.write(np.array([x is None for x in doc_ids], np.uint8).tobytes())
        out.write(np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64).tobytes())
        out.write(np.concatenate([[0], np.cumsum([*map(len, blocks)])]).astype(np.uint64).tobytes())
        for b in blocks:
            out.write(b)
        return len(ids), len(flat)

    def __init__(self, data: bytes):
        magic, self.bits, _, n, self.n_ids, n_blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token file")
        at = HEADER.size
        raw = np.frombuffer(data, np.int64, n, at)
        nulls = np.frombuffer(data, np.uint8, n, at := at + 8 * n)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(raw, nulls)]
        self.firsts = np.frombuffer(data, np.uint64, n + 1, at := at + n).astype(np.int64)
        self.offsets = np.frombuffer(data, np.uint64, n_blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self.blocks = memoryview(data)[at + 8 * (n_blocks + 1) :]
        if self.offsets[-1] != len(self.blocks) or self.firsts[-1] != self.n_ids:
            raise ValueError("the file's lengths differ from its header")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start ... stop - 1 of the file; only the blocks that hold them are unpacked."""
        out = []
        while start < stop:
            b, first = divmod(start, BLOCK)
            n = min(stop, (b + 1) * BLOCK) - start
            out.append(unpack(self.blocks[self.offsets[b] : self.offsets[b + 1]], n, self.bits, first))
            start += n
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation(), t.no_padding()
    return t


def vocabulary_size(path: str) -> int:
    return load(path).get_vocab_size()


#: Byte-level alphabet of the tokenizers library: the printable bytes stand for themselves, the others for 256, 257, ...
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
BYTE_LEVEL = "".join(chr(b if b in set(_PRINTABLE) else 256 + _OTHERS.index(b)) for b in range(256))
#: From here on the library's idea of a letter or digit may be older than Python's.
UNSURE = "\u0530"
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_byte_level(config: dict) -> bool:
    """Whether a tokenizer is byte-level BPE without any other step, so that Encoder may cut its texts."""
    pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    return (
        not config.get("normalizer")
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and (config.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    )


class Numbers(dict):
    """Numbers of pieces; a new piece gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values) -> None:
        if self.n + len(values) > len(self.data):
            wider = np.zeros(max(2 * len(self.data), self.n + len(values)), self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct piece once.

    A text is cut at blanks and before line breaks.  A piece as it stands has a blank before it; one that starts with
    a line break, or with a null character at the start of a text, has none.  A byte-level tokenizer without other steps
    ends its matches at these places, after a line break, and between a letter or digit and the ASCII marks that end a
    piece, so the ids of the parts are the ids of the text.  Texts with runs of white space or white space of another
    kind, where this need not hold, texts with null characters, and those of any other tokenizer are encoded whole.

    New parts of letters only are one match each and go to the library's BPE in their byte-level spelling, the other new
    parts as lines of one text; an id stands for a fixed number of bytes, which tells where each part's ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = load(path)
        config = json.loads(self.tokenizer.to_str())
        self.whole = not plain_byte_level(config)
        if not self.whole:
            self.merger = Tokenizer.from_str(json.dumps(config | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
            words = self.tokenizer.get_vocab()
            self.bytes_of = np.zeros(max(words.values()) + 1, np.int64)
            for word, i in words.items():
                self.bytes_of[i] = len(word)
            self.forget()

    def forget(self) -> None:
        """Known pieces, where the ids of each start, how many it has, and which ones need their whole text."""
        self.known = Numbers()
        self.starts, self.sizes, self.odd, self.flat = Grown(np.int64), Grown(np.int32), Grown(bool), Grown(np.uint32)
        line_break = self._ids("\n")
        self.known["\0\n"] = 0
        self.starts.add([0]), self.sizes.add([len(line_break)]), self.odd.add([False]), self.flat.add(line_break)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces one after another, and how many each has."""
        sizes = self.sizes.data[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        gaps = self.starts.data[numbers] - (ends - sizes)
        return self.flat.data[np.repeat(gaps, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def learn(self) -> None:
        """Finds the ids of all pieces that are noted as new; parts of them are new pieces too."""
        new, number, base = self.known.new, self.known.__getitem__, len(self.known) - len(self.known.new)
        words, others, marked, broken = [], [], [], []  # places in `new`; the last two with the numbers of their parts
        odd = []
        for i, piece in enumerate(new):  # grows while parts are found
            bare = piece.lstrip("\0\n")
            if bare.split() != [bare]:
                if piece != "\0":
                    odd.append(i)
            elif piece[0] == "\n":
                broken.append((i, number("\0\n"), number("\0" + bare)))
            else:
                core = piece.rstrip(ASCII_MARKS)
                if len(core) < len(piece) and core[-1:].isalnum() and core[-1] < UNSURE:
                    marked.append((i, number(core), number("\0" + piece[len(core) :])))
                else:
                    (words if bare.isalpha() and (bare.isascii() or max(bare) < UNSURE) else others).append(i)
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int32)
        for places, ids_of in ((words, self.merged), (others, self.lines)):
            ids, own = ids_of([new[i][1:] if new[i][0] == "\0" else " " + new[i] for i in places])
            starts[places], sizes[places] = self.flat.n + np.cumsum(own) - own, own
            self.flat.add(ids)
        self.starts.add(starts), self.sizes.add(sizes), self.odd.add(np.isin(np.arange(len(new)), odd))
        for some in (marked, broken):  # a line break may be followed by marked words, not the other way round
            if some:
                place, *parts = np.array(some, np.int64).T
                ids, own = self.gather(np.stack(parts, axis=1).ravel())
                own = own.reshape(-1, 2).sum(axis=1)
                self.starts.data[place + base], self.sizes.data[place + base] = self.flat.n + np.cumsum(own) - own, own
                self.flat.add(ids)
        new.clear()

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are one match each, one after another, and how many each has."""
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(0, len(words), 3000):
            raw = [w.encode() for w in words[i : i + 3000]]
            found = np.array(self.merger.encode_batch_fast([[r.decode("latin-1").translate(BYTE_LEVEL) for r in raw]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            last = np.searchsorted(np.cumsum(self.bytes_of[found]), np.cumsum([*map(len, raw)])) + 1
            out.append(found)
            sizes.append(np.diff(last, prepend=0))
        return np.concatenate(out), np.concatenate(sizes)

    def lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of other parts, none of which has a line break, one after another, and how many each has."""
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(0, len(lines), 3000):
            some = lines[i : i + 3000]
            found = self._ids("\n".join(some))
            last = np.searchsorted(np.cumsum(self.bytes_of[found]), np.cumsum([len(p.encode()) + 1 for p in some]) - 1) + 1
            out.append(np.delete(found, last[:-1]))
            sizes.append(np.diff(last, prepend=-1) - 1)  # without the line break before it
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        if self.whole:
            return [self._ids(t) for t in texts]
        if len(self.known) > PIECES:
            self.forget()
        out, cut = [None] * len(texts), []
        for i, text in enumerate(texts):
            if not text or "\0" in text:
                out[i] = self._ids(text)
                cut.append([])
            else:
                cut.append(("\0" + text).replace("\n", " \n").split(" "))
        lengths = np.array([*map(len, cut)], np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, lengths.sum())
        if self.known.new:
            self.learn()
        if (odd := self.odd.data[numbers]).any():
            for i in np.unique(np.repeat(np.arange(len(texts)), lengths)[odd]):
                out[i] = self._ids(texts[i])
        ids, sizes = self.gather(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths)]
        for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            if out[i] is None:
                out[i] = ids[a:b]
        return out

    def _ids(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], np.uint32)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder; what it knows serves all its tasks."""
    return Encoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 0, rows_each: int = ROWS_EACH) -> DataFrame:
    """Encodes every whole text (null: empty), ends each with end_id, and writes the ids in ascending doc_id order.

    Returns a row per file: bucket and part (ascending), path, documents, ids.  A bucket is a range of doc_id (null first);
    repeated doc_ids stand side by side, in the order of their ids within a bucket, and where they fill several buckets,
    these are cut by a hash of text and input partition, so even many copies of one row are spread.  A file is closed at
    FILE_IDS ids, and the bucket goes on with the next part.  Only ids packed into bytes are shuffled, never texts, and no
    file depends on another.  Retried tasks write other names; only those in the returned table count.  Only doc_id (a
    whole number) and text are read, texts of any length; an empty table gives no files.
    """
    spark = docs.sparkSession
    bits = bits_for(max(vocabulary_size(tokenizer), (end_id or 0) + 1))
    bucket, n = ordered_buckets(docs, "doc_id", rows_each, F.xxhash64("text", F.spark_partition_id()))
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def encode(batches):
        encoder = encoder_of(tokenizer)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and size < STEP_CHARS:
                    size, to = size + len(texts[to] or ""), to + 1
                ids = [np.concatenate([i, tail]) for i in encoder.encode(texts[at:to])]
                packed, counts = [pack(i, bits) for i in ids], [*map(len, ids)]
                own, at = batch.slice(at, to - at), to
                yield pa.RecordBatch.from_arrays([own.column("bucket"), own.column("doc_id"), pa.array(packed, pa.binary()), pa.array(counts, pa.int64())], ["bucket", "doc_id", "packed", "n"])

    folder = fresh_path(spark, "tokens")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        now, part, held, doc_ids, ids = None, 0, 0, [], []

        def close():
            path = f"{folder}/{now:08d}-{part:06d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{root}/{path.rpartition('/')[2]}") as out:
                docs_, ids_ = TokenFile.write(out, doc_ids, ids, bits)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()), "path": [path], "documents": [docs_], "ids": [ids_]})

        for batch in batches:
            for b, d, packed, count in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "packed", "n"))):
                if doc_ids and (b != now or held + count > FILE_IDS):
                    yield close()
                    part, held, doc_ids, ids = part + 1 if b == now else 0, 0, [], []
                now, held = b, held + count
                doc_ids.append(d)
                ids.append(unpack(packed, count, bits))
        if doc_ids:
            yield close()

    kind = dict(docs.dtypes)["doc_id"]
    encoded = docs.select(bucket.alias("bucket"), "doc_id", "text").mapInArrow(encode, f"bucket int, doc_id {kind}, packed binary, n long")
    placed = encoded.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "packed")
    return table(placed.mapInArrow(write, "bucket int, part int, path string, documents long, ids long"), "token-manifest")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of the files.

    A file's first start is a running sum over the few rows of the manifest; a task reads one file at a time.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    file = TokenFile(f.read())
                flat = file.ids(0, file.n_ids).astype("<u4")
                spans = list(zip(file.firsts[:-1], file.firsts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, pa.int64()), pa.array(file.firsts[:-1] + base), pa.array(np.diff(file.firsts)),
                        pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in spans], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.select("path", before.alias("base")).repartition(n, F.xxhash64("path"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

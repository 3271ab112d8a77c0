"""Byte-level BPE with a local rank file: whole texts to token ids and back to the same bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: A text longer than this is encoded in parts, if the pattern is PATTERN; texts of other patterns are encoded whole.
PART_CHARS = 50_000
#: Fixed value: the pattern for which the boundaries below are right.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before a blank or line break that no white space precedes; between an ASCII letter and digit; between a Chinese,
#: Japanese or Korean letter and a mark of these scripts.  No match of the pattern spans these places and no lookahead
#: reaches over them.
SAFE = re.compile("(?<=\\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, without special tokens."""
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in pieces of at least size characters (the last may be shorter), each cut at a safe boundary."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    """Ids of a whole text (null: none), each match of the pattern merged for itself."""
    encoder = load(path, pattern)
    if len(text or "") <= PART_CHARS or pattern != PATTERN:
        return encoder.encode_ordinary(text or "")
    return [i for part in parts(text) for i in encoder.encode_ordinary(part)]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of the ids, which need not be whole UTF-8 characters."""
    return load(path, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids (array of int) and n_tokens of every row's whole text, by a narrow pass over the rows.

    Null or empty texts have no ids; repeated rows are encoded each for itself; columns not kept are not read.
    The rank file must be at the same path on every executor, as the library that holds it is.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                ids = [np.array(encode(t, path, pattern), np.int32) for t in texts[at : at + 500]]
                sizes = np.array([*map(len, ids)], np.int64)
                own = batch.slice(at, 500)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([own.column(c) for c in keep] + [flat, pa.array(sizes)], [*keep, "ids", "n_tokens"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids array<int>, n_tokens long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every whole text encoded, and its ids decoded again.

    Nulls, empty and repeated rows, empty tables and further columns are treated as by encode_documents(); a null text
    decodes to no bytes.  Texts may be of any length; one that has no safe boundary is encoded at once.
    """

    def run(batches):
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in batch.column("ids"):
                own = ids.values.to_pylist()
                out["n_tokens"].append(len(own))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decode(own, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_pydict(out)

    encoded = encode_documents(docs, path, pattern)
    return encoded.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")

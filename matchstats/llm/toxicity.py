"""Toxic spans by a linear-chain conditional random field; its marginals give document scores and offsets.

Only documents are labelled, so the training tokens get their labels from the sample itself: a word is toxic in a toxic
document if it, or its first four characters, occurs far more often in toxic than in other documents.  The field learns
from words, their beginnings and ends, and the labels of neighbours; a document's score is a logistic function of the
marginals' sum and maximum and the number of toxic words.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstats.llm.shared import WORD_BYTES, WordHashes, binaries, free, gram_hashes, mix, table, words_of

#: The model is fitted on at most so many labelled documents that are not and that are toxic (those of smallest hashed
#: doc_id) of at most so many characters; scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_CHARS = (1500, 700), 8000
#: Least log-odds of a toxic word of the sample, and the least number and share of toxic documents that have it.
LOG_ODDS, LEAST_DOCS, LEAST_SHARE = 4.0, 3, 0.01
ROUNDS, STEP, L2 = 25, 0.5, 1e-3
#: Tokens of a row of the blocked forward-backward pass.
COLUMNS = 64


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return ["w=" + w, "a3=" + w[:3], "a4=" + w[:4], "a5=" + w[:5], "z3=" + w[-3:]] if len(w) > 4 else ["w=" + w]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    #: Scores of label pairs (from, to), and of label 1 at a document's start.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    #: Of 1, log(1 + sum of the marginals over 0.05), their maximum, log(1 + number of marginals from 0.5 on).
    document: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 4.0, 0.0]))


class Emissions(dict):
    """Score of label 1 against label 0 for each word; forgets all when it is large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        get = self.model.weights.get
        self[word] = e = self.model.bias + sum(get(f, 0.0) for f in features(word))
        return e


def _compose(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The product of 2 x 2 matrices, scaled so that the largest entry is 1."""
    out = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    top = np.maximum(np.maximum(out[0], out[1]), np.maximum(out[2], out[3]))
    return [x / top for x in out]


def _scan(m: list[np.ndarray]) -> np.ndarray:
    """Odds r_t of r_t = (m1 + r m3) / (m0 + r m2) over all steps, from r = 1.

    Rows of 64 steps are composed side by side, the rows' starts follow one after another, then all rows are stepped
    through side by side again: few numpy calls however long the chain is.
    """
    n = len(m[0])
    rows = -(-n // COLUMNS)
    wide = [np.concatenate([x, np.full(rows * COLUMNS - n, i in (0, 3), float)]).reshape(rows, COLUMNS) for i, x in enumerate(m)]
    whole = [x[:, 0] for x in wide]
    for c in range(1, COLUMNS):
        whole = _compose(whole, [x[:, c] for x in wide])
    starts, r = np.empty(rows), 1.0
    for k, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in whole))):
        starts[k] = r
        low = a + r * c
        r = min(max((b + r * d) / low if low > 1e-300 else 1e30, 1e-30), 1e30)
    out, r = np.empty((rows, COLUMNS)), starts
    for c in range(COLUMNS):
        r = np.clip((wide[1][:, c] + r * wide[3][:, c]) / np.maximum(wide[0][:, c] + r * wide[2][:, c], 1e-300), 1e-30, 1e30)
        out[:, c] = r
    return out.ravel()[:n]


def forward_backward(e: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and marginals of label 1 for the tokens of some documents, one after another."""
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    first = np.zeros(n, bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    t, up = np.exp(moves - moves.max()), np.exp(np.clip(e, -30, 30))
    begin = math.exp(min(max(start, -30), 30))
    m = [np.where(first, 1.0, t[0, 0]), np.where(first, begin, t[0, 1]) * up, np.where(first, 1.0, t[1, 0]), np.where(first, begin, t[1, 1]) * up]
    ahead = _scan(m)
    # Backward the same recurrence over the transposed steps, from the end; a document's last token starts at odds 1.
    nxt = [np.append(x[1:], 1.0)[::-1] for x in m]
    back = _scan([nxt[0], nxt[2], nxt[1], nxt[3]])[::-1]
    back = np.where(np.append(first[1:], True), 1.0, back)
    odds = ahead * back
    return ahead, back, odds / (1 + odds)


def summaries(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The document features of Model.document for each document; one without tokens has only zeros after the 1."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    some = sizes > 0
    if some.any():
        at = (np.cumsum(sizes) - sizes)[some]
        total, number = np.add.reduceat(np.where(p > 0.05, p, 0.0), at), np.add.reduceat((p >= 0.5).astype(float), at)
        out[some, 1], out[some, 2], out[some, 3] = np.log1p(total), np.maximum.reduceat(p, at), np.log1p(number)
    return out


def toxic_words(texts: list[list[bytes]], labels: np.ndarray) -> set[bytes]:
    """The sample's words that are far more frequent in toxic documents, by themselves or by their beginning."""
    counts = [Counter(), Counter()]
    start = lambda w: b"^" + w.decode("utf-8", "replace")[:4].encode()
    for words, y in zip(texts, labels):
        kinds = set(words)
        counts[y].update(kinds | {start(w) for w in kinds if len(w) > 4})
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    odds = lambda f: math.log((counts[1][f] + 0.5) / (n[1] + 1)) - math.log((counts[0][f] + 0.5) / (n[0] + 1))
    strong = {f for f, c in counts[1].items() if c >= max(LEAST_DOCS, LEAST_SHARE * n[1]) and odds(f) >= LOG_ODDS}
    return {w for w in set().union(*map(set, texts)) if w in strong or len(w) > 4 and start(w) in strong} if texts else set()


def first_of_copies(texts: list[bytes]) -> list[bool]:
    """False for texts that share one of three min-hashes of five-word runs with an earlier text: copies and near
    copies of a toxic document would make its ordinary words look toxic."""
    cache, seen, out = WordHashes(), set(), []
    for t in texts:
        h = gram_hashes(cache.array(words_of(t)), 5)
        names = {(k, int(mix(h + np.uint64(k)).min())) for k in (1, 2, 3)} if len(h) else {bytes(t)}
        out.append(not names & seen)
        seen |= names
    return out


def fit_field(texts: list[list[bytes]], labels: np.ndarray) -> Model:
    """The field's weights by full-batch gradient ascent (AdaGrad) on the token labels of some texts."""
    model = Model()
    if not len(labels) or labels.min() == labels.max():
        return model
    sizes = np.array([*map(len, texts)])
    kinds = {w: i for i, w in enumerate(dict.fromkeys(w for ws in texts for w in ws))}
    names: dict[str, int] = {}
    ids = [[names.setdefault(f, len(names)) for f in features(w)] for w in kinds]
    row, col = np.repeat(np.arange(len(ids)), [*map(len, ids)]), np.array([f for i in ids for f in i], np.int64)
    bad = toxic_words(texts, labels)
    token = np.array([kinds[w] for ws in texts for w in ws], np.int64)
    is_bad = np.array([w in bad for w in kinds], bool)
    y = (is_bad[token] & np.repeat(labels == 1, sizes)).astype(float)
    first = np.zeros(len(token), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    inner = np.flatnonzero(~first)
    weights, bias, moves, start = np.zeros(len(names)), model.bias, model.moves, 0.0
    squares, own = np.zeros(len(names)), np.zeros(6)
    for _ in range(ROUNDS):
        e = (bias + np.bincount(row, weights[col], len(kinds)))[token]
        ahead, back, p = forward_backward(e, sizes, moves, start)
        gap = np.bincount(token, y - p, len(kinds))
        grad = np.bincount(col, gap[row], len(names)) - L2 * weights
        a1 = ahead[inner - 1] / (1 + ahead[inner - 1])
        up, s, t = np.exp(np.clip(e[inner], -30, 30)), back[inner], np.exp(moves)
        pairs = np.stack([(1 - a1) * t[0, 0], (1 - a1) * t[0, 1] * up * s, a1 * t[1, 0], a1 * t[1, 1] * up * s])
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1)
        seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)
        small = np.append(seen - expected, [(y - p).sum(), (y - p)[first].sum()])
        squares += grad**2
        own += small**2
        weights += STEP * grad / np.sqrt(squares + 1e-8)
        small = STEP * 0.5 * small / np.sqrt(own + 1e-8)
        moves, bias, start = moves + small[:4].reshape(2, 2), bias + small[4], start + small[5]
    all_names = list(names)
    kept = {all_names[i]: float(weights[i]) for i in np.flatnonzero(np.abs(weights) > 0.01)}
    return Model(kept, float(bias), moves, float(start))


def marginals(model: Model, emissions: Emissions, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words of some texts, one after another, and the texts' numbers of words."""
    parts = [np.fromiter(map(emissions.__getitem__, words), float, len(words)) for words in texts]
    sizes = np.array([*map(len, parts)], np.int64)
    return forward_backward(np.concatenate([np.zeros(0), *parts]), sizes, model.moves, model.start)[2], sizes


def fit(rows: list[tuple[bytes, int]], share: float) -> Model:
    """A model of a sample of (text, toxic) rows; `share` is the share of toxic documents among all labelled ones.

    The document score learns from marginals of fields that did not see the document (two halves of the sample).
    """
    rows = [r for r, k in zip(rows, first_of_copies([t for t, _ in rows])) if k]
    texts, labels = [words_of(t) for t, _ in rows], np.array([y for _, y in rows], np.int64)
    model = fit_field(texts, labels)
    if not model.weights:
        return model
    x, half = np.zeros((len(texts), 4)), np.arange(len(texts)) % 2
    for k in (0, 1):
        field = fit_field([t for t, h in zip(texts, half) if h != k], labels[half != k])
        x[half == k] = summaries(*marginals(field, Emissions(field), [t for t, h in zip(texts, half) if h == k]))
    part = labels.mean()
    weight = np.where(labels == 1, share / part, (1 - share) / (1 - part))
    d = np.zeros(4)
    for _ in range(40):  # Newton's method with a weak prior
        q = 1 / (1 + np.exp(-np.clip(x @ d, -30, 30)))
        grad = x.T @ (weight * (labels - q)) - 0.02 * d
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.02 * np.eye(4)
        d = d + np.linalg.solve(hess, grad)
    model.document = d
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of a bounded sample of the labelled documents that are not held out.

    Labels other than 0 and 1 and null doc_ids are left out; of a repeated doc_id the smallest text is taken; without labels of both kinds a fixed model that rejects
    nothing results.
    """
    use = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in use.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # Which rows: ids only.  Then the texts of those few ids (at most the sum of `rows`, so they may be broadcast).
    near = docs.where(F.length("text") <= chars).where(~held_out()).select("doc_id").join(use, "doc_id")
    ids = [near.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[y]) for y in (0, 1)]
    ids = table(ids[0].unionByName(ids[1]).distinct(), "sample-ids")
    sample = docs.where(F.length("text") <= chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text of a repeated doc_id

    def run(batches):
        found = sorted((r for b in batches for r in zip(b.column("doc_id").to_pylist(), binaries(b, "text"), b.column("toxic").to_pylist())), key=lambda r: (r[2], xxhash.xxh64_intdigest(str(r[0])), r[1]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit([(t, y) for _, t, y in found], share))], pa.binary())})

    # The sample is bounded, so one task fits the model.
    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else Model()


def spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Character offsets [start, stop) of each stretch of words whose marginal is at least a half."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out: list[list[int]] = []
    for k in np.flatnonzero(p >= 0.5).tolist():
        if out and out[-1][2] == k - 1:
            out[-1][1:] = [places[k][1], k]
        else:
            out.append([places[k][0], places[k][1], k])
    if not out:
        return []
    chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # those that begin up to each byte
    before = lambda at: int(chars[at - 1]) if at else 0
    return [{"start": before(a), "stop": before(b)} for a, b, _ in out]


def score(spark: SparkSession, docs: DataFrame, model: Model, names: tuple[str, str] = ("_score", "_spans")) -> DataFrame:
    """All columns of docs with a score (0 to 1), and spans (offending character offsets), by a narrow pass.

    `names` are those of the two new columns.  Whole texts of any length are scored, repeated rows each for itself; an
    empty table gives an empty one.  Null and empty texts have the score of a document without toxic words; labels, lang, source and doc_id play no part.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        emissions = Emissions(model)
        for batch in batches:
            texts, at = binaries(batch, "text"), 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and size < 2_000_000:
                    size, to = size + len(texts[to] or b""), to + 1
                p, sizes = marginals(model, emissions, [words_of(t) for t in texts[at:to]])
                z = summaries(p, sizes) @ model.document
                ends = np.cumsum(sizes)
                found = []
                for t, b, n in zip(texts[at:to], ends, sizes):
                    own = p[b - n : b]
                    found.append(spans(t, own) if n and own.max() >= 0.5 else [])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, to - at).columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    [*batch.schema.names, *names],
                )
                at = to

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + f", `{names[0]}` double, `{names[1]}` array<struct<start: long, stop: long>>"
    return docs.mapInArrow(run, schema)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) and spans for every row of docs; see train() and score()."""
    scored = score(spark, docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_spans").alias("spans"))


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, whatever those are called."""
    names = tuple(free(docs, "_score", "_spans"))
    return score(spark, docs, train(docs, labels), names).where(F.col(names[0]) < 0.5).drop(*names)

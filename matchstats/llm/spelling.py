"""Grouping of spelling variants over a reduced alphabet.

1. words and their counts: one partially aggregated count over all texts;
2. every letter is hashed to one of a few symbols.  Two words that differ by one letter have reduced words that are equal
   or differ by one symbol, so each word's reduced word gets its full one-edit neighbourhood (every insertion, deletion
   and replacement of a symbol, and itself), and the neighbourhoods are joined with the reduced vocabulary;
3. a neighbour's key also holds the original letters of the half that its edit leaves alone, so that words which only
   reduce alike rarely meet; the pairs that meet are verified on the original strings;
4. forms are followed to their roots by doubling the steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.llm.decontaminate import TERM_BITS, term_map
from matchstats.llm.shared import mix, signed, table

#: Fewest letters and occurrences of a word; how many times as often its form occurs; one run of ONE_IN loses a letter.
MIN_LETTERS, MIN_COUNT, TIMES, ONE_IN = 7, 2, 10, 31
#: Symbols of the reduced alphabet: a letter's code point modulo their number.
SYMBOLS = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ODD = 0x9E3779B97F4A7C15
#: Sides of a word: its first half, its second half.
FIRST, SECOND = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    A run is a maximal stretch of letters, A-Z lower-cased; where the crc32 of `<doc_id>:<run>` is a multiple of ONE_IN,
    the run loses the letter at that number modulo its length.  Shorter or rarer words are left out.  A null text has no
    runs, a null doc_id is written as nothing.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]{%d,}" % MIN_LETTERS), F.lit(0))).alias("run"),
    )
    marked = runs.select("run", F.expr("crc32(cast(concat(id, ':', run) AS binary))").alias("h"))
    at = "cast(h % length(run) AS int)"
    word = F.expr(f"CASE WHEN h % {ONE_IN} = 0 THEN concat(substr(run, 1, {at}), substr(run, {at} + 2)) ELSE run END")
    counts = marked.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= MIN_LETTERS) & (F.col("n") >= MIN_COUNT))


def _powers(n: int, base: int = _ODD) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(n)], np.uint64)


def _sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """sums[:, i]: the polynomial of the first i values of each row."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.uint64)
    np.cumsum(values * powers[: values.shape[1]], axis=1, out=out[:, 1:])
    return out


class Words:
    """Some words of one length (rows of code points): polynomials of their letters and of their symbols."""

    def __init__(self, codes: np.ndarray):
        self.m, self.length = codes.shape
        self.power, self.inverse = _powers(self.length + 2), _powers(self.length + 2, pow(_ODD, -1, 1 << 64))
        self.symbols = codes % np.uint64(SYMBOLS) + np.uint64(1)
        self.letters, self.reduced = _sums(codes, self.power), _sums(self.symbols, self.power)

    def half(self, side: np.uint64, length: int) -> np.ndarray:
        """Names of the letters that a word of the given length has in one of its halves, if the edit is in the other."""
        n = length // 2
        if side == FIRST:
            return mix(self.letters[:, n] + side)
        start = self.length - (length - n)
        return mix((self.letters[:, -1] - self.letters[:, start]) * self.inverse[start] + side)

    def key(self, reduced: np.ndarray, side: np.uint64, length: int) -> np.ndarray:
        return mix(mix(reduced + np.uint64(length)) ^ self.half(side, length))

    def own(self) -> np.ndarray:
        """The two keys of each word: its reduced word with either half left alone."""
        return np.stack([self.key(self.reduced[:, -1], side, self.length) for side in (FIRST, SECOND)], axis=1)

    def neighbourhood(self) -> np.ndarray:
        """The keys of all reduced words within one edit of each word's."""
        r, total, one = self.reduced, self.reduced[:, -1], np.uint64(1)
        out = [*self.own().T]
        for p in range(self.length + 1):  # a symbol more, before position p
            side = FIRST if p >= (self.length + 1) // 2 else SECOND
            rest = r[:, p] + (total - r[:, p]) * self.power[1]
            out += [self.key(rest + s * self.power[p], side, self.length + 1) for s in np.arange(1, SYMBOLS + 1, dtype=np.uint64)[:, None]]
        for p in range(self.length):  # one less, one replaced
            side = FIRST if p >= (self.length - 1) // 2 else SECOND
            out.append(self.key(r[:, p] + (total - r[:, p + 1]) * self.inverse[1], side, self.length - 1))
            side = FIRST if p >= self.length // 2 else SECOND
            others = (self.symbols[:, p] - one + np.arange(1, SYMBOLS, dtype=np.uint64)[:, None]) % np.uint64(SYMBOLS) + one
            out += [self.key(total + (o - self.symbols[:, p]) * self.power[p], side, self.length) for o in others]
        return np.stack(out, axis=1)


def key_rows(words: DataFrame, whole: bool, bits=None) -> DataFrame:
    """(key, word, n) of the words' own keys, or of their whole neighbourhoods; with a map of bits only of keys in it."""

    def run(batches):
        known = bits.value if bits is not None else None
        for batch in batches:
            texts = batch.column("word").to_pylist()
            by: dict[int, list[int]] = {}
            for i, w in enumerate(texts):
                by.setdefault(len(w), []).append(i)
            for length, rows in by.items():
                for at in range(0, len(rows), step := max(1, 200_000 // (length * SYMBOLS))):
                    own = np.array(rows[at : at + step])
                    codes = np.frombuffer("".join([texts[i] for i in own]).encode("utf-32-le"), np.uint32).reshape(len(own), length).astype(np.uint64)
                    found = Words(codes)
                    keys = np.sort(found.neighbourhood() if whole else found.own(), axis=1)
                    keep = np.ones(keys.shape, bool)
                    keep[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    if known is not None:
                        keep &= (known[(keys & np.uint64((1 << TERM_BITS) - 1)) >> np.uint64(6)] >> (keys & np.uint64(63))) & np.uint64(1) == 1
                    take = pa.array(own[np.nonzero(keep)[0]])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys[keep])), batch.column("word").take(take), batch.column("n").take(take)], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by just one letter inserted, deleted or replaced."""
    right = table(key_rows(words, False), "reduced").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # A map of fixed size drops the neighbours that no word reduces to; where it fills up, more are joined in vain.
    bits = words.sparkSession.sparkContext.broadcast(term_map(right.select(F.col("key").alias("term"))))
    # Spark takes the neighbourhoods to be as small as the words they come from, and would send them all to the driver.
    met = key_rows(words, True, bits).select("key", "word").join(right.hint("merge"), "key").where(F.levenshtein("word", "near", 1) == 1)
    return met.select("word", "near", "near_n").distinct()  # either half may have brought a pair together


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: the last of the forms that follow from it.

    A form occurs TIMES as often as its word, so chains are short and have no circles; each round doubles the steps.  Joins here
    never broadcast, as a written table of a few MB is compressed and fills many times that on the driver.
    """
    now = table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = table(now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts.

    A word's form is its near word with the largest n (of several the first in code-point order) if that is at least TIMES
    its own n, else null; its root is the last form reached from it, or itself.  Null, empty and wordless texts add
    nothing, repeated rows count each; only doc_id and text are read, texts of any length; an empty table gives an empty
    one.
    """
    words = table(vocabulary(docs), "vocabulary")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    known = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    known = table(known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")), "near")
    found = known.join(roots(known.where("form is not null")).hint("merge"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

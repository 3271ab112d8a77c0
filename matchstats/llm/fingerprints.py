"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction of the hash range.  Built-in functions only.

A fingerprint has the kept 64-bit hashes and, by itself, the smallest hash of all.  The kept hashes of a union of sets of
shingles are the union of their kept hashes, and its smallest hash is the smaller one, so fingerprints merge exactly.  The
share of one fingerprint's hashes in another estimates containment however unequal the documents are; where a text is so
short that none of its hashes is kept, its smallest hash stands for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstats.llm.shared import free, ordered_buckets, table

#: Words of a shingle, and the fraction of the hash range that is kept.
SHINGLE, FRACTION = 5, 0.25
#: Documents of an ordered bucket, about.
ROWS_EACH = 1000
#: Java pattern of the characters between words.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bound(fraction: float = FRACTION) -> int:
    """Signed 64-bit hashes below this are kept."""
    return int(-(2**63) + fraction * 2**64)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str | Column) -> Column:
    """Lower-cased words of ASCII letters and digits and all other characters; none of a null."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.lower(c), GAPS), "")


def fingerprint(text: str | Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """A struct: kept, the sorted distinct shingle hashes below the bound, and least, the smallest hash of all.

    A text of fewer words than a shingle is one shingle; of a text without words nothing is kept and least is null.
    """

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, shingle)))

    def kept(h: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(bound(fraction))))).alias("kept"), F.array_min(h).alias("least"))

    return let(words(text), lambda w: let(hashes(w), kept))


def sample(fp: Column) -> Column:
    """The hashes that stand for a fingerprint's text: the kept ones, or the smallest if none is kept."""
    return F.when((F.size(fp["kept"]) == 0) & fp["least"].isNotNull(), F.array(fp["least"])).otherwise(fp["kept"])


def to_text(fp: Column) -> Column:
    """A fingerprint as text: sixteen hexadecimal digits for each kept hash, ascending; without one, `~` and the smallest
    hash; nothing of a text without words."""
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.when(F.size(fp["kept"]) > 0, F.array_join(F.transform(fp["kept"], digits), "")).otherwise(F.coalesce(F.concat(F.lit("~"), digits(fp["least"])), F.lit("")))


def merge(fingerprints: list[Column]) -> Column:
    """The fingerprint of all the shingles together."""
    least = F.array_min(F.array(*[f["least"] for f in fingerprints]))
    return F.struct(F.array_sort(F.array_distinct(F.flatten(F.array(*[f["kept"] for f in fingerprints])))).alias("kept"), least.alias("least"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 if both are empty."""
    x, y = sample(a), sample(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(shared / F.greatest(F.size(x) + F.size(y) - shared, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    x = sample(a)
    return F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.array_intersect(x, sample(b))) / F.greatest(F.size(x), F.lit(1)))


def with_next(docs: DataFrame, columns: dict[str, str], computed: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Adds the named columns of the next row in descending doc_id order; after the last comes the first.

    Rows are put into quantile buckets of doc_id and each bucket's first row is copied to the bucket before it, so every
    bucket is a window of its own and the rows are shuffled once; `computed` columns are added behind that shuffle.  Equal
    doc_ids are ordered by a hash of the text, null doc_ids come last; many rows without a doc_id, or of one, have several
    buckets, cut by that hash (rows that agree in the text too share one).  doc_id must be a whole number.
    """
    bucket, n = ordered_buckets(docs, "doc_id", ROWS_EACH, F.xxhash64("text"))
    _tie, _bucket, _b, _d, _t, _to, _guest = free(docs, "_tie", "_bucket", "_b", "_d", "_t", "_to", "_guest")
    own = docs.withColumn(_tie, F.xxhash64("text")).withColumn(_bucket, bucket)
    # The first row of a bucket, as (doc_id, tie): some numbers for each bucket.
    firsts = own.groupBy(_bucket).agg(F.max(F.struct(F.col("doc_id").alias("d"), F.col(_tie).alias("t"))).alias("f"))
    order = Window.orderBy(F.col(_bucket).desc())
    to = F.coalesce(F.lag(_bucket).over(order), F.min(_bucket).over(Window.partitionBy()))
    firsts = table(firsts.select(F.col(_bucket).alias(_b), F.col("f.d").alias(_d), F.col("f.t").alias(_t), to.alias(_to)), "firsts")
    same = (own[_bucket] == firsts[_b]) & own["doc_id"].eqNullSafe(firsts[_d]) & (own[_tie] == firsts[_t])
    # firsts has some 100,000 rows of four numbers at most, whatever the input.
    guests = own.join(F.broadcast(firsts), same).select(*[c for c in own.columns if c != _bucket], F.col(_to).alias(_bucket)).dropDuplicates([_bucket])
    rows = own.withColumn(_guest, F.lit(False)).unionByName(guests.withColumn(_guest, F.lit(True)))
    rows = rows.repartition(_bucket).withColumns(computed)
    w = Window.partitionBy(_bucket).orderBy(_guest, F.col("doc_id").desc_nulls_last(), F.col(_tie).desc())
    out = rows.select("*", *[F.lead(c).over(w).alias(a) for c, a in columns.items()])
    return out.where(~F.col(_guest)).drop(_guest, _bucket, _tie)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints every whole text (null: empty) and its edited text, whose last floor(n_chars / 2) code points are
    replaced by the first as many (or all) of the next document's, in descending doc_id order.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (Jaccard estimates),
    and the containment estimates kept_in_edited and kept_in_next.  Only doc_id (a whole number) and text are read.  A
    single row is its own next; repeated rows follow each other; an empty table gives an empty one; texts may be of any
    length.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(own, {"text": "next_text", "fp": "next_fp"}, {"fp": fingerprint("text")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    pairs = pairs.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("edited").alias("edited_fp"))
    a, e, x = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", to_text(a).alias("fingerprint"), to_text(e).alias("edited_fingerprint"),
        jaccard(a, e).alias("near_edited"), jaccard(a, x).alias("near_next"),
        containment(a, e).alias("kept_in_edited"), containment(a, x).alias("kept_in_next"),
    )

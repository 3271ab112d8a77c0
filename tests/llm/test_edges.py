"""Awkward rows and sizes: repeated ids, clashing columns, very long texts, hot groups, damaged input."""

import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from matchstats.llm import bpe, decontaminate, fingerprints, licenses, ngram_join, queries, shared, substring_dedup, token_files, toxicity, url_filter, warc
from tests.llm.test_llm import P, SF, brute_contamination, brute_dedup, lower, rows_of, shingle_set

WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(r, n, prefix="w", size=400):
    return " ".join(f"{prefix}{r.randrange(size)}" for _ in range(n))


# 3: names, hot buckets, recall --------------------------------------------------------------------------------------


def brute_rows(rows):
    """Per doc_id the smallest class and the most links of its rows; every row is a document."""
    sets = [shingle_set(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    pairs = [(x, y) for x in range(len(rows)) for y in range(len(rows)) if x != y and near(sets[x], sets[y])]
    root = [d for d, _ in rows]
    for _ in rows:
        for x, y in pairs:
            root[x] = min(root[x], root[y])
    out = {}
    for i, (d, _) in enumerate(rows):
        c, n = out.get(d, (root[i], 0))
        out[d] = min(c, root[i]), max(n, sum(x == i for x, _ in pairs))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_of_repeated_and_null_ids(spark, seed):
    r = random.Random(seed)
    a, b, c = (words(r, 60) for _ in range(3))
    rows = [(5, a), (7, a), (9, a), (5, b), (8, b), (11, b), (5, c), (12, c + " more"), (8, None), (13, ""), (14, "x")]
    df = spark.createDataFrame([*rows, (None, a)], "doc_id long, text string").withColumns({"rep": F.lit(1), "a": F.lit("x"), "class_id": F.lit(2)})
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.join(df.repartition(3)).collect()} == brute_rows(rows)


def test_join_of_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    r = random.Random(1)
    base = [f"v{r.randrange(900)}" for _ in range(300)]
    rows = []
    for i in range(24):
        own = list(base)
        for _ in range(r.choice([0, 1, 3, 8])):
            own[r.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.join(df).collect()} == brute_rows(rows)


def test_join_recall_near_the_threshold(spark):
    """Pairs of a similarity from 0.8 to 0.85, among them those of one group with a common half: links found over links."""
    r, rows = random.Random(11), []
    for i in range(700):
        own = [f"p{i}x{r.randrange(10**6)}" for _ in range(250)]
        other = list(own)
        for k in range(r.choice([4, 5])):  # each changed word takes five shingles of about 246
            other[8 + 45 * k + r.randrange(20)] = "changed"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    true = [i for i in range(700) if 0.8 <= (lambda a, b: len(a & b) / len(a | b))(shingle_set(rows[2 * i][1]), shingle_set(rows[2 * i + 1][1])) <= 0.86]
    got = {x["doc_id"]: x["n_links"] for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = sum(got[2 * i] == 1 and got[2 * i + 1] == 1 for i in true)
    assert len(true) > 400 and found >= 0.998 * len(true)


# 4 ------------------------------------------------------------------------------------------------------------------


def xxh64_of_strings(parts):
    """Spark's xxhash64 of an array: each element's hash is the next one's seed, from 42."""
    import xxhash

    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def sketch(text):
    w = WORDS.findall((text or "").lower())
    h = {xxh64_of_strings(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sorted(x for x in h if x < fingerprints.bound()), min(h, default=None)


def test_fingerprints_recomputed_outside_spark(spark):
    r = random.Random(4)
    texts = [words(r, n) for n in (0, 1, 4, 5, 6, 7, 40, 300)] + [None, "", "  ", "É Über ß don't 中文 x", words(r, 30_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"fp": F.lit(1), "_tie": F.lit(2), "_bucket": F.lit(3), "next_text": F.lit("n")})
    got = {x["doc_id"]: x for x in fingerprints.compare_edited(rows.drop("fp")).collect()}
    show = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s[0]) if s[0] else "" if s[1] is None else f"~{s[1] & (1 << 64) - 1:016x}"
    like = lambda a, b: (lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y))(*({*s[0]} or {*filter(lambda v: v is not None, [s[1]])} for s in (a, b)))
    for i, t in enumerate(texts):
        t, nxt = t or "", (texts[i - 1] if i else texts[-1]) or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, other, new = sketch(t), sketch(nxt), sketch(edited)
        x = got[i]
        assert (x["fingerprint"], x["edited_fingerprint"]) == (show(own), show(new))
        assert abs(x["near_edited"] - like(own, new)) < 1e-9 and abs(x["near_next"] - like(own, other)) < 1e-9


def test_fingerprints_of_short_texts_merge(spark):
    """The merged fingerprint is the fingerprint of all shingles together, for texts without a kept hash too."""
    r = random.Random(5)
    rows = [(i, words(r, 6, "a"), words(r, r.choice([3, 6, 90]), "b")) for i in range(60)] + [(60, "", None)]
    df = spark.createDataFrame(rows, "i long, a string, b string").select("i", "a", "b", fingerprints.merge([fingerprints.fingerprint("a"), fingerprints.fingerprint("b")]).alias("m"))
    for x in df.collect():
        one, two = sketch(x["a"]), sketch(x["b"])
        assert x["m"]["kept"] == sorted({*one[0], *two[0]}) and x["m"]["least"] == min(filter(lambda v: v is not None, (one[1], two[1])), default=None)


def test_ordered_keys_must_be_whole_numbers(spark):
    for n in (1, 3000):
        df = spark.range(n).selectExpr("string(id) AS doc_id", "'t' AS text")
        for run in (fingerprints.compare_edited, lambda d: token_files.write_token_files(d, P.path("byte_bpe_50k.json"))):
            with pytest.raises(TypeError):
                run(df)


@pytest.fixture
def hot_ids(spark):
    """Half of the rows have no doc_id, a quarter share one, the others have their own."""
    r = random.Random(46)
    rows = [(None if i % 2 else 700 if i % 4 else i, words(r, r.randrange(12), size=50) if i % 11 else None) for i in range(2400)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_hot_ids_fill_several_buckets(spark, hot_ids):
    rows, df = hot_ids
    for n, tie in ((40, F.xxhash64("text", "doc_id")), (40, F.xxhash64("text", F.spark_partition_id())), (7, F.xxhash64("text", F.spark_partition_id()))):
        bucket, most = shared.ordered_buckets(df, "doc_id", len(rows) // n, tie)
        got = df.select(bucket.alias("b"), "doc_id").collect()
        sizes = {}
        for b, d in got:
            sizes.setdefault(b, []).append((d is not None, d or 0))
        assert 0 <= min(sizes) and max(sizes) < most <= 2 * n + 2
        assert max(map(len, sizes.values())) < 6 * len(rows) // n  # a tenth of the texts are null and share their hash
        order = [(min(v), max(v)) for _, v in sorted(sizes.items())]
        assert all(a[1] <= b[0] for a, b in zip(order, order[1:]))


def test_copies_of_one_row_are_spread(spark):
    df = spark.range(0, 4000, 1, 16).selectExpr("if(id % 3 = 0, null, 5L) AS doc_id", "'same' AS text")
    bucket, _ = shared.ordered_buckets(df, "doc_id", 250, F.xxhash64("text", F.spark_partition_id()))
    assert max(r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()) < 2000


def test_fingerprints_of_hot_ids(spark, hot_ids, monkeypatch):
    """Every row meets one next row, in one ring over all buckets, by doc_id and hash of the text."""
    rows, df = hot_ids
    monkeypatch.setattr(fingerprints, "ROWS_EACH", 60)
    got = fingerprints.with_next(df, {"text": "next_text", "doc_id": "next_id"}).collect()
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]), reverse=True)
    want = [(d, t, nt, nd) for (d, t), (nd, nt) in zip(order, order[1:] + order[:1])]
    assert sorted(map(repr, want)) == sorted(repr((x["doc_id"], x["text"], x["next_text"], x["next_id"])) for x in got)


def test_token_files_of_hot_ids(spark, hot_ids, monkeypatch):
    rows, df = hot_ids
    path = P.path("byte_bpe_50k.json")
    whole = token_files.write_token_files(df, path, end_id=0, rows_each=60)
    assert whole.agg(F.max("documents")).first()[0] < len(rows) // 4
    monkeypatch.setattr(token_files, "FILE_IDS", 100)
    files = token_files.write_token_files(df, path, end_id=0, rows_each=600)
    assert files.agg(F.max("part")).first()[0] > 3 and files.agg(F.max("ids")).first()[0] <= 100
    for f in (whole, files):
        got = sorted(token_files.read_token_files(f).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sorted(repr((r["doc_id"], r["ids_crc32"])) for r in got) == sorted(repr((d, crc([*token_files.load(path).encode(t or "", add_special_tokens=False).ids, 0]))) for d, t in rows)


# 5 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [2, 6, 40])
def test_substring_dedup_of_hot_anchors(spark, monkeypatch, hot):
    """A common phrase in many contexts, and one passage in most documents."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_ROWS", 30)
    r = random.Random(hot)
    phrase, passage, contexts = "to be or not", words(r, 40, "p"), [words(r, 12, "c") for _ in range(9)]
    rows = []
    for i in range(70):
        parts = [words(r, r.randrange(20), "w", 30)]
        for _ in range(3):
            parts += [r.choice(contexts), phrase, r.choice(contexts)]
        if i % 3:
            parts.insert(r.randrange(len(parts)), passage)
        rows.append((i * 11 % 71, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(substring_dedup.removed(df)) == sorted(brute_dedup(rows), key=repr)


# 6 and 2: long texts, other patterns --------------------------------------------------------------------------------


def test_encoder_equals_library_on_odd_texts():
    e, r = token_files.Encoder(P.path("byte_bpe_50k.json")), random.Random(0)
    letters = list("abXé9ñ0'.,!?-_ \n\t\r\x00\u00a0\u3000\x0b\x1c\x85中字ªº²½ͅำ\U0001f600") + ["'s", "'ll", " ", "  ", "\n", "don't", "word", "Word,", "...", "!!", "  \n"]
    assert not e.whole
    for _ in range(1500):
        some = ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(8)]
        assert [x.tolist() for x in e.encode(some)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_encoder_of_another_tokenizer_is_whole():
    e = token_files.Encoder(P.path("word_bpe_49k.json"))
    some = ["Hello, World's end.", None, "", "a  b\nc"]
    assert e.whole and [x.tolist() for x in e.encode(some)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_bit_packing_of_long_texts():
    ids = np.random.default_rng(1).integers(0, 1 << 17, 50_001).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, 17), len(ids), 17) == ids).all()


def test_bpe_of_other_patterns_and_scripts(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.PATTERN == P.PATTERN
    monkeypatch.setattr(bpe, "PART_CHARS", 5)
    other = r"[^\s\p{L}\p{N}]+[\r\n]*| ?\p{L}+|\p{N}+|\s+"
    for t in ["中文字。日本語、한국어，é à, ü.\n\n x", "a.\n\nb!!\n c12d", "\u3000 \u00a0 a\u00a0 b", "x" * 40 + "。" * 9]:
        for pattern in (P.PATTERN, other):
            assert bpe.encode(t, path, pattern) == bpe.load(path, pattern).encode_ordinary(t)
    assert len(list(bpe.parts("中文字。" * 9, 5))) > 2


def test_texts_longer_than_a_step(spark, monkeypatch):
    """One text of over STEP_BYTES bytes and of over PART_CHARS characters through the text operators."""
    r = random.Random(8)
    long = words(r, 260_000, "l", 10**6)
    assert len(long) > shared.STEP_BYTES and len(long) > bpe.PART_CHARS
    passage = " ".join(long.split()[1000:1040])
    rows = [(1, long), (2, "start " + passage + " end"), (3, "MIT License. " + long[:200]), (4, long + " idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(substring_dedup.removed(df)) == sorted(brute_dedup(rows), key=repr)
    items = [(1, passage), (2, "nothing of it")]
    assert rows_of(decontaminate.digest(decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")))) == brute_contamination(rows, items)
    assert {x["doc_id"]: x["n_words"] for x in licenses.scan(df).collect()} == {d: len(t.replace(".", " ").split()) for d, t in rows}
    assert {x["doc_id"]: x["class_id"] for x in ngram_join.join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert {x["doc_id"]: x["n_tokens"] for x in bpe.encode_documents(df, path, P.PATTERN).collect()} == {d: len(bpe.load(path, P.PATTERN).encode_ordinary(t)) for d, t in rows}
    assert {x["doc_id"] for x in toxicity.score(spark, df, toxicity.Model({"w=idiot": 20.0})).where("size(_spans) = 1").collect()} == {4}


# 7 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_score_equals_a_plain_field(spark):
    """Scores and spans of a fitted model, recomputed with a plain forward-backward pass for each document."""
    r, rows = random.Random(2), []
    for i in range(160):
        w = [f"word{r.randrange(120)}" for _ in range(r.randrange(5, 30))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["idiot", "morons", "scumbag"])
        rows.append((" ".join(w).encode(), int(i % 4 == 0)))
    model = toxicity.fit(rows, 0.25)
    assert model.weights
    texts = [*[t for t, _ in rows[:30]], b"", b"idiot", None]
    got = toxicity.score(spark, spark.createDataFrame([(i, t.decode() if t is not None else None) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for x in got:
        w = shared.words_of(texts[x["doc_id"]])
        e = [model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(v)) for v in w]
        ahead = [np.array([1.0, np.exp(model.start + e[0])])] if w else []
        for v in e[1:]:
            step = (ahead[-1] @ np.exp(model.moves)) * [1.0, np.exp(v)]
            ahead.append(step / step.sum())
        back = [np.ones(2) for _ in w]
        for k in range(len(w) - 2, -1, -1):
            back[k] = np.exp(model.moves) @ (back[k + 1] * [1.0, np.exp(e[k + 1])])
            back[k] /= back[k].sum()
        p = [float((a * b)[1] / (a * b).sum()) for a, b in zip(ahead, back)]
        z = model.document @ [1, np.log1p(sum(v for v in p if v > 0.05)), max(p, default=0), np.log1p(sum(v >= 0.5 for v in p))]
        assert abs(x["_score"] - 1 / (1 + np.exp(-z))) < 1e-6 and sum(v >= 0.5 for v in p) >= len(x["_spans"]) >= (max(p, default=0) >= 0.5)


def test_toxicity_of_repeated_and_clashing_rows(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string").withColumns({"_score": F.lit(9), "_SPANS": F.lit("s")})
    lab = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.clean(spark, d, lab).columns == d.columns and toxicity.clean(spark, d, lab).count() == 4


# 8 ------------------------------------------------------------------------------------------------------------------


def test_decontamination_of_common_words(spark):
    """Windows of common words only, one of a single word, and one whose terms stand in a block but not together."""
    r = random.Random(3)
    rows = [(i, words(r, r.choice([0, 2, 30, 200]), "t", 12)) for i in range(80)] + [(None, "t1 t1 t1"), (99, None)]
    items = [(i, words(r, 13 if i % 2 else 3, "t", 12)) for i in range(30)] + [(40, rows[5][1]), (41, "t1 t1 t1"), (42, "t1"), (43, "t2 absent")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit(1), "block": F.lit(2), "n": F.lit(0)})
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.digest(decontaminate.contamination(df.repartition(5), b))) == brute_contamination(rows, items)


def test_proximity_marks_the_words_found(spark, monkeypatch):
    """Words up to one place away from where the window has them, also at the start of a document."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    item = [f"q{i}" for i in range(13)]
    shifted = ["x", *item[:5], "gap", *item[5:], "y"]  # the last eight words stand one place further on
    late = [*item[1:], "q0"]  # the first word stands behind the others
    docs = [(1, " ".join(item)), (2, " ".join(shifted)), (3, " ".join(late)), (4, " ".join(["q0", "gap", *item[1:]])), (5, None), *[(100 + i, "q0 q12 " * 30) for i in range(20)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    near = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(df, b, slop=1).collect()}
    assert near[1] == near[2] == near[4] == (13, ["a"]) and near[3] == (0, []) and near[5] == (0, [])
    assert all(near[100 + i] == (0, []) for i in range(20))
    exact = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(df, b).collect()}
    assert exact == {d: 13 if d == 1 else 0 for d, _ in docs}


# 9 ------------------------------------------------------------------------------------------------------------------


class Plain:
    """A recursive-descent reader of licence expressions, to compare with; `longest` tries every beginning."""

    def __init__(self, text):
        self.t, self.i = re.findall(r"[()]|[^\s()]+", text), 0

    def value(self):
        v = self.conjunction()
        while self.i < len(self.t) and self.t[self.i] == "or":
            self.i += 1
            w = self.conjunction()
            v = v[0] or w[0], v[1] | w[1]
        return v

    def conjunction(self):
        v = self.one()
        while self.i < len(self.t) and self.t[self.i] == "and":
            self.i += 1
            w = self.one()
            v = v[0] and w[0], v[1] | w[1]
        return v

    def one(self):
        token = self.t[self.i]
        self.i += 1
        if token == "(":
            v = self.value()
            assert self.t[self.i] == ")"
            self.i += 1
            return v
        label = licenses.family(token)
        assert token not in licenses.BINDING and label
        if self.i < len(self.t) and self.t[self.i] == "with":
            assert licenses.family(self.t[self.i + 1])
            self.i += 2
        return label in licenses.PERMISSIVE, {label}

    @classmethod
    def longest(cls, text):
        t = re.findall(r"[()]|[^\s()]+", text)
        for n in range(len(t), 0, -1):
            p = cls(" ".join(t[:n]))
            try:
                v = p.value()
            except (AssertionError, IndexError):
                continue
            if p.i == n:
                return t[:n], v
        return [], None


def test_license_expressions_equal_a_plain_reader():
    r = random.Random(6)
    alphabet = ["mit", "gpl-3.0-only", "apache-2.0", "epl-2.0", "zlib", "and", "or", "with", "(", ")", "word", "classpath-exception-2.0"]
    for _ in range(4000):
        text = " ".join(r.choice(alphabet) for _ in range(r.randrange(1, 9)))
        tokens, value = Plain.longest(text)
        assert licenses.longest(text) == tokens, text
        if tokens:
            assert licenses.evaluate(licenses.postfix(" ".join(tokens))) == value


def test_licenses_of_long_expressions_and_odd_identifiers(spark):
    tag = "SPDX-License-Identifier: "
    long = " AND ".join(["MIT"] * 60) + " AND GPL-3.0-only"
    cases = [
        (1, tag + long, "gpl,mit", False, 1), (2, tag + "(" + " OR ".join(["Apache-2.0"] * 70) + ") AND GPL-3.0-only", "apache,gpl", False, 1),
        (3, tag + "EPL-2.0 OR Zlib", "epl-2.0,zlib", True, 1), (4, tag + "mitre", "", False, 0), (5, f"{tag}MIT {tag}GPL-2.0+", "gpl,mit", False, 2),
        (6, "// " + tag + "BSD-3-Clause */ int x;", "bsd", True, 1), (7, tag + "MIT. See the file", "mit", True, 1), (8, tag + "(MIT", "", False, 0), (9, "SPDX License Identifier: MIT", "", False, 0),
        (10, tag, "", False, 0), (11, tag + "\nMIT", "", False, 0), (12, "é " + tag + "LicenseRef-own-1 WITH x-1", "licenseref-own-1", False, 1), (13, tag + "x " * 200_000, "", False, 0),
        (14, tag + "MIT-0 AND GPLv2", "gpl,mit", False, 1),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string").withColumns({"n_words": F.lit(1), "score": F.lit("s")})
    got = {x["doc_id"]: x for x in licenses.scan(df).collect()}
    for d, _, labels, free, n in cases:
        assert (got[d]["labels"], got[d]["permissive"], len(got[d]["expressions"])) == (labels, free, n), d
        assert got[d]["score"] == (1 if n else 0) and got[d]["n_base"] == 0


def test_license_labels_equal_brute_force(spark):
    r = random.Random(9)
    parts = [*licenses.BASE, *licenses.MORE, "lorem", "ipsum", "mit", "license", "SPDX-License-Identifier: MIT OR EPL-2.0\n", "SPDX-License-Identifier: GPL-2.0-only;"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(12)))) for i in range(200)]
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    phrases = {**licenses.BASE, **licenses.MORE}
    for d, t in rows:
        w = WORDS.findall(lower(t))
        at = [p for i in range(len(w)) for p in phrases if w[i : i + len(p.split())] == p.split()]
        found = [Plain.longest(re.split(r"[;\n]|spdx-", m)[0]) for m in lower(t).split("spdx-license-identifier:")[1:]]
        labels = {phrases[p] for p in at}.union(*[v[1] for _, v in found if v])
        assert got[d]["labels"] == ",".join(sorted(labels)) and abs(got[d]["score"] - (1.0 if any(v for _, v in found) else 1 - 0.5 ** len(at))) < 1e-12


# 1 and 10 -----------------------------------------------------------------------------------------------------------


def test_warc_of_odd_ids(spark):
    ids = ["a\r\nWARC-Type: x", "", "é<>%41 b+c", None, "x", "x"]
    pages = spark.createDataFrame([(i, f"http://{k}", f"p{min(k, 4)}") for k, i in enumerate(ids)], "page_id string, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(((x["page_id"], x["record_type"]) for x in warc.archived(pages).collect()), key=repr)
    assert got == sorted(((i, "response") for i in ids), key=repr)
    empty = spark.createDataFrame([("", "u", "same"), ("b", "u", "same"), (None, "u", "same")], "page_id string, url string, html string")
    assert sorted(((x["page_id"], x["refers_to"]) for x in warc.archived(empty).collect()), key=repr) == sorted([("", "b"), ("b", None), (None, "b")], key=repr)


def test_warc_of_damaged_and_large_frames():
    out = io.BytesIO()
    warc.archive(iter([warc.record(1, "u", b"x" * 5000, None, "2024-01-01T00:00:00Z")]), out)
    data = out.getvalue()
    assert len(list(warc.frames(data + struct.pack("<II", 0x184D2A51, 4) + b"note"))) == 1
    for bad in (data + struct.pack("<II", 0x184D2A51, 400) + b"cut", data[:-1]):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(bad))
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(b"y" * 100_000)
    assert [len(f) for f in warc.frames(unsized)] == [100_000]
    for frame in (unsized, zstandard.ZstdCompressor().compress(b"y" * 100_000)):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(frame, most=1000))


def test_url_rules_are_texts(spark):
    rules = [url_filter.Rule("x.org/a*", "block"), url_filter.Rule("x.org/b?c", "block"), url_filter.Rule("x.org/d\\e", "block")]
    urls = ["h://x.org/a*z", "h://x.org/a/b", "h://x.org/ab", "h://x.org/b?c", "h://x.org/bxc", "h://x.org/d\\e", "h://s.x.org/a*"]
    df = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2)})
    got = url_filter.judge(df, rules).collect()
    assert {x["page_id"]: x["rule"] for x in got} == {0: "x.org/a*", 1: None, 2: None, 3: None, 4: None, 5: "x.org/d\\e", 6: "x.org/a*"} and len(got) == 8
    assert url_filter.judge(df.where("false"), rules).count() == 0


# Pipeline and shared folder -----------------------------------------------------------------------------------------


def test_pipeline_stages_on_awkward_tables(spark):
    r = random.Random(12)
    shared_passage, item = words(r, 40, "s"), spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first()["text"]
    rows = [
        (1, words(r, 50) + " " + shared_passage), (2, words(r, 50) + " " + shared_passage), (2, words(r, 50)), (None, "no id " + words(r, 30)), (None, item), (3, item), (3, "clean " + words(r, 40)),
        (4, None), (5, ""), (6, words(r, 60)),
    ]
    rows += [(7, rows[-1][1]), (7, "other " + words(r, 40)), (None, rows[-1][1])]
    names = ["kept", "_sig", "_score", "_spans", "_key", "sig", "n_removed", "class_id", "contaminated", "block"]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(f"own {n}") for n in names})
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        after[name] = [(x["doc_id"], x["text"]) for x in out.collect()] if name != "bpe" else out.count()
        if name != "bpe":
            assert out.columns == df.columns and all(x[n] == f"own {n}" for x in out.collect() for n in names)
        assert stage(spark, df.where("false"), SF).count() == 0
    count = lambda name, row: after[name].count(row)
    assert len(after["toxicity"]) == len(rows) == after["bpe"] == len(after["substring-dedup"])
    assert count("near-copies", rows[9]) + count("near-copies", rows[10]) + count("near-copies", rows[12]) == 1 and count("near-copies", rows[11]) == 1
    assert count("near-copies", (None, item)) + count("near-copies", (3, item)) == 1 and len(after["near-copies"]) == len(rows) - 3
    assert not count("decontamination", (None, item)) and not count("decontamination", (3, item)) and len(after["decontamination"]) == len(rows) - 2


def test_shared_folder_and_clearing(spark, monkeypatch, tmp_path):
    path = shared.own_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = shared.table(spark.range(3), "mine")
    with monkeypatch.context() as m:
        m.setattr(shared, "shared_dir", lambda s: f"file://{tmp_path}")
        shared.table(spark.range(3), "mine")
        assert any(tmp_path.iterdir())
        shared.clear(spark)
        assert not any(tmp_path.iterdir())
    assert df.count() == 3

    class Unset:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "local[2]", "x"

    assert shared.shared_dir(Unset) == shared.shared_dir(Unset) and shared.shared_dir(Unset).startswith("file:///")
    Unset.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared.shared_dir(Unset)
    assert shared.free(df.withColumn("A", F.lit(1)), "a", "id", "b") == ["a_", "id_", "b"]


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_toxicity_and_encoding_equal_their_operators(spark):
    """What the first stage keeps is what the score says, and the last stage's ids are the library's."""
    larger = SF.replace("0.001", "0.01")  # with enough toxic documents to learn from
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    rejected = {x["doc_id"] for x in toxicity.judge(spark, docs, labels).where("predicted = 1").collect()}
    kept = {x["doc_id"] for x in corpus_pipeline.drop_toxic(spark, docs, larger).collect()}
    assert rejected and kept == {x["doc_id"] for x in docs.collect()} - rejected
    plain = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    got = {x["doc_id"]: x for x in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert got.keys() == texts.keys() and all(x["ids"] == plain.encode_ordinary(texts[d] or "") and x["n_tokens"] == len(x["ids"]) for d, x in got.items())

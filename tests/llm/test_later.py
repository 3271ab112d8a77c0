"""Spelling variants, hard negatives and suffix-array dedup against brute force; op5 on words whose hashes are alike."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchstats.llm import hard_negatives, queries, shared, spelling, substring_dedup, suffix_dedup, suffixes
from tests.llm.test_llm import brute_dedup, rows_of

SF = "/root/testdata/sf0.001"


def sql_rows(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toArrow())
    rel = con.execute(queries.SQL[name])
    names = [c[0] for c in rel.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()), key=repr)


def found(df):
    return rows_of(df.select(*sorted(df.columns)))


# 5: words that the lower bits of their hashes don't tell apart -------------------------------------------------------


def colliding():
    """Two words whose hashes have equal lower 31 bits."""
    text = " ".join(f"n{i}" for i in range(200_000)).encode()
    h, _ = shared.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shared.RAW)
    low = (h & np.uint64(0x7FFFFFFF)).astype(np.int64)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])[0]
    return f"n{order[at]}", f"n{order[at + 1]}"


@pytest.mark.parametrize("hot", [5_000, 2])
def test_dedup_tells_words_apart_whose_hashes_are_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    a, b = colliding()
    same = [f"same{i}" for i in range(30)]
    rows = []
    for i, at in enumerate((0, 3, 6, 9, 12)):
        start = same[at : at + 12]
        rows += [(4 * i, " ".join([*start[:6], a, *start[6:]])), (4 * i + 1, " ".join([*start[:6], b, *start[6:]])), (4 * i + 2, " ".join([f"own{i}", *start[:6], a, *start[6:], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substring_dedup.removed(df)) == sorted(brute_dedup(rows), key=repr)


# 11 ------------------------------------------------------------------------------------------------------------------


def brute_variants(rows):
    n = {}
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in low).split(" "):
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in close.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((form.get(w), n[form[w]] if w in form else None, n[w], len(close[w]), root, w))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_spelling_variants(spark, seed):
    r = random.Random(seed)
    letters = "abcdeßéÿ×"
    base = ["".join(r.choice(letters) for _ in range(r.choice([7, 8, 9, 12]))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    pool = []
    for w in base:
        for _ in range(6):
            p, v = r.randrange(len(w)), w
            v = r.choice([w, w[:p] + w[p + 1 :], w[:p] + r.choice(letters) + w[p:], w[:p] + r.choice(letters) + w[p + 1 :]])
            pool += [v] * r.choice([1, 2, 3, 25, 300])
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i::40]).upper().replace("SS", "ß") if i % 2 else "-".join(pool[i::40])) for i in range(40)]
    rows += [(1, None), (2, ""), (3, "12 34"), (None, "aaaaaaa AAAAAAA"), (5, rows[5][1]), (6, "x" * 100_000 + " " + "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2)}).repartition(3)
    assert found(spelling.variants(df)) == brute_variants(rows)
    assert spelling.variants(df.where("text = ''")).count() == 0 == spelling.variants(df.where("false")).count()


def test_no_neighbourhood_is_broadcast(spark):
    """A neighbourhood has some hundred times the rows of its words, whose size is all that Spark knows of it."""
    words = shared.table(spark.createDataFrame([("analysis", 9), ("analyses", 2)], "word string, n long"), "words")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10_000_000
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in spelling.near_pairs(words).collect()} == {("analysis", "analyses", 2), ("analyses", "analysis", 9)}


def test_spelling_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(queries.op11_spelling_variants(spark, SF)) == sql_rows("op11_spelling_variants", documents=docs)


def test_roots_of_long_chains(spark):
    rows = [(f"w{i:02}", f"w{i + 1:02}") for i in range(18)] + [("x", "w03")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {w: "w18" for w, _ in rows}


# 12 ------------------------------------------------------------------------------------------------------------------


def vectors(seed, n=260, dim=6, spread=0.2, coarse=False):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    x = centres[r.integers(0, 5, n)] + spread * r.normal(size=(n, dim))
    if coarse:
        x = np.round(x)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, r.integers(0, 10, n)))]
    rows += [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), 1), (n + 3, [float("inf")] * dim, 2), (n + 4, [1.0] * dim, None), (50, rows[50][1], rows[50][2])]
    return rows


def brute_negatives(rows):
    use = []
    for i, x, label in rows:
        if x is None or label is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * v)) for v in x]))
    out, seen = [], set()
    for a, (i, label, q) in enumerate(use):
        if i % 50 or (i, label, *q) in seen:
            continue
        seen.add((i, label, *q))
        dot = [sum(s * t for s, t in zip(q, p)) for _, _, p in use]
        positives = sorted((-dot[b], use[b][0]) for b in range(len(use)) if b != a and use[b][1] == label)[:5]
        for s, p in positives:
            good = sorted((-dot[b], use[b][0]) for b in range(len(use)) if use[b][1] != label and 50 * -s <= 100 * dot[b] <= 95 * -s)[:3]
            out += [(i, j, -s, p, k + 1, -t) for k, (t, j) in enumerate(good)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,coarse,step", [(0, False, 4096), (1, True, 7), (2, False, 50)])
def test_hard_negatives(spark, monkeypatch, seed, coarse, step):
    for name, value in (("VALUES", 300), ("STEP", step), ("BLOCK", 4), ("LEAST", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(seed, coarse=coarse)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).repartition(3)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    own = hard_negatives.whole_vectors(df).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    columns = ["anchor_id", "negative_id", "positive_score", "positive_id", "rank", "negative_score"]
    got = hard_negatives.mine(own, F.col("vec_id") % 50 == 0).select(*columns)
    assert rows_of(got) == brute_negatives(rows)
    assert hard_negatives.mine(own.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_hard_negatives_sql(spark):
    assert found(queries.op12_hard_negatives(spark, SF)) == sql_rows("op12_hard_negatives", embeddings=spark.read.parquet(f"{SF}/embeddings.parquet"))


def test_large_components_and_other_lengths(spark):
    big = float(1 << 22)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 2, [big * 0.75, 5.0]), (3, 2, [1.0, 2.0, 3.0]), (50, 1, [2.0, 2.0, 2.0]), (51, 1, [3.0, 3.0, 3.0]), (52, 2, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, k) for i, k, v in rows], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.whole_vectors(df), F.col("vec_id") % 50 == 0).orderBy("anchor_id").collect()]
    b = int(big) * 256
    assert got[0] == (0, 1, 1, 2, b * b + 256 * 768, b * (b * 3 // 4) + 256 * 1280)
    assert got[1] == (50, 51, 1, 3, 512 * 768 * 3, 512 * 256 * 6)


def test_bounds_spare_scores():
    r = np.random.default_rng(0)
    x = np.repeat(r.integers(-256, 256, (20, 32)), 200, axis=0) + r.integers(-2, 3, (4000, 32))
    labels = np.repeat(np.arange(20), 200) % 3
    wanted = [hard_negatives.Wanted(np.array([-(1 << 62)]), np.array([1 << 62]), 6) for _ in range(400)]
    n = hard_negatives.search(x, np.arange(4000), labels, x[::10], labels[::10], wanted, True)
    assert n < 0.3 * 400 * 4000 / 3
    for row, w in zip(range(0, 4000, 10), wanted):
        s = np.where(labels == labels[row], x @ x[row], -(1 << 62))
        assert w.found[0][1].tolist() == np.lexsort((np.arange(4000), -s))[:6].tolist()


# 13 ------------------------------------------------------------------------------------------------------------------


def test_suffix_places():
    r = random.Random(5)
    for _ in range(600):
        k, parts = r.choice([1, 2, 3, 5]), [0]
        base = [r.randint(1, k) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(1, 5)):
            own = r.choice([[r.randint(1, k) for _ in range(r.randint(0, 20))], base, base[3:] + base[:2], [r.randint(1, k) for _ in range(r.randint(1, 4))] * r.randint(1, 6)])
            parts += [*own, 0]
        s = np.array(parts, np.int32)
        ends = [next(j for j in range(i, len(s)) if s[j] == 0) for i in range(len(s))]
        order = sorted(range(len(s)), key=lambda i: [*[(x, 0) for x in s[i : ends[i]].tolist()], (0, ends[i])])
        assert suffixes.suffix_places(s)[order].tolist() == list(range(len(s)))


def brute_bytes(rows):
    """Rows (doc_id, text); no doc_id has two different texts."""
    texts = sorted({(d, t or "") for d, t in rows if d is not None})
    seen, gone = set(), {}
    for d, t in texts:
        b = t.encode()
        marks = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                marks[i : i + 100] = True
            seen.add(b[i : i + 100])
        gone[d, t] = marks
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = gone.get((d, t or ""), np.zeros(len(b), bool))
        spans = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(m) else 0
        out.append((d, len(b), int(m.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, m) if not g)).hexdigest()))
    return sorted(out, key=repr)


def byte_texts(seed):
    r = random.Random(seed)
    text = lambda n, letters="abcdefgh éß": "".join(r.choice(letters) for _ in range(n))
    passage, base = text(400), text(900)
    out = [text(r.choice([0, 5, 99, 100, 101, 300])) for _ in range(25)]
    out += [passage, text(50) + passage + text(60), passage[:99], passage[:100], text(10) + passage[100:300] + text(10) + passage[50:220], passage + passage]
    out += [base, base, base[:400] + "!" + base[401:], base[:450] + base[460:], base[1:], "=" * 700, "=" * 150 + text(200), "ab" * 300, "ba" * 200 + "c", text(30) + "=" * 120, None, None, ""]
    out += [text(40, "xyz") + passage[i % 7 : 250] + text(40, "xyz") for i in range(30)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,hot,longest,chunk", [(0, 5_000, 256, 1 << 18), (1, 3, 256, 1 << 18), (2, 10, 8, 300)])
def test_suffix_dedup(spark, monkeypatch, seed, hot, longest, chunk):
    for name, value in (("HOT", hot), ("LONGEST", longest), ("CHUNK", chunk), ("SHARD_BYTES", 4_000), ("BROADCAST_ROWS", 0 if seed else 500_000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [(i * 7 % 101, t) for i, t in enumerate(byte_texts(seed))]
    rows += [(None, rows[0][1] or "x"), (None, "y" * 500), rows[3], rows[3], (500, "z" * 30_000), (501, "q" + "z" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"anchor": F.lit(1), "places": F.lit("x"), "SIG": F.lit(2)}).repartition(3)
    assert rows_of(suffix_dedup.removed(df)) == brute_bytes(rows)
    assert suffix_dedup.removed(df.where("false")).count() == 0


def test_suffix_dedup_of_one_id(spark):
    """Texts that share a doc_id take bytes from each other in one order or the other, once."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh") for _ in range(300))
    rows = [(1, passage + "x"), (1, "y" + passage), (1, "y" + passage), (2, passage)]
    got = sorted(x["n_removed"] for x in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([0, 0, 300, 300], [0, 300, 300, 300])


def test_suffix_dedup_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_suffix_dedup(spark, SF)) == brute_bytes(rows)

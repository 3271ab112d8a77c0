"""The corpus operators against brute force, on small and awkward tables."""

import hashlib
import io
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchstats.llm import bpe, decontaminate, fingerprints, licenses, ngram_join, queries, shared, substring_dedup, token_files, toxicity, url_filter, warc

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")


def texts(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empty, short and long ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ñu", "Über", "don't", "a.b", "x-y"]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    out = [make(r.choice([0, 1, 3, 5, 12, 13, 14, 40, 120])) for _ in range(n)]
    base, passage = make(150), make(60)
    out += [base, base, base + " tail", base.replace("w1 ", "w2 ", 1), "  " + make(20) + "\t" + passage + "\n" + make(5), passage, make(9) + " " + passage + " " + passage, make(9000), None, None, "", "same words", "same words", "\u3000 nbsp\u00a0x"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, "en", "s", len(t or ""), 0.5) for i, t in enumerate(texts())] + [(None, "no id here at all", None, None, None, None), (3, "again id three", "en", "s", 14, 0.1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------------------------


def test_warc_sql_and_cases(spark):
    con = duckdb.connect()
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b\r\n", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 9000), (5, "u", "é" * 9000), (None, "u", "x")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archived(pages).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[None]["refers_to"] == 2
    assert got[3]["refers_to"] == 4 and got[3]["payload_bytes"] == 0 and got[4]["payload_digest"] == warc.digest32(b"")
    assert got[5]["payload_bytes"] == 18000 and warc.archived(pages).count() == 7 and warc.archived(pages.where("false")).count() == 0
    assert {r["record_type"] for r in warc.archived(pages, min_bytes=2).where("page_id < 5").collect()} == {"response"}
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.execute(queries.SQL["op1_warc"])
    assert sorted(rel.fetchall(), key=repr) == rows_of(queries.op1_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def test_warc_archive_round_trip_and_damage(monkeypatch):
    records = [warc.record(i, f"http://x/{i}", os.urandom(i * 50) + b"<html>" * i, None, "2024-01-01T00:00:00Z") for i in range(40)]
    out = io.BytesIO()
    assert warc.archive(iter(records), out) == (40, False)
    data = out.getvalue()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC and list(warc.frames(data)) == records
    assert [warc.parse(f)["fields"]["warc-record-id"] for f in warc.frames(data)] == [f"<urn:page:{i}>" for i in range(40)]
    for bad in (data[:-3], data[:20], data[:-40] + b"\0" * 40):
        with pytest.raises(warc.BadArchive):
            [warc.parse(f) for f in warc.frames(bad)]
    good = records[3]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"<html>", b"<htmm>", 1)):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 1000)
    n, more = warc.archive(iter(records), io.BytesIO(), most=2000)
    assert more and n < 40


# 2 and 6 ------------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = bpe.load(path, P.PATTERN)
    got = bpe.round_trip(docs, path, P.PATTERN).collect()
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = plain.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0


def test_bpe_parts(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "PART_CHARS", 7)
    for t in [t for t in texts(5) if t] + ["it's 12ab  c\n\n d\t,e", "x" * 3000, " " * 3000, "中文 字, 。 a1 b2", "don't  we'll 's"]:
        assert "".join(bpe.parts(t, 7)) == t and bpe.encode(t, path, P.PATTERN) == bpe.load(path, P.PATTERN).encode_ordinary(t)


def test_token_files_equal_library(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, path, end_id=0, rows_each=10)
    assert files.count() > 3
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])
    rows = docs.select("doc_id", "text").collect()
    ids = lambda t: [*token_files.load(path).encode(t or "", add_special_tokens=False).ids, 0]
    bits = token_files.bits_for(token_files.vocabulary_size(path))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, token_files.pack(np.array(ids(r["text"]), np.uint32), bits))
    start = 0
    for want, have in zip(sorted(rows, key=key), got, strict=True):
        own = np.array(ids(want["text"]), "<u4")
        assert (have["doc_id"], have["start"], have["n_tokens"], have["ids_crc32"]) == (want["doc_id"], start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert token_files.read_token_files(token_files.write_token_files(none, path)).count() == 0


def test_bit_packing_and_random_access():
    r = np.random.default_rng(0)
    for bits in (1, 5, 8, 16, 17, 24):
        ids = r.integers(0, 1 << bits, 9000).astype(np.uint32)
        assert (token_files.unpack(token_files.pack(ids, bits), 9000, bits) == ids).all() and len(token_files.pack(ids, bits)) == -(-9000 * bits // 8)
        out = io.BytesIO()
        token_files.TokenFile.write(out, [5, None], [ids[:10], ids[10:]], bits)
        f = token_files.TokenFile(out.getvalue())
        assert f.doc_ids == [5, None] and (f.ids(4090, 8500) == ids[4090:8500]).all()
    with pytest.raises(ValueError):
        token_files.TokenFile.write(io.BytesIO(), [1], [np.array([4], np.uint32)], 2)
    e = token_files.Encoder(P.path("byte_bpe_50k.json"))
    odd = ["a  b\n\n c\t d ", "it's  don't 's s", "x" * 500, "", None, "<|endoftext|> a", "中文 字, 。 a1 b2.", "\n", "a.\nB, c.", "\x00 a"]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(odd)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]


# 3 ------------------------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = WORDS.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    pairs = [(x, y) for x in range(len(sets)) for y in range(len(sets)) if x != y and near(sets[x][1], sets[y][1])]
    root = [d for d, _ in sets]
    for _ in range(len(sets)):
        for x, y in pairs:
            root[x] = min(root[x], root[y])
    return {d: (root[i], sum(x == i for x, _ in pairs)) for i, (d, _) in enumerate(sets)}


def check_join(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect()} == brute_links(rows)


def test_join_equals_brute_force(spark, none):
    check_join(spark, [(i * 7 % 97, t) for i, t in enumerate(texts(3))])
    assert ngram_join.join(none).count() == 0


def test_join_of_a_large_near_group(spark, monkeypatch):
    for name, value in (("SMALL", 5), ("BLOCK", 6), ("LEVELS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(7)
    base = [f"v{r.randrange(500)}" for _ in range(160)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 4])):
            own[r.randrange(160)] = f"new{i}"
        rows.append((i, " ".join(own)))
    check_join(spark, rows + [(100, " ".join(base[:80])), (101, None)])


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.99, 0.8, 1) == 5 and ngram_join.runs_for(0.9999) > ngram_join.runs_for(0.99)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_word_hashes_follow_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["Ab cd", None, "", "cd ab,cd", "éa ÉA", " x" * 600_000, "ab"]})
    h, sizes = (np.concatenate(x) for x in zip(*[(h, s) for _, h, s in shared.steps(iter([batch]), size=100)]))
    assert sizes.tolist() == [2, 0, 0, 3, 2, 600_000, 1]
    assert h[0] == h[3] == h[-1] and h[1] == h[2] == h[4] and h[5] != h[6] and len(set(h.tolist())) == 5


# 4 ------------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_EACH", 7)
    df = docs.where("doc_id is not null and not (doc_id = 3 and text like 'again%')")
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(df).collect()}
    order = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), reverse=True)
    assert len(got) == len(order)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        true = shingle_set(t) & shingle_set(edited), shingle_set(t) | shingle_set(edited)
        if len(true[1]) > 60:
            assert abs(r["near_edited"] - len(true[0]) / len(true[1])) < 0.25
    same = {}
    for d, t in order:
        assert same.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert fingerprints.compare_edited(none).count() == 0 and fingerprints.compare_edited(docs).count() == docs.count()
    one = docs.where("doc_id = 6")
    assert fingerprints.compare_edited(one).first()["near_next"] == 1


def test_fingerprints_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint("a").alias("x"), fingerprints.fingerprint("b").alias("y"), fingerprints.fingerprint(F.concat_ws(" ", "a", "b")).alias("z"))
    r = r.select(fingerprints.containment(fingerprints.merge([F.col("x"), F.col("y")]), F.col("z")).alias("c"), fingerprints.jaccard(F.col("x"), F.col("y")).alias("j"), fingerprints.containment(F.col("x"), F.col("z")).alias("d")).first()
    assert r["c"] == 1 and r["j"] == 0 and r["d"] == 1


# 5 ------------------------------------------------------------------------------------------------------------------


def brute_dedup(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            low[k] = min(low.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [5000, 3])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, none, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_ROWS", 40)
    rows = [(i * 5 % 103, t) for i, t in enumerate(texts(4) + ["a " * 300, "b " + "a " * 40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substring_dedup.removed(df)) == sorted(brute_dedup(rows), key=repr)
    if hot == 3:
        assert substring_dedup.removed(none).count() == 0
        twice = spark.createDataFrame([(1, "x " * 20), (1, "x " * 20), (None, "x " * 20), (2, "x " * 20)], "doc_id long, text string")
        assert sorted(r["n_removed"] for r in substring_dedup.removed(twice).collect()) == [0, 0, 0, 20]


# 7 ------------------------------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    e, sizes, moves, start = r.normal(0, 2, 300), np.array([100, 1, 0, 199]), r.normal(0, 1, (2, 2)), 0.3
    p, at = toxicity.forward_backward(e, sizes, moves, start)[2], 0
    for s in sizes[sizes > 0]:
        own = e[at : at + s]
        a, b = np.zeros((s, 2)), np.ones((s, 2))
        a[0] = [1, np.exp(start + own[0])]
        for t in range(1, s):
            a[t] = (a[t - 1] @ np.exp(moves)) * [1, np.exp(own[t])]
            a[t] /= a[t].sum()
        for t in range(s - 2, -1, -1):
            b[t] = np.exp(moves) @ (b[t + 1] * [1, np.exp(own[t + 1])])
            b[t] /= b[t].sum()
        q = a * b
        assert np.allclose(q[:, 1] / q.sum(axis=1), p[at : at + s])
        at += s


def test_toxicity_held_out_and_cases(spark, docs, none):
    r = random.Random(1)
    ordinary = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(ordinary) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge(spark, d, lab).collect()
    assert len(got) == 400 and all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)
    held = [g for g in got if g["held_out"]]
    assert sum(g["predicted"] == (g["doc_id"] % 4 == 0) for g in held) >= 0.95 * len(held)
    bad = next(g for g in got if g["doc_id"] % 4 == 0 and g["predicted"])
    text = dict(rows)[bad["doc_id"]]
    assert {text[s["start"] : s["stop"]].split()[0] for s in bad["spans"]} <= {"idiot", "moron", "scumbag"}
    assert toxicity.judge(spark, docs, lab).count() == docs.count() and toxicity.judge(spark, none, lab.where("false")).count() == 0
    assert toxicity.clean(spark, docs, lab).columns == docs.columns


# 8 ------------------------------------------------------------------------------------------------------------------


def brute_contamination(rows, items):
    windows = {}
    for item, t in items:
        w = WORDS.findall(lower(t))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, found = WORDS.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        ids = sorted(map(str, found))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark, docs, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    passages = [t for t in texts() if t and len(t.split()) > 30][:6]
    items = [(i, " ".join(p.upper().split()[i : i + 12 + i])) for i, p in enumerate(passages)] + [(10, None), (11, ""), (12, "same WORDS"), (13, "not there at all"), (13, "w1"), (2, passages[0])]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.digest(decontaminate.contamination(docs, b))) == brute_contamination(rows, items)
    assert decontaminate.contamination(docs, b.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, b).count() == 0


def test_decontamination_without_term_filter_and_proximity(spark, docs, monkeypatch):
    items = [(12, "same words")]
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "TERM_BITS", 6)  # a full map: the postings of nearly all terms are stored
    assert rows_of(decontaminate.digest(decontaminate.contamination(docs, b))) == brute_contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], items)
    near = spark.createDataFrame([(1, "one big three"), (2, "one x y z three")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one three")], "item_id long, text string")
    assert {r["doc_id"]: len(r["items"]) for r in decontaminate.contamination(near, b, slop=1).collect()} == {1: 1, 2: 0}


# 9 ------------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, none):
    cases = [
        (1, "Released under the MIT License, not the mit  licensed one. MIT-license", "mit"), (2, "Apache\nLicense and GNU Lesser General Public License", "apache,gpl"),
        (3, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\n", ""), (4, None, ""), (5, "", ""), (6, "mit licensemit license", ""),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(cases, "doc_id long, text string, labels string")).collect()}
    for d, t, base in cases:
        w = WORDS.findall(lower(t))
        at = [i for i in range(len(w)) for p in licenses.BASE if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), base)
    assert got[2]["labels"] == "apache,gpl,lgpl" and got[3]["labels"] == "apache,gpl,mit" and got[3]["score"] == 1 and got[4]["score"] == 0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def test_license_expressions():
    post = licenses.postfix
    assert post("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert post("(MIT OR X) AND GPL-2.0 WITH e") == ["mit", "x", "or", "gpl-2.0", "e", "with", "and"]
    for bad in ("", "MIT MIT", "OR MIT", "MIT OR", "(MIT", "MIT)", "()"):
        assert post(bad) is None
    assert licenses.evaluate(post("GPL-2.0 OR MIT"))[0] and not licenses.evaluate(post("GPL-2.0 AND MIT"))[0]


# 10 -----------------------------------------------------------------------------------------------------------------


def test_globs_equal_regex():
    r = random.Random(0)
    globs = ["a*b", "**.a/b**", "*", "**", "a?b/*", "ab", "", "*a*b*/**", "b**a", "?" * 70 + "*", "*/*"]
    urls = ["".join(r.choice("ab/.") for _ in range(r.randrange(0, 9))) for _ in range(300)] + ["a" * 80, "a" * 5000, "b" * 69, "b" * 70]
    regex = [re.compile("".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*|.", g)), re.S) for g in globs]
    got = url_filter.Automaton(globs).match([u.encode() for u in urls])
    assert got.tolist() == [[bool(x.fullmatch(u)) for x in regex] for u in urls]
    assert url_filter.Automaton(globs).match([]).shape == (0, len(globs))


def test_url_rules(spark):
    urls = ["http://EXAMPLE.org/es/x?q=/y", "https://sub.example.org/en/12", "x://example.org/en/2", "a://notexample.org", "http://evil.net/a.org/es/", "http://a.com/de/", "http://a.com:80/de/", "http://a.com/fr/#f", None, "no scheme.org/", "", "http://ads.net/", "://org/", "h://x.net/f.zip", "http://ü.org/" + "p" * 9000]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()}
    rules = [(r.text.split("/", 1)[0], "/" + r.text.split("/", 1)[1], r) for r in queries.URL_RULES]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fit = [r for h, p, r in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best.text if best else None)
        if best:
            assert got[i]["verdict"] == best.verdict
    assert got[11]["verdict"] == "block" and got[13]["verdict"] == "block" and got[8]["verdict"] == "allow"


# All ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_ngram_join", "op5_substring_dedup", "op8_decontamination", "op10_url_filter"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(rel.fetchall(), key=repr) == rows_of(df.select(*columns))


def test_pipeline(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = base, {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.table(stage(spark, docs, SF), name)
        kept[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == base.columns
        if name == "near-copies":
            links = brute_links([tuple(r) for r in docs.select("doc_id", "text").collect()])
            assert {r["doc_id"] for r in out.collect()} == {d for d, (root, _) in links.items() if root == d}
        if name == "substring-dedup":
            want = {d: (n, h) for d, _, n, h in brute_dedup([tuple(r) for r in docs.select("doc_id", "text").collect()])}
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in out.collect():
                n, h = want[r["doc_id"]]
                assert r["text"] == before[r["doc_id"]] if n == 0 else hashlib.sha256(r["text"].encode()).hexdigest() == h
                assert r["n_chars"] == len(r["text"])
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {x[0] for x in brute_contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], items) if not x[5]}
            assert {r["doc_id"] for r in out.collect()} == want
        docs = out
    assert 0 < kept["bpe"] == kept["decontamination"] < base.count()

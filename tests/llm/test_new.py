"""Exact dedup, Merkle manifest and fill-in-middle against brute force and awkward inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import check
from voxloom.llm import exact, fim, merkle, registry

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
AWKWARD = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one"), (5, "one"), (6, "é ß " * 3000), (None, "one"), (None, None), (7, "x" * 300_000), (8, "a <P> b"), (9, "A\x00b c")]
CLASHES = ["n", "form", "output", "k", "at", "row", "top", "size", "kept", "digest", "restored", "leaf"]


def docs(spark, rows, clashes=False):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASHES]) if clashes else d


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_merkle_manifest", "op13_fill_in_middle"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_against_sql(spark, name, sf):
    check(spark, name, registry.queries(), registry.oracle_sql(), f"/root/testdata/{sf}")


# --- 11 ---


def brute_groups(rows, keep=max):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in by.items()}
    return sorted((str(i), str(best[t or ""]), len(by[t or ""]), sha(t or "")) for i, t in rows), best


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_and_clean_match_brute_force(spark, keep):
    r = np.random.default_rng(4)
    texts = [f"text {v} " * int(v % 7) for v in range(60)] + ["hot " * 40]
    rows = [(int(i), texts[60 if i % 3 == 0 else int(r.integers(0, 60))]) for i in r.permutation(4000)] + AWKWARD
    d = docs(spark, rows, clashes=True).repartition(7)
    got = exact.groups(d, keep).collect()
    want, best = brute_groups(rows, max if keep == "largest" else min)
    assert sorted((str(x["doc_id"]), str(x["keep_id"]), x["group_size"], x["text_sha256"]) for x in got) == want
    stay = collections.Counter(x["text_sha256"] for x in got if x["kept"])
    assert set(stay.values()) == {1} and len(stay) == len(best)
    assert all(x["doc_id"] == x["keep_id"] for x in got if x["kept"])
    left = exact.clean(d, keep)
    assert left.columns == d.columns
    assert sorted((str(x["doc_id"]), x["text"] or "") for x in left.collect()) == sorted((str(i), t) for t, i in best.items())
    assert exact.groups(d.limit(0)).count() == 0 and exact.clean(d.limit(0)).count() == 0


def test_hot_texts_are_dealt_to_several_runs(spark):
    d = docs(spark, [(i, "hot") for i in range(2000)] + [(None, "hot")] * 500 + [(i, f"t{i}") for i in range(3000)])
    runs = exact._runs(d, "largest", exact._unchanged).where(f"{exact.PARTS} is not null").groupBy(exact.SALT).count().collect()
    assert len(runs) > 40 and max(x["count"] for x in runs) < 150
    assert {(x["keep_id"], x["group_size"]) for x in exact.groups(d).where(F.col("group_size") > 1).collect()} == {(1999, 2500)}


def test_normalised_texts(spark):
    got = exact.groups(docs(spark, [(1, "A b"), (2, "a B"), (3, "c")]), "smallest", F.lower).orderBy("doc_id").collect()
    assert [(x["keep_id"], x["kept"]) for x in got] == [(1, True), (1, False), (3, True)]


# --- 12 ---


def brute_manifest(rows, arity=16):
    """rows of (doc_id, source, lang, n_chars, text); the proof of a leaf is found by walking its tree."""
    h = lambda *p: sha("".join(p))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def walk(tree, i):
        steps = []
        for level in tree[:-1]:
            run = level[i // arity * arity : i // arity * arity + arity]
            steps.append((i % arity, run))
            i //= arity
        return steps

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], h(*map(part, r)), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc, leaf, r) in enumerate(by[s]):
            steps = walk(trees[s], i) + walk(top, k)
            start = leaf
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                start = h(*map(part, (*r[:4], None if r[4] is None else r[4].translate(low))))
            for at, run in steps:
                start = h(*run[:at], start, *run[at + 1 :])
            proof = h(*[v for at, run in steps for j, v in enumerate(run) if j != at])
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, start, start == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity", [16, 2])
def test_manifest_matches_brute_force(spark, arity):
    r = np.random.default_rng(5)
    rows = [(int(i), ["hot", None, "a", "é", "b"][0 if i % 3 else int(r.integers(1, 5))], None if i % 7 == 0 else "EN", i, f"Text {i}" * (i % 5)) for i in range(700)]
    rows += [(i + 1000, f"s{i}", "x", 1, "Upper" if i % 2 else None) for i in range(40)]
    rows += [(3, "hot", None, None, None), (3, "hot", None, None, None), (None, None, None, None, "Q"), (None, "hot", None, None, "Q"), (5000, "lone", "x", 3, "abc")]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).repartition(5)
    got = merkle.manifest(merkle.leaves(d, where=merkle.tampered(F.col("doc_id")), change={"text": merkle.lower_ascii(F.col("text"))}), arity).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_manifest(rows, arity)
    assert {x["verified"] for x in got} == {True, False}
    if arity == 16:
        assert merkle.manifest(merkle.leaves(d.limit(0))).count() == 0
        one = merkle.manifest(merkle.leaves(d.where("doc_id = 5000"))).collect()
        assert [tuple(x) for x in one] == brute_manifest([rows[-1]])


def test_reports_of_partitions_give_places():
    reports = [(0, 1, b"a", 5, b"a", 5, 5), (1, 1, b"a", 2, b"a", 2, 2), (2, 3, b"a", 1, b"c", 4, 9), (4, 2, b"c", 1, b"d", 2, 2)]
    places, trees, most = merkle._places(reports)
    assert places == {0: (0, 0, 0, 8, 8), 1: (0, 0, 5, 8, 8), 2: (0, 2, 7, 8, 5), 4: (2, 3, 4, 5, 2)}
    assert (trees, most) == (4, 9)


# --- 13 ---

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_fim(doc, text):
    t = text or ""
    u = UNITS.findall(t)
    h = [int(sha(f"42:{'' if doc is None else doc}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_brute_force(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, "".join(r.choice(list("ab <>PSM\t\n\x0bé\U0001f600"), int(r.integers(0, 60))))) for i in range(800)] + AWKWARD
    d = docs(spark, rows, clashes=True)
    out = fim.fill_in_middle(d)
    assert out.columns == [c for c in d.columns if c not in fim.ADDED] + list(fim.ADDED)
    got = fim.restored(out).collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((x["doc_id"], x["text"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in got), key=key) == sorted(((i, t, *brute_fim(i, t)) for i, t in rows), key=key)
    assert all(x["restored"] == (x["text"] or "") for x in got)
    assert {x["form"] for x in got} == {"plain", "spm", "psm"} and {x["leaf"] for x in got} == {"clash"}
    assert fim.restored(fim.fill_in_middle(d.limit(0))).count() == 0
    assert fim.fill_in_middle(d, rate=0).where("form <> 'plain'").count() == 0


# --- components ---


def test_contracted_links_keep_components_and_are_fewer(spark):
    from voxloom.llm import graph

    r = np.random.default_rng(9)
    pairs = [(int(p), int(m)) for m in range(100, 700) for p in r.choice(12, 6, replace=False)] + [(1000, 1001), (1003, 1002), (5, 5), (1001, 1000)]
    links = spark.createDataFrame(pairs, "a long, b long")
    root = {i: i for p in pairs for i in p}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {x["id"]: x["label"] for x in graph.components(links).collect()} == {i: find(i) for i in root if i != 5 or find(5) != 5}
    assert graph.contracted(links).count() < 700 < len(pairs)


# --- packages of other writers ---


def test_package_of_another_writer_is_read(spark, tmp_path):
    import gzip
    import zipfile

    from voxloom.llm import warc

    records = [warc.record(5, "http://a/", b"x" * 200, 200, sha("x" * 200), None), warc.record(7, "http://b/", b"y", 1, sha("y"), None)]
    other = records[1].replace(b"<urn:voxloom:page:7>", b"<urn:uuid:1-2>").replace(b"WARC-Payload-Digest: sha256:" + sha("y").encode(), b"WARC-Payload-Digest: sha1:ABC")
    parts = {"a.warc.gz": [gzip.compress(records[0])], "b.warc.gz": [b"junk", gzip.compress(other), b"gap", gzip.compress(records[1])]}
    lines = ["!meta 0 {\"format\": \"cdxj\"}"]
    for name, chunks in parts.items():
        at = 0
        for c in chunks:
            if c[:2] == b"\x1f\x8b":
                lines.append(f'com,a)/ 2024 {{"offset": "{at}", "length": {len(c)}, "filename": "{name}"}}')
            at += len(c)
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, chunks in parts.items():
            z.writestr(f"archive/{name}", b"".join(chunks))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
    got = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert sorted((str(r["page_id"]), r["payload"], r["payload_digest"]) for r in got) == [("5", "x" * 200, sha("x" * 200)), ("7", "y", sha("y")), ("None", "y", sha("y"))]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz", b"")
    with pytest.raises(Exception, match="no index"):
        warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()


# --- classifiers against their formulas ---


def _texts(words, n=60):
    r = np.random.default_rng(10)
    sep = list(" \n\t.!?;,\"")
    return ["", " ", "ab", "é", *["".join(f"{w}{s}" for w, s in zip(r.choice(words, k), r.choice(sep, k), strict=True)) for k in r.integers(1, 80, n)]]


def test_quality_score_is_the_mean_of_its_features():
    import pyarrow as pa

    from voxloom.llm import quality
    from voxloom.llm import text as T

    r = np.random.default_rng(11)
    model = quality.Model(r.normal(0, 3, (2, 1 << quality.BITS)), 0.25)
    texts = [*_texts(["alpha", "beta", "beta", "gé", "x1", "delta"]), "same same same"]

    def brute(t):
        data = t.encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", data)
        h = [int(T.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
        group = [v >> (64 - quality.BITS) for v in h]
        group += [quality.REPEAT if a == b else int(T.ngrams(np.array([a, b], np.uint64), 2)[0]) >> (64 - quality.BITS) for a, b in zip(h, h[1:], strict=False)]
        grams = [(int.from_bytes(data[i : i + n], "little") * (0x9E3779B97F4A7C15 + 2 * n) % 2**64) >> (64 - quality.BITS) for n in quality.GRAMS for i in range(len(data) - n + 1)]
        total = model.bias + sum(sum(model.table[side][b] for b in g) / len(g) for side, g in enumerate((group, grams)) if g)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    assert np.allclose(model.score(pa.array(texts)), [brute(t) for t in texts])


def test_toxicity_score_is_that_of_clauses_one_by_one():
    import pyarrow as pa

    from voxloom.llm import toxicity

    lexicon = toxicity.Lexicon({b"zork": 1.5}, {b"flim": 0.7, b"snorkel": 2.0})
    weights = tuple(np.linspace(-1, 2, 3 + len(toxicity.CHANNELS)))
    model = toxicity.Model(lexicon, weights, -0.5)
    texts = _texts(["zorkling", "flim", "Snorkel", "you", "not", "said", "kill", "house", "é", "they"])

    def brute(t):
        channel, total, largest = np.zeros(len(toxicity.CHANNELS)), 0.0, 0.0
        for clause in re.split(rb"[.!?;\n]", t.encode()):
            c, _ = toxicity.channels(clause, lexicon)
            channel += c
            total, largest = total + c @ np.array(toxicity.PRIOR), max(largest, c @ np.array(toxicity.PRIOR))
        words = len(re.findall(rb"[A-Za-z\x80-\xff]+", t.encode()))
        x = [min(total, 12) / 4, min(largest, 8) / 4, min(total / np.sqrt(words + 9), 1.0), *np.minimum(channel, 6) / 6]
        return 1 / (1 + np.exp(-(np.dot(x, weights) - 0.5)))

    got = model.score(toxicity.evidence(pa.array(texts), lexicon))
    assert np.allclose(got, [brute(t) for t in texts]) and got.max() > 0.6 > got.min()


def test_written_tables_can_be_removed(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from voxloom.llm import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/voxloom-app/table")
    assert shared.written(spark.range(3)).count() == 3 and Path(tmp_path, "voxloom-app").exists()
    shared.clear(spark)
    assert not Path(tmp_path, "voxloom-app").exists() and tmp_path.exists()

"""Training-data operators against brute force, exact round trips and awkward inputs."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import SF, check
from voxloom.llm import ann, decontaminate, graph, lines, minhash, packing, quality, registry, substring, toxicity, urls, warc
from voxloom.llm import text as T

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def vocabulary(n, k, seed):
    r = np.random.default_rng(seed)
    return [" ".join(f"w{v}" for v in r.integers(0, k, n))] * 1


AWKWARD = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one two three four five"), (6, "é ß " * 3000), (7, "a b c d e f\n" * 40), (8, "a b c d e f\n" * 40), (8, "a b c d e f\n" * 40), (None, "a b c d e f\n" * 40), (9, "x" * 300_000)]


# --- words ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0bé.", max_size=40)), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = T.buffer(pa.array(texts, pa.string()))
    starts, ends, first = T.spans(data, offsets)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        got = [raw[starts[i] : ends[i]].decode() for i in range(first[k], first[k + 1])]
        assert got == WORDS.findall(t or "")


def test_hashes_do_not_depend_on_position_or_slices(monkeypatch):
    words = [f"w{i % 50}" for i in range(4000)]
    data, offsets = T.buffer(pa.array([" ".join(words)]))
    s, e, _ = T.spans(data, offsets)
    h = T.word_hashes(data, s, e)
    monkeypatch.setattr(T, "SLICE", 97)
    assert np.array_equal(h, T.word_hashes(data, s, e))
    assert len(set(h)) == 50 and len(set(zip(words, h, strict=True))) == 50


# --- 1 ---


def test_warc_matches_sql(spark):
    check(spark, "op1_warc", registry.queries(), registry.oracle_sql())


def test_warc_round_trip_and_awkward_rows(spark):
    rows = [(1, "http://a/\r\nX: y", "p" * 200), (2, None, "p" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "p" * 200), (1, "u", "p" * 200), (7, "u", "é" * 100_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = warc.read_archives(warc.write_archives(p, most_records=3)).collect()
    assert len(got) == len(rows)
    by = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert by[(1, "response", None, 200)] == 2 and by[(2, "revisit", 1, 200)] == 1 and by[(None, "revisit", 1, 200)] == 1
    assert by[(5, "response", None, 5)] == by[(6, "response", None, 5)] == 1 and by[(3, "response", None, 0)] == 1
    assert {r["payload"] for r in got if r["page_id"] == 7} == {"é" * 100_000}
    assert warc.read_archives(warc.write_archives(p.limit(0))).count() == 0


def test_zip64_directory(tmp_path):
    import zipfile

    path = tmp_path / "a.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("packed", b"z" * 100, zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    count, length, offset = __import__("struct").unpack("<HII", raw[end + 10 : end + 20])
    pack = __import__("struct").pack
    z64 = b"PK\x06\x06" + pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, offset)
    raw = raw[:end] + z64 + b"PK\x06\x07" + pack("<IQI", 0, end, 1) + b"PK\x05\x06" + pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    read = lambda o, n: raw[o : o + n]
    d = warc.directory(read, len(raw))
    at, n = warc.member(read, d["big"])
    assert raw[at : at + n] == b"0123456789"
    with pytest.raises(ValueError):
        warc.member(read, d["packed"])
    with pytest.raises(ValueError):
        warc.directory(lambda o, n: b"", 0)


# --- 2 ---


def shingle_set(t):
    w = WORDS.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, least=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= least * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(12):  # templates with many edited copies: chains, stars and outsiders
        base = [f"w{v}" for v in r.integers(0, 400, 160)]
        for k in range(14):
            w = list(base)
            for at in r.integers(0, len(w), int(r.integers(0, 7))):
                w[at] = f"e{r.integers(0, 10_000)}"
            rows.append((n, " ".join(w) if k % 3 else " ".join(w).upper()))
            n += 1
    rows += [(n + 1, "a b"), (n + 2, "A b"), (n + 3, None), (n + 4, ""), (n + 5, "a c")]
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    want = brute_components(rows)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingle_set(t)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_blocks_find_what_pivots_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    r = np.random.default_rng(5)
    base = [f"w{v}" for v in r.integers(0, 400, 200)]
    rows = []
    for n in range(60):
        w = list(base)
        for at in r.integers(0, len(w), 4):
            w[at] = f"e{r.integers(0, 10_000)}"
        rows.append((n, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pigeonhole_guarantee():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for row in b:
        row[r.permutation(minhash.SYMBOLS)[:most]] ^= 1
    ka, kb = minhash.index_keys(a), minhash.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka, kb, strict=True))


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["kept"] and by[1]["n_shingles"] == 0 and by[8]["component_id"] == 7 and by[3]["component_id"] == 3
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def near(rng, words, edits):
    w = list(words)
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(w)


def test_near_duplicates_of_rows_that_share_an_id_or_have_none(spark):
    r = np.random.default_rng(31)
    a, b, c, d = ([f"{x}{v}" for v in r.integers(0, 5000, 200)] for x in "abcd")
    rows = [(3, " ".join(a)), (8, near(r, a, 2)), (8, " ".join(b)), (9, near(r, b, 2)), (None, near(r, c, 0)), (None, near(r, c, 2)), (None, " ".join(d)), (11, near(r, d, 2)), (None, None), (12, "x y z x y z"), (12, "x y z x y z")]
    got = collections.Counter((x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == collections.Counter([(3, 3, True), (8, 3, False), (8, 8, True), (9, 8, False), (None, None, False), (None, None, False), (None, 11, False), (11, 11, True), (None, None, False), (12, 12, True), (12, 12, True)])
    clash = docs(spark, rows).withColumns({"id": F.lit(1), "key": F.lit(2), "component": F.lit(3), "kept": F.lit("mine")})
    left = minhash.representatives(clash).collect()
    texts = collections.Counter((x["doc_id"], x["text"]) for x in left)
    want = [rows[0], rows[2], rows[7], rows[8], rows[9]]
    assert all(texts.pop(w) == 1 for w in want) and set(texts) < {rows[4], rows[5]} and sum(texts.values()) == 1
    assert {(x["id"], x["key"], x["component"], x["kept"]) for x in left} == {(1, 2, 3, "mine")}


# --- 3 ---


def test_decontamination_matches_sql(spark):
    check(spark, "op3_benchmark_decontamination", registry.queries(), registry.oracle_sql())


def test_decontamination_finds_edited_items_and_spares_others(spark):
    r = np.random.default_rng(8)
    item = [f"q{v}" for v in r.integers(0, 5000, 60)]
    near = list(item)
    near[30] = "changed"
    pad = [f"p{v}" for v in r.integers(0, 5000, 300)]
    rows = [(1, " ".join(pad[:100] + item + pad[100:])), (2, " ".join(pad + near).upper()), (3, " ".join(pad + item[:20])), (4, None), (5, ""), (6, "q1 q2")]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["start"] for x in decontaminate.matches(docs(spark, rows), items).collect()}
    assert got == {(1, 7): 100, (2, 7): 300}
    assert decontaminate.matches(docs(spark, rows), items.limit(0)).count() == 0


def test_decontamination_finds_items_cut_at_the_edges_of_a_text(spark):
    r = np.random.default_rng(9)
    item = [f"q{v}" for v in r.integers(0, 5000, 60)]
    pad = [f"p{v}" for v in r.integers(0, 5000, 100)]
    texts = {1: item[1:] + pad, 2: pad + item[:-1], 3: item[1:], 4: item[:-1], 5: item[:30] + item[31:], 6: item[:40], 7: item[30:] + pad, 8: item[2:-2], 9: item}
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {x["doc_id"]: (x["start"], x["n_words"]) for x in decontaminate.matches(docs(spark, [(i, " ".join(w)) for i, w in texts.items()]), items).collect()}
    assert got == {1: (0, 60), 2: (99, 60), 3: (0, 59), 4: (0, 59), 5: (0, 59), 8: (0, 56), 9: (0, 60)}


def brute_windows(rows, items, least=0.8):
    """Best similarity of every text and item over all windows of the item's length (whole texts where they are shorter)."""
    split = lambda t: (t or "").lower().split()
    grams = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    items = [(i, split(t)) for i, t in items if len(split(t)) >= 5]
    df = collections.Counter(g for _, w in items for g in grams(w))
    weight = lambda g: np.log(1 + len(items) / df[g]) if df[g] else np.log(1 + len(items))
    out = set()
    for d, t in rows:
        w = split(t)
        for i, x in items:
            theirs = grams(x)
            for s in range(max(1, len(w) - len(x) + 1)):
                own = grams(w[s : s + len(x)])
                both = sum(min(own[g], theirs[g]) * weight(g) for g in own)
                if both and both / (sum(n * weight(g) for c in (own, theirs) for g, n in c.items()) - both) >= least - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_decontamination_against_all_windows(spark):
    r = np.random.default_rng(14)
    items = [(i, " ".join(f"q{v}" for v in r.integers(0, 800, int(r.integers(15, 60))))) for i in range(12)] + [(12, "t u v w x y z " * 4), (12, "other text of item twelve " * 5)]
    rows = [(None, items[0][1]), (None, "p " * 40), (5, items[1][1]), (5, "p q r s t u v"), (6, None), (7, ""), (8, "t u v w x y z " * 5), (8, "t u v w x y z " * 5)]
    for n in range(20, 140):
        w = items[int(r.integers(0, len(items)))][1].split()
        for _ in range(int(r.integers(0, 2))):
            k = int(r.integers(0, len(w)))
            w[k : k + 1] = [[], ["changed"], [w[k], "added"]][int(r.integers(0, 3))]
        w = w[int(r.integers(0, 4)) : len(w) - int(r.integers(0, 4))]
        front, back = ([f"p{v}" for v in r.integers(0, 500, int(r.integers(0, 2) * r.integers(0, 60)))] for _ in range(2))
        rows.append((n, " ".join(front + w + back)))
    d = docs(spark, rows).withColumns({c: F.lit(1) for c in ("w", "s", "h", "start", "item", "n_words", "block")})
    i = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(d, i).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == brute_windows(rows, items)
    assert max(x["distance"] for x in found) <= decontaminate.RADIUS and len(found) > 30
    bad = {(x["doc_id"], t) for x in found for n, t in rows if n == x["doc_id"]} - {(None, "p " * 40), (5, "p q r s t u v")}
    assert collections.Counter((x["doc_id"], x["text"]) for x in decontaminate.clean(d, i).collect()) == collections.Counter(x for x in rows if x not in bad)
    assert decontaminate.clean(d.limit(0), i).count() == decontaminate.matches(d.limit(0), i).count() == 0


# --- 4 ---


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(hist, k):
    v, c = np.array(list(hist)), np.array(list(hist.values()))
    cost = lambda b: sum(n * (min(x for x in b if x >= l) - l) for l, n in hist.items())
    got = packing.boundaries(v, c, k)
    best = min(cost(s) for n in range(1, min(k, len(v)) + 1) for s in itertools.combinations(sorted(hist), n) if max(s) == max(hist))
    assert len(got) <= k and cost(got) == best


@pytest.mark.parametrize("tokenizer", [False, True])
def test_packing_keeps_every_token(spark, tokenizer):
    import glob

    files = glob.glob("/opt/tokenizers/word_bpe_*.json")
    if tokenizer and not files:
        pytest.skip("no tokenizer file")
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([1, 5, 5, 30, 47, 100, 10, 0])] + [(50, None), (5, "é ß"), (5, "é ß"), (51, " a\tb\n c  ")] + [(None, f"n{k} o") for k in range(30)]
    d = docs(spark, rows).withColumn("batch", F.lit("clash"))
    got = packing.pack(d, buckets=3, budget=60, max_tokens=40, shard_rows=8, tokenizer_file=files[0] if tokenizer else None).collect()
    texts, pieces = collections.Counter(), collections.defaultdict(list)
    for x in got:
        pieces[x["doc_id"], x["piece"]].append(x)
        assert (x["n_tokens"] > 0) == (x["text"] is not None) == (x["batch"] is not None)
        assert x["start"] == 40 * x["piece"] and x["n_tokens"] <= min(40, x["bucket_tokens"] or 0) and (x["padding"] or 0) == (x["bucket_tokens"] or 0) - x["n_tokens"]
        if not tokenizer and x["text"] is not None:
            assert len(WORDS.findall(x["text"])) == x["n_tokens"]
        texts.update((x["doc_id"], w) for w in WORDS.findall(x["text"] or "")) if not tokenizer else None
    if not tokenizer:
        assert texts == collections.Counter((i, w) for i, t in rows for w in WORDS.findall(t or ""))
        assert [x["text"].split()[0] for p in range(3) for x in pieces[5, p] if x["text"].startswith("w5")] == ["w5x0", "w5x40", "w5x80"]
    assert len({x["batch"].split("-")[1] for x in got if x["doc_id"] is None}) > 1  # rows without an id are dealt to several shards
    batches = collections.defaultdict(list)
    for x in got:
        if x["batch"]:
            batches[x["batch"]].append(x["bucket_tokens"])
    assert all(len(set(b)) == 1 and sum(b) <= max(60, b[0]) for b in batches.values())
    assert packing.pack(docs(spark, [])).count() == 0


# --- 5, 6 ---


def corpus(spark, bad):
    r = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        w = [f"{'abcdefgh'[v % 8]}{v}o" for v in r.integers(0, 300, 60)]
        y = i % 4 == 0
        rows.append((i, bad(w, r) if y else " ".join(w)))
        labels.append((i, int(not y), int(y)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def crc(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    d, labels, _ = corpus(spark, lambda w, r: " | ".join(w))
    model = quality.train(d, labels)
    got = {x["doc_id"]: x["good"] for x in quality.score(d, model).collect()}
    held = [i for i in range(400) if crc(i)]
    assert np.mean([got[i] == int(i % 4 != 0) for i in held]) > 0.95
    awkward = quality.score(docs(spark, AWKWARD), model).collect()
    assert len(awkward) == len(AWKWARD) and all(0 <= x["quality"] <= 1 for x in awkward)
    assert quality.train(d.limit(0), labels).score(pa.array(["x"]))[0] == 0.5


def test_toxicity_on_held_out_rows(spark):
    def bad(w, r):
        w = list(w)
        for at in r.integers(0, len(w), 5):
            w[at] = "zork" + "aeiou"[int(r.integers(0, 5))]
        return " ".join(w)

    d, labels, rows = corpus(spark, bad)
    model = toxicity.train(d, labels)
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score(d, model).collect()}
    held = [i for i in range(400) if crc(i)]
    assert np.mean([got[i] == int(i % 4 == 0) for i in held]) > 0.95
    awkward = toxicity.score(docs(spark, AWKWARD), model).collect()
    assert len(awkward) == len(AWKWARD) and not any(x["toxic"] for x in awkward)
    assert toxicity.train(d.limit(0), labels).score(np.zeros((1, toxicity.EVIDENCE)))[0] == 0.5


def test_grammar_raises_and_lowers():
    lex = toxicity.Lexicon({b"zork": 2.0}, {})
    w = lambda t: toxicity.clause_weight(t.encode(), lex)
    plain = w("that zorky thing")
    assert w("you zorky thing") > plain > w("not a zorky thing") and w("he said zorky") < plain and w("zorky like you") == w("you zorky")
    assert w("i kill you") == w("you i kill") > w("kill time") > w("he said kill you") and w("never kill you") < w("kill you") and w("zork") == 0
    assert w("zorky zorky") == 2 * plain and w("zorky a b c d you") == plain


def test_composition_equals_its_machines_in_turn():
    moves, acts = toxicity.composed()
    r = np.random.default_rng(0)
    state, states = 0, [0] * 5
    for c in r.integers(0, 6, 4000):
        symbol = (toxicity.CLASSES[c],)
        for k, m in enumerate(toxicity.MACHINES):
            states[k], symbol = m(states[k], symbol)
        act, state = acts[state, c], moves[state, c]
        assert (act in (7, 9)) == ("insult waited" in symbol) and (act in (8, 9)) == ("threat waited" in symbol)
        assert (act in (3, 6)) == ("damped" in symbol) and (1 <= act <= 6) == (symbol[0] in ("insult", "threat"))


def test_grammar_beats_its_word_list():
    """Insults in denials and reports are not toxic here: a word list can't tell them, the learned channels can."""
    r = np.random.default_rng(21)
    texts, y = [], []
    for i in range(600):
        w = [f"{'abcdefgh'[v % 8]}{v}o" for v in r.integers(0, 300, 40)]
        w[10:10] = [[], ["you", "zorky"], ["she", "never", "said", "zorky"]][i % 3]
        texts.append(" ".join(w))
        y.append(int(i % 3 == 1))
    y, e = np.array(y), toxicity.evidence(pa.array(texts), toxicity.Lexicon({b"zork": 2.0}, {}))
    w, b = toxicity._logistic(toxicity.inputs(e[:400]), y[:400])
    right = np.mean((toxicity.inputs(e[400:]) @ w + b > 0) == (y[400:] == 1))
    listed = np.mean((e[400:, 2] > 0) == (y[400:] == 1))
    assert right > 0.99 > 0.7 > listed


# --- 7 ---


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 16)).astype(np.float32)
    v[50:90] = v[40]
    v[7] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (420, [1.0, None] + [0.0] * 14), (440, [float("nan")] * 16), (460, [1.0, 2.0, 3.0]), (480, [3.0, 2.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = collections.defaultdict(list)
    for x in ann.nearest(d, F.col("vec_id") % 20 == 0, k=20, query_rows=4, block_rows=64).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    ids = np.array([i for i in range(300) if i != 7])
    for q in range(0, 300, 20):
        c = ids[ids != q]
        s = (v[c].astype(float) * v[q].astype(float)).sum(axis=1)
        o = np.lexsort((c, -s))[:20]
        assert got.pop(q) == [(int(c[i]), float(s[i])) for i in o]
    assert dict(got) == {460: [(480, 10.0)], 480: [(460, 10.0)]}


# --- 8 ---


def test_urls_match_sql(spark):
    check(spark, "op8_url_filter", registry.queries(), registry.oracle_sql())


def test_url_list_in_time(spark):
    e = spark.createDataFrame([("b.com", "2024-01-10", "block"), ("b.com", "2024-02-10", "allow"), ("x.b.com/p", "2024-01-15", "allow"), ("b.com", "2024-01-10", "allow"), (None, "2024-01-01", "block"), ("c.com", None, "block")], "key string, day string, action string").withColumn("day", F.to_date("day"))
    c = spark.createDataFrame([(1, "http://b.com/", "2024-01-09"), (2, "http://B.com:80/", "2024-01-10"), (3, "https://u@x.b.com/p/q", "2024-01-20"), (4, "https://x.b.com/P2", "2024-02-09"), (5, "http://b.com", "2024-02-10"), (6, None, "2024-01-20"), (7, "nonsense", "2024-01-20"), (8, "http://b.com", None), (2, "http://B.com:80/", "2024-01-10")], "k long, url string, day string")
    got = [(r["k"], r["action"], r["blocked"]) for r in urls.evaluate(c, e, day="day").orderBy("k").collect()]
    assert got == [(1, None, False), (2, "block", True), (2, "block", True), (3, "allow", False), (4, "block", True), (5, "allow", False), (6, None, False), (7, None, False), (8, None, False)]
    assert urls.evaluate(c.limit(0), e, day="day").count() == 0


def test_url_list_of_deep_paths(spark):
    e = spark.createDataFrame([("a.com", "2024-01-01", "allow"), ("a.com/1/2/3/4/5", "2024-01-01", "block")], "key string, day string, action string")
    c = spark.createDataFrame([(1, "http://a.com/1/2/3/4/5/6?q"), (2, "http://a.com/1/2/3/4"), (3, "http://a.com/1/2/3/4/5"), (4, "http://a.com")], "k int, url string").withColumn("fetched", F.lit("2024-01-02"))
    got = [(r["k"], r["matched_key"], r["blocked"]) for r in urls.evaluate(c, e).orderBy("k").collect()]
    assert got == [(1, "a.com/1/2/3/4/5", True), (2, "a.com", False), (3, "a.com/1/2/3/4/5", True), (4, "a.com", False)]
    assert {r["blocked"] for r in urls.evaluate(c, e.limit(0)).collect()} == {False}


def test_url_list_within_a_day_and_with_clashing_columns(spark):
    e = spark.createDataFrame([("b.com", "2024-01-10 18:00:00", "block"), ("b.com", "2024-01-11 06:30:00", "allow"), ("b.com", "not a time", "block"), ("net", "2024-01-31 23:59:59", "block")], "key string, day string, action string")
    times = ["2024-01-10 09:00:00", "2024-01-10 18:00:00", "2024-01-11 06:29:59", "2024-01-11 06:30:00"]
    rows = [(i, "http://b.com/x", t) for i, t in enumerate(times)] + [(4, "http://c.net", "2024-01-31 23:59:58"), (5, "http://c.net", "2024-02-29 00:00:00"), (6, "http://c.net", "never")]
    c = spark.createDataFrame(rows, "_day int, url string, fetched string").withColumns({"_url": F.lit("mine"), "key": F.lit(1), "month": F.lit(2), "rank": F.lit(3)})
    got = urls.evaluate(c, e).orderBy("_day").collect()
    assert [r["blocked"] for r in got] == [False, True, True, False, False, True, False]
    assert {(r["_url"], r["key"], r["month"], r["rank"]) for r in got} == {("mine", 1, 2, 3)}


# --- 9 ---


def brute_repeats(rows, n=13):
    least = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, 1 << 62), (1 << 62) if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < ((1 << 62) if i is None else i):
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_substrings_against_brute_force(spark, chunk):
    r = np.random.default_rng(6)
    passages = [[f"p{v}" for v in r.integers(0, 30, int(n))] for n in r.integers(10, 40, 6)]
    rows = list(AWKWARD)
    for i in range(20, 70):
        w = [f"w{v}" for v in r.integers(0, 3 if i % 7 == 0 else 500, int(r.integers(0, 60)))]
        for p in r.integers(0, 6, 2):
            w += passages[p] + [f"x{i}"]
        rows.append((i, " ".join(w)))
    found = substring.remove_repeats(docs(spark, rows), chunk_bytes=chunk, blocks=3).collect()
    got = collections.Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found)
    assert got == brute_repeats(rows)
    # Each factor is what its source holds at that place, ends where the source goes on otherwise, and their union is what went.
    words = collections.defaultdict(list)
    for i, t in rows:
        words[i].append(WORDS.findall(t or ""))
    for x in found:
        own = next(w for w in words[x["doc_id"]] if len(w) == x["n_words"])
        for f in x["factors"]:
            n = f["end"] - f["start"]
            assert n >= 13 and f["source"] < (x["doc_id"] or 1 << 62)
            assert any(own[f["start"] : f["end"]] == w[f["source_start"] : f["source_start"] + n] for w in words[f["source"]])
        assert x["n_removed"] == len({p for f in x["factors"] for p in range(f["start"], f["end"])})
    assert substring.remove_repeats(docs(spark, [])).count() == 0


# --- 10 ---


def test_lines_match_sql(spark):
    check(spark, "op10_line_dedup", registry.queries(), registry.oracle_sql())


def test_lines_awkward(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb\nc\nd\ne"), (4, None), (5, ""), (6, "a\nb"), (7, "\n\n\n\n"), (8, "r\nr\nr\nr\nr")]
    d = docs(spark, rows).withColumns({"n_lines": F.lit("clash"), "id": F.lit(1), "_id": F.lit(2), "removed_at": F.lit(3)}).withColumn("n_chars", F.length("text").cast("long"))
    got = {x["doc_id"]: x for x in lines.remove_repeated_lines(d).collect()}
    assert got[1]["text"] == "a\nb\nc\nd" and got[2]["text"] == "x" and got[3]["text"] == "e" and got[4]["text"] is None
    assert got[5]["text"] == "" and got[6]["text"] == "a\nb" and got[7]["n_removed"] == 4 and got[8]["text"] == "r"
    assert got[2]["n_chars"] == 1 and lines.remove_repeated_lines(docs(spark, [])).count() == 0


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "a\nb\nc"), (None, "k\nl\nm\nn\no\np\na\nb\nc"), (None, "q\nr\ns"), (None, "t\nu\nv\nw\nx\ny\nz\n1\n2"), (None, "d\ne\nf"), (None, "d\ne\nf")]
    rows += [(5, "0\n1\n3\n4\n5\n6\n7\na\nb\nc"), (5, "g\nh\ni"), (5, "j\nj\nk\n9"), (6, "3\n2\n1"), (6, "3\n2\n1")]
    got = collections.Counter((x["doc_id"], x["text"]) for x in lines.remove_repeated_lines(docs(spark, rows)).collect())
    want = collections.Counter(rows)
    want.subtract([rows[1], rows[5], rows[6]])
    want.update([(None, "k\nl\nm\nn\no\np"), (None, ""), (5, "0\n1\n3\n4\n5\n6\n7")])
    assert got == +want


# --- pipeline ---


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in d.select("doc_id").collect()}
        d = stage(spark, d, SF)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in d.select("doc_id").collect()} <= before
    assert pipeline.STAGES[-1][1](spark, d, SF).select("doc_id").distinct().count() == d.count()


def test_pipeline_near_copies_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.default_rng(12)
    rows = []
    for n in range(0, 120, 3):
        base = [f"w{v}" for v in r.integers(0, 4000, 200)]
        for k, edits in enumerate((0, 4, 6)):  # to the first: similarities of 176/216 and 166/226
            w = list(base)
            for at in range(edits):
                w[10 + at * 30] = f"e{n}"
            rows.append((n + k, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    between = sum(80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y) for x, y in zip(sets[::3], sets[1::3], strict=True))
    assert between == 40
    want = {i for i, c in brute_components(rows, 80).items() if c == i}
    assert {x["doc_id"] for x in pipeline.near_copies_out(spark, docs(spark, rows), SF).collect()} == want


def test_pipeline_awkward_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["doc_id", "text", "lang", "source", "n_chars", "toxic", "kept", "id", "w"]
    d = docs(spark, AWKWARD).selectExpr("*", "cast(null as string) as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as toxic", "true as kept", "5 as id", "'x' as w")
    for _, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == names
    left = {r["doc_id"] for r in d.select("doc_id").collect()}
    assert {1, 2, 3, 4, 5, 6, 9, None} <= left
    assert {(r["toxic"], r["kept"], r["id"], r["w"]) for r in d.collect()} == {(1, True, 5, "x")}
    assert pipeline.STAGES[-1][1](spark, d, SF).count() >= len(left)
    d = d.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0

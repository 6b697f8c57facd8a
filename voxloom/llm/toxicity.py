"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause one after another, each the output of the one before: negation and reported
speech mark the insults and threats in their scope, target marks those that follow a person word, insult and threat hand on
an unmarked one, with its weight, and wait a few words for a person word to come after it.  Their composition is compiled once into one table of states.  It emits
weights into CHANNELS (insult or threat; plain, aimed at a person, or damped by negation or report), so clauses are scored, not words.

Insult patterns (word stems or whole words with a log-odds weight) are learned from labelled rows by greedy set cover: the pattern
that explains most labelled toxic texts not yet explained is taken, so words that merely accompany insults in
copied texts do not enter.  What each channel counts is learned too, by a logistic function that starts from the PRIOR factors.  The small word lists below
are starting values of the other transducers.

Null and empty texts have no clause and score the logistic intercept; repeated rows are scored each; texts of any length are
read whole; ties of patterns go to the longer one; an empty table gives no rows, and without labelled toxic rows nothing is toxic.
Columns of the caller are kept; the two added ones take the names given, and replace columns of these names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .labelled import held_out, training_rows
from .shared import importable

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True
LENGTHS = (3, 4, 5, 6, 8)  # bytes of stems that may enter the lexicon; whole words may too
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|\"")

NEGATION = {"not", "no", "never", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ninguno"}
REPORTED = {"said", "says", "quoted", "wrote", "called", "sagte", "schrieb", "nannte", "dit", "disait", "dijo", "escribió", '"'}
TARGET = {"you", "your", "youre", "they", "them", "these", "those", "du", "ihr", "dich", "euch", "tu", "vous", "toi", "ustedes", "vosotros"}
THREAT = {"kill": 3.0, "hurt": 2.0, "destroy": 2.0, "murder": 3.0, "töten": 3.0, "umbringen": 3.0, "tuer": 3.0, "matar": 3.0}


#: What the classes of words are, and the channels that weights go to.
CLASSES = ("word", "insult", "threat", "target", "negation", "reported")
CHANNELS = ("insult", "insult at", "insult damped", "threat", "threat at", "threat damped")
#: Starting factors of the channels, and how far each scope reaches in words.
PRIOR = (1.0, 1.5, 0.5, 0.33, 1.0, 0.2)
NEGATED, QUOTED, BEFORE, INSULT_WAITS, THREAT_WAITS = 3, 8, 6, 3, 4


def _scope(opens: str, mark: str, width: int):
    """A transducer that marks insults and threats of the ``width`` words after ``opens``."""

    def step(state: int, symbol: tuple) -> tuple[int, tuple]:
        if symbol[0] == opens:
            return width, symbol
        return max(0, state - 1), (symbol + (mark,) if state and symbol[0] in ("insult", "threat") else symbol)

    return step


def _waits(kind: str, width: int):
    """A transducer that lets an unmarked word of ``kind`` wait ``width`` words for a target."""

    def step(state: int, symbol: tuple) -> tuple[int, tuple]:
        if symbol == (kind,):
            return width, symbol
        if symbol[0] == "target" and state:
            return 0, symbol + (f"{kind} waited",)
        return max(0, state - 1), symbol

    return step


MACHINES = (_scope("negation", "damped", NEGATED), _scope("reported", "damped", QUOTED), _scope("target", "at", BEFORE), _waits("insult", INSULT_WAITS), _waits("threat", THREAT_WAITS))


@lru_cache(maxsize=1)
def composed() -> tuple[np.ndarray, np.ndarray]:
    """The composition of MACHINES: next state and action for every (state, class).

    Actions: 0 nothing; 1 + k emits the word's weight to channel k; 7, 8, 9 move what an insult, a threat or both emitted last from plain to aimed.
    """
    number, todo, moves, acts = {(0,) * len(MACHINES): 0}, [(0,) * len(MACHINES)], [], []
    for states in todo:
        row, act = [], []
        for name in CLASSES:
            symbol, after = (name,), []
            for machine, state in zip(MACHINES, states, strict=True):
                state, symbol = machine(state, symbol)
                after.append(state)
            to = tuple(after)
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
            if name in ("insult", "threat"):
                act.append(1 + 3 * (name == "threat") + (2 if "damped" in symbol else 1 if "at" in symbol else 0))
            else:
                act.append({(False, False): 0, (True, False): 7, (False, True): 8, (True, True): 9}["insult waited" in symbol, "threat waited" in symbol])
        moves.append(row)
        acts.append(act)
    return np.array(moves, np.int32), np.array(acts, np.int8)


@dataclass(frozen=True)
class Lexicon:
    stems: dict[bytes, float]
    words: dict[bytes, float]

    def weight(self, word: bytes) -> float:
        best = self.words.get(word, 0.0)
        for k in LENGTHS:
            if len(word) > k and (w := self.stems.get(word[:k], 0.0)) > best:
                best = w
        return best


def channels(clause: bytes, lexicon: Lexicon) -> tuple[np.ndarray, int]:
    """Weights that the composed machine emits on a clause, by channel, and how many insults there are."""
    moves, acts = composed()
    out, last, state, n = np.zeros(len(CHANNELS)), [0.0, 0.0], 0, 0
    for raw in WORD.findall(clause):
        word = raw.lower()
        weight = lexicon.weight(word)
        name = word.decode("utf-8", "replace")
        if weight:
            symbol = 1
            n += 1
        elif name in THREAT:
            symbol, weight = 2, THREAT[name]
        else:
            symbol = 4 if name in NEGATION else 5 if name in REPORTED else 3 if name in TARGET else 0
        act = acts[state, symbol]
        state = moves[state, symbol]
        if 1 <= act <= 6:
            out[act - 1] += weight
            last[symbol - 1] = weight
        elif act:
            for k in (0, 1):
                if act in (7 + k, 9):
                    out[3 * k] -= last[k]
                    out[3 * k + 1] += last[k]
    return out, n


def clause_weight(clause: bytes, lexicon: Lexicon) -> float:
    """A clause's weight by the starting factors."""
    return float(channels(clause, lexicon)[0] @ np.array(PRIOR))


def _first_bytes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    d = T.LOWER[data]
    last = len(data) - 1
    return d[starts].astype(np.int64) | d[np.minimum(starts + 1, last)].astype(np.int64) << 8 | d[np.minimum(starts + 2, last)].astype(np.int64) << 16


EVIDENCE = 4 + len(CHANNELS)
COLUMNS = [f"e{k}" for k in range(EVIDENCE)]


def evidence(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: sum of clause weights, largest clause weight, number of insult words, words in all, then the channels (n x 10)."""
    data, offsets = T.buffer(texts)
    out = np.zeros((len(offsets) - 1, EVIDENCE))
    keys = {*lexicon.words, *lexicon.stems, *(t.encode() for t in THREAT)}
    table, prior = np.zeros(1 << 24, bool), np.array(PRIOR)
    short = {k for k in keys if len(k) < 3}
    for k in keys - short:
        table[k[0] | k[1] << 8 | k[2] << 16] = True
    for i, j in T.groups(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = T.spans(d, o, ~LETTER)
        out[i:j, 3] = np.diff(first)
        if not len(starts):
            continue
        hit = np.flatnonzero(table[_first_bytes(d, starts)] & (ends - starts >= 3))
        raw = d.tobytes()
        hit = [x for x in hit if lexicon.weight(w := raw[starts[x] : ends[x]].lower()) or w.decode("utf-8", "replace") in THREAT]
        if not hit:
            continue
        stops = np.flatnonzero(CLAUSE_END[d])
        doc = np.searchsorted(o, starts[hit], "right") - 1
        done: set[int] = set()
        for x, k in zip(hit, doc, strict=True):
            a = np.searchsorted(stops, starts[x])
            lo = max(int(o[k]), int(stops[a - 1]) + 1 if a else 0)
            hi = min(int(o[k + 1]), int(stops[a]) if a < len(stops) else len(d))
            if lo not in done:
                done.add(lo)
                c, n = channels(raw[lo:hi], lexicon)
                w = float(c @ prior)
                row = out[i + k]
                row[4:] += c
                row[0] += w
                row[1] = max(row[1], w)
                row[2] += n
    return out


def inputs(e: np.ndarray) -> np.ndarray:
    """What the logistic function sees: total, largest and relative weight by the starting factors, and each channel."""
    return np.column_stack([np.minimum(e[:, 0], 12) / 4, np.minimum(e[:, 1], 8) / 4, np.minimum(e[:, 0] / np.sqrt(e[:, 3] + 9), 1.0), np.minimum(e[:, 4:], 6) / 6])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, y, feature) for every distinct stem and word of a text; features are 64-bit hashes."""
    for b in batches:
        data, offsets = T.buffer(b.column("text"))
        ids, y = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False)
        for i, j in T.groups(offsets, 1 << 20):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            h, doc = _hashes(d, o)[:2]
            if len(h):
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new] + i
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(y[doc].astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "y", "feature"])


def _hashes(d: np.ndarray, o: np.ndarray):
    starts, ends, _ = T.spans(d, o, ~LETTER)
    doc = np.searchsorted(o, starts, "right") - 1
    hs, docs, at, to, whole = [], [], [], [], []
    low = T.LOWER[d]
    for k in (*LENGTHS, 0):
        pick = np.flatnonzero(ends - starts > k) if k else np.flatnonzero(ends - starts >= 3)
        e = starts[pick] + k if k else ends[pick]
        with np.errstate(over="ignore"):
            hs.append(T.mix(T.word_hashes(low, starts[pick], e), 100 + k) if len(pick) else np.zeros(0, np.uint64))
        docs.append(doc[pick])
        at.append(starts[pick])
        to.append(e)
        whole.append(np.full(len(pick), k == 0))
    return tuple(map(np.concatenate, (hs, docs, at, to, whole)))


def _strings(wanted: list):
    """The bytes of each wanted feature, and whether it is a whole word."""
    need = np.array(sorted(wanted), np.int64)

    def run(batches):
        found: dict[int, tuple[bytes, bool]] = {}
        for b in batches:
            data, offsets = T.buffer(b.column("text"))
            for i, j in T.groups(offsets, 1 << 20):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, _, s, e, whole = _hashes(d, o)
                pick = np.flatnonzero(np.isin(h.view(np.int64), need))
                h = h.view(np.int64)
                low = T.LOWER[d]
                for x in pick:
                    if int(h[x]) not in found:
                        found[int(h[x])] = (low[s[x] : e[x]].tobytes(), bool(whole[x]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x for x, _ in found.values()], pa.binary()), pa.array([w for _, w in found.values()], pa.bool_())], names=["feature", "piece", "whole"])

    return run


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def score(self, e: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(inputs(e) @ np.array(self.weights) + self.bias)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; the channels are held near the starting factors by a stronger ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.array([0.01] * 3 + [2.0] * len(CHANNELS) + [0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w -= np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 20_000, least: int = 4, share: float = 0.015) -> Model:
    """Learn the lexicon and the logistic function from at most ``bound`` labelled rows (see ``training_rows``).

    A pattern is taken while it explains at least ``share`` of the toxic rows, and ``least`` - 1, that no other explains yet.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = training_rows(docs, labels, label, bound).persist()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        rows.unpersist()
        return Model(Lexicon({}, {}), (0.0,) * (3 + len(CHANNELS)), -6.0 if clean else 0.0)
    f = rows.mapInArrow(_features, "doc_id long, y int, feature long")
    counts = f.groupBy("feature").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    rate = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    good = counts.where((F.col("t") >= least) & (rate > 12)).select("feature", "t", "c")
    # At most as many rows as the sample's toxic texts have words, which the sample's bound on characters limits; ids and counts only.
    pairs = f.where("y = 1").join(good, "feature").select("feature", "doc_id", "t", "c").toPandas()
    cover = {k: (set(g["doc_id"]), int(g["t"].iloc[0]), int(g["c"].iloc[0])) for k, g in pairs.groupby("feature")}
    piece = {r["feature"]: (bytes(r["piece"]), r["whole"]) for r in rows.where("y = 1").mapInArrow(_strings(list(cover)), "feature long, piece binary, whole boolean").dropDuplicates(["feature"]).collect()}
    chosen: dict[int, tuple[int, int]] = {}
    left: set = set(pairs["doc_id"])
    rest = dict(cover)
    gain = max(least - 1, share * toxic)
    while rest:
        k = max(rest, key=lambda k: (round(len(rest[k][0] & left) * rest[k][1] / (rest[k][1] + 3 * rest[k][2]), 6), len(piece[k][0]), piece[k][1], k))
        if len(rest[k][0] & left) < gain:
            break
        chosen[k] = rest.pop(k)[1:]
        left -= cover[k][0]
        rest = {k: v for k, v in rest.items() if len(v[0] & left) >= gain}
    # Patterns as frequent as those chosen and never seen in a clean text: other insults of texts explained already.
    usual = 0.25 * max((t for t, _ in chosen.values()), default=0)
    for k, (_, t, c) in sorted(cover.items(), key=lambda x: (-len(piece[x[0]][0]), -piece[x[0]][1], x[0])):
        nested = any(piece[o][0].startswith(piece[k][0]) and chosen[o][0] >= 0.9 * t for o in chosen)
        if k not in chosen and c == 0 and t >= max(least, usual) and not nested:
            chosen[k] = (t, c)
    stems, words = {}, {}
    for k, (t, c) in chosen.items():
        weight = float(min(6.0, np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))) / 3
        (words if piece[k][1] else stems)[piece[k][0]] = weight
    lexicon = Lexicon(stems, words)
    got = rows.mapInArrow(_evidence(lexicon, ("y",)), "y int, " + ", ".join(f"{c} double" for c in COLUMNS)).toPandas()
    rows.unpersist()
    w, b = _logistic(inputs(got[COLUMNS].to_numpy()), got["y"].to_numpy())
    return Model(lexicon, tuple(map(float, w)), b)


def _evidence(lexicon: Lexicon, keep: tuple[str, ...]):
    def run(batches):
        for b in batches:
            e = evidence(b.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(e[:, k]) for k in range(EVIDENCE))], names=[*keep, *COLUMNS])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5, names: tuple[str, str] = ("toxicity", "toxic")) -> DataFrame:
    """Every row of ``docs`` (its column text is read) with a score (0 to 1) and a verdict (0 or 1) under ``names``."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)  # patterns that each explain a share of the bounded sample

    def run(batches):
        m = shared.value
        for b in batches:
            s = m.score(evidence(b.column("text"), m.lexicon))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, *names])

    clean = docs.drop(*names)
    fields = ", ".join(f"`{n}` {t}" for n, t in clean.dtypes)
    return clean.mapInArrow(run, f"{fields}, `{names[0]}` double, `{names[1]}` int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))

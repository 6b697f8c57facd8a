"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is every document, deduplicated: each sequence of WINDOW words stands for where it is first, in the document of smallest id.
Its index is cut into blocks by hash, sized by a count of words; an entry holds the first document's id and the word it stands at.
Documents are parsed greedily: where a window is found, a factor starts at its place in the source and is
extended as long as the next word continues the source; then a new factor starts.  Windows across a factor's boundary are
looked up as well, so factors may overlap.  A factor has WINDOW words at least; those whose source is another document of smaller id are the
duplicate spans.  Every window is thus either inside a factor or looked up, and a window is removed if, and only if, a smaller id has it.

Two passes keep what is shuffled small.  Pass 1 asks only about anchors: of the ANCHOR-word grams inside
a window the one with the least hash, so equal windows have equal anchors.  Pass 2 asks about the windows whose anchor
also occurs in another document.  Documents are packed into chunks; a chunk asks about each distinct anchor or window once,
and each block answers it with one row, so a window that a third of all documents hold costs an entry for each chunk and no
group outgrows its block.  Chunks are a written table; texts move compressed.

Null and blank texts have no words and keep the digest of an empty string.  Documents of fewer than
WINDOW words lose nothing.  A null id counts as larger than every id.  Repeated ids are rows of their own and do not
remove each other's words.  Ties of a source go to its smallest position.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import importable, shuffle_partitions, written

WINDOW, ANCHOR = 13, 5
NO_ID = np.iinfo(np.int64).max
BLOCK_WORDS = 8_000_000  # of the corpus to one index block; about a fifth are entries
CHUNK = "chunk long, bytes long, ids binary, known binary, sizes binary, packed binary"


def _pack(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, offsets = T.buffer(b.column("text"))
            known = ~np.asarray(b.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
            for i, j in T.groups(offsets, limit):
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([int(offsets[j] - offsets[i])], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids[i:j].tobytes(), known[i:j].tobytes(), np.diff(offsets[i : j + 1]).tobytes(), z.compress(data[offsets[i] : offsets[j]].tobytes())))],
                    names=["chunk", "bytes", "ids", "known", "sizes", "packed"],
                )

    return run


class Chunk:
    """The words, anchors and windows of one packed chunk: the same in every pass."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["packed"]) if len(row["packed"]) else b""
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int64))))
        data = np.frombuffer(self.raw, np.uint8)
        starts, ends, self.first = T.spans(data, self.offsets)
        self.h = T.word_hashes(data, starts, ends)
        n = np.diff(self.first)
        have = np.maximum(n - WINDOW + 1, 0)
        # Word at which each whole window starts, and the text it is of.
        self.doc = np.repeat(np.arange(len(n)), have)
        self.at = np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have) + np.repeat(self.first[:-1], have)
        g = T.ngrams(self.h, ANCHOR)
        if len(self.at):
            k = WINDOW - ANCHOR + 1
            m, width = g, 1
            while width * 2 <= k:
                m = np.minimum(m[: len(m) - width], m[width:])
                width *= 2
            if width < k:
                m = np.minimum(m[: len(m) - (k - width)], m[k - width :])
            self.anchors, self.anchor_of = np.unique(m[self.at], return_inverse=True)
        else:
            self.anchors, self.anchor_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def asked(self, shared: np.ndarray) -> None:
        """Windows to ask about: their anchor is in another chunk too, or in two texts of this one."""
        low, high = np.full(len(self.anchors), NO_ID), np.full(len(self.anchors), -1)
        np.minimum.at(low, self.anchor_of, self.doc)
        np.maximum.at(high, self.anchor_of, self.doc)
        pick = np.flatnonzero((shared | (low < high))[self.anchor_of]) if len(self.at) else np.zeros(0, np.int64)
        self.pick = pick
        w1, w2 = T.ngrams(self.h, WINDOW), T.ngrams(self.h, WINDOW, 3)
        key = np.empty(len(pick), [("a", np.uint64), ("b", np.uint32)])
        key["a"], key["b"] = w1[self.at[pick]] if len(pick) else 0, (w2[self.at[pick]] >> np.uint64(32)) if len(pick) else 0
        order = np.lexsort((key["b"], key["a"]))
        s = key[order]
        new = np.ones(len(s), bool)
        new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
        self.windows = s[new]
        self.window_of = np.empty(len(s), np.int64)
        self.window_of[order] = np.cumsum(new) - 1
        # Where each window is first in this chunk: the smallest id, then the smallest position.
        ids, place = self.ids[self.doc[pick]], (self.at[pick] - self.first[self.doc[pick]]).astype(np.int64)
        order = np.lexsort((place, ids, self.window_of))
        head = order[np.searchsorted(self.window_of[order], np.arange(len(self.windows)))] if len(order) else order
        self.least, self.place = ids[head], place[head]


def _blocks(values: np.ndarray, blocks: int) -> list[tuple[int, int, int]]:
    """Sorted values cut into index blocks by their leading 32 bits: (block, from, to)."""
    block = (values >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    cuts = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(blocks) if cuts[b] < cuts[b + 1]]


def _bits(answers: list | None, values: np.ndarray, blocks: int) -> np.ndarray:
    """The answers of all blocks put together: one bool for each value."""
    out = np.zeros(len(values), bool)
    if answers:
        at = {b: (i, j) for b, i, j in _blocks(values, blocks)}
        for a in answers:
            i, j = at[a["block"]]
            out[i:j] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=j - i).astype(bool)
    return out


def _sources(answers: list | None, values: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value: whether a smaller id has it, and the source's id and position."""
    found, ids, place = _bits(answers, values, blocks), np.full(len(values), NO_ID), np.zeros(len(values), np.int64)
    at = {b: (i, j) for b, i, j in _blocks(values, blocks)}
    for a in answers or []:
        i, j = at[a["block"]]
        raw, hit = zstandard.ZstdDecompressor().decompress(a["sources"]), np.flatnonzero(found[i:j]) + i
        ids[hit], place[hit] = np.frombuffer(raw, np.int64, len(hit)), np.frombuffer(raw, np.int64, len(hit), 8 * len(hit))
    return found, ids, place


QUESTION = "block int, chunk long, n int, body binary"
ANSWER = "chunk long, block int, bits binary"
SOURCES = ANSWER + ", sources binary"


def _question(rows: list) -> pa.RecordBatch:
    b, c, n, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], names=["block", "chunk", "n", "body"])


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _ask_anchors(blocks: int):
    def run(batches):
        for r in _rows(batches):
            a = Chunk(r).anchors
            if len(a):
                yield _question([(b, r["chunk"], j - i, a[i:j].tobytes()) for b, i, j in _blocks(a, blocks)])

    return run


def _ask_windows(blocks: int):
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for r in _rows(batches):
            c = Chunk(r)
            c.asked(_bits(r["anchors"], c.anchors, blocks))
            if len(c.windows):
                yield _question(
                    [(b, r["chunk"], j - i, z.compress(c.windows["a"][i:j].tobytes() + c.windows["b"][i:j].tobytes() + c.least[i:j].tobytes() + c.place[i:j].tobytes())) for b, i, j in _blocks(c.windows["a"], blocks)]
                )

    return run


def _answer(chunks: list, block: int, sizes: np.ndarray, flag: np.ndarray) -> pa.Table:
    cut = np.concatenate(([0], np.cumsum(sizes)))
    rows = [(chunks[k], np.packbits(flag[cut[k] : cut[k + 1]]).tobytes()) for k in range(len(chunks)) if flag[cut[k] : cut[k + 1]].any()]
    return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int32()), "bits": pa.array([b for _, b in rows], pa.binary())})


def _answer_anchors(t: pa.Table) -> pa.Table:
    sizes = t["n"].to_numpy()
    v = np.concatenate([np.frombuffer(x, np.uint64) for x in t["body"].to_pylist()])
    order = np.argsort(v, kind="stable")
    s = v[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    flag = np.empty(len(s), bool)
    flag[order] = same
    return _answer(t["chunk"].to_pylist(), t["block"][0].as_py(), sizes, flag)


def _answer_windows(t: pa.Table) -> pa.Table:
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    sizes, chunks, block = t["n"].to_numpy(), t["chunk"].to_pylist(), t["block"][0].as_py()
    a, b, ids, place = [], [], [], []
    for n, body in zip(sizes, t["body"].to_pylist(), strict=True):
        raw = unpack.decompress(body)
        a.append(np.frombuffer(raw, np.uint64, n))
        b.append(np.frombuffer(raw, np.uint32, n, 8 * n))
        ids.append(np.frombuffer(raw, np.int64, n, 12 * n))
        place.append(np.frombuffer(raw, np.int64, n, 20 * n))
    a, b, ids, place = map(np.concatenate, (a, b, ids, place))
    order = np.lexsort((place, ids, b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(sa), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first place of each window
    first = np.empty(len(sa), np.int64)
    first[order] = head
    flag = ids[first] < ids
    out, cut = [], np.concatenate(([0], np.cumsum(sizes)))
    for k, chunk in enumerate(chunks):
        hit = flag[cut[k] : cut[k + 1]]
        if hit.any():
            source = first[cut[k] : cut[k + 1]][hit]
            out.append((chunk, np.packbits(hit).tobytes(), pack.compress(ids[source].tobytes() + place[source].tobytes())))
    c, bits, sources = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"chunk": pa.array(c, pa.int64()), "block": pa.array([block] * len(c), pa.int32()), "bits": pa.array(bits, pa.binary()), "sources": pa.array(sources, pa.binary())})


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of found windows (position, source id and position, by position): first and last window of each factor."""
    if not len(at):
        return at, at
    cut = (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)
    heads = np.concatenate(([0], np.flatnonzero(cut) + 1))
    return heads, np.concatenate((heads[1:], [len(at)])) - 1


FACTORS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "source", "source_start")]))


def _parse(blocks: int, with_text: bool):
    """Factors of every text, and what is left of it."""

    def run(batches):
        for r in _rows(batches):
            c = Chunk(r)
            c.asked(_bits(r["anchors"], c.anchors, blocks))
            found, source, place = _sources(r["windows"], c.windows["a"], blocks)
            source, place = np.where(found, source, c.least), np.where(found, place, c.place)
            hit = c.pick[source[c.window_of] < c.ids[c.doc[c.pick]]]
            of = c.window_of[source[c.window_of] < c.ids[c.doc[c.pick]]]
            at, source, place = c.at[hit], source[of], place[of]
            heads, lasts = factors(at, source, place)
            starts, ends = at[heads], at[lasts] + WINDOW
            edge = np.zeros(len(c.h) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            covered = np.cumsum(edge)[:-1] > 0
            removed = np.concatenate(([0], np.cumsum(covered)))
            known = np.frombuffer(r["known"], bool)
            ids, words, gone, digest, spans, texts = [], [], [], [], [], []
            for k in range(len(c.ids)):
                lo, hi = int(c.first[k]), int(c.first[k + 1])
                kept = c.raw[c.offsets[k] : c.offsets[k + 1]].split()
                n = int(removed[hi] - removed[lo])
                cut = []
                if n:
                    i, j = np.searchsorted(starts, (lo, hi))
                    cut = [{"start": int(starts[f] - lo), "end": int(ends[f] - lo), "source": int(source[heads[f]]), "source_start": int(place[heads[f]])} for f in range(i, j)]
                    kept = list(compress(kept, ~covered[lo:hi]))
                left = b" ".join(kept)
                ids.append(int(c.ids[k]) if known[k] else None)
                words.append(hi - lo)
                gone.append(n)
                spans.append(cut)
                digest.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, FACTORS), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True, chunk_bytes: int = 1 << 20, blocks: int | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256, the factors (start, end, source id, start there) and the text left.

    ``blocks`` is the number of index blocks: by default three for each shuffle partition, and more where a block would pass BLOCK_WORDS words.
    """
    spark = docs.sparkSession
    importable(spark)
    chunks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(chunk_bytes), CHUNK), "chunks")
    if blocks is None:
        # A word and its separator take two bytes at least; six is usual.
        words = (chunks.agg(F.sum("bytes")).first()[0] or 0) // 6
        blocks = max(3 * shuffle_partitions(spark), -(-words // BLOCK_WORDS))

    def together(answers: DataFrame, name: str, *columns: str) -> DataFrame:
        """One row for each chunk; it has at most ``blocks`` answers."""
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("block", *columns)).alias(name))

    first = written(chunks.select("chunk", "ids", "sizes", "packed").mapInArrow(_ask_anchors(blocks), QUESTION).groupBy("block").applyInArrow(_answer_anchors, ANSWER), "anchors")
    asked = chunks.select("chunk", "ids", "sizes", "packed").join(together(first, "anchors", "bits"), "chunk", "left")
    second = written(asked.mapInArrow(_ask_windows(blocks), QUESTION).groupBy("block").applyInArrow(_answer_windows, SOURCES), "windows")
    parsed = chunks.drop("bytes").join(together(first, "anchors", "bits"), "chunk", "left").join(together(second, "windows", "bits", "sources"), "chunk", "left")
    factor = "array<struct<start:long,end:long,source:long,source_start:long>>"
    out = parsed.mapInArrow(_parse(blocks, with_text), f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors {factor}, text string")
    return out if with_text else out.drop("text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")

"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, links confirmed on full sets.

A document's signature has CHUNKS x WIDTH symbols of 16 bits, each the low bits of one minimum over its
shingle hashes.  The signature is split into CHUNKS chunks.  By pigeonhole, two signatures that differ
in at most CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS differing symbols; every way
to leave out ERRORS symbols of a chunk is an index key, so such pairs always share a key.  At a similarity of
0.85 a pair fails to (12 or more of 24 symbols differ, in every chunk two) with a probability near 1e-6, at 0.8 near 3.5e-5.

Documents are told apart by what their texts hold, never by id: a node is a distinct shingle set, under a number of its own, and
its copies share it.  Ids come in again at the end, as the smallest of each component.

Pairs inside a bucket are not all made.  Every member is compared with three pivots of its bucket, which joins most
near copies.  Two documents of one component need no further comparison.  A bucket that still holds several components is
cut into blocks of bounded size; each pair of blocks is one matrix product of shingle incidences, which gives all
intersections exactly, and only a spanning forest of its links is returned.  So no link that could join components is lost,
and no row is made for a pair: the work in one such bucket still grows with the square of its members, in block products of BLOCK_ROWS.
A text moves once to its block, and a block once to each other block of its bucket.

Null, empty or blank texts have no shingles and are linked with nothing.  Repeated ids are separate rows, each judged by its own text, so
texts that share an id may be in different components.  Rows with a null id link like others; their component is null only if nothing
they reach has an id, and they are never ``kept`` (``representatives`` keeps one row for such a component too).  Empty tables give no rows;
other columns are not read, ``representatives`` keeps them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .shared import importable, written

CHUNKS, WIDTH, ERRORS = 6, 4, 1
SYMBOLS = CHUNKS * WIDTH
WORDS = 5
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 600_000
ROW = ["__row_id", "__row_text"]  # an id and a hash of the text, under names no other column has


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of texts: index of the first, and the sorted distinct shingle hashes of each (ASCII lower-cased)."""
    data, offsets = T.buffer(texts)
    for i, j in T.groups(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = T.spans(d, o)
        h = T.word_hashes(d, starts, ends, lower=True)
        g = T.ngrams(h, words)
        out = []
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= words:
                s = np.sort(g[a : b - words + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                out.append(np.array([T.one_hash(h[a:b])], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        yield i, out


_SALTS = np.random.default_rng(97).integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """n x SYMBOLS minima (16 bits of each); rows of empty sets are zero."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[k]) for k in full])
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    u = np.concatenate([sets[k] for k in full])
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS):
            h = (u ^ (u >> np.uint64(31))) * _SALTS[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            m = np.minimum.reduceat(h, at)
            out[full, k] = (T.mix(m, k) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """n x (CHUNKS * WIDTH) keys: chunk number, left-out symbol and the other symbols of the chunk, hashed."""
    s = sig.astype(np.uint64).reshape(len(sig), CHUNKS, WIDTH)
    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            v = np.full(len(sig), c * WIDTH + out + 1, np.uint64)
            for w in range(WIDTH):
                if w != out:
                    v = v << np.uint64(16) | s[:, c, w]
            keys.append(T.mix(v, 5))
    return np.column_stack(keys).view(np.int64)


def _sign(batches):
    for b in batches:
        ids, hashes = b.column("doc_id"), b.column("text_hash")
        for i, sets in shingle_sets(b.column("text")):
            with np.errstate(over="ignore"):
                s0 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s1 = np.array([T.mix(s, 9).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, len(sets)), hashes.slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(s0), pa.array(s1), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "s0", "s1", "sig"],
            )


def _keys(batches):
    for b in batches:
        if b.num_rows:
            k = index_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            n = k.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), n)), pa.array(np.repeat(b.column("n").to_numpy(), n))], names=["key", "id", "n"]
            )


def _squeeze(batches):
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("text_hash"), pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["text_hash", "packed"])


def _confirm(least: int):
    """Of (a, b, packed_a, packed_b), the pairs with 100 * intersection >= least * union."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def shingles(i: int, packed: bytes) -> np.ndarray:
            nonlocal held
            if i in kept:
                kept.move_to_end(i)
                return kept[i]
            ((_, (s,)),) = shingle_sets(pa.array([unpack.decompress(packed)], pa.large_binary()))
            kept[i] = s
            held += len(s)
            while held > 4_000_000 and len(kept) > 2:
                held -= len(kept.popitem(last=False)[1])
            return s

        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            pa_, pb = batch.column("packed_a"), batch.column("packed_b")
            good = np.zeros(len(a), bool)
            for k in range(len(a)):
                x, y = shingles(int(a[k]), pa_[k].as_py()), shingles(int(b[k]), pb[k].as_py())
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                good[k] = 100 * both >= least * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def _compare(least: int):
    """A spanning forest of the links inside one pair of blocks (id, label, packed)."""

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        ids, at = np.unique(t["id"].to_numpy(), return_index=True)
        label = t["label"].to_numpy()[at]
        n = len(ids)
        edges: list[tuple[int, int]] = []
        if len(np.unique(label)) > 1:
            texts = t["packed"].take(pa.array(at)).to_pylist()
            sets = [s for _, run_ in shingle_sets(pa.array([unpack.decompress(x) for x in texts], pa.large_binary())) for s in run_]
            size = np.array([len(s) for s in sets])
            values, doc = np.concatenate(sets), np.repeat(np.arange(n), size)
            order = np.argsort(values, kind="stable")
            values, doc = values[order], doc[order]
            new = np.ones(len(values), bool)
            new[1:] = values[1:] != values[:-1]
            col = np.cumsum(new) - 1
            common = np.bincount(col)[col] > 1
            col, doc = np.unique(col[common], return_inverse=True)[1], doc[common]
            both = np.zeros((n, n), np.float32)
            width = 4096
            cuts = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else -1) + width + 1, width))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = np.zeros((n, width), np.float32)
                x[doc[lo:hi], col[lo:hi] % width] = 1
                both += x @ x.T
            link = 100 * both.astype(np.float64) >= least * (size[:, None] + size - both)
            link |= label[:, None] == label
            waiting = np.ones(n, bool)
            for root in range(n):
                if waiting[root]:
                    waiting[root] = False
                    front = [root]
                    while front:
                        x = front.pop()
                        for y in np.flatnonzero(link[x] & waiting):
                            waiting[y] = False
                            front.append(y)
                            if label[x] != label[y]:
                                edges.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return run


def _signed(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, first_id) for every row: the component as a number of its own, and its smallest id.

    Shingles stand as 64-bit hashes in the sets that links are confirmed on, and texts go by a 64-bit hash.
    """
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = written(docs.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, s0 long, s1 long, sig binary"), "signatures")
    # Equal shingle sets are one node, numbered in a written table; all aggregates combine before the shuffle, so thousands of copies are cheap.
    nodes = signed.where("n_shingles > 0").groupBy("s0", "s1").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("id", "n", "sig").mapInArrow(_keys, "key long, id long, n long")
    seen = F.xxhash64("id", F.lit(11))
    pivots = keys.groupBy("key").agg(F.min("id").alias("p0"), F.max("id").alias("p1"), F.min(F.struct(seen.alias("h"), "id"))["id"].alias("p2")).where("p0 < p1")
    members = written(keys.join(pivots, "key"), "members")
    sizes = nodes.select("id", "n")
    # Of each node in a bucket one text moves, compressed: of its copies those of one hash, once.
    wanted = nodes.select("id", "text_hash").join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.where("text is not null").select("text_hash", "text").mapInArrow(_squeeze, "text_hash long, packed binary")
    # Copies combine before the shuffle, so a text that many rows share moves once from each task.
    texts = texts.groupBy("text_hash").agg(F.first("packed").alias("packed")).join(wanted.select("text_hash").distinct(), "text_hash", "left_semi")
    packed = written(wanted.join(texts, "text_hash").select("id", "packed"), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        """Confirmed pairs; a pair whose sizes alone rule it out is dropped before its texts are joined."""
        p = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = p.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
        p = p.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * least).select("a", "b")
        p = p.join(packed.select(F.col("id").alias("b"), F.col("packed").alias("packed_b")), "b").join(packed.select(F.col("id").alias("a"), F.col("packed").alias("packed_a")), "a")
        return written(p.select("a", "b", "packed_a", "packed_b").mapInArrow(_confirm(least), "a long, b long"), "links")

    found = links(members.select(F.col("id").alias("a"), F.explode(F.array("p0", "p1", "p2")).alias("b")))
    labels = components(found)
    # Buckets of up to three members have had every pair; of larger ones those that still hold several components
    # are cut into blocks, and each pair of blocks is compared whole.
    here = members.select("key", "id", "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    cut = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = here.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m"), cut.alias("blocks")).where("l0 < l1 and m > 3")
    left = here.join(mixed.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(packed, "id")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", "id", "label", "packed", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"))
    more = written(left.groupBy("key", "b0", "b1").applyInArrow(_compare(least), "a long, b long"), "links")
    if more.limit(1).count():
        labels = components(written(found.unionByName(more), "links"))
    # The smallest id of each component, by way of its nodes.
    node = nodes.select("s0", "s1", "id", "first_id").join(labels, "id", "left").select("s0", "s1", "first_id", F.coalesce("label", "id").alias("component"))
    node = written(node, "node_components")
    least_id = node.groupBy("component").agg(F.min("first_id").alias("first_id"))
    node = node.drop("first_id").join(least_id, "component")
    return signed.drop("sig").join(node, ["s0", "s1"], "left").select("doc_id", "text_hash", "n_shingles", "component", "first_id")


def near_duplicates(docs: DataFrame, least: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (columns doc_id and text are read)."""
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first_id"))
    return _signed(docs, least).select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame, least: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the one of the smallest id (without any id, of the smallest hash), and all rows without shingles.

    Rows that share that id, or a text, still leave one row.
    """
    rows = _signed(docs, least)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = rows.where("n_shingles > 0").groupBy("component").agg(F.min(place).alias("b")).select(F.col("b.doc_id").alias(ROW[0]), F.col("b.text_hash").alias(ROW[1]))
    # Of repeated rows one stays: a count by row tells whether there are any, so that only those are grouped.
    count = rows.groupBy(F.col("doc_id").alias(ROW[0]), F.col("text_hash").alias(ROW[1])).agg(F.count("*").alias("__copies"), F.max("n_shingles").alias("__shingles"))
    count = count.join(best.withColumn("__best", F.lit(True)), (count[ROW[0]].eqNullSafe(best[ROW[0]])) & (count[ROW[1]] == best[ROW[1]]), "left").select(count["*"], "__best")
    keep = written(count.where("__best or __shingles = 0").select(*ROW, ((F.col("__copies") > 1) & (F.col("__shingles") > 0)).alias("__many")), "kept")
    here = docs.withColumns({ROW[0]: F.col("doc_id").cast("long"), ROW[1]: F.xxhash64("text")})

    def rows_of(k: DataFrame) -> DataFrame:
        return here.join(k, (here[ROW[0]].eqNullSafe(k[ROW[0]])) & (here[ROW[1]] == k[ROW[1]]), "left_semi")

    one = rows_of(keep.where("not __many")).select(*docs.columns)
    many = rows_of(keep.where("__many")).groupBy(*ROW).agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return one.unionByName(many)


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Merkle dataset manifest: Pregel-style RDD supersteps over hash trees of documents.

A row is a leaf; the leaves of a source, in order, are a tree, and the roots of all sources are the leaves of a tree of their own.

* Numbering.  Leaf hashes are made in the JVM, so texts never reach Python.  Leaves are range-sorted by (source, id, hash); every partition reports its rows and how many of them belong
  to its first and last source, and from these reports, a few numbers for each partition, each leaf gets its tree, its place and the size of its tree.
  No source, however large, is gathered in one task.
* Up.  In a superstep every node messages its parent, at most ``arity`` children each; a parent that has all of them hashes and forwards.
* Down.  In reverse supersteps a parent messages each child the path above it, to which the child adds its run of siblings, until the path is at the leaves.
* Verification.  A leaf folds its own hash, or a tampered one, with the siblings of its path, and compares the result with the root.

Each superstep ends in a written table, so a lost executor costs the tasks of one superstep.  A message down is at most ``arity`` hashes a level.

H is hex SHA-256 of its inputs put together.  Null ids and sources come first; rows that share an id are ordered by leaf hash, and repeated rows are leaves each.  A
null in any column has its own sign.  A lone leaf is its tree's root.  Rows without an id are not tampered with.  An empty table gives no rows.  Columns other
than ``columns`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import importable, shuffle_partitions, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
NODES = "tree long, at long, size long, hash string"
PATHS = "tree long, at long, subroot string, path binary"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _signed(value: Column) -> Column:
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_signed(c) for c in columns.values()]), 256)


def tampered(doc_id: Column) -> Column:
    """Where 5 divides the unsigned crc32 of the id in decimals."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, where: Column | None = None, change: dict[str, Column] | None = None) -> DataFrame:
    """(source, doc_id, leaf, changed): the leaf of each row, and that of the row with ``change`` made to it, for rows ``where`` it is to be made."""
    given = {c: F.col(c) for c in columns}
    changed = F.when(where, leaf_hash(given | (change or {}))) if where is not None else F.lit(None).cast("string")
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(given).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))


# --- numbering -----------------------------------------------------------------------------------


def _by_source(rows: Iterator) -> Iterator[tuple[bytes | None, Iterator]]:
    return groupby(rows, lambda r: None if r["source"] is None else hashlib.sha256(r["source"].encode()).digest())


def _report(part: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, sources, first source, its rows, last source, its rows, most rows of one source)."""
    first, last, sources, most = None, None, 0, 0
    for key, held in _by_source(rows):
        n = sum(1 for _ in held)
        first = first or (key, n)
        last, sources, most = (key, n), sources + 1, max(most, n)
    if sources:
        yield part, sources, *first, *last, most


def _places(reports: list[tuple]) -> tuple[dict[int, tuple], int, int]:
    """(for each partition: number of its first tree and of its last, leaves of the first one before it, sizes of both), trees, size of the largest."""
    tree, key, before, found, sizes, most = -1, object(), 0, {}, {}, 0
    for part, sources, first, n_first, last, n_last, n_most in sorted(reports, key=lambda r: r[0]):
        went_on = tree >= 0 and first == key
        start, offset = (tree, before) if went_on else (tree + 1, 0)
        sizes[start] = sizes.get(start, 0) + n_first
        if sources > 1:
            sizes[start + sources - 1] = n_last
        tree, key, before = start + sources - 1, last, (offset + n_first if sources == 1 else n_last)
        found[part] = (start, tree, offset)
        most = max(most, n_most)
    return {p: (a, b, offset, sizes[a], sizes[b]) for p, (a, b, offset) in found.items()}, tree + 1, max([most, *sizes.values()])


def _numbered(places: dict[int, tuple], arity: int):
    def run(part: int, rows: Iterator) -> Iterator[tuple]:
        if part not in places:
            return
        first, last, offset, n_first, n_last = places[part]
        for k, (_, held) in enumerate(_by_source(rows), first):
            # Only a source that lies wholly inside the partition is counted here.
            size = n_first if k == first else n_last if k == last else len(held := list(held))
            for at, r in enumerate(held, offset if k == first else 0):
                yield (k, at // arity), (at % arity, size, r["doc_id"], r["leaf"], r["changed"])

    return run


# --- supersteps ----------------------------------------------------------------------------------


def _table(spark: SparkSession, rows: RDD, fields: str, name: str) -> DataFrame:
    return written(spark.createDataFrame(rows, fields, verifySchema=False), name)


def _run_table(spark: SparkSession, sent: RDD, parts: int, arity: int) -> DataFrame:
    """Superstep 0: leaves message the runs they belong to; a run keeps its members for the way down, and hashes them unless its tree is one leaf."""

    def complete(message) -> tuple:
        (tree, at), members = message[0], sorted(message[1], key=lambda m: m[0])
        size, hashes = members[0][1], [m[3] for m in members]
        return tree, at, -(-size // arity), hashes[0] if size == 1 else H(*hashes), size, [(m[2], m[3], m[4]) for m in members]

    return _table(spark, sent.groupByKey(parts).map(complete), f"{NODES}, leaves long, members array<struct<doc_id: long, leaf: string, changed: string>>", "runs")


def _climbed(nodes: DataFrame, most: int, arity: int, parts: int) -> list[DataFrame]:
    """Levels of trees, from ``nodes`` up: in each superstep nodes of trees that aren't done message their parents, which hash and forward."""
    levels = [nodes]

    def send(r) -> tuple:
        return (r["tree"], r["at"] // arity), (r["at"] % arity, r["size"], r["hash"])

    def complete(message) -> tuple:
        (tree, at), children = message[0], sorted(message[1])
        return tree, at, -(-children[0][1] // arity), H(*[c[2] for c in children])

    while most > 1:
        most, parts = -(-most // arity), max(1, parts // arity)
        levels.append(_table(nodes.sparkSession, levels[-1].where("size > 1").rdd.map(send).groupByKey(parts).map(complete), NODES, "level"))
    return levels


def _packed(at: int, hashes: list[str]) -> bytes:
    """One step of a path: place in the run, members of the run, their hashes."""
    return bytes([at, len(hashes)]) + b"".join(map(bytes.fromhex, hashes))


def _steps(path: bytes) -> Iterator[tuple[int, list[str]]]:
    p = 0
    while p < len(path):
        at, n = path[p], path[p + 1]
        yield at, [path[q : q + 32].hex() for q in range(p + 2, p + 2 + 32 * n, 32)]
        p += 2 + 32 * n


def _handed_down(levels: list[DataFrame], roots: DataFrame, arity: int, parts: int) -> DataFrame:
    """(tree, at, subroot, path) of the nodes of the lowest level; ``roots`` has the path above each tree's root."""

    def receive(message) -> Iterator[tuple]:
        (tree, _), (run, above) = message
        run, above = sorted(run), list(above)
        for at, hash_ in run if above else ():
            yield tree, at, above[0][0], _packed(at % arity, [h for _, h in run]) + bytes(above[0][1])

    paths = None
    for k, level in reversed(list(enumerate(levels))):
        n = max(1, parts // arity**k)
        done = level.where("size = 1").select("tree", "at").join(roots, "tree").select("tree", "at", "subroot", "path")
        if paths is not None:
            run = level.where("size > 1").rdd.map(lambda r: ((r["tree"], r["at"] // arity), (r["at"], r["hash"])))
            above = paths.rdd.map(lambda r: ((r["tree"], r["at"]), (r["subroot"], r["path"])))
            done = done.unionByName(level.sparkSession.createDataFrame(run.cogroup(above, n).flatMap(receive), PATHS, verifySchema=False))
        paths = written(done, "paths")
    return paths


def _fold(hash_: str, steps: list[tuple[int, list[str]]]) -> str:
    for at, run in steps:
        hash_ = H(*run[:at], hash_, *run[at + 1 :])
    return hash_


def _verified(root: str):
    def run(rows: Iterator) -> Iterator[tuple]:
        for r in rows:
            own = [m["leaf"] for m in r["members"]]
            above = list(_steps(bytes(r["path"])))
            for at, m in enumerate(r["members"]):
                steps = ([(at, own)] if r["leaves"] > 1 else []) + above
                siblings = [h for p, run in steps for k, h in enumerate(run) if k != p]
                folded = _fold(m["changed"] or m["leaf"], steps)
                yield m["doc_id"], m["leaf"], r["subroot"], root, H(*siblings), folded, folded == root

    return run


def manifest(leaf_rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf (source, doc_id, leaf, changed, row)."""
    if not 2 <= arity <= 255:
        raise ValueError("a run has 2 to 255 members")
    spark = leaf_rows.sparkSession
    importable(spark)
    rows = written(leaf_rows, "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).rdd
    places, trees, most = _places(ordered.mapPartitionsWithIndex(_report).collect())
    if not trees:
        return spark.createDataFrame([], PROOFS)
    parts = shuffle_partitions(spark)
    runs = _run_table(spark, ordered.mapPartitionsWithIndex(_numbered(places, arity)), parts, arity)
    levels = _climbed(runs.select("tree", "at", "size", "hash"), -(-most // arity), arity, max(1, parts // arity))

    subroots = levels[0].where("size = 1")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("size = 1"))
    subroots = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("size"), "hash"), "subroots")
    top = _climbed(subroots, trees, arity, max(1, parts // arity))
    root = top[-1].first()["hash"]
    # A row for each source: its subroot, and the path above it.
    nothing = spark.createDataFrame([(0, "", b"")], "tree long, subroot string, path binary")
    above = _handed_down(top, nothing, arity, max(1, parts // arity)).select("at", "path").join(subroots.select("at", F.col("hash").alias("subroot")), "at")
    paths = _handed_down(levels, above.withColumnRenamed("at", "tree"), arity, max(1, parts // arity))
    return spark.createDataFrame(runs.join(paths, ["tree", "at"]).rdd.mapPartitions(_verified(root)), PROOFS, verifySchema=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(leaves(docs, where=tampered(F.col("doc_id")), change={"text": lower_ascii(F.col("text"))}))


def _sql(levels: int = 6, top: int = 4) -> str:
    """The tree unrolled: trees of up to 16 ** ``levels`` leaves, up to 16 ** ``top`` sources."""
    part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        # crc32 of the decimals of an id, bit by bit.
        "ids as (select distinct doc_id::varchar as s from documents where doc_id is not null)",
        "crc as (select s, 0 as k, 4294967295::bigint as c from ids union all select s, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end "
        "from (select s, k, case when k % 8 = 0 then xor(c, ord(s[k // 8 + 1])::bigint) else c end as x from crc where k < 8 * len(s)))",
        "tam as (select s from crc where k = 8 * len(s) and xor(c, 4294967295) % 5 = 0)",
        f"lf as (select doc_id, source, {leaf('text')} as leaf, case when doc_id::varchar in (select s from tam) then {leaf(lower)} else {leaf('text')} end as given from documents)",
        "l0 as (select doc_id, leaf, given, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, leaf as h from lf)",
        "n0 as (select tree, pos, h from l0)",
    ]
    for k in range(levels):
        out.append(f"r{k} as (select tree, pos // 16 as up, list(h order by pos) as run, any_value(n) as n from (select *, count(*) over (partition by tree) as n from n{k}) group by tree, pos // 16)")
        out.append(f"n{k + 1} as (select tree, up as pos, case when n = 1 then run[1] else sha256(array_to_string(run, '')) end as h from r{k})")
    out.append(f"m0 as (select tree as pos, h from n{levels})")
    for k in range(top):
        out.append(f"q{k} as (select pos // 16 as up, list(h order by pos) as run, any_value(n) as n from (select *, count(*) over () as n from m{k}) group by pos // 16)")
        out.append(f"m{k + 1} as (select up as pos, case when n = 1 then run[1] else sha256(array_to_string(run, '')) end as h from q{k})")
    out.append("f0 as (select doc_id, leaf, tree, pos, tree as place, given as g, '' as proof from l0)")
    step = "case when n = 1 then g else sha256(array_to_string(list_transform(run, lambda v, j: case when j = {p} % 16 + 1 then g else v end), '')) end"
    rest = "proof || case when n = 1 then '' else array_to_string(list_filter(run, lambda v, j: j <> {p} % 16 + 1), '') end"
    for k in range(levels):
        out.append(f"f{k + 1} as (select doc_id, leaf, f.tree, f.pos // 16 as pos, place, {step.format(p='f.pos')} as g, {rest.format(p='f.pos')} as proof from f{k} f join r{k} r on r.tree = f.tree and r.up = f.pos // 16)")
    for k in range(levels, levels + top):
        out.append(f"f{k + 1} as (select doc_id, leaf, tree, f.pos, place // 16 as place, {step.format(p='place')} as g, {rest.format(p='place')} as proof from f{k} f join q{k - levels} on up = place // 16)")
    return (
        "with recursive " + ",\n".join(out) + f"\nselect doc_id, leaf, m.h as subroot, t.h as root, sha256(proof) as proof_sha256, g as folded_root, g = t.h as verified\n"
        f"from f{levels + top} f join m0 m on m.pos = f.tree, m{top} t"
    )


OP12_SQL = _sql()

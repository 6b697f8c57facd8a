"""Line dedup: overlapping windows of three lines.

Lines are what stands between newlines.  Every three consecutive lines of a text are a window.  Of equal windows, over
all documents and inside one, the first by (doc_id, line) stays; the three lines of every later one are
removed, where covered lines are merged, so overlapping windows remove a line once.  Windows are judged on the input.

Texts of fewer than three lines and null texts stay as they are.  A null id counts as larger than every id, and each
row without one is a document of its own.  Rows of one id and one text are taken for copies of one document: their equal windows at
equal lines do not remove each other.  Texts that share an id are told apart, and ordered, by a hash.
Other columns are kept, ``n_chars`` is recounted where there is one; the two added ones take the names given, and replace columns of
these names.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import importable, written

LINES = 3
LAST = 2**63 - 1
ID, KEY, AT = "__lines_id", "__lines_key", "__lines_at"  # names no other column has


def _windows(batches):
    for b in batches:
        data, offsets = T.buffer(b.column("text"))
        ids, keys = b.column("id").to_numpy(), b.column("key").to_numpy()
        for i, j in T.groups(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            breaks = np.flatnonzero(d == 0x0A)
            # A line starts at each text's first byte and after each newline; it ends at a newline or the text's end.
            starts = np.concatenate((o[:-1], breaks + 1))
            ends = np.concatenate((breaks, o[1:]))
            doc = np.concatenate((np.arange(j - i), np.searchsorted(o, breaks, "right") - 1))
            order = np.lexsort((starts, doc))
            starts, doc_s = starts[order], doc[order]
            doc_e = np.concatenate((np.searchsorted(o, breaks, "right") - 1, np.arange(j - i)))
            ends = ends[np.lexsort((ends, doc_e))]
            h = T.word_hashes(d, starts, ends)
            first = np.searchsorted(doc_s, np.arange(j - i + 1))
            m = len(h) - LINES + 1
            if m <= 0:
                continue
            keep = np.flatnonzero(doc_s[:m] == doc_s[LINES - 1 :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.ngrams(h, LINES).view(np.int64)[keep]), pa.array(T.ngrams(h, LINES, 7).view(np.int64)[keep]), pa.array(ids[i:j][doc_s[keep]]), pa.array(keys[i:j][doc_s[keep]]), pa.array((keep - first[doc_s[keep]]).astype(np.int32))],
                names=["w1", "w2", "id", "key", "line"],
            )


def _strip(kinds: list[str], names: tuple[str, str]):
    def run(batches):
        for b in batches:
            texts, at = b.column("text").to_pylist(), b.column(AT)
            n, gone = [], []
            for k, t in enumerate(texts):
                p = at[k].as_py() if at[k].is_valid else None
                if t is None:
                    n.append(0)
                    gone.append(0)
                    continue
                if not p:
                    n.append(t.count("\n") + 1)
                    gone.append(0)
                    continue
                lines = t.split("\n")
                covered = np.zeros(len(lines) + LINES, bool)
                for s in range(LINES):
                    covered[np.array(p) + s] = True
                covered = covered[: len(lines)]
                n.append(len(lines))
                gone.append(int(covered.sum()))
                texts[k] = "\n".join(x for x, c in zip(lines, covered, strict=True) if not c)
            out = {c: b.column(c) for c in kinds} | {"text": pa.array(texts, b.schema.field("text").type)}
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*out, *names])

    return run


def remove_repeated_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Every row of ``docs``, its text without later repeats; adds how many lines it had and how many went, under ``names``."""
    importable(docs.sparkSession)
    docs = docs.drop(*names)
    kinds = docs.columns
    # Rows without an id are numbered, in a written table, so that a row has the same number in both passes.
    unnamed = written(docs.where("doc_id is null").withColumn(KEY, F.monotonically_increasing_id()), "unnamed")
    rows = docs.where("doc_id is not null").withColumn(KEY, F.xxhash64("text")).unionByName(unnamed)
    rows = rows.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    # Only texts with two newlines at least have a window.
    w = rows.where("instr(text, '\n') > 0").select(F.col(ID).alias("id"), F.col(KEY).alias("key"), "text").mapInArrow(_windows, "w1 long, w2 long, id long, key long, line int")
    place = F.struct("id", "key", "line")
    first = w.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(first, ["w1", "w2"]).where(place > F.col("first"))
    covered = later.groupBy("id", "key").agg(F.array_sort(F.collect_set("line")).alias(AT))
    joined = rows.join(covered.withColumnsRenamed({"id": ID, "key": KEY}), [ID, KEY], "left").drop(ID, KEY)
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    out = joined.mapInArrow(_strip(kinds, names), f"{fields}, `{names[0]}` long, `{names[1]}` long")
    if "n_chars" in kinds:
        out = out.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as p
  from documents where text is not null),
windows as (
  select doc_id, p, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c
  from lines window d as (partition by doc_id order by p)),
numbered as (
  select doc_id, p, row_number() over (partition by a, b, c order by doc_id, p) as k
  from windows where c is not null),
covered as (
  select distinct doc_id, p + s as p from numbered, (values (0), (1), (2)) v(s) where k > 1),
kept as (
  select l.doc_id, count(*) as n_lines, count(c.p) as n_removed,
         coalesce(string_agg(case when c.p is null then l.line end, chr(10) order by l.p), '') as kept
  from lines l left join covered c on c.doc_id = l.doc_id and c.p = l.p group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       case when d.text is not null then sha256(kept) end as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""

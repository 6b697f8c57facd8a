"""Fill-in-middle transformation: SQL of DuckDB inside mapInArrow.

Each slice of an Arrow batch is registered as a table; ``regexp_extract_all`` cuts its texts into units (a run of separators with the word after it, or trailing
separators), ``sha256`` of seed and id draws the form and the two cuts, and ``list_slice`` with ``array_to_string`` writes prefix, middle and suffix.  The answer leaves
as Arrow; no row is touched in Python.  Slices hold at most ``SLICE`` bytes of text (a longer text is a slice of its own), so
a task's memory is bounded by its longest text.

Form: plain where the text is empty, holds a sentinel, or isn't drawn; else spm or psm.  A null text counts as empty, a null id as an empty string.  Rows that share an id
are cut by the same draws, each by its own number of units; an empty table gives no rows.  Other columns are kept; those named like
the five added ones are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import importable

SLICE = 1 << 22
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
TYPES = {"long": pa.int64(), "string": pa.string()}

CUT = r"""
with cut as (
  select nth, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, sha256($seed || ':' || id) as drawn
  from slice),
draws as (
  select nth, text, units, len(units) as n, [('0x' || drawn[8 * k + 1 : 8 * k + 8])::ubigint for k in [0, 1, 2, 3]] as h from cut),
forms as (
  select nth, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1))::bigint as a, greatest(h[1] % (n + 1), h[2] % (n + 1))::bigint as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= $rate then 'plain'
              when h[4] % 100 < $spm then 'spm' else 'psm' end as form
  from draws),
parts as (
  select nth, text, n, form, case when form <> 'plain' then array_to_string(list_slice(units, 1, a), '') end as prefix,
         case when form <> 'plain' then array_to_string(list_slice(units, a + 1, b), '') end as middle,
         case when form <> 'plain' then array_to_string(list_slice(units, b + 1, n), '') end as suffix
  from forms)
select nth, n::bigint as n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars,
       case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                 else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output
from parts
"""

# A sentinel stands at the start; the next two are found in turn, which is exact because the text holds none.
JOIN = r"""
with second as (
  select nth, form, output, case form when 'psm' then strpos(output, '<S>') when 'spm' then strpos(output, '<P>') end as p from slice),
third as (select nth, form, output, p, case when form <> 'plain' then p + 2 + strpos(substr(output, p + 3), '<M>') end as q from second),
parts as (
  select nth, form, output, case when form <> 'plain' then substr(output, 4, p - 4) end as one, case when form <> 'plain' then substr(output, p + 3, q - p - 3) end as two,
         case when form <> 'plain' then substr(output, q + 3) end as middle from third)
select nth, case form when 'plain' then output when 'psm' then one || middle || two else two || middle || one end as restored from parts
"""


def _asked(sql: str, given: dict[str, str], added: dict[str, str], values: dict):
    """A function for mapInArrow: ``sql`` over each slice of the columns ``given`` (name in the slice to column), its answer beside the other columns."""

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for b in batches:
            _, offsets = T.buffer(b.column(next(iter(given.values()))))
            for i, j in T.groups(offsets, SLICE):
                rows = b.slice(i, j - i)
                held = pa.table({"nth": pa.array(range(j - i), pa.int64())} | {n: rows.column(c) for n, c in given.items()})
                con.register("slice", held)
                answer = con.sql(sql, params=values or None).to_arrow_table().sort_by("nth")
                con.unregister("slice")
                got = {c: answer.column(c).cast(TYPES[t]).combine_chunks() for c, t in added.items()}
                out = {c: rows.column(c) for c in rows.schema.names if c not in added and not c.startswith("__fim_")} | got
                yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x for x in out.values()], names=list(out))

    return run


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """Every row of ``docs`` with its number of units, form, lengths of prefix and middle in characters, and the transformed text.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of those with the suffix first.
    """
    importable(docs.sparkSession)
    docs = docs.drop(*ADDED)
    fields = ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], *[f"`{n}` {t}" for n, t in ADDED.items()]])
    rows = docs.withColumns({"__fim_text": F.coalesce("text", F.lit("")), "__fim_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    return rows.mapInArrow(_asked(CUT, {"text": "__fim_text", "id": "__fim_id"}, ADDED, {"seed": str(seed), "rate": rate, "spm": spm}), fields)


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` with the text that its output and form stand for, as ``restored``."""
    importable(transformed.sparkSession)
    docs = transformed.drop("restored")
    fields = ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], "restored string"])
    return docs.mapInArrow(_asked(JOIN, {"output": "output", "form": "form"}, {"restored": "string"}, {}), fields)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as x from documents),
u as (
  select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
         ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
f as (
  select doc_id, t, w, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
         case when t = '' or t like '%<P>%' or t like '%<S>%' or t like '%<M>%' or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
c as (select doc_id, t, n, form, array_to_string(w[1:a], '') as p, array_to_string(w[a+1:b], '') as m, array_to_string(w[b+1:], '') as s from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from c
"""

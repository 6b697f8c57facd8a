"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

1. Windows.  A window without any shingle (five lower-cased words) of the benchmark has similarity 0, so only windows around
   benchmark shingles are fingerprinted: a shingle at word p of a text that stands at word q of an item gives the window of
   that item's length at p - q, moved inside the text where it juts out; a text shorter than the item is the window itself.
   Which item gave the window is then forgotten.
2. Windows and items get 64-bit SimHash fingerprints of their weighted shingles, cut into BLOCKS blocks of 12 or 13 bits.
   Within RADIUS = BLOCKS * (ERRORS + 1) - 1 differing bits some block differs in at most ERRORS bits.  All
   variants of an item's blocks within ERRORS bits are index keys, so a window, whose number grows with the corpus, asks
   with BLOCKS keys only.  A key carries the window's length too; so every pair within the radius is found, whatever item gave the window.
3. Pairs within the radius are verified: weighted Jaccard similarity of the shingle multisets, at least ``least``.

A shingle weighs ln(1 + items / items with it).  The verdict depends on the text alone, so texts go by two hashes of theirs (128
bits), copies are examined once, and rows without an id or with a repeated one are judged each by its own text.  Texts are
joined once, to the windows of those that have any.  DataFrame functions only.  The index of item shingles is
broadcast only while the benchmark has at most ``BROADCAST_ITEMS`` items of bounded length, else joined by shuffle.

Items of fewer than five words and null items take no part; each text of a repeated item_id is an item.  Null, blank and texts of fewer
than five words match nothing; repeated rows give one row for each distinct (doc_id, text); empty tables give no rows.  Ties of similarity
go to the smaller start.  Other columns are not read; ``clean`` keeps them.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

WORDS = 5
BLOCKS, ERRORS = 5, 4
RADIUS = BLOCKS * (ERRORS + 1) - 1
BROADCAST_ITEMS = 20_000
BROADCAST_WORDS = 1_000_000
#: First bit and width of each block of a fingerprint.
CUTS = [(13 * b, min(13, 64 - 13 * b)) for b in range(BLOCKS)]
TEXT = ["__text_1", "__text_2"]  # two hashes of a text, under names no other column has
WINDOW = [*TEXT, "start", "n_words", "whole"]
SEPARATORS = " \\t\\n\\u000b\\u000c\\r"


def words(text: str) -> Column:
    """Lower-cased words of a text column (a blank text has one empty word)."""
    return F.expr(f"split(trim(BOTH '{SEPARATORS}' FROM lower({text})), '[{SEPARATORS}]+')")


def shingles(words_col: Column) -> Column:
    """64-bit hashes of every five consecutive words."""
    w = words_col
    return F.when(
        F.size(w) >= WORDS,
        F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WORDS)])),
    ).otherwise(F.array().cast("array<bigint>"))


def text_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the hashes that stand for their texts."""
    return docs.withColumns({TEXT[0]: F.xxhash64("text"), TEXT[1]: F.xxhash64("text", F.lit(1))})


def _bit(b: int) -> int:
    return 1 << b if b < 63 else -(1 << 63)


def _fingerprint(weight: str) -> Column:
    """SimHash of a group's shingles ``h``: bit b is set where the weights of hashes with it outweigh those without."""
    return F.expr(" | ".join(f"if(sum(if(h & {_bit(b)}L <> 0, {weight}, -({weight}))) > 0, {_bit(b)}L, 0L)" for b in range(64)).replace(f"{-(1 << 63)}L", "shiftleft(1L, 63)"))


def _block(fp: str | Column, b: int) -> Column:
    at, width = CUTS[b]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _index(fps: DataFrame) -> DataFrame:
    """(block, value) of every block of ``fp`` and all its variants of at most ERRORS flipped bits."""
    out = []
    for b, (_, width) in enumerate(CUTS):
        masks = F.explode(F.expr(f"filter(sequence(0, {(1 << width) - 1}), m -> bit_count(m) <= {ERRORS})"))
        out.append(fps.withColumn("mask", masks).select("*", F.lit(b).alias("block"), _block("fp", b).bitwiseXOR(F.col("mask")).alias("value")).drop("mask"))
    return reduce(DataFrame.unionByName, out)


def _verdicts(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(hashes of a text, item_id, start, n_words, distance, similarity): the best window of each text and item it holds."""
    item = items.where("text is not null and item_id is not null").select("item_id", words("text").alias("w")).distinct().where(F.size("w") >= WORDS)
    item = written(item.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("w").alias("m_words"), shingles(F.col("w")).alias("s")), "items")
    total, longest = item.agg(F.count("*"), F.max("m_words")).first()
    small = total <= BROADCAST_ITEMS and total * (longest or 0) <= BROADCAST_WORDS
    hint = F.broadcast if small else (lambda df: df)
    at = item.select("item", "m_words", F.posexplode("s").alias("q", "h"))
    weight = at.groupBy("h").agg(F.log(1 + F.lit(float(total)) / F.countDistinct("item")).alias("weight"))
    most = F.log(F.lit(1.0 + total))
    theirs = written(at.groupBy("item", "m_words", "h").agg(F.count("*").alias("tf_item")).join(hint(weight), "h"), "item_shingles")

    docs = text_key(docs.where("text is not null").select("text"))
    # The outer forms keep the optimiser from testing the size of an array before it is made, which would split texts once more for every word.
    text = docs.select(*TEXT, words("text").alias("w")).select(*TEXT, F.size("w").alias("size"), shingles(F.col("w")).alias("s"))
    seeds = text.select(*TEXT, "size", F.posexplode_outer("s").alias("p", "h"))
    # Only lengths and positions of the benchmark's shingles are needed here; many hits give one window, and copies of a text the same ones.
    seeds = seeds.join(hint(at.select("h", "q", "m_words").distinct()), "h")
    seeds = seeds.select(*TEXT, F.expr("greatest(0, least(p - q, size - m_words))").alias("start"), F.least("m_words", "size").alias("n_words"), (F.col("m_words") >= F.col("size")).alias("whole"))
    windows = written(seeds.distinct(), "windows")

    held = docs.join(windows.select(*TEXT).distinct(), TEXT, "left_semi").groupBy(*TEXT).agg(F.first("text").alias("text"))
    held = windows.join(held.select(*TEXT, words("text").alias("w")), TEXT)
    held = held.select(*WINDOW, F.slice("w", F.col("start") + 1, F.col("n_words")).alias("w")).select(*WINDOW, shingles(F.col("w")).alias("s"))
    own = held.select(*WINDOW, F.explode_outer("s").alias("h")).groupBy(*WINDOW, "h").agg(F.count("*").alias("tf"))
    own = written(own.join(hint(weight), "h", "left").withColumn("weight", F.coalesce("weight", most)), "window_shingles")

    asked = written(own.groupBy(*WINDOW).agg(_fingerprint("tf * weight").alias("window_fp"), F.sum(F.col("tf") * F.col("weight")).alias("own_sum")), "window_prints")
    known = written(theirs.groupBy("item", "m_words").agg(_fingerprint("tf_item * weight").alias("fp"), F.sum(F.col("tf_item") * F.col("weight")).alias("item_sum")), "item_prints")
    # A text that is shorter than an item may still hold most of its weight: it asks for every length its weights can reach.
    reach = F.least(F.lit(longest or 0), F.ceil((F.col("n_words") - WORDS + 1) * F.lit(log(1.0 + total) / (log(2.0) * least))).cast("int") + WORDS)
    lengths = F.when(F.col("whole"), F.sequence("n_words", F.greatest("n_words", reach))).otherwise(F.array("n_words"))
    asked = asked.withColumn("m_words", F.explode(lengths)).withColumn("cut", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block("window_fp", b).alias("value")) for b in range(BLOCKS)])))
    asked = asked.select("*", "cut.block", "cut.value").drop("cut")
    differ = F.col("window_fp").bitwiseXOR(F.col("fp"))
    pairs = asked.join(_index(known), ["block", "value", "m_words"]).where(F.bit_count(differ) <= RADIUS)
    # A pair that meets in several blocks is kept at the first of them.
    first = reduce(lambda a, b: a & b, [(F.col("block") <= b) | (F.bit_count(_block(differ, b)) > ERRORS) for b in range(BLOCKS)])
    pairs = pairs.where(first).select(*WINDOW, "item", "own_sum", "item_sum", F.bit_count(differ).cast("int").alias("distance"))

    both = pairs.join(own.drop("weight"), WINDOW).join(theirs.select("item", "h", "tf_item", "weight"), ["item", "h"])
    both = both.groupBy(*WINDOW, "item", "own_sum", "item_sum", "distance").agg(F.sum(F.least("tf", "tf_item") * F.col("weight")).alias("both"))
    scored = both.withColumn("similarity", F.col("both") / (F.col("own_sum") + F.col("item_sum") - F.col("both"))).where(F.col("similarity") >= least - 1e-9)
    best = scored.join(item.select("item", "item_id"), "item").groupBy(*TEXT, "item_id").agg(F.max(F.struct(F.round("similarity", 6).alias("similarity"), (-F.col("start")).alias("start"), "n_words", "distance")).alias("b"))
    return written(best.select(*TEXT, "item_id", (-F.col("b.start")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity")), "verdicts")


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): the best window of each distinct (doc_id, text) and each item it holds."""
    found = _verdicts(docs, items, least)
    ids = text_key(docs.where("text is not null").select("doc_id", "text")).drop("text").join(found.select(*TEXT).distinct(), TEXT, "left_semi").distinct()
    return ids.join(found, TEXT).drop(*TEXT)


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no item; rows of null text stay."""
    found = _verdicts(docs, items, least).select(*TEXT).distinct()
    return text_key(docs).join(found, TEXT, "left_anti").drop(*TEXT)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("start").cast("int").alias("start"), "n_words", "similarity")


OP3_SQL = r"""
with words as (
  select doc_id, string_split_regex(trim(lower(text), e' \t\n\x0b\f\r'), '[ \t\n\x0b\f\r]+') as w from documents where text is not null),
iw as (select item_id, string_split_regex(trim(lower(text), e' \t\n\x0b\f\r'), '[ \t\n\x0b\f\r]+') as w from benchmark where text is not null),
items as (select item_id, len(w) as n, w from iw where len(w) >= 5),
ish as (select item_id, n, i - 1 as q, array_to_string(list_slice(w, i, i + 4), ' ') as h from (select item_id, n, w, unnest(range(1, n - 3)) as i from items)),
weights as (select h, ln(1 + (select count(*) from items) / count(distinct item_id)) as weight from ish group by h),
dsh as (select doc_id, i - 1 as p, array_to_string(list_slice(w, i, i + 4), ' ') as h from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
windows as (
  select distinct d.doc_id, greatest(0, least(d.p - s.q, len(x.w) - s.n)) as start, least(s.n, len(x.w)) as n, s.n >= len(x.w) as whole
  from dsh d join ish s on s.h = d.h join words x on x.doc_id = d.doc_id),
own as (
  select v.doc_id, v.start, v.n, v.whole, d.h, count(*) as tf, any_value(coalesce(g.weight, ln(1 + (select count(*) from items)))) as weight
  from windows v join dsh d on d.doc_id = v.doc_id and d.p >= v.start and d.p <= v.start + v.n - 5 left join weights g on g.h = d.h
  group by v.doc_id, v.start, v.n, v.whole, d.h),
own_size as (select doc_id, start, n, whole, sum(tf * weight) as own_sum from own group by doc_id, start, n, whole),
theirs as (select item_id, n as m, h, count(*) as tf from ish group by item_id, n, h),
item_size as (select item_id, sum(tf * weight) as item_sum from theirs join weights using (h) group by item_id),
both_ as (
  select o.doc_id, o.start, o.n, o.whole, t.item_id, sum(least(o.tf, t.tf) * o.weight) as both_sum
  from own o join theirs t on t.h = o.h and (t.m = o.n or (o.whole and o.n < t.m)) group by o.doc_id, o.start, o.n, o.whole, t.item_id),
final as (
  select b.doc_id, b.item_id, b.start, b.n, both_sum / (own_sum + item_sum - both_sum) as sim
  from both_ b join own_size using (doc_id, start, n, whole) join item_size using (item_id)),
ranked as (select *, row_number() over (partition by doc_id, item_id order by round(sim, 6) desc, start, n desc) as k from final where sim >= 0.8 - 1e-9)
select doc_id, item_id, start::int as start, n::int as n_words, round(sim, 6) as similarity from ranked where k = 1
"""

"""Label volumes, raw volumes and tile measurements derived from the relational test tables.

They are synthetic: spheres rasterised from ``supplier`` and ``part`` rows on a 48-voxel grid for each roi, and tile
measurements from ``lineitem``.  Nothing here stands for microscopy data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import importable

SIDE = 48
FULL = 46  # voxels from here on along x are padding
LINE = ("roi", "z", "y")
SPHERES = 250  # a task makes their voxels: about 100,000 labelled ones, a million raw ones


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spheres: DataFrame) -> int:
    """How many tasks make the voxels of spheres: one for each ``SPHERES`` of them, however many files they lie in."""
    return max(1, -(-spheres.count() // SPHERES))


def spheres_to_voxels(spheres: DataFrame, side: int = SIDE, by: tuple[str, ...] = ("roi",)) -> DataFrame:
    """(roi, z, y, x, label, d2) of integer spheres (roi, id, cz, cy, cx, r, label): the nearest centre, then the smallest id, wins.

    Each sphere makes only the voxels of its own bounding box.  A few rows make many voxels, so spheres are dealt out first, by roi: what then compares, counts or cuts the voxels of a roi has them in one task and shuffles none.
    With ``by`` of more columns the spheres' lines along x are shuffled by those, and turn into voxels in the task that compares them.
    """
    n = tasks(spheres)
    reach = lambda a: F.explode(F.sequence(F.greatest(F.lit(0), F.col(f"c{a}") - F.col("r")), F.least(F.lit(side - 1), F.col(f"c{a}") + F.col("r"))))
    d2 = lambda axes: sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in axes)
    lines = spheres.repartition(n, "roi" if by == ("roi",) else "id").withColumn("z", reach("z")).withColumn("y", reach("y")).where(d2("zy") <= F.col("r") * F.col("r"))
    lines = lines if by == ("roi",) else lines.repartition(n, *by)
    df = lines.withColumn("x", reach("x")).withColumn("d2", d2("zyx")).where("d2 <= r * r")
    best = df.groupBy(*LINE, "x").agg(F.min(F.struct("d2", "id", "label")).alias("b"))
    return best.select(*LINE, "x", F.col("b.label").alias("label"), F.col("b.d2").alias("d2"), F.col("b.id").alias("id"))


def truth(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("roi",)) -> DataFrame:
    """Ground-truth label voxels with the squared distance to the owning centre; ``by`` as ``spheres_to_voxels`` takes it."""
    s = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey div 25 as roi", "s_suppkey + 1 as id", "(7 * s_suppkey) % 40 + 4 as cz", "(13 * s_suppkey) % 40 + 4 as cy", "(29 * s_suppkey) % 40 + 4 as cx", "3 + s_suppkey % 4 as r", "s_suppkey + 1 as label"
    )
    return spheres_to_voxels(s, by=by).drop("id")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted label voxels: misses, shifts, smaller radii, splits and false positives."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3").selectExpr(
        "s_suppkey div 25 as roi", "s_suppkey + 1 as id", "(7 * s_suppkey) % 40 + 4 as cz", "(13 * s_suppkey) % 40 + 4 as cy", "(29 * s_suppkey) % 40 + 4 + s_suppkey % 3 - 1 as cx",
        "3 + s_suppkey % 4 - if(s_suppkey % 4 = 0, 1, 0) as r", "struct(s_suppkey + 1 as label, s_suppkey as k) as label",
    )
    p = table(spark, sf_dir, "part").where("p_partkey % 100 = 50").selectExpr(
        "p_partkey div 500 as roi", "200000 + p_partkey as id", "(11 * p_partkey) % 40 + 4 as cz", "(17 * p_partkey) % 40 + 4 as cy", "(23 * p_partkey) % 40 + 4 as cx", "3L as r", "struct(200000 + p_partkey as label, cast(null as bigint) as k) as label"
    )
    v = spheres_to_voxels(s.unionByName(p))
    label, k = F.col("label.label"), F.col("label.k")  # no k: a false positive
    split = (k % 10 == 7) & (F.col("z") >= (7 * k) % 40 + 4)
    return v.select("roi", "z", "y", "x", F.when(split, label + 100000).otherwise(label).alias("label"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer intensities of every voxel of every roi; 0 beyond x = 45 (padding)."""
    lines = raw_lines(spark, sf_dir).drop("xs").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))  # exploding the values themselves would make them twice more, to count them
    return lines.select(*LINE, F.col("x").cast("long").alias("x"), F.get("vs", F.col("x")).alias("v"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels of ``raw`` by lines along x, as ``tiles.lines`` has them: (roi, z, y, xs, vs).

    A task makes all lines of its rois from their spheres, which are 25 keys a roi and so bounded; no voxel or line is shuffled, and what then groups or cuts a roi's voxels needs no shuffle either.
    """
    suppliers, long = table(spark, sf_dir, "supplier"), lambda v: F.lit(v).cast("long")
    axis = F.sequence(long(0), long(SIDE - 1))
    spheres = suppliers.selectExpr("s_suppkey div 25 as roi", "struct((7 * s_suppkey) % 40 + 4 as cz, (13 * s_suppkey) % 40 + 4 as cy, (29 * s_suppkey) % 40 + 4 as cx, 3 + s_suppkey % 4 as r) as s")
    rois = spheres.repartition(tasks(suppliers), "roi").groupBy("roi").agg(F.collect_set("s").alias("near"))  # a sphere follows from its key
    lines = rois.withColumn("z", F.explode(axis)).withColumn("near", F.filter("near", lambda s: F.abs(F.col("z") - s["cz"]) <= s["r"])).withColumn("y", F.explode(axis))
    # A sphere on a line: its voxels first .. last, and what it adds at its middle.
    off = lambda s: (F.col("z") - s["cz"]) * (F.col("z") - s["cz"]) + (F.col("y") - s["cy"]) * (F.col("y") - s["cy"])
    half = lambda s: F.floor(F.sqrt(s["r"] * s["r"] - off(s)))
    on = F.transform(F.filter("near", lambda s: off(s) <= s["r"] * s["r"]), lambda s: F.struct(F.greatest(long(0), s["cx"] - half(s)).alias("first"), F.least(long(SIDE - 1), s["cx"] + half(s)).alias("last"), s["cx"].alias("cx"), (1500 - 40 * off(s)).alias("top")))
    lines = lines.select(*LINE, axis.alias("xs"), F.filter(on, lambda s: s["first"] <= s["last"]).alias("near"), (F.col("z") * 7919 + F.col("y") * 104729 + F.col("roi") * 15485863).alias("start")).withColumn("noise", _noise(F.col("start")))
    nothing = F.array_repeat(long(0), SIDE)
    part = lambda acc, a, n: F.slice(acc, a.cast("int") + 1, n.cast("int"))
    # The nearest centre wins, which adds the most.
    over = lambda acc, s: F.concat(part(acc, F.lit(0), s["first"]), F.transform(part(acc, s["first"], s["last"] - s["first"] + 1), lambda v, i: F.greatest(v, s["top"] - 40 * (i + s["first"] - s["cx"]) * (i + s["first"] - s["cx"]))), part(acc, s["last"] + 1, SIDE - 1 - s["last"]))
    added = F.zip_with("noise", F.aggregate("near", nothing, over), lambda v, more: v + more)
    lit = F.concat(F.slice(added, 1, FULL), F.array_repeat(long(0), SIDE - FULL))
    return lines.select(*LINE, "xs", F.when(F.size("near") == 0, F.col("noise")).otherwise(lit).alias("vs"))


def _noise(start: Column) -> Column:
    """(start + x * 1299709) % 601 + 3000 for x below ``FULL``, then 0: a run of one table, as x * 1299709 takes all values modulo 601."""
    step, zeros = 1299709 % 601, F.array_repeat(F.lit(0).cast("long"), SIDE - FULL)
    table_ = F.array(*[F.lit(i * step % 601 + 3000).cast("long") for i in range(601 + FULL)])
    run = F.slice(table_, ((start % 601) * pow(step, -1, 601) % 601 + 1).cast("int"), FULL)
    slow = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FULL - 1).cast("long")), lambda x: (start + x * 1299709) % 601 + 3000)  # a negative remainder
    return F.concat(F.when(start >= 0, run).otherwise(slow), zeros)


def tile_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """384 tiles with quality measurements from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as roi", "cast(((l_linenumber - 1) % 2) * 128 as bigint) as z", "(l_suppkey % 8) * 128 as y", "(l_partkey % 8) * 128 as x", "l_quantity", "l_extendedprice", "l_partkey"
    )
    g = li.groupBy("roi", "z", "y", "x").agg(
        F.count("*").alias("n"), F.median("l_extendedprice").alias("price"), F.avg(F.when(F.col("l_quantity") > 45, 1e0).otherwise(0e0)).alias("big"),
        F.avg(F.when(F.col("l_quantity") < 5, 1e0).otherwise(0e0)).alias("small"), F.countDistinct("l_partkey").alias("parts"),
    )
    g = g.withColumn("q", F.expr("(z div 128) * 64 + (y div 128) * 8 + (x div 128)")).withColumn("has_output", F.expr("q % 17 <> 5")).withColumn("usable", F.expr("q % 23 <> 7"))
    none = F.expr("not has_output or q % 31 = 9")
    return g.select(
        tile_name(F.col("roi"), F.col("z"), F.col("y"), F.col("x")).alias("chunk"), "roi", "z", "y", "x", "q", "has_output", "usable",
        F.expr("case when not has_output then null when q % 31 = 9 then 0L else n end").alias("n_nuclei"),
        F.expr("case when not has_output then null when q % 31 = 9 then 0e0 else cast(n as double) * if(q % 29 = 11, 5e0, 1e0) end").alias("nuclei_per_mvox"),
        F.when(none, None).otherwise(F.expr("price * if(q % 37 = 13, 6e0, 1e0)")).alias("median_vol_vox"),
        F.when(none, None).otherwise(F.expr("big + if(q % 41 = 17, 6e-1, 0e0)")).alias("oversized_frac"),
        F.when(none, None).otherwise(F.expr("small + if(q % 43 = 19, 6e-1, 0e0)")).alias("tiny_frac"),
        F.when(none, None).otherwise(F.expr("cast(n as double) / parts + if(q % 59 = 31, 2e0, 0e0)")).alias("ratio_to_blobs"),
        F.expr("if(q % 53 = 20, 12e-1, 3e-1)").alias("exemplar_distance"), F.lit(4.0).alias("contrast_p99"),
    )


def tile_name(roi: Column, z: Column, y: Column, x: Column) -> Column:
    return F.concat(roi, *[p for a, c in (("z", z), ("y", y), ("x", x)) for p in (F.lit(f"_{a}"), F.lpad(c.cast("string"), 6, "0"))])


def exemplars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(exemplars, queries): the lowest vec_id of each label, and every other row; three descriptors each."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.abs(F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(3)])
    first = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = e.withColumn("k", first)
    return e.where("k = 1").drop("k"), e.where("k > 1").drop("k")


# The same fixtures as DuckDB common table expressions, for the oracle.
SQL = {
    "ax": "ax as (select range as i from range(48))",
    "gt": """sph as (select s_suppkey // 25 as roi, s_suppkey + 1 as label, (7*s_suppkey)%40+4 as cz, (13*s_suppkey)%40+4 as cy, (29*s_suppkey)%40+4 as cx, 3 + s_suppkey%4 as r from supplier),
gtd as (select roi, z.i as z, y.i as y, x.i as x, label, (z.i-cz)*(z.i-cz)+(y.i-cy)*(y.i-cy)+(x.i-cx)*(x.i-cx) as d2 from sph join ax z on z.i between cz-r and cz+r join ax y on y.i between cy-r and cy+r join ax x on x.i between cx-r and cx+r
  where (z.i-cz)*(z.i-cz)+(y.i-cy)*(y.i-cy)+(x.i-cx)*(x.i-cx) <= r*r),
gt as (select roi, z, y, x, label, d2 from gtd qualify row_number() over (partition by roi, z, y, x order by d2, label) = 1)""",
    "pred": """psph as (select s_suppkey // 25 as roi, s_suppkey + 1 as id, (7*s_suppkey)%40+4 as cz, (13*s_suppkey)%40+4 as cy, (29*s_suppkey)%40+4 + s_suppkey%3 - 1 as cx, 3 + s_suppkey%4 - (case when s_suppkey%4=0 then 1 else 0 end) as r, s_suppkey as k from supplier where s_suppkey%10 <> 3
  union all select p_partkey // 500, 200000 + p_partkey, (11*p_partkey)%40+4, (17*p_partkey)%40+4, (23*p_partkey)%40+4, 3, null from part where p_partkey%100 = 50),
pd as (select roi, z.i as z, y.i as y, x.i as x, id + (case when k is not null and k%10=7 and z.i >= cz then 100000 else 0 end) as label, id, (z.i-cz)*(z.i-cz)+(y.i-cy)*(y.i-cy)+(x.i-cx)*(x.i-cx) as d2
  from psph join ax z on z.i between cz-r and cz+r join ax y on y.i between cy-r and cy+r join ax x on x.i between cx-r and cx+r where (z.i-cz)*(z.i-cz)+(y.i-cy)*(y.i-cy)+(x.i-cx)*(x.i-cx) <= r*r),
pred as (select roi, z, y, x, label from pd qualify row_number() over (partition by roi, z, y, x order by d2, id) = 1)""",
    "raw": """rois as (select distinct s_suppkey // 25 as roi from supplier),
raw as (select roi, z, y, x, case when x >= 46 then 0 else 3000 + (7919*z + 104729*y + 1299709*x + 15485863*roi) % 601 + coalesce(1500 - 40*d2, 0) end as v
  from (select roi, z.i as z, y.i as y, x.i as x from rois, ax z, ax y, ax x) left join gt using (roi, z, y, x))""",
    "qc": """li as (select l_returnflag as roi, (((l_linenumber-1)%2)*128)::bigint as z, (l_suppkey%8)*128 as y, (l_partkey%8)*128 as x, l_quantity, l_extendedprice, l_partkey from lineitem),
qg as (select roi, z, y, x, count(*) as n, median(l_extendedprice) as price, avg(case when l_quantity>45 then 1e0 else 0e0 end) as big, avg(case when l_quantity<5 then 1e0 else 0e0 end) as small, count(distinct l_partkey) as parts, (z//128)*64+(y//128)*8+(x//128) as q from li group by roi, z, y, x),
qh as (select *, q%17<>5 as has_output, q%23<>7 as usable, (q%17=5 or q%31=9) as none from qg),
qc as (select roi || '_z' || lpad(z::varchar,6,'0') || '_y' || lpad(y::varchar,6,'0') || '_x' || lpad(x::varchar,6,'0') as chunk, roi, z, y, x, q, has_output, usable,
  case when not has_output then null when q%31=9 then 0 else n end as n_nuclei, case when not has_output then null when q%31=9 then 0e0 else n::double * (case when q%29=11 then 5e0 else 1e0 end) end as nuclei_per_mvox,
  case when none then null else price * (case when q%37=13 then 6e0 else 1e0 end) end as median_vol_vox, case when none then null else big + (case when q%41=17 then 6e-1 else 0e0 end) end as oversized_frac,
  case when none then null else small + (case when q%43=19 then 6e-1 else 0e0 end) end as tiny_frac, case when none then null else n::double / parts + (case when q%59=31 then 2e0 else 0e0 end) end as ratio_to_blobs,
  case when q%53=20 then 12e-1 else 3e-1 end as exemplar_distance, 4e0 as contrast_p99 from qh)""",
    "ex": """emb as (select vec_id, label, abs(embedding[1]::double) as d0, abs(embedding[2]::double) as d1, abs(embedding[3]::double) as d2, row_number() over (partition by label order by vec_id) as k from embeddings),
ex as (select vec_id, label, d0, d1, d2 from emb where k = 1), qu as (select vec_id, label, d0, d1, d2 from emb where k > 1)""",
}


def ctes(*names: str) -> str:
    """``with`` clause of the named fixtures."""
    need = (["ax"] if set(names) & {"gt", "pred", "raw"} else []) + (["gt"] if "raw" in names and "gt" not in names else []) + list(names)
    return "with " + ",\n".join(SQL[n] for n in need)

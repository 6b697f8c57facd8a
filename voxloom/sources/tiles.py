"""Tiles: discovery by name, subsets, even samples, resume, pairing, manifests; files of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_tile_name
from .session import importable


def parsed(names: DataFrame, column: str = "name") -> DataFrame:
    """Names that are tile names, with roi, z, y, x, in that order; others are dropped."""
    return names.withColumns(parse_tile_name(F.col(column))).where("roi is not null").orderBy("roi", "z", "y", "x")


def listed(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """Tile files of a folder (path, length, roi, z, y, x); contents are not read.  A missing folder is empty."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, length long, name string, roi string, z long, y long, x long")
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return parsed(f.withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)))


def subset(tiles: DataFrame, names: list[str] | None = None, roi: str | None = None, box: tuple | None = None) -> DataFrame:
    """By names, by roi (an index into sorted rois, else part of its name), by a half-open box on origins."""
    if names is not None:
        tiles = tiles.where(F.col("chunk").isin(names))
    if roi is not None:
        if roi.isdigit():
            rank = tiles.select("roi").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("roi")) - 1)
            tiles = tiles.join(rank.where(F.col("k") == int(roi)).select("roi"), "roi", "left_semi")
        else:
            tiles = tiles.where(F.col("roi").contains(roi))
    if box is not None:
        for a, (lo, hi) in zip("zyx", box, strict=True):
            tiles = tiles.where((F.col(a) >= lo) & (F.col(a) < hi))
    return tiles


def numbered(tiles: DataFrame, name: str = "k", within: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """Adds each tile's number from 0 in order of (roi, *within): ranks inside rois, shifted by the counts of rois before; only rois are ordered as a whole."""
    counts = tiles.groupBy("roi").agg(F.count("*").alias("n"))
    shift = counts.select(F.col("roi").alias("roi_"), F.coalesce(F.sum("n").over(Window.orderBy("roi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = tiles.withColumn(name, F.row_number().over(Window.partitionBy("roi").orderBy(*within)) - 1)
    return inside.join(shift.hint("merge"), F.col("roi") == F.col("roi_")).withColumn(name, F.col(name) + F.col("before")).drop("roi_", "before")


def every_nth(tiles: DataFrame, n: int) -> DataFrame:
    """n tiles evenly spaced in order: every max(1, count // n)-th, the first n of them."""
    step = max(1, tiles.count() // n)
    return numbered(tiles).where((F.col("k") % step == 0) & (F.col("k") < step * n)).orderBy("k").drop("k")


def spread(tiles: DataFrame, k: int) -> DataFrame:
    """Tiles at k positions spread linearly from first to last, truncated."""
    n = tiles.count()
    at = [int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)] if n else []
    return numbered(tiles).where(F.col("k").isin(at)).drop("k")


def unfinished(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles whose output doesn't exist yet."""
    return tiles.join(done.select("chunk").distinct(), "chunk", "left_anti")


def pairing(left: DataFrame, right: DataFrame, column: str = "name") -> DataFrame:
    """(side, n) of names on the left only, on the right only, on both, by one full outer join."""
    a, b = (d.select(column).distinct().withColumn(s, F.lit(True)) for d, s in ((left, "l"), (right, "r")))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, column, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def check_pairs(left: DataFrame, right: DataFrame, column: str = "name") -> None:
    """Raise unless both sides have the same names; the message lists up to ten of each difference."""
    bad = [r[0] for r in left.join(right, column, "left_anti").orderBy(column).limit(10).select(column).collect()]
    bad2 = [r[0] for r in right.join(left, column, "left_anti").orderBy(column).limit(10).select(column).collect()]
    if bad or bad2:
        raise ValueError(f"unpaired names: left {bad}, right {bad2}")


def manifest_test_set(manifest: DataFrame, available: DataFrame) -> DataFrame:
    """(region, tests, matched) of a JSON manifest {region: {train: [id], test: [id]}} against available ids."""
    m = manifest.select(F.explode(F.from_json("json", "map<string,struct<train:array<bigint>,test:array<bigint>>>")).alias("region", "v")).select("region", F.explode("v.test").alias("id"))
    have = available.select(F.col("id"), F.lit(1).alias("have")).distinct()
    return m.join(have, "id", "left").groupBy("region").agg(F.count("*").alias("tests"), F.count("have").alias("matched"))


def cut(voxels: DataFrame, size: int) -> DataFrame:
    """Voxels with their tile's origin and in-tile coordinates; the last tile's padding is implicit zeros."""
    for a in "zyx":
        voxels = voxels.withColumn(f"t{a}", (F.floor(F.col(a) / size) * size).cast("long")).withColumn(f"l{a}", F.col(a) % size)
    return voxels


def lines(voxels: DataFrame, keys: tuple[str, ...] = ("roi",), size: int | None = None) -> DataFrame:
    """Voxels (keys, z, y, x, v) by lines along x: (keys, z, y, xs, vs), one row for many voxels; with ``size`` a line is cut where tiles of that side meet."""
    piece = [F.floor(F.col("x") / size).alias("_piece")] if size else []
    return voxels.groupBy(*keys, "z", "y", *piece).agg(F.collect_list(F.struct("x", "v")).alias("_run")).select(*keys, "z", "y", F.col("_run.x").alias("xs"), F.col("_run.v").alias("vs"))


def label_type(labels: DataFrame) -> DataFrame:
    """Smallest unsigned type for each roi's labels."""
    m = labels.groupBy("roi").agg(F.max("label").alias("m"))
    return m.select("roi", F.when(F.col("m") <= 255, "uint8").when(F.col("m") <= 65535, "uint16").otherwise("uint32").alias("dtype"))


def split(rows: DataFrame, id_col: str, share: int = 80) -> DataFrame:
    """Adds train: a split by a fixed hash of the id, about ``share`` of 100 rows, the same on every run and every engine."""
    return rows.withColumn("train", F.abs(F.col(id_col) * 2654435761) % 100 < share)


BLOB = T.StructType([T.StructField("roi", T.StringType()), *[T.StructField(a, T.LongType()) for a in ("z", "y", "x", "nz", "ny", "nx")], T.StructField("dtype", T.StringType()), T.StructField("data", T.BinaryType())])


def to_blobs(voxels: DataFrame, size: int) -> DataFrame:
    """Sparse voxels (roi, z, y, x, v) to one dense zero-padded row for each tile: uint16, or a wider type where a tile's values need it."""
    import numpy as np
    import pandas as pd

    importable(voxels.sparkSession)

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        top = g["v"].max()
        a = np.zeros((size, size, size), np.uint64 if top > 0xFFFFFFFF else np.uint32 if top > 0xFFFF else np.uint16)
        a[g["lz"], g["ly"], g["lx"]] = g["v"]
        return pd.DataFrame([[str(key[0]), *map(int, key[1:]), size, size, size, a.dtype.name, a.tobytes()]], columns=BLOB.names)

    return cut(voxels, size).groupBy("roi", "tz", "ty", "tx").applyInPandas(pack, BLOB)


def from_blobs(blobs: DataFrame) -> DataFrame:
    """Dense tile rows back to their non-zero voxels."""
    import numpy as np
    import pyarrow as pa

    importable(blobs.sparkSession)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], r["dtype"]).reshape(r["nz"], r["ny"], r["nx"])
                at = np.nonzero(a)
                yield pa.RecordBatch.from_arrays([pa.array([r["roi"]] * len(at[0]), pa.string()), *[pa.array(i.astype(np.int64) + r[c]) for i, c in zip(at, "zyx", strict=True)], pa.array(a[at].astype(np.int64))], names=["roi", "z", "y", "x", "v"])

    return blobs.mapInArrow(run, "roi string, z long, y long, x long, v long")


def tiff_tiles(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Tile rows of TIFF files that ``listed`` found; needs the optional ``tifffile`` package on the executors."""

    def run(batches):
        import io

        import pyarrow as pa
        import tifffile

        for b in batches:
            for r in b.to_pylist():
                a = tifffile.imread(io.BytesIO(r["content"]))
                yield pa.RecordBatch.from_pylist([{"roi": r["roi"], **{c: r[c] for c in "zyx"}, "nz": a.shape[0], "ny": a.shape[1], "nx": a.shape[2], "dtype": str(a.dtype), "data": a.tobytes()}])

    importable(spark)
    one = files.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).distinct().limit(1000).collect()  # folders, not files
    if len(one) == 1000:
        raise ValueError("tiles lie in 1,000 folders or more: read them by common parent folders")
    if not one:
        return spark.createDataFrame([], BLOB)
    body = spark.read.format("binaryFile").load([r["folder"] for r in one]).select("path", "content")
    return body.join(files.select("path", "roi", "z", "y", "x"), "path").mapInArrow(run, BLOB)

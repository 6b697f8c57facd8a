"""Tile files: round trip, filters that choose files, and writes that leave all or nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tiles import rows
from voxloom.sources import tilefiles, tiles


def test_tile_files(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 900, (8, 8, 12)).astype(float)
    v = rows(spark, a).unionByName(rows(spark, a + 1, 7))
    blobs = tiles.to_blobs(v, 4)
    path = str(tmp_path / "tiles")
    assert tilefiles.read_tiles(spark, path).count() == 0
    tilefiles.write_tiles(blobs, path)
    (tmp_path / "tiles" / "junk.tile").write_bytes(b"junk")
    back = tilefiles.read_tiles(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, blobs.collect()))
    box = back.where("roi = '7' and z >= 4 and x < 8 and dtype = 'uint16'")
    assert {(r["roi"], r["z"], r["x"]) for r in box.collect()} == {("7", 4, 0), ("7", 4, 4)} and box.count() == 4
    # Files outside the box are never opened: a broken one does no harm there.
    broken = next((tmp_path / "tiles" / "roi=0").glob("*_z000000_y000000_x000000.tile"))
    broken.write_bytes(b"x" * 100)
    assert back.where("roi = '7'").count() == 12 and back.where("roi = '0' and x >= 4").count() == 8
    with pytest.raises(Exception, match="isn't a tile file"):
        back.collect()
    assert tilefiles.read_tiles(spark, path, most_bytes=1).where("roi in ('7', '8')").rdd.getNumPartitions() == 12
    tilefiles.write_tiles(blobs.where("roi = '7' and z = 0"), path, "overwrite")
    assert tilefiles.read_tiles(spark, path).count() == 6


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "tiles"
    v = spark.createDataFrame([(k, 0, 0, 0, 1.0) for k in range(4)], "roi long, z long, y long, x long, v double")
    blobs = tiles.to_blobs(v, 2).withColumn("dtype", F.when(F.col("roi") == "3", F.raise_error("no such type").cast("string")).otherwise(F.col("dtype")))
    with pytest.raises(Exception, match="no such type"):
        tilefiles.write_tiles(blobs, str(path))
    assert not [f for f in path.rglob("*") if f.is_file()]


def test_small_rois_share_a_task(spark, tmp_path):
    path = str(tmp_path / "tiles")
    v = spark.createDataFrame([(k, 0, 0, x, k + x + 1.0) for k in range(60) for x in (0, 2)], "roi long, z long, y long, x long, v double")
    blobs = tiles.to_blobs(v, 2)
    tilefiles.write_tiles(blobs, path)
    back = tilefiles.read_tiles(spark, path)
    assert back.rdd.getNumPartitions() <= 8  # by bytes, not one for each roi
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, blobs.collect())) and back.count() == 120
    assert sorted((r["roi"], r["x"]) for r in back.where("roi in ('7', '9') and x >= 2").collect()) == [("7", 2), ("9", 2)]


def test_labels_beyond_sixteen_bits_come_back_whole(spark, tmp_path):
    path = str(tmp_path / "tiles")
    v = spark.createDataFrame([("0", 0, 0, 0, 65535), ("0", 0, 0, 5, 65536), ("1", 1, 0, 0, 360001), ("1", 1, 1, 1, 7), ("2", 0, 1, 0, 2**33)], "roi string, z long, y long, x long, v long")
    tilefiles.write_tiles(tiles.to_blobs(v, 4), path)
    back = tilefiles.read_tiles(spark, path)
    assert sorted(map(tuple, tiles.from_blobs(back).collect())) == sorted(map(tuple, v.collect()))
    assert {(r["roi"], r["x"]): r["dtype"] for r in back.collect()} == {("0", 0): "uint16", ("0", 4): "uint32", ("1", 0): "uint32", ("2", 0): "uint64"}

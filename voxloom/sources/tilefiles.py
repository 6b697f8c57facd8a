"""Dense tile files as a Spark data source: one file for each tile, planned by bytes in order of roi, read only where filters reach.

A file is ``roi=<roi>/<roi>_z000128_y000000_x000256.tile``: a header of 24 bytes (magic, type, three sizes), then the values.  Files of other names are left out; a folder that isn't there is empty.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .session import importable

NAME = re.compile(r"^(.+)_z(\d+)_y(\d+)_x(\d+)$")
MAGIC = b"VXT1"
HEADER = struct.Struct("<4s8s3I")
FIELDS = "roi string, z long, y long, x long, nz long, ny long, nx long, dtype string, data binary"
SUFFIX = ".tile"
#: A file counts as so many bytes more, so that a task doesn't open thousands of small ones.
OPENING = 1 << 20
#: Comparisons on the origin that choose files before they are opened.
TESTS = {D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Tiles(D.InputPartition):
    """Some tiles, of one roi or of several small ones: (path, roi, z, y, x) of each."""

    files: list[tuple[str, str, int, int, int]]


class TileReader(D.DataSourceReader):
    def __init__(self, path: str, most_bytes: int, least_tasks: int):
        self.path, self.most_bytes, self.least_tasks, self.wanted = path, most_bytes, least_tasks, []

    def pushFilters(self, filters: list[D.Filter]):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in ("roi", "z", "y", "x"):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[Tiles]:
        from pyarrow import fs

        system, base = _open(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            hidden = any(p.startswith((".", "_")) for p in info.path[len(base) :].split("/"))
            if hidden or not info.is_file or not info.base_name.endswith(SUFFIX) or not (m := NAME.match(info.base_name.removesuffix(SUFFIX))):
                continue
            key = dict(zip(("roi", "z", "y", "x"), (m[1], *map(int, m.groups()[1:])), strict=True))
            if all(TESTS[type(f)](key[f.attribute[0]], f.value) for f in self.wanted):
                found.append((*key.values(), info.path, info.size))
        out: list[Tiles] = []
        held = 0
        most = min(self.most_bytes, sum(OPENING + f[-1] for f in found) // self.least_tasks)
        for roi, z, y, x, path, size in sorted(found):
            if not out or held + OPENING + size > most:
                out.append(Tiles([]))
                held = 0
            out[-1].files.append((path, roi, z, y, x))
            held += OPENING + size
        return out

    def read(self, partition: Tiles) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path, roi, z, y, x in partition.files if partition else ():
            with system.open_input_file(path) as f:
                magic, dtype, *shape = HEADER.unpack(f.read(HEADER.size))
                if magic != MAGIC:
                    raise ValueError(f"{path} isn't a tile file")
                yield roi, z, y, x, *shape, dtype.rstrip(b"\0").decode(), bytes(f.read())


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, str]]


class TileWriter(D.DataSourceWriter):
    """Tasks write to a staging folder of the job; only a job whose tasks have all ended moves files into place, so a failed one leaves nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system, base = _open(self.path)
        folder, made = f"{self._staging(base)}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        for r in iterator:
            name = f"{r['roi']}_z{r['z']:06d}_y{r['y']:06d}_x{r['x']:06d}{SUFFIX}"
            with system.open_output_stream(f"{folder}/{quote(name, safe='')}") as f:
                f.write(HEADER.pack(MAGIC, r["dtype"].encode(), r["nz"], r["ny"], r["nx"]))
                f.write(bytes(r["data"]))
            made.append((f"{folder}/{quote(name, safe='')}", f"{base}/roi={quote(r['roi'], safe='')}/{name}"))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = _open(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.base_name.startswith("roi="):
                    system.delete_dir(info.path)
        for folder in {to.rsplit("/", 1)[0] for m in messages if m for _, to in m.files}:
            system.create_dir(folder, recursive=True)
        for m in messages:
            for at, to in m.files if m else ():
                system.move(at, to)
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self._staging(base)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(base))


class TileSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilefiles"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("mostBytes", 64 << 20)), int(self.options.get("leastTasks", 1)))

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"], overwrite)


def _ready(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tiles(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Tile rows of a folder; filters on roi and on the origin choose which files are opened, and a task reads ``most_bytes`` at most (or one file), of as many rois as that holds."""
    _ready(spark)
    return spark.read.format("tilefiles").option("mostBytes", most_bytes).option("leastTasks", spark.sparkContext.defaultParallelism).load(path)


def write_tiles(blobs: DataFrame, path: str, mode: str = "append") -> None:
    """Tile rows (as ``tiles.to_blobs`` makes them) as files in a folder by roi; all of them or, where a task fails, none.  A tile that is there already is replaced."""
    _ready(blobs.sparkSession)
    blobs.select("roi", "z", "y", "x", "nz", "ny", "nx", "dtype", "data").write.format("tilefiles").mode(mode).save(path)

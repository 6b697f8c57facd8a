"""What a session needs to run this package's Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def archive(folder: str | None = None) -> str:
    """The package as a zip file that Python imports from."""
    path = Path(folder or tempfile.mkdtemp(prefix="voxloom-")) / "voxloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(Path(ROOT, "voxloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    return str(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package: by path where they run on the driver's machine, else as an archive sent to them."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        if not any(x.endswith("/voxloom.zip") for x in sc._python_includes + [str(x) for x in sc.listFiles]):
            sc.addPyFile(archive())
        return
    env = sc.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[x for x in have if x]])

"""What the operators of this subpackage share: the cluster's shared folder, written tables, text primitives.

Text conventions (used by every operator that says "words"):

* a null text counts as the empty text;
* white space is exactly ``[\\x20\\x09-\\x0D]``; a word is a maximal run of anything else;
* "lower-cased A-Z" touches the 26 ASCII letters only.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.readers import spread

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder as a DataFrame; one of few row groups has its rows on all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors see.

    It lies in ``spark.checkpoint.dir`` where the session has that setting. Only where it is unset (local tests) a
    temporary folder of this machine is chosen and set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            base = jdir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="docquarry-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{base.rstrip('/')}/docquarry-{uuid.uuid4().hex}"
    spark.sparkContext._docquarry_folders = [*getattr(spark.sparkContext, "_docquarry_folders", []), folder]
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> int:
    """Delete all intermediate tables that this session's operators wrote, and say how many folders that were.

    Results are computed from these tables when they are asked for, so call it only when all results have been written.
    """
    folders = getattr(spark.sparkContext, "_docquarry_folders", [])
    for f in folders:
        remove(spark, f)
    spark.sparkContext._docquarry_folders = []
    return len(folders)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't inherit the driver's search path.

    Where they don't, an archive of the package goes to the shared folder and is added to the session once.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_docquarry_shipped", False):
        return
    from pyarrow import fs

    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "docquarry")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    uri = f"{shared_dir(spark)}/docquarry_package.zip"
    filesystem, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(archive.getvalue())
    spark.sparkContext.addPyFile(uri)
    spark.sparkContext._docquarry_shipped = True


def send_file(spark: SparkSession, path: str) -> None:
    """Make a file of the driver's machine (a vocabulary) reachable for ``local_file`` on all workers; once per session."""
    sent = getattr(spark.sparkContext, "_docquarry_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        spark.sparkContext._docquarry_files = sent | {path}


def local_file(path: str) -> str:
    """On a worker: the file itself where it is installed, else the copy that ``send_file`` brought."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, nothing else touched. The byte-wise path of ``lower`` serves pure ASCII texts."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """The words of a text, in order; an empty array for a null text."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))

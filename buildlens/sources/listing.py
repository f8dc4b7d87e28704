"""Listing input files and reading their first bytes, spread over tasks.

Spark's own readers leave files of zero bytes out and read a file to its end to see its start.
Here tasks list the folders and open the files themselves, so neither the names nor the
contents pass through the driver. It only looks at what the caller named and, while that is
short, one level below, to have folders to hand out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import batched, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.session import materialize

# The driver looks at so many entries of a named folder; longer ones are listed by a task.
DRIVER_ENTRIES = 4096
# A task waits for so many files at once.
THREADS = 16
BATCH = 4096
_FILES = "source string, size long"


def plain_name(uri: str) -> str:
    """A local path without its URI scheme; other URIs as they are."""
    return re.sub(r"^file:(//)?(?=/)", "", uri)


def is_hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def file_system(path: str):
    """(file system, path within it, what the path lacks to be a source's name)."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path, ""
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: len(path) - len(inner)]


def reachable(path: str) -> bool:
    """Whether a task can open the path by itself; else Spark's readers have to."""
    try:
        file_system(path)
    except (OSError, ValueError, ImportError):
        return False
    return True


def _entries(folder: str) -> Iterator[tuple[str, int | None]]:
    """(name, size) of what lies in a folder; folders have no size."""
    from pyarrow import fs

    system, inner, prefix = file_system(folder)
    for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if not is_hidden(info.base_name):
            yield prefix + info.path, None if info.type == fs.FileType.Directory else info.size


def _tree(folder: str) -> Iterator[tuple[str, int]]:
    """Every file below a folder; several folders are waited for at once."""
    with ThreadPoolExecutor(THREADS) as pool:
        level = [folder]
        while level:
            deeper = []
            for some in batched(level, THREADS):
                for entries in pool.map(lambda f: list(_entries(f)), some):
                    for name, size in entries:
                        if size is None:
                            deeper.append(name)
                        else:
                            yield name, size
            level = deeper


def _over_folders(list_one):
    """An Arrow function from folders to the (source, size) rows that `list_one` finds in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (row for folder in batch.column(0).to_pylist() for row in list_one(folder))
            for some in batched(rows, BATCH):
                names, sizes = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["source", "size"])

    return run


def _named(spark: SparkSession, paths: list[str]) -> list:
    """Hadoop's statuses of what path patterns name."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        found = path.getFileSystem(conf).globStatus(path)
        if not found:
            raise FileNotFoundError(f"no such input: {text}")
        out += list(found)
    return out


def _below(spark: SparkSession, folder, recursive: bool = False) -> Iterator:
    """Statuses in a folder, as Hadoop pages through them."""
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = system.listFiles(folder, True) if recursive else system.listStatusIterator(folder)
    while entries.hasNext():
        yield entries.next()


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, size) of every file that the path patterns name or that lies below, empty ones too.

    Hidden names are left out, as in Spark's readers. Stores that only Hadoop reaches are listed
    by the driver.
    """
    files, folders, wide = [], [], []
    for status in _named(spark, paths):
        name = status.getPath().toString()
        if status.isFile():
            files.append((plain_name(name), status.getLen()))
        elif not reachable(plain_name(name)):
            inside = len(name.rstrip("/")) + 1
            for found in _below(spark, status.getPath(), recursive=True):
                text = found.getPath().toString()
                if not any(map(is_hidden, text[inside:].split("/"))):
                    files.append((text, found.getLen()))
        else:
            some = list(islice(_below(spark, status.getPath()), DRIVER_ENTRIES + 1))
            if len(some) > DRIVER_ENTRIES:
                wide.append((plain_name(name),))
                continue
            for found in some:
                text = plain_name(found.getPath().toString())
                if is_hidden(found.getPath().getName()):
                    continue
                if found.isFile():
                    files.append((text, found.getLen()))
                else:
                    folders.append((text,))
    listed = spark.createDataFrame([f for f in files if not is_hidden(f[0].rsplit("/", 1)[-1])], _FILES)
    if folders:
        tasks = min(len(folders), task_count(spark))
        listed = listed.unionByName(
            spark.createDataFrame(folders, "folder string").repartition(tasks).mapInArrow(_over_folders(_tree), _FILES)
        )
    if wide:
        level = materialize(spark.createDataFrame(wide, "folder string").mapInArrow(_over_folders(_entries), _FILES), "listing")
        deeper = level.where("size IS NULL").select("source").repartition(task_count(spark))
        listed = listed.unionByName(level.where("size IS NOT NULL")).unionByName(deeper.mapInArrow(_over_folders(_tree), _FILES))
    return listed


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def first_bytes(path: str, count: int) -> bytes:
    """The first bytes of a file; no others are asked for."""
    system, inner, _ = file_system(path)
    with system.open_input_file(inner) as file:
        return file.read(count)


def _read(files: DataFrame, column: str, kind: str, read) -> DataFrame:
    """`files` with a column that `read` makes of each source, several files at once."""
    names = [*files.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                at = batch.schema.get_field_index("source")
                for low in range(0, batch.num_rows, THREADS):
                    part = batch.slice(low, THREADS)
                    values = pa.array(list(pool.map(read, part.column(at).to_pylist())))
                    yield pa.RecordBatch.from_arrays([*part.columns, values], names=names)

    spread = files.repartition(task_count(files.sparkSession))
    return spread.mapInArrow(run, files.withColumn(column, F.lit(None).cast(kind)).schema)


def read_heads(files: DataFrame, count: int) -> DataFrame:
    """`files` (with `source`) with `head`: the first `count` bytes, each as one character."""
    return _read(files, "head", "string", lambda path: first_bytes(path, count).decode("latin-1"))


def read_texts(files: DataFrame) -> DataFrame:
    """`files` (with `source`) with `value`: the whole text, bytes that are not UTF-8 replaced."""

    def whole(path: str) -> str:
        system, inner, _ = file_system(path)
        with system.open_input_stream(inner, compression=None) as file:
            return file.read().decode("utf-8", "replace")

    return _read(files, "value", "string", whole)

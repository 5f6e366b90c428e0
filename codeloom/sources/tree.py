"""Source trees: every file below a folder, hidden and underscored names included.

Folders are listed by Spark tasks, round by round; the driver lists none and holds no names. A task lists the
folders it is given and goes on below them, up to a budget; what is left is dealt out again in the next
round. Paths are then spread evenly over tasks that read the files, so neither a large sub-tree nor a
large folder makes a slow task. A root is a path that all executors reach, or a URI of a store that
``pyarrow.fs`` knows (``file://``, ``s3://``, ``gs://``, ``hdfs://``).
"""

from __future__ import annotations

import os
import sys
from collections import deque
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators.filters import JUNK_NAMES
from codeloom.session import written

# Executors get this module by value, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 8 << 20
# Folders that a task lists in a round, if it was given fewer.
BUDGET = 1_000
# A larger file does not fit a binary value.
MAX_BYTES = (1 << 31) - (1 << 24)


def local_path(path: str) -> str | None:
    """The path on the file system of a plain path or a ``file://`` URI; ``None`` for other stores."""
    if "://" not in path:
        return path
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme == "file" else None


def store_of(uri: str):
    """File system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def entries(path: str) -> Iterator[tuple[str, bool]]:
    """Path and kind (is a folder) of all that lies in a folder; links to folders are left out."""
    base, local = path.rstrip("/"), local_path(path)
    if local is not None:
        quoted = "://" in path
        with os.scandir(local) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False) or not e.is_dir():
                    name = e.name.replace("%", "%25") if quoted else e.name
                    yield f"{base}/{name}", e.is_dir(follow_symlinks=False)
        return
    from pyarrow import fs

    store, inside = store_of(path)
    for info in store.get_file_info(fs.FileSelector(inside, recursive=False)):
        yield f"{base}/{info.base_name}", info.type == fs.FileType.Directory


def read_bytes(path: str, most: int) -> bytes:
    """Content of a file of at most ``most`` bytes."""
    local = local_path(path)
    if local is not None:
        size = os.stat(local).st_size
    else:
        store, inside = store_of(path)
        size = store.get_file_info(inside).size or 0
    if size > most:
        raise OSError(None, f"{size} bytes, more than {most}")
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    with store.open_input_stream(inside) as f:
        return f.read()


def _reason(problem: OSError) -> str:
    return f"{type(problem).__name__}: {problem.strerror or problem}"


def list_tree(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str],
    prune: Sequence[str] = (),
    folders: int = 256,
) -> DataFrame:
    """``path, error``: files whose name ends in one of ``suffixes``, and folders that cannot be listed, with the reason.

    Folders with a pruned name are not entered. ``folders`` is the number of tasks that folders are dealt to
    in each round after the first; rounds are written below the shared folder.
    """
    endings, pruned = tuple(suffixes), frozenset(prune)
    schema = "path string, folder boolean, error string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, bool, str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], ["path", "folder", "error"]
            )

        for given in batches:
            todo = deque(given.column("path").to_pylist())
            left = max(BUDGET, len(todo))
            while todo:
                folder = todo.popleft()
                if left <= 0:
                    rows.append((folder, True, None))
                    continue
                left -= 1
                try:
                    for path, is_folder in entries(folder):
                        name = path[path.rindex("/") + 1 :]
                        if is_folder and name not in pruned:
                            todo.append(path)
                        elif not is_folder and name.endswith(endings):
                            rows.append((path, False, None))
                            if len(rows) >= 10_000:
                                yield batch()
                                rows.clear()
                except OSError as problem:
                    rows.append((folder, False, _reason(problem)))
        if rows:
            yield batch()

    level, found = spark.createDataFrame([(root,)], "path string").coalesce(1), None
    while True:
        listed = written(level.mapInArrow(walk, schema), "tree")
        here = listed.where("NOT folder").select("path", "error")
        found = here if found is None else found.unionByName(here)
        level = listed.where("folder").select("path")
        if level.isEmpty():
            return found
        level = level.repartition(folders, "path")


def read_files(paths: DataFrame, tasks: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path``, ``content`` and ``error``; a file that cannot be read, or is larger than ``max_bytes``, has an error and no content.

    Paths that come with an ``error`` (folders that cannot be listed) keep it.
    """
    spark = paths.sparkSession
    spread = tasks or max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema
            )

        rows: list[tuple] = []
        size = 0
        for given in batches:
            for path, error in zip(given.column("path").to_pylist(), given.column("error").to_pylist()):
                content = None
                if error is None:
                    try:
                        content = read_bytes(path, max_bytes)
                    except OSError as problem:
                        error = _reason(problem)
                if size + len(content or b"") >= BATCH_BYTES and rows:
                    yield batch(rows)
                    rows, size = [], 0
                rows.append((path, content, error))
                size += len(content or b"")
        if rows:
            yield batch(rows)

    known = paths if "error" in paths.columns else paths.withColumn("error", F.lit(None).cast("string"))
    return (
        known.select("path", "error")
        .repartition(spread, "path")
        .mapInArrow(read, "path string, content binary, error string")
    )


def files_by_extension(spark: SparkSession, root: str, extensions: Sequence[str] = (".py", ".js")) -> DataFrame:
    """All files with one of the extensions, junk folders included (see the path filter)."""
    return read_files(list_tree(spark, root, extensions))


def walk_sources(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = (".py", ".js", ".jsx"),
    prune: Sequence[str] = JUNK_NAMES,
) -> DataFrame:
    """Files whose suffix is exactly one of ``suffixes``, outside folders with a pruned name."""
    from codeloom.functions.text import file_suffix

    found = list_tree(spark, root, suffixes, prune)
    return read_files(found.where(F.col("error").isNotNull() | file_suffix(F.col("path")).isin(*suffixes)))

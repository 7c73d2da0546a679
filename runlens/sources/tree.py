"""Folder trees as DataFrames: every file counts, whatever its name or size.

Spark's file index hides names that start with ``_`` or ``.`` and its readers skip empty files, but
``__init__.py`` and an empty ``result.yaml`` are data here.  Tasks list the folders in rounds, and a second
step deals the files out evenly before they are opened, so one folder with most of the files is no hot task.  Paths may be local or any URI that ``pyarrow.fs`` opens
(``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfss:``).
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import materialize, ship_package

BATCH_BYTES = 32 << 20
TEXT_BATCH_BYTES = 4 << 20  # bytes of files whose decoded texts a task holds; a character may take four bytes then
SPLIT_BYTES = 64 << 20
TASK_ENTRIES = 10_000       # entries of folders that a task lists before it leaves the rest to the next round
LISTING_ROWS = 4096         # rows of a listing in an Arrow batch


def open_root(root: str):
    """(file system, folder on it) of a path or URI."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def _exists(root: str) -> None:
    from pyarrow import fs

    system, base = open_root(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


class PathPattern:
    """A path pattern cut into its levels: ``*`` and ``?`` inside a name, ``**`` for any number of folders."""

    def __init__(self, pattern: str):
        self.parts = [p if p == "**" else re.compile(fnmatch.translate(p)) for p in pattern.split("/")]

    def _behind(self, names: list[str]) -> set[int]:
        """Parts that may come next behind these names."""
        at = self._open({0})
        for name in names:
            at = self._open({i if self.parts[i] == "**" else i + 1 for i in at
                             if i < len(self.parts) and (self.parts[i] == "**" or self.parts[i].match(name))})
        return at

    def _open(self, at: set[int]) -> set[int]:
        for i in range(len(self.parts)):
            if i in at and self.parts[i] == "**":
                at.add(i + 1)
        return at

    def is_file(self, rel: str) -> bool:
        return len(self.parts) in self._behind(rel.split("/"))

    def may_hold(self, rel: str) -> bool:
        """Can a file below this folder match?"""
        return any(i < len(self.parts) for i in self._behind(rel.split("/")))


def _listing(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))],
                                      names=["rel", "size", "todo"])


def list_tree(spark: SparkSession, root: str, pattern: str = "**") -> DataFrame:
    """rel (path below the root) and size of every file under ``root`` whose path matches.

    A table of folders is worked off in rounds: a task opens its folders and goes on with what it finds in
    them until it has seen ``TASK_ENTRIES`` entries; the folders that are left are dealt out in the next round.
    Folders that cannot hold a match are never opened.  The driver sees no listing, and a root that does not
    exist is an error.  Runs a job per round.
    """
    ship_package(spark)
    _exists(root)
    wanted = PathPattern(pattern if pattern != "**" else "**/*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = open_root(root)
        seen, out, queue = 0, [], []
        for batch in batches:
            queue += reversed(batch.column("rel").to_pylist())
        while queue:
            folder = queue.pop()
            if seen >= TASK_ENTRIES:
                out.append((folder, 0, True))
            else:
                for i in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    seen += 1
                    rel = f"{folder}/{i.base_name}" if folder else i.base_name
                    if i.type == fs.FileType.Directory:
                        if wanted.may_hold(rel):
                            queue.append(rel)
                    elif wanted.is_file(rel):
                        out.append((rel, i.size or 0, False))
                    if len(out) >= LISTING_ROWS:        # a folder may hold any number of files
                        yield _listing(out)
                        out = []
            if len(out) >= LISTING_ROWS:
                yield _listing(out)
                out = []
        yield _listing(out)

    frontier, found = spark.createDataFrame([("",)], "rel string"), None
    while True:
        listed = materialize(frontier.mapInArrow(run, "rel string, size long, todo boolean"), "listing")
        files = listed.where("not todo").select("rel", "size")
        found = files if found is None else found.union(files)
        frontier = listed.where("todo").select("rel")
        if frontier.isEmpty():
            return found
        frontier = _spread(frontier)


def child_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """root and name of the direct child folders of each root, listed in tasks and dealt out evenly."""
    ship_package(spark)
    for root in roots:
        _exists(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for root in batch.column("root").to_pylist():
                system, base = open_root(root)
                names = [i.base_name for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
                for a in range(0, len(names), LISTING_ROWS):
                    some = names[a:a + LISTING_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([root] * len(some), type=pa.string()), pa.array(some, type=pa.string())],
                                                     names=["root", "name"])

    given = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string")
    return _spread(_spread(given).mapInArrow(run, "root string, name string"))


def read_tree(files: DataFrame, root: str) -> DataFrame:
    """path, rel and content of listed files (rows of ``list_tree``, filtered before anything is opened)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        names, contents, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{root.rstrip('/')}/{n}" for n in names], type=pa.string()),
                                               pa.array(names, type=pa.string()), pa.array(contents, type=pa.binary())],
                                              names=["path", "rel", "content"])

        for batch in batches:
            for rel in batch.column("rel").to_pylist():
                with system.open_input_stream(f"{base}/{rel}") as f:
                    contents.append(f.readall())
                names.append(rel)
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield flush()
                    names, contents, held = [], [], 0
        yield flush()

    return _spread(files.select("rel")).mapInArrow(run, "path string, rel string, content binary")


def file_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of listed files, each once for every ``split_bytes`` of the file, with ``start``; an empty file has one split."""
    ends = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))
    return _spread(files.withColumn("start", F.explode(ends)))


def _characters(f, start: int, split_bytes: int) -> bytes:
    """The bytes of the split at ``start``, both ends moved on to the next UTF-8 character (by three bytes at most)."""
    f.seek(start)
    raw = f.read(split_bytes + 3)

    def behind(at: int) -> int:
        return next((i for i in range(at, min(at + 3, len(raw))) if raw[i] & 0xC0 != 0x80), min(at + 3, len(raw)))

    return raw[behind(0) if start else 0:behind(split_bytes)]


def _split_batches(batches: Iterator[pa.RecordBatch], root: str, split_bytes: int, name: str, value: pa.DataType, of) -> Iterator[pa.RecordBatch]:
    """The rows of splits with a column more, handed on after every ``TEXT_BATCH_BYTES`` that were read for it."""
    system, base = open_root(root)
    for batch in batches:
        first, found, held = 0, [], 0
        for i, (rel, start) in enumerate(zip(batch.column("rel").to_pylist(), batch.column("start").to_pylist())):
            with system.open_input_file(f"{base}/{rel}") as f:
                data = _characters(f, start, split_bytes)
            try:
                found.append(of(data.decode("utf-8")))
            except UnicodeDecodeError:
                found.append(None)
            held += len(data)
            if held >= TEXT_BATCH_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(first, len(found))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, type=value)], names=[*batch.schema.names, name])
                first, found, held = i + 1, [], 0


def _with_splits(splits: DataFrame, root: str, split_bytes: int, field: str, value: pa.DataType, of) -> DataFrame:
    if split_bytes < 4:
        raise ValueError("a split must hold a character")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _split_batches(batches, root, split_bytes, field.split()[0], value, of)

    ship_package(splits.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in splits.schema.fields)
    return splits.mapInArrow(run, f"{schema}, {field}")


def split_chars(splits: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``chars``: the code points of each split (rows of ``file_splits``), NULL where its bytes are not UTF-8.

    Ends of splits are moved to characters, so a file is valid UTF-8 if all its splits are.
    """
    return _with_splits(splits, root, split_bytes, "chars long", pa.int64(), len)


def split_texts(splits: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``text`` of each split, cut where ``split_chars`` counts; the texts of a file by ``start`` make up the file."""
    return _with_splits(splits, root, split_bytes, "text string", pa.string(), str)


def read_tree_lines(files: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """rel, pos and line of listed text files; ``pos`` is the line's byte offset in its file.

    A file is read in splits of ``split_bytes`` by as many tasks: a split has the lines that begin in
    it.  Lines end with ``\\n`` (a ``\\r`` before it belongs to the break); bytes that are not UTF-8 are
    replaced.
    """
    splits = files.where("size > 0").select("rel", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        for batch in batches:
            for rel, start in zip(batch.column("rel").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(f"{base}/{rel}") as f:
                    yield from _split_lines(f, rel, start, start + split_bytes)

    return _spread(splits).mapInArrow(run, "rel string, pos long, line string")


def _split_lines(f, rel: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The lines that begin in [start, end), in batches."""
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + _skip_line(f)
    f.seek(at)
    rest, places, lines, held = b"", [], [], 0
    while at < end:
        block = f.read(1 << 20)
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        if not block and rest:
            parts, rest = [rest], b""
        for part in parts:
            if at >= end:
                break
            places.append(at)
            lines.append(part.removesuffix(b"\r").decode("utf-8", "replace"))
            held += len(part) + 1
            at += len(part) + 1
        if held >= BATCH_BYTES:
            yield _lines_batch(rel, places, lines)
            places, lines, held = [], [], 0
        if not block:
            break
    if lines:
        yield _lines_batch(rel, places, lines)


def _skip_line(f) -> int:
    """Bytes up to and with the next line break."""
    n = 0
    while block := f.read(1 << 16):
        if (i := block.find(b"\n")) >= 0:
            return n + i + 1
        n += len(block)
    return n + 1


def _lines_batch(rel: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rel] * len(lines), type=pa.string()), pa.array(places, type=pa.int64()),
                                       pa.array(lines, type=pa.string())], names=["rel", "pos", "line"])

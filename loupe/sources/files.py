"""File sources and sinks (SRC1-5, SNK1): CSV with explicit schemas and
encodings, file listings, whole-text files keyed by file name.

Scratch output goes under the session's checkpoint folder (the shared
folder a cluster names in ``spark.checkpoint.dir``), never a machine-local
temporary folder."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loupe.session import scratch_dir, stored


def new_scratch(spark: SparkSession, tag: str) -> str:
    return scratch_dir(spark, f"{tag}-{uuid.uuid4().hex[:12]}")


def write_csv(df: DataFrame, path: str, header: bool = True, encoding: str | None = None,
              date_format: str = "yyyy-MM-dd", single_file: bool = False) -> None:
    """Header row, no row label.  One file only on request (``coalesce(1)``
    funnels the data through one task, so keep it for small results)."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite").option("header", header).option("dateFormat", date_format)
    if encoding:
        w = w.option("encoding", encoding)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
             encoding: str | None = None, sep: str = ",", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with an explicit schema (no inference pass over the data)."""
    r = (spark.read.schema(schema).option("header", header).option("sep", sep)
         .option("dateFormat", date_format).option("mode", "PERMISSIVE"))
    if encoding:
        r = r.option("encoding", encoding)
    return r.csv(path)


def file_inventory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Every file below ``root``: path, name, size.  The ``content`` column is
    never selected, so file bodies are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    df = r.load(root).select("path", "length")
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the tasks' Python opens it, if its store is mounted (scheme
    ``file``)."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


FOLDERS = 256  # that text files are dealt over, so that their listing is spread


def _text_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for b in batches:
            for folder, key, text in zip(*(c.to_pylist() for c in b.columns)):
                at = os.path.join(root, f"text-{folder:03d}")
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                path = os.path.join(at, f"{quote(key, safe='')}.txt")
                part = f"{path}.{uuid.uuid4().hex}"  # a task that is repeated replaces whole files
                with open(part, "wb") as f:
                    f.write((text or b"") + b"\n")
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])
    return run


def write_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """One text file per key, ended by a line break; keys are unique, rows
    without one get no file.

    In a shared folder that is mounted (scheme ``file``) the tasks write
    ``{key}.txt`` files themselves (names quoted as in URLs), dealt over
    sub-folders ``text-NNN`` by the key's hash: a
    folder, a checksum and a permission call for each would take longer than
    the texts.  Elsewhere Spark's writer makes ``key=value/part-*.txt``."""
    df = df.where(F.col(key).isNotNull())
    root = _mounted(df.sparkSession, path)
    if root is None:
        df.select(key, text).write.mode("overwrite").partitionBy(key).text(path)
        return
    os.makedirs(root, exist_ok=True)
    name = F.col(key).cast("string")
    rows = df.select(F.pmod(F.xxhash64(name), F.lit(FOLDERS)).alias("folder"), name.alias("key"), F.col(text).cast("binary").alias("text"))
    rows.mapInArrow(_text_files(root), "n long").agg(F.sum("n")).collect()


PER_TASK = 64  # of Spark's small-file splits read by one task
LISTED = 10_000  # ids that are named to the file listing


def _in_folders(spark: SparkSession, path: str, key: str) -> bool:
    """Whether the first entry, but for hidden ones, is a ``key=value`` folder."""
    root = _mounted(spark, path)
    if root is not None:  # Hadoop's local file system has no iterator that holds less than the folder
        if not os.path.isdir(root):
            return False
        with os.scandir(root) as entries:
            return next((e.name.startswith(f"{key}=") for e in entries if not e.name.startswith(("_", "."))), False)
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    entries = at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatusIterator(at)
    while entries.hasNext():
        name = entries.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return name.startswith(f"{key}=")
    return False


ENTRIES = 10_000  # files that a listing or reading task holds at once
TASK_FILES, TASK_BYTES = 4096, 64 << 20  # of text files read by one task
HELD = 4 << 20  # bytes of texts that it holds at once, or one text


def _file_name(name: str) -> str:
    """A file's name as Spark's ``_metadata`` has it, escaped as in a URI."""
    return re.sub(r"""[\x00-\x20\x7f"#%<>?\[\\\]^`{|}]""", lambda m: f"%{ord(m[0]):02X}", name)


def _entry(e: os.DirEntry) -> tuple | None:
    """Path, key, name and size of a text file, the path alone of a folder;
    nothing of hidden or other entries."""
    name = e.name.decode(errors="replace")
    if e.is_dir():
        hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
        return None if hidden else (e.path, None, None, 0)
    if name.startswith(("_", ".")) or not name.endswith(".txt"):
        return None
    try:
        size = e.stat().st_size
    except FileNotFoundError:  # a link to nowhere, or gone meanwhile
        return None
    key = name[:-4]
    written = re.search(rb"/text-\d{3}/[^/]+$", e.path)  # by write_texts, with quoted names
    return e.path, unquote(key) if written else key, _file_name(name), size


LISTING = pa.schema([("path", pa.binary()), ("key", pa.string()), ("file_name", pa.string()), ("bytes", pa.int64())])
CONTENTS = pa.schema([("key", pa.string()), ("content", pa.binary()), ("file_name", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sub-folders and text files of each folder, not what is below."""
    rows = []
    for b in batches:
        for folder in b.column(0).to_pylist():
            with os.scandir(folder) as entries:
                for row in filter(None, map(_entry, entries)):
                    rows.append(row)
                    if len(rows) == ENTRIES:
                        yield _batch(rows, LISTING)
                        rows = []
    if rows:
        yield _batch(rows, LISTING)


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Path, key, name and size of the text files below a mounted folder.

    Tasks list the folders, one level of them after the other, and store what
    they find: the driver gets two numbers a level, never the files."""
    level, levels = spark.createDataFrame([(bytearray(os.fsencode(root)),)], "path binary"), []
    while True:
        found = stored(level.mapInArrow(_entries, "path binary, key string, file_name string, bytes long"), "listing")
        levels.append(found.where("key is not null"))
        level = found.where("key is null").select("path")
        folders = level.count()
        if not folders:
            break
        level = level.repartition(min(folders, 4 * spark.sparkContext.defaultParallelism))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, content and name of each file."""
    rows, held = [], 0
    for b in batches:
        for path, key, file_name in zip(*(c.to_pylist() for c in b.columns)):
            with open(path, "rb") as f:
                content = f.read()
            if rows and (held + len(content) > HELD or len(rows) == ENTRIES):
                yield _batch(rows, CONTENTS)
                rows, held = [], 0
            rows.append((key, content, file_name))
            held += len(content)
    if rows:
        yield _batch(rows, CONTENTS)


def read_texts(spark: SparkSession, path: str, key: str, ids: DataFrame | None = None) -> DataFrame:
    """Whole files below a folder as ``key, text, file_name``: one row a file.

    The key is the value of a ``key=value`` folder around the file, else the
    name of an ``{id}.txt`` file (``write_texts`` writes either); other files
    are not returned.  Small files are packed, some thousands a task.  With
    ``ids`` (a table with the column ``key``) only theirs are returned: up to
    LISTED ids are named to the file listing, more are joined.  The line break
    that the text writer ends a file with is removed.

    ``{id}.txt`` files of a mounted folder are listed and opened by tasks, and
    the ids are joined to their listing, so that other files are never opened.
    In ``key=value`` folders and other stores Spark's driver holds an entry
    for each file, and more than LISTED ids are joined to the texts."""
    foldered = _in_folders(spark, path, key)
    root = _mounted(spark, path)
    if root is not None and os.path.isdir(root) and not foldered:
        return _read_listed(_listing(spark, root), key, ids)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", not foldered).load(path)
    name = F.col("_metadata.file_name")
    if foldered:  # the key has its discovered type
        found = F.col(key)
    else:
        # paths are percent-encoded; a plus sign in them is one
        stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
        plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
        found = F.when(F.col("_metadata.file_path").rlike(r"/text-\d{3}/[^/]+$"), plain(plain(stem))).otherwise(plain(stem))  # written with quoted names
    if ids is not None:
        ids = ids.select(F.col(key).cast(dict(df.dtypes)[key] if foldered else "string").alias(key)).where(F.col(key).isNotNull()).distinct()
        few = [r[0] for r in ids.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            df = df.where(F.col(key).isin(few) if foldered else name.isin(
                [f"{x}.txt" for i in few for q in (i, quote(i, safe="")) for x in {q, quote(q)}]))  # as listed and as in a row
    out = df.select(found.alias(key), F.regexp_replace(F.col("content").cast("string"), r"\n\z", "").alias("text"), name.alias("file_name"))
    out = out if foldered else out.where(F.col(key) != "")
    out = out.coalesce(max(1, -(-df.rdd.getNumPartitions() // PER_TASK)))
    return out.join(ids, key, "left_semi") if ids is not None else out


def _read_listed(files: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """The listed files, opened by the tasks they are dealt to.  The planner
    knows the size of the listing only, so that a join is told not to take the
    texts for a small side and broadcast them through the driver."""
    if ids is not None:
        ids = ids.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        few = [r[0] for r in ids.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            files = files.where(F.col("file_name").isin(sorted({_file_name(f"{q}.txt") for i in few for q in (i, quote(i, safe=""))})))
        files = files.join(ids, "key", "left_semi")
    n, size = files.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(min(n, files.sparkSession.sparkContext.defaultParallelism), -(-n // TASK_FILES), -(-(size or 0) // TASK_BYTES), 1)
    out = files.select("path", "key", "file_name").repartition(tasks).mapInArrow(_contents, "key string, content binary, file_name string")
    return out.select(F.col("key").alias(key), F.regexp_replace(F.col("content").cast("string"), r"\n\z", "").alias("text"), "file_name").hint("merge")

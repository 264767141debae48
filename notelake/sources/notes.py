"""Reading notes and small lists from files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.predicates import glob_regex

#: Files that a folder of written notes has at most.
FOLDER_FILES = 1000


def write_notes(notes: DataFrame, root: str, name: str = "path", text: str = "content", ext: str = "md") -> int:
    """Writes each row as a file of its own below root (a URI, or a local path that all tasks share), named <name>-<row of the task>.<ext>; how many files.

    A task writes its rows one after the other into folders of its own, FOLDER_FILES each, so that no file is moved at the end by the driver, rows of one
    name stay apart, and the folders can be listed in parallel. A task that runs again clears its folders first.
    """

    def put(batches) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        base, n = f"{base}/{TaskContext.get().partitionId()}", 0
        store.delete_dir_contents(base, missing_dir_ok=True)
        for batch in batches:
            for title, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n % FOLDER_FILES == 0:
                    store.create_dir(f"{base}/{n // FOLDER_FILES}")
                with store.open_output_stream(f"{base}/{n // FOLDER_FILES}/{title or ''}-{n}.{ext}", compression=None) as f:
                    f.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return notes.select(F.col(name).cast("string"), F.col(text)).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


#: Folders are listed level by level until there are so many; each is then walked by a task.
WALKED = 64


def _store(spark: SparkSession, root: str) -> tuple[str, str, str] | None:
    """(URI, path in its store, what stands before paths of this store) of a folder that Arrow opens, else None."""
    if root.startswith("/"):
        root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + root
        root = root.replace("file:", "file://", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    root = root.rstrip("/")
    try:
        store, base = fs.FileSystem.from_uri(root)
        if re.search(r"[*?{\[\\%]", root) or not root.endswith(base) or store.get_file_info(base).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):
        return None
    return root, base, "file:" if root.startswith("file:") else root.removesuffix(base)


def _shown(info: fs.FileInfo) -> bool:
    """Spark's readers leave out files and folders of other names."""
    return not (info.base_name.startswith(".") or info.base_name.startswith("_") and "=" not in info.base_name or info.base_name.endswith("._COPYING_"))


def _files(spark: SparkSession, root: str, base: str, glob: str) -> DataFrame:
    """(path, size, mtime) of the files below a folder of a store, listed by tasks: the driver sees folders only, of the first levels."""

    def subfolders(batches) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(root)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and _shown(x)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["folder"])

    def listed(batches) -> Iterator[pa.RecordBatch]:
        store, fits = fs.FileSystem.from_uri(root)[0], re.compile(glob_regex(glob))
        for batch in batches:
            for folder, walk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                todo = [folder]
                while todo:
                    found = [x for x in store.get_file_info(fs.FileSelector(todo.pop())) if _shown(x)]
                    todo += [x.path for x in found if walk and x.type == fs.FileType.Directory]
                    files = [x for x in found if x.type == fs.FileType.File and fits.match(x.base_name)]
                    yield pa.RecordBatch.from_arrays([pa.array([x.path for x in files], pa.string()), pa.array([x.size for x in files], pa.int64()), pa.array([x.mtime_ns // 1_000_000 * 1000 for x in files], pa.timestamp("us", "UTC"))], names=["path", "size", "mtime"])

    own, level = [], [base]
    table = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))
    while 0 < len(level) < WALKED:
        own, level = own + level, [r[0] for r in table([(f,) for f in level], "folder string").mapInArrow(subfolders, "folder string").collect()]
    return table([(f, False) for f in own] + [(f, True) for f in level], "folder string, walk boolean").mapInArrow(listed, "path string, size long, mtime timestamp")


def scan_notes(spark: SparkSession, root: str, glob: str = "*.md", with_text: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """(path, basename, ext, mtime, size[, content]) of the files below root.

    Where Arrow opens the store, tasks list the folders and read the files, about batch_bytes at once, so that no list of all files is ever in the driver.
    Others (and roots with wildcards) go to Spark's reader, which lists them there and leaves out files without bytes.
    """
    name = F.substring_index("path", "/", -1)
    out = [F.col("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("basename"), F.lower(F.substring_index(name, ".", -1)).alias("ext"), F.col("mtime"), F.col("size")]
    text = [F.decode("content", "UTF-8").alias("content")] if with_text else []
    if (found := _store(spark, root)) is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        return files.withColumnsRenamed({"modificationTime": "mtime", "length": "size"}).select(*out, *text)
    uri, base, before = found
    files = _files(spark, uri, base, glob)

    def read(batches) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            sizes, first = batch.column("size").to_pylist(), 0
            while first < len(sizes):
                end, size = first, 0
                while end < len(sizes) and (end == first or size + sizes[end] <= batch_bytes):
                    size, end = size + sizes[end], end + 1
                part, content = batch.slice(first, end - first), []
                for path in part.column("path").to_pylist():
                    with store.open_input_stream(path, compression=None) as f:
                        content.append(f.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], names=[*part.schema.names, "content"])
                first = end

    if with_text:
        files = files.repartition("path").mapInArrow(read, "path string, size long, mtime timestamp, content binary")
    return files.withColumn("path", F.concat(F.lit(before), "path")).select(*out, *text)


def attach_extracted_text(notes: DataFrame, extracted: DataFrame, max_chars: int = 200_000) -> DataFrame:
    """notes (path, ..) of foreign formats with text from (path, text), cut; notes without text drop out."""
    most = max(10_000, max_chars)
    return notes.join(extracted.select("path", F.col("text").alias("_x")), "path").filter("_x is not null").withColumn("content", F.substring("_x", 1, most)).drop("_x")


def clean_tag_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(tag): one tag a line, leading # off, lower case; blank lines and // remarks dropped."""
    tag = F.lower(F.regexp_replace(F.trim(col), "^#+", ""))
    return lines.select(tag.alias("tag")).filter((F.col("tag") != "") & ~F.col("tag").startswith("//"))


def load_allowed_tags(spark: SparkSession, path: str) -> DataFrame:
    return clean_tag_lines(spark.read.text(path))


def load_translations(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """(term, translation) from JSON objects, one a line as write_translations() writes them, or one a file."""
    whole = spark.read.text(path, wholetext=one_a_file)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "translation"))


def write_translations(df: DataFrame, path: str, terms_per_object: int = 5000) -> None:
    """JSON objects, one a line, of about terms_per_object terms each."""
    n = max(1, -(-df.count() // terms_per_object))
    each = df.groupBy(F.pmod(F.xxhash64("term"), F.lit(n)).alias("part")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "translation"))))).alias("value"))
    each.select("value").write.mode("overwrite").text(path)

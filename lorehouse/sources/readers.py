"""File readers, upload rules and table sinks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse import schemas
from lorehouse.functions.text import is_blank
from lorehouse.sources import pages as page_rules


#: Folders that files written one by one are dealt over: few to list, and each listed by a task of its own.
FOLDERS = 64
#: Bytes and files that a task hands over at once; tasks that read files, as a multiple of the cores.
READ_BYTES, READ_FILES, READERS = 4 << 20, 512, 4


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def file_stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]+\z", "")


def _local_path(uri: Column) -> Column:
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"\Afile:/+", "/")


def _whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return lines.select(
        _local_path(F.col("_metadata.file_path")).alias("source_path"), F.col("value").alias("text")
    )


def _local_roots(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """The paths as the operating system has them; None if one is not local, is a pattern, or does not exist."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    roots = []
    for one in [path] if isinstance(path, str) else path:
        if re.search(r"[*?\[\]{}\\]", one):
            return None
        found = jvm.org.apache.hadoop.fs.Path(one)
        fs = found.getFileSystem(conf)
        if fs.getUri().getScheme() != "file" or not fs.exists(found):
            return None
        roots.append(fs.makeQualified(found).toUri().getPath())
    return sorted(set(roots))


def _hidden(name: str) -> bool:
    """What Spark's readers pass over: names that begin with a dot or an underscore, and unfinished copies."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _listed(roots: list[str]) -> Iterator[str]:
    """The files that are not empty, below folders or given by name."""
    waiting = list(roots)
    while waiting:
        at = waiting.pop()
        if os.path.isfile(at):
            yield from _data(at, os.path.getsize(at))
            continue
        with os.scandir(at) as entries:
            for entry in entries:
                if entry.is_dir() and not _hidden(entry.name):
                    waiting.append(entry.path)
                elif entry.is_file():
                    yield from _data(entry.path, entry.stat().st_size)


def _data(path: str, length: int) -> list[str]:
    name = os.path.basename(path)
    return [path] if length and not _hidden(name) and (not name.startswith("_") or "=" in name) else []


def _list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: list[str] = []
    for batch in batches:
        for path in _listed(batch.column("root").to_pylist()):
            paths.append(path)
            if len(paths) == 1 << 13:
                yield pa.record_batch([pa.array(paths, pa.string())], names=["source_path"])
                paths = []
    yield pa.record_batch([pa.array(paths, pa.string())], names=["source_path"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, texts, held = [], [], 0

    def taken() -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["source_path", "text"])

    for batch in batches:
        for path in batch.column("source_path").to_pylist():
            with open(path, "rb") as file:
                texts.append(file.read())
            names.append(path)
            held += len(texts[-1])
            if held >= READ_BYTES or len(names) >= READ_FILES:
                yield taken()
                names, texts, held = [], [], 0
    yield taken()


def _files_of(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...]) -> DataFrame:
    """Whole files with one of some extensions: source_path, text.

    Local and mounted folders are listed by tasks, one for each given path, and the
    driver never holds a list of files. Other stores and patterns go through Spark's reader, which lists on the driver.
    """
    wanted = file_suffix(F.col("source_path")).isin(*extensions)
    roots = _local_roots(spark, path)
    if roots is None:
        return _whole_files(spark, path).filter(wanted)
    cores = spark.sparkContext.defaultParallelism
    given = spark.createDataFrame([(r,) for r in roots], "root string").repartition(min(len(roots), READERS * cores))
    files = given.mapInArrow(_list_files, "source_path string").filter(wanted)
    if any(a != b and f"{a}/".startswith(f"{b.rstrip('/')}/") for b in roots for a in roots):
        files = files.distinct()
    read = files.repartition(READERS * cores).mapInArrow(_read_files, "source_path string, text binary")
    return read.select("source_path", F.col("text").cast("string").alias("text"))


def read_text_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text and Markdown files, one row per file: source_path, title, text, source_kind."""
    return _files_of(spark, path, fixed.TEXT_EXTENSIONS).select(
        "source_path",
        file_stem(F.col("source_path")).alias("title"),
        "text",
        F.lit("file").alias("source_kind"),
    )


def read_html_documents(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """HTML files as readable text; files without text come back as rejects."""
    html = _files_of(spark, path, fixed.HTML_EXTENSIONS)
    loaded = page_rules.with_text(html.withColumnRenamed("text", "html"), "html").select(
        "source_path",
        file_stem(F.col("source_path")).alias("title"),
        "text",
        F.lit("file").alias("source_kind"),
    )
    blank = is_blank(F.col("text"))
    rejects = loaded.filter(blank).select("source_path", F.lit("no text").alias("reason"))
    return loaded.filter(~blank), rejects


def read_manifest_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of a folder named by its ``manifest.json``."""
    manifest = spark.read.schema(schemas.MANIFEST_ENTRY).json(
        f"{folder.rstrip('/')}/manifest.json", multiLine=True
    )
    files = _whole_files(spark, folder).select(
        file_name(F.col("source_path")).alias("file"), "text"
    )
    return manifest.join(files, "file").select(
        "source_path",
        "title",
        "text",
        F.coalesce("source_kind", F.lit("url")).alias("source_kind"),
    )


def read_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Benchmark questions with their expected answers."""
    return spark.read.schema(schemas.BENCHMARK_QUESTION).json(path, multiLine=True)


def read_labelled_set(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Label rows (title, doc_type, required) and question rows of a labelled set."""
    labelled = spark.read.schema(schemas.LABELLED_SET).json(path, multiLine=True)
    labels = labelled.select(F.explode("documents").alias("title", "label")).select(
        "title", "label.doc_type", F.coalesce("label.required", F.array().cast("array<string>")).alias("required")
    )
    questions = labelled.select(F.explode("questions").alias("row")).select(
        F.col("row.q").alias("question"),
        F.col("row.expect_docs").alias("expect_docs"),
        F.coalesce("row.in_corpus", F.lit(True)).alias("in_corpus"),
    )
    return labels, questions


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), F.col("length"))


def filter_supported(files: DataFrame) -> DataFrame:
    """Add ``reject_reason``: unsupported extension, too large, or NULL."""
    supported = fixed.TEXT_EXTENSIONS + fixed.HTML_EXTENSIONS + fixed.OFFICE_EXTENSIONS
    return files.withColumn(
        "reject_reason",
        F.when(~file_suffix(F.col("path")).isin(*supported), "unsupported type").when(
            F.col("length") > fixed.MAX_FILE_BYTES, "too large"
        ),
    )


def split_valid(rows: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows to process and rows to report, by a reason column."""
    good = F.col(reason).isNull()
    return rows.filter(good).drop(reason), rows.filter(~good)


def upload_source_path(origin: Column, user_id: Column, name: Column) -> Column:
    """Per-user source path of an uploaded file; chat attachments ignore case."""
    chat = F.concat_ws(":", F.lit("tg"), user_id.cast("string"), F.lower(name))
    return F.when(origin == "telegram", chat).otherwise(
        F.concat_ws(":", F.lit("file"), user_id.cast("string"), name)
    )


def bulk_load(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loaded documents of a mixed batch, and one reject row per bad input.

    ``inputs``: path, length, body, is_url. A bad row never stops the others.
    """
    checked = filter_supported(inputs.filter(~F.col("is_url"))).unionByName(
        inputs.filter("is_url").withColumn("reject_reason", F.lit(None).cast("string"))
    )
    html = F.col("is_url") | file_suffix(F.col("path")).isin(*fixed.HTML_EXTENSIONS)
    office = ~F.col("is_url") & file_suffix(F.col("path")).isin(*fixed.OFFICE_EXTENSIONS)
    staged = page_rules.with_text(checked.withColumn("_html", F.when(html, F.col("body"))), "_html")
    text = F.when(html, F.col("text")).otherwise(F.col("body"))
    loaded = staged.withColumn("text", text).withColumn(
        "reject_reason",
        F.coalesce(
            "reject_reason",
            F.when(office, "no parser").when(html & is_blank(F.col("text")), "no text"),
        ),
    )
    title = F.when(
        F.col("is_url"), page_rules.page_title(F.col("body"), F.col("path"))
    ).otherwise(file_stem(F.col("path")))
    good, bad = split_valid(loaded)
    documents = good.select(
        F.when(F.col("is_url"), page_rules.canonical_url(F.col("path")))
        .otherwise(F.col("path"))
        .alias("source_path"),
        title.alias("title"),
        "text",
        F.when(F.col("is_url"), "url").otherwise("file").alias("source_kind"),
    )
    return documents, bad.select(F.col("path"), F.col("reject_reason").alias("reason"))


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_table(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    rows.write.mode("append").parquet(path)


def write_files(rows: DataFrame, path: str, folders: int = FOLDERS) -> list[str]:
    """One file for each row of (name, text), ended by a line feed; returns the folders they are dealt over.

    ``path``: a mounted folder, or one that Arrow's file systems know. Names are
    distinct. The tasks write the files themselves, under a name of their own that
    is then changed, so there is neither a folder nor a commit for each file.
    """
    fs, root = pafs.FileSystem.from_uri(path)
    for n in range(folders):
        fs.create_dir(f"{root}/{n}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = pafs.FileSystem.from_uri(path)
        own = f".{uuid.uuid4().hex}"
        for batch in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with target.open_output_stream(f"{base}/{folder}/{own}", compression=None) as out:
                    out.write(f"{text}\n".encode())
                target.move(f"{base}/{folder}/{own}", f"{base}/{folder}/{name}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["files"])

    folder = F.pmod(F.xxhash64("name"), F.lit(folders)).alias("folder")
    placed = rows.select(folder, "name", F.coalesce("text", F.lit("")).alias("text"))
    placed.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
    return [f"{path}/{n}" for n in range(folders)]


def write_results(rows: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines."""
    rows.write.mode("overwrite").json(path)

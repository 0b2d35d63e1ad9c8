"""Zip archives as a table of entries, read in planned ranges, and a dataset sink that appears as a whole or not at all."""

from __future__ import annotations

import os
import posixpath
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallyleaf.operators import dataset
from tallyleaf.sources import files


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; plain paths are local or on a mounted share."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


# ---- entries of archives ----


@dataclass
class Entries(InputPartition):
    """Entries ``start`` to ``stop`` of an archive; an ``error`` stands for one that doesn't open."""

    path: str
    start: int
    stop: int
    error: str | None = None


class EntryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.content = options["path"], int(options.get("entries", "5000")), options.get("content", "false").lower() == "true"
        if self.size < 1:
            raise ValueError("entries must be 1 or more")

    def partitions(self) -> list[Entries]:
        fs, path = located(self.path)
        found = [fs.get_file_info(path)]
        if found[0].type == pafs.FileType.Directory:
            found = sorted((f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(".zip")), key=lambda f: f.path)
        parts = []
        for f in found:
            try:
                with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    n = len(z.namelist())
                parts += [Entries(f.path, k, min(n, k + self.size)) for k in range(0, n, self.size)]
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                parts.append(Entries(f.path, 0, 0, f"{type(e).__name__}: {e}"))
        return parts or [Entries(path, 0, 0)]

    def read(self, partition: Entries) -> Iterator[tuple]:
        if partition.error:
            yield partition.path, None, None, None, None, partition.error
        if partition.start == partition.stop:
            return
        fs, _ = located(self.path)
        with fs.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as z:
            for k, e in enumerate(z.infolist()[partition.start : partition.stop], partition.start):
                if not e.is_dir():
                    data, error = contents(z, e) if self.content else (None, None)
                    yield partition.path, k, e.filename, e.file_size, data, error


def contents(z: zipfile.ZipFile, entry: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    try:
        return z.read(entry), None
    except Exception as e:  # a damaged entry is a row with its error
        return None, f"{type(e).__name__}: {e}"


class ZipEntries(DataSource):
    """(path, entry_no, name, size, content, error) of the files in one archive or in all below a folder.

    Options: ``entries``, how many of an archive a task takes; ``content``,
    whether they are unpacked.  The driver keeps ranges only, no names.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "path string, entry_no int, name string, size long, content binary, error string"

    def reader(self, schema) -> EntryReader:
        return EntryReader(dict(self.options))


def entries(spark: SparkSession, path: str, per_task: int = 5000, content: bool = False) -> DataFrame:
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").option("entries", per_task).option("content", str(content)).load(path)


def images(listing: DataFrame, prefer: str = "") -> DataFrame:
    """(path, entry_no, name, file, size, preferred) of image entries below a folder dataset/images; ``file`` is the name without folders."""
    file = F.element_at(F.split("name", "/"), -1)
    own = listing.where(F.col("name").contains("/dataset/images/") & files.is_image_path(F.col("name"))).withColumn("file", file)
    return own.select("path", "entry_no", "name", "file", "size", F.col("file").startswith(f"{prefer}_").alias("preferred"))


def with_content(listing: DataFrame) -> DataFrame:
    """Adds content and error to entries (path, entry_no); only these are unpacked, and an archive is opened once a batch."""

    @F.pandas_udf("content binary, error string")
    def unpack(path: pd.Series, entry_no: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"content": None, "error": None}, index=path.index, dtype=object)
        for archive, rows in entry_no.groupby(path):
            fs, own = located(archive)
            with fs.open_input_file(own) as raw, zipfile.ZipFile(raw) as z:
                listed = z.infolist()
                for at, k in rows.items():
                    out.at[at, "content"], out.at[at, "error"] = contents(z, listed[k])
        return out

    return listing.withColumn("_u", unpack("path", "entry_no")).select("*", "_u.content", "_u.error").drop("_u")


def samples(listing: DataFrame, there: DataFrame, prefer: str, limit: int, offset: int = 0) -> DataFrame:
    """(place, file, path, entry_no, name, size): the images to copy, none whose file name is ``there`` (name).

    Of entries with one file name the first of the first archive counts.
    """
    own = images(listing, prefer)
    w = Window.partitionBy("file").orderBy("path", "entry_no")
    first = own.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    chosen = dataset.choose_samples(first.select(F.col("file").alias("name")), there, prefer, limit, offset).withColumnRenamed("name", "file")
    return chosen.join(first, "file").select("place", "file", "path", "entry_no", "name", "size")


# ---- datasets as a whole ----


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder, and files by split."""

    folder: str
    counts: dict[str, int]


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.fs_path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        fs, path = located(self.fs_path)
        if fs.get_file_info(path).type != pafs.FileType.NotFound and not overwrite:
            raise ValueError(f"{self.fs_path} exists")
        fs.create_dir(self.staging(path), recursive=True)

    def staging(self, path: str) -> str:
        return posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}-{self.job}")

    def write(self, rows: Iterator) -> Written:
        fs, path = located(self.fs_path)
        # attempts of one task write to folders of their own; those that fail are never named in a message.
        # No folder is made without the one it lies in: a task that outlives an abort can't bring its files back
        folder, counts, known = posixpath.join(self.staging(path), uuid.uuid4().hex), {}, set()
        fs.create_dir(folder, recursive=False)
        for row in rows:
            parts = [p for p in row["file"].split("/") if p]
            if not parts or ".." in parts:
                raise ValueError(f"not a file of the dataset: {row['file']!r}")
            for k in range(1, len(parts)):
                if (*parts[:k],) not in known:
                    fs.create_dir(posixpath.join(folder, *parts[:k]), recursive=False)
                    known.add((*parts[:k],))
            with fs.open_output_stream(posixpath.join(folder, *parts)) as out:
                out.write(bytes(row["content"] or b""))
            split = parts[1] if len(parts) > 2 else ""
            counts[split] = counts.get(split, 0) + 1
        return Written(folder, counts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = located(self.fs_path)
        whole = posixpath.join(self.staging(path), "whole")
        fs.create_dir(whole, recursive=True)
        for m in filter(None, messages):
            for f in fs.get_file_info(pafs.FileSelector(m.folder, recursive=True)):
                if f.is_file:
                    to = posixpath.join(whole, posixpath.relpath(f.path, m.folder))
                    if fs.get_file_info(to).type != pafs.FileType.NotFound:
                        self.abort(messages)
                        raise ValueError(f"two rows for {posixpath.relpath(f.path, m.folder)}")
                    fs.create_dir(posixpath.dirname(to), recursive=True)
                    fs.move(f.path, to)
        counts: dict[str, int] = {}
        for m in filter(None, messages):
            for split, n in m.counts.items():
                counts[split] = counts.get(split, 0) + n
        with fs.open_output_stream(posixpath.join(whole, "files.csv")) as out:
            out.write(("split,files\n" + "".join(f"{s},{n}\n" for s, n in sorted(counts.items()))).encode())
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.move(path, posixpath.join(self.staging(path), "old"))
        fs.move(whole, path)
        fs.delete_dir(self.staging(path))

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = located(self.fs_path)
        for again in range(10):  # tasks may still be writing while it goes
            try:
                if fs.get_file_info(self.staging(path)).type != pafs.FileType.NotFound:
                    fs.delete_dir(self.staging(path))
                return
            except OSError:
                time.sleep(0.1 * again)


class DatasetTree(DataSource):
    """Rows (file, content) as files below ``path``, which takes its place only when every task has ended well.

    For file systems that rename; tasks write beside ``path``, in a hidden folder.

    ``file`` is images/split/name or labels/split/name; files.csv holds the
    number of files by split, from what the tasks report.
    """

    @classmethod
    def name(cls) -> str:
        return "dataset_tree"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options), overwrite)


def write_dataset(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Files of a dataset (file, content) below a folder; nothing is left of a job that fails."""
    df.sparkSession.dataSource.register(DatasetTree)
    df.select("file", "content").write.format("dataset_tree").mode("overwrite" if overwrite else "append").save(path)

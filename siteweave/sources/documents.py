"""Named text files of any size as a data source: ``site_documents`` (pieces) and ``site_reports`` (whole files).

A document is a file ``<folder>/<file_name>``.  ``site_documents`` rows are pieces of documents, ``(folder, file_name, text)``, in the order
in which they are to be written; a writing task streams them into files and holds one piece at a time.  A document may run over several
tasks: :func:`write_pieces` deals the pieces out by range, so a site with most of the pieces is written by many tasks, and the parts are put
together afterwards by copying bytes.

Tasks write below a hidden folder of their own.  The commit records which attempts Spark accepted; then their files move into place, each by
renaming, and what other attempts left is removed.  Moving can be repeated: a job that stops half way is ended by :func:`place_all`.

Reading gives ``site_documents`` as pieces of at most ``pieceBytes`` and ``site_reports`` as ``(folder, file_name, content)``.

Names: signs that a file system or this layout would not take (``/``, ``\\``, control characters, a leading ``.`` or ``_``) are
percent-encoded, an empty name is ``%``; a name of over 200 bytes keeps its end and gets a hash of the whole.  Null texts are empty pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siteweave.sources import files

PIECES = "folder string, file_name string, piece int, text string"
REPORTS = "folder string, file_name string, content string"
MANIFEST = "committed.json"


def segment(name: str | None, most: int = 200) -> str:
    """A folder or file name that every file system takes."""
    name = re.sub(r"[/\\\x00-\x1f\x7f]|\A[._]", lambda m: f"%{ord(m[0]):02X}", name or "") or "%"
    raw = name.encode()
    if len(raw) <= most:
        return name
    return hashlib.md5(raw).hexdigest() + "-" + raw[-(most - 33):].decode("utf-8", "ignore")


def original(segment_: str) -> str:
    """The name behind a segment that was not shortened."""
    return "" if segment_ == "%" else re.sub(r"%(2F|5C|2E|5F|[01][0-9A-F]|7F)", lambda m: chr(int(m[1], 16)), segment_)


class SiteDocuments(DataSource):
    """Options: ``path``; writing ``defer`` (leave moving to :func:`place_all`); reading ``suffix``, ``pieceBytes``, ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "site_documents"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options, whole=False)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options, overwrite, "text")


class SiteReports(SiteDocuments):
    @classmethod
    def name(cls) -> str:
        return "site_reports"

    def schema(self) -> str:
        return REPORTS

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options, whole=True)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options, overwrite, "content")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SiteDocuments)
    spark.dataSource.register(SiteReports)


@dataclass
class Attempt(WriterCommitMessage):
    """What one task wrote: its number, its folder, its first and last document (None without any)."""

    task: int
    folder: str
    first: str | None
    last: str | None


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, column: str) -> None:
        self.path, self.overwrite, self.column, self.job = options["path"], overwrite, column, uuid.uuid4().hex
        self.defer = options.get("defer", "false") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, hidden = files.filesystem(files.staging(self.path, self.job))
        own = f"{context.partitionId():06d}-{uuid.uuid4().hex}"
        first = last = key = None
        made, out = set(), None
        try:
            for batch in iterator:
                folders, names, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("folder", "file_name", self.column))
                for folder, name, text in zip(folders, names, texts):
                    if (folder, name) != key:
                        if out is not None:
                            out.close()
                        key, relative = (folder, name), f"{segment(folder)}/{segment(name)}"
                        if first is None:
                            first = relative
                        parent, last = segment(folder), relative
                        if parent not in made:
                            store.create_dir(f"{hidden}/{own}/{parent}", recursive=True)
                            made = {parent}
                        elif store.get_file_info(f"{hidden}/{own}/{relative}").type != fs.FileType.NotFound:
                            raise ValueError(f"pieces of {relative} do not follow one another: sort the rows by folder and file_name")
                        out = store.open_output_stream(f"{hidden}/{own}/{relative}", compression=None)
                    out.write((text or "").encode())
        finally:
            if out is not None:
                out.close()
        return Attempt(context.partitionId(), own, first, last)

    def commit(self, messages: list[Attempt | None]) -> None:
        attempts = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.task)
        store, hidden = files.filesystem(files.staging(self.path, self.job))
        store.create_dir(hidden, recursive=True)
        plan = [[a.folder, a.first, a.last] for a in attempts]
        with store.open_output_stream(f"{hidden}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"attempts": plan, "overwrite": self.overwrite}).encode())
        if not self.defer:
            finish(self.path, self.job, [place(self.path, self.job, step) for step in steps(plan)])

    def abort(self, messages) -> None:
        files.discard(self.path, self.job)


def steps(plan: list[list[str]]) -> list[dict]:
    """The moves of a job: files of each attempt, but documents that run over several are put together from their parts."""
    parts: dict[str, list[str]] = {}
    for folder, first, last in plan:
        for name in {first, last}:
            parts.setdefault(name, []).append(folder)
    shared = {name: folders for name, folders in parts.items() if len(folders) > 1}
    moves = [{"move": folder, "but": sorted({first, last} & set(shared))} for folder, first, last in plan]
    return moves + [{"join": name, "from": folders} for name, folders in shared.items()]


def place(path: str, job: str, step: dict) -> int:
    """Carry out one step; what an earlier try has done stays done."""
    store, root = files.filesystem(path)
    _, hidden = files.filesystem(files.staging(path, job))
    if "move" in step:
        own = f"{hidden}/{step['move']}"
        found = store.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=True))
        names = [f.path[len(own) + 1:] for f in found if f.type == fs.FileType.File]
        names = [n for n in names if n not in step["but"]]
        for folder in {n.split("/")[0] for n in names}:
            store.create_dir(f"{root}/{folder}", recursive=True)
        for n in names:
            store.move(f"{own}/{n}", f"{root}/{n}")
        return len(names)
    target = f"{root}/{step['join']}"
    whole = f"{hidden}/joined-{uuid.uuid4().hex}"
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(whole, compression=None) as out:
        for folder in step["from"]:
            with store.open_input_file(f"{hidden}/{folder}/{step['join']}") as part:
                while data := part.read(1 << 20):
                    out.write(data)
    store.move(whole, target)
    return 1


def finish(path: str, job: str, done: list[int]) -> None:
    store, root = files.filesystem(path)
    files.discard(path, job)
    with store.open_output_stream(f"{root}/{files.DONE}", compression=None) as out:
        out.write(json.dumps({"documents": sum(done)}).encode())


def place_all(spark: SparkSession, path: str) -> int:
    """Move the documents of committed jobs into place, by Spark tasks; also ends jobs that stopped while moving."""
    store, root = files.filesystem(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    total = 0
    for folder in sorted(f.path for f in found if f.base_name.startswith("_temporary-")):
        job = folder.rsplit("_temporary-", 1)[1]
        if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
            continue  # still being written, or given up
        with store.open_input_file(f"{folder}/{MANIFEST}") as file:
            todo = [json.dumps(s) for s in steps(json.loads(file.read())["attempts"])]

        def task(batches: Iterator[pa.RecordBatch], job=job) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [place(path, job, json.loads(s)) for s in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

        if todo:
            rows = spark.createDataFrame([(s,) for s in todo], "step string").repartition(len(todo))
            n = rows.mapInArrow(task, "n bigint").agg(F.sum("n")).first()[0]
        else:
            n = 0
        finish(path, job, [n])
        total += n
    return total


def write_pieces(pieces: DataFrame, order: Sequence[str | Column], path: str) -> int:
    """Write ``(folder, file_name, text, ...)`` as documents whose pieces follow ``order``; returns their number.

    Rows are dealt out by ranges of (folder, file name, order) and sorted within each: no task takes a whole large document, and none holds
    more than a piece.  Documents already at ``path`` stay, unless written anew.
    """
    register(pieces.sparkSession)
    keys = ["folder", "file_name", *order]
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = pieces.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    sorted_.select("folder", "file_name", F.lit(0).alias("piece"), "text").write.format("site_documents").mode("append").option("defer", "true").save(path)
    return place_all(pieces.sparkSession, path)


def write_reports(reports: DataFrame, path: str) -> int:
    """SNK7: one file per row of ``(site_id, file_name, content)``, in a folder per site."""
    rows = reports.select(F.col("site_id").alias("folder"), "file_name", F.col("content").alias("text"))
    return write_pieces(rows, [], path)


@dataclass
class Documents(InputPartition):
    paths: list[tuple[str, int]]


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, whole: bool) -> None:
        self.path, self.suffix, self.whole = options["path"], options.get("suffix", ""), whole
        self.piece, self.task = int(options.get("pieceBytes", 1 << 20)), int(options.get("taskBytes", 64 << 20))

    def partitions(self) -> list[Documents]:
        """Files packed into tasks of about ``taskBytes``."""
        tasks, held, size = [], [], 0
        for path, n in files.files(self.path, self.suffix):
            held.append((path, n))
            size += n + 4096
            if size >= self.task:
                tasks.append(Documents(held))
                held, size = [], 0
        return [*tasks, Documents(held)] if held or not tasks else tasks

    def read(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        store, _ = files.filesystem(self.path)
        names = ["folder", "file_name", "content"] if self.whole else ["folder", "file_name", "piece", "text"]
        types = [pa.string(), pa.string(), pa.string()] if self.whole else [pa.string(), pa.string(), pa.int32(), pa.string()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for path, _ in partition.paths:
            folder, name = map(original, path.rsplit("/", 2)[-2:])
            with store.open_input_file(path) as file:
                number, rest = 0, b""
                while True:
                    data = file.read() if self.whole else file.read(self.piece)
                    rest += data
                    cut = len(rest) if self.whole or not data else _whole_signs(rest)
                    if cut or not number:
                        text = rest[:cut].decode("utf-8", "replace")
                        rows.append((folder, name, text) if self.whole else (folder, name, number, text))
                        number, held, rest = number + 1, held + cut, rest[cut:]
                    if held >= 8 << 20 or len(rows) >= 1000:
                        yield batch()
                        rows, held = [], 0
                    if self.whole or not data:
                        break
        if rows:
            yield batch()


def _whole_signs(data: bytes) -> int:
    """Length of the data without a sign cut off at its end."""
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte >= 0xC0:
            need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return len(data) - back if need > back else len(data)
        if byte < 0x80:
            break
    return len(data)

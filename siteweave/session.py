"""Session helpers shared by jobs that cut lineage."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in ``spark.checkpoint.dir``; whoever starts a session chooses it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder the driver and all executors share")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: rows per file of stored page tables, by their names.  Spark packs files into reading tasks by their bytes, and counts each as ``openCostInBytes`` at least:
#: pages that compress well would else come in a few files that one task reads, and that task would grow with the table
FILE_ROWS = {"signals": 1000}


def _store(writer: DataFrameWriter, name: str, path: str) -> None:
    (writer.option("maxRecordsPerFile", FILE_ROWS[name]) if name in FILE_ROWS else writer).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Used where many operators read one derived table: the copy is columnar, so
    each reads only its columns, it outlives any executor, and plans built on
    it start from a plain scan.  Copies stay until :func:`clean` or until the
    folder is emptied by its owner.
    """
    path = shared_folder(df.sparkSession, name)
    _store(df.write, name, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept:
    """Stages of a job that are stored for the session only."""

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return materialise(build(), name)


@dataclass
class Stages(Kept):
    """Stages of a job in a folder of its own, so that a job run again takes up where it stopped.

    The folder's key is a hash of the input and the parameters: other input or parameters begin a new job.  A stage counts once its success
    mark is there, which its writer sets last; what a stopped stage has left is replaced.  Beside each stage lies what is known of it
    (:meth:`manifest`).  :meth:`prune` removes the oldest jobs.
    """

    spark: SparkSession
    folder: str
    parameters: dict
    built: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, spark: SparkSession, folder: str, source: DataFrame, **parameters) -> Stages:
        """The job on ``source``: told by the names of its files, or by its plan if it reads none."""
        names = sorted(source.inputFiles())
        said = hashlib.sha256("\n".join(names).encode()).hexdigest() if names else str(source.semanticHash())
        return cls(spark, folder, {"source": said, **parameters})

    @property
    def path(self) -> str:
        key = hashlib.sha256(json.dumps(self.parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return f"{self.folder.rstrip('/')}/job-{key}"

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self, name: str) -> bool:
        system, p = self._file(f"{self.path}/{name}/_SUCCESS")
        return system.exists(p)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored stage; built and stored if it is not there."""
        path = f"{self.path}/{name}"
        if not self.done(name):
            began = time.time()
            _store(build().write.mode("overwrite"), name, path)
            self.built.append(name)
            self._note(name, {"stage": name, "seconds": round(time.time() - began, 3), "ended": round(time.time()), "parameters": self.parameters})
        return self.spark.read.parquet(path)

    def _note(self, name: str, said: dict) -> None:
        system, p = self._file(f"{self.path}/_manifest/{name}.json")
        out = system.create(p, True)
        out.write(bytearray(json.dumps(said, default=str).encode()))
        out.close()

    def manifest(self) -> list[dict]:
        """What is stored of this job, in the order in which it was built."""
        system, p = self._file(f"{self.path}/_manifest")
        if not system.exists(p):
            return []
        # Spark hides folders that begin with an underscore, files named one by one are read
        names = [str(s.getPath()) for s in system.listStatus(p) if s.getPath().getName().endswith(".json")]
        found = [json.loads(self._read(n)) for n in names]
        return sorted((m for m in found if self.done(m["stage"])), key=lambda m: m["ended"])

    def _read(self, path: str) -> str:
        system, p = self._file(path)
        file = system.open(p)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def prune(self, keep: int = 3) -> int:
        """Remove all but the ``keep`` youngest jobs of the folder, never this one; returns how many went."""
        system, p = self._file(self.folder)
        if not system.exists(p):
            return 0
        own = self.path.rsplit("/", 1)[1]
        jobs = sorted((s for s in system.listStatus(p) if s.getPath().getName().startswith("job-") and s.getPath().getName() != own),
                      key=lambda s: s.getModificationTime(), reverse=True)
        old = jobs[max(0, keep - 1):]
        for s in old:
            system.delete(s.getPath(), True)
        return len(old)


def clean(spark: SparkSession) -> None:
    """Remove what this session stored in the shared folder, once its results are written elsewhere."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

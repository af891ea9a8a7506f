"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(df: DataFrame) -> str:
    """The folder spark.checkpoint.dir names; where none is named, as in a test on one machine, a temporary one."""
    session = df.sparkSession
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if not folder:
        if not session.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="xylem-")
        session.sparkContext.setCheckpointDir(folder)
        folder = session.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{session.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table to the shared folder and read again: what follows starts there, also after an
    executor is lost. The application's folder can go when the application has ended."""
    path = f"{shared_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that ``checkpointed`` gave and nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            session = table.sparkSession
            file = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(session._jsc.hadoopConfiguration()).delete(file, True)


def give_back() -> None:
    """Returns memory that this process has freed to the system: a Python worker lives on into the next stages, where what
    its largest arrays took counts beside what others need."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def free(name: str, taken: Iterable[str]) -> str:
    """A column name like ``name`` that is not taken."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def mapped(docs: DataFrame, fields: list[T.StructField], made: list[T.StructField], of: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]]) -> DataFrame:
    """The columns of docs that ``fields`` names, and those that ``of`` adds: it gets batches of the former and gives both. Names
    may hold any character: Spark's own call takes dots apart, so columns go by number meanwhile."""
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable, f.metadata) for i, f in enumerate([*fields, *made])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in of(batches):
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    numbered = docs.select(*(F.col("`" + f.name.replace("`", "``") + "`").alias(f"c{i}") for i, f in enumerate(fields)))
    return numbered.mapInArrow(run, schema).toDF(*(f.name for f in [*fields, *made]))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value evaluated once, also where of() has it in a loop."""
    return F.element_at(F.transform(F.array(value), of), 1)

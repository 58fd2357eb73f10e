"""Published releases: six tables that change together, by one small file.

A *release* is a generation of the tables and the list of the batches that belong to it. Rows are
stored with the id of their batch, in a partition of its own. What readers see is told by the pointer,
a file beside the tables that is replaced by one rename after everything else is stored: until then
all six tables are the old ones, from then on all six are the new ones. A batch that is stored but
not listed, left by a run that failed, is not read; storing the batch again replaces it.

Overwriting starts a new generation. The generation before stays for readers who have opened it;
older ones are removed. Appending lists one more batch; a batch that is listed already adds nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

POINTER = "current.json"
#: Column that holds the id of the batch, and the folders of its partitions.
BATCH = "published_batch"


@dataclass(frozen=True)
class Batch:
    """A delivered batch: its id and the rows it has in each table."""

    id: str
    rows: dict[str, int]


@dataclass(frozen=True)
class Release:
    """A generation of the tables and the batches that readers see; ``previous`` is the generation before."""

    generation: str
    batches: list[Batch] = field(default_factory=list)
    previous: str | None = None

    @property
    def ids(self) -> list[str]:
        return [batch.id for batch in self.batches]

    def with_batch(self, batch: Batch) -> Release:
        return Release(self.generation, [*self.batches, batch], self.previous)


def new_id() -> str:
    return uuid.uuid4().hex


def is_id(name: str) -> bool:
    """Whether a name may be that of a generation."""
    return re.fullmatch("[0-9a-f]{32}", name) is not None


def checked_id(batch: str) -> str:
    """The id, if it may stand in a path."""
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"a batch id has letters, digits, '_', '-' and '.' only: {batch!r}")
    return batch


def _path(spark: SparkSession, place: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place)


def _file_system(spark: SparkSession, place: str):
    return _path(spark, place).getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, place: str) -> bool:
    return _file_system(spark, place).exists(_path(spark, place))


def remove_folder(spark: SparkSession, place: str) -> None:
    _file_system(spark, place).delete(_path(spark, place), True)


def folders_in(spark: SparkSession, place: str) -> list[str]:
    """Names of the folders in a folder."""
    found = _file_system(spark, place).listStatus(_path(spark, place))
    return [status.getPath().getName() for status in found if status.isDirectory()]


def csv_tables(spark: SparkSession, place: str) -> dict[str, str]:
    """Names of the CSV files, and folders of such, of a folder, by table; hidden ones are left out. The listing is Spark's."""
    names = sorted(status.getPath().getName() for status in _file_system(spark, place).listStatus(_path(spark, place)))
    return {name[: -len(".csv")]: name for name in names if name.lower().endswith(".csv") and name[0] not in "._"}


def read_pointer(spark: SparkSession, home: str) -> Release | None:
    """The release that readers of ``home`` see, or None before the first."""
    place = f"{home}/{POINTER}"
    if not folder_exists(spark, place):
        return None
    stream = _file_system(spark, place).open(_path(spark, place))
    try:
        content = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Release(content["generation"], [Batch(**batch) for batch in content["batches"]], content["previous"])


def switch_pointer(spark: SparkSession, home: str, release: Release) -> None:
    """Make ``release`` the one that readers see: a file is written beside the pointer and takes its place."""
    jvm, new = spark._jvm, f"{home}/.{new_id()}.json"
    system = _file_system(spark, new)
    stream = system.create(_path(spark, new), True)
    try:
        stream.write(json.dumps(asdict(release)).encode())
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(_path(spark, new)), system.makeQualified(_path(spark, f"{home}/{POINTER}")), overwrite)

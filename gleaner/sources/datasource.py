"""Sources as a Spark data source (A3, §2.11): loaders plug in, ``spark.read`` and
``spark.readStream`` read them.

A loader knows one source: which parts there are and how one part is read. ``items_format``
makes a data source out of named loaders; a part becomes an input partition, so parts are
read on executors side by side. A filter on ``loader`` is pushed to the list of loaders:
those not asked for are not even listed. A loader that fails while it is listed, or a part
that fails while it is read, becomes a row with ``error`` set; the rest goes on, and
``split_failures`` separates the items from the failed parts, whose rows are left out as
a whole. Streams keep one number per loader as their offset.
"""

from __future__ import annotations

import json
import sys
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In,
                                    InputPartition)

FIELDS = ["source", "title", "link", "creation_date", "input"]
SCHEMA = "source string, title string, link string, creation_date string, input string, ord bigint, loader string, part string, error string"
#: Records of an Arrow batch.
BATCH_ROWS = 2048


class Loader(ABC):
    """One source. ``parts`` lists what there is in an order that only grows, each part by a
    name that stays; ``read`` yields the records of a part as dicts of the item fields
    (and ``ord`` where the source numbers them)."""

    @abstractmethod
    def parts(self) -> list[str]: ...

    @abstractmethod
    def read(self, part: str) -> Iterator[dict]: ...


class JsonLines(Loader):
    """A folder of files with one JSON record a line, on any file system that Arrow reads. File
    names order the parts, so writers add files whose names sort after the earlier ones."""

    def __init__(self, folder: str, suffix: str = ".json") -> None:
        self.folder, self.suffix = folder, suffix

    def _files(self) -> tuple[pafs.FileSystem, str]:
        if self.folder.startswith("file:") or "://" not in self.folder:
            return pafs.LocalFileSystem(), "/" + self.folder.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(self.folder)

    def parts(self) -> list[str]:
        fs, path = self._files()
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        names = [f.path[len(path.rstrip("/")) + 1:] for f in found if f.is_file and f.path.endswith(self.suffix)]
        return sorted(n for n in names if not any(x.startswith(("_", ".")) for x in n.split("/")))

    def read(self, part: str) -> Iterator[dict]:
        fs, path = self._files()
        with fs.open_input_stream(f"{path.rstrip('/')}/{part}") as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from (json.loads(line) for line in lines if line.strip())
            if rest.strip():
                yield json.loads(rest)


class Part(InputPartition):
    """One part of one loader; ``error`` instead of a part where the listing failed."""

    def __init__(self, loader: str, part: str | None, error: str | None = None) -> None:
        super().__init__((loader, part))
        self.loader, self.part, self.error = loader, part, error


def batches(loader: Loader | None, part: Part) -> Iterator[pa.RecordBatch]:
    """Records of a part as Arrow batches, then a row with the error if reading failed."""
    kinds = [*[pa.string()] * 5, pa.int64(), *[pa.string()] * 3]
    names = [*FIELDS, "ord", "loader", "part", "error"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    rows, error = [], part.error
    try:
        if error is None:
            for record in loader.read(part.part):
                rows.append((*(text(record.get(f)) for f in FIELDS), record.get("ord"), part.loader, part.part, None))
                if len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows = []
    except Exception as exc:  # noqa: BLE001 - one failing part must not stop the rest
        rows, error = [], f"{type(exc).__name__}: {exc}"
    if error is not None:
        rows.append((*[None] * 6, part.loader, part.part, error))
    if rows:
        yield batch(rows)


def listed(loaders: dict[str, Loader], name: str) -> list[Part]:
    try:
        return [Part(name, p) for p in loaders[name].parts()]
    except Exception as exc:  # noqa: BLE001
        return [Part(name, None, f"{type(exc).__name__}: {exc}")]


class ItemsReader(DataSourceReader):
    def __init__(self, loaders: dict[str, Loader]) -> None:
        self.loaders, self.names = loaders, list(loaders)

    def pushFilters(self, filters: list[Filter]):
        """Equality and membership tests on ``loader`` choose the loaders."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == ("loader",):
                asked = [f.value] if not isinstance(f, In) else list(f.value)
                self.names = [n for n in self.names if n in asked]
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [p for n in self.names for p in listed(self.loaders, n)] or [Part("", "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.loader:
            yield from batches(self.loaders.get(partition.loader), partition)


class ItemsStreamReader(DataSourceStreamReader):
    """Offsets count the parts of each loader that have been read."""

    def __init__(self, loaders: dict[str, Loader]) -> None:
        self.loaders = loaders
        self.known = dict.fromkeys(loaders, 0)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.loaders, 0)

    def latestOffset(self) -> dict:
        for name, loader in self.loaders.items():
            try:
                self.known[name] = max(self.known[name], len(loader.parts()))
            except Exception:  # noqa: BLE001 - it is asked again for the next batch
                pass
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        found = []
        for name in self.loaders:
            a, b = start.get(name, 0), end.get(name, 0)
            if b > a:
                parts = listed(self.loaders, name)
                found += parts[a:b] if parts and parts[0].error is None else parts
        return found or [Part("", "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.loader:
            yield from batches(self.loaders.get(partition.loader), partition)


def items_format(spark: SparkSession, name: str, loaders: dict[str, Loader]) -> str:
    """Register a format that reads the given loaders; its name, for ``format(...)``. The
    loaders' modules travel with it, so workers need not have them installed."""
    for loader in loaders.values():
        module = sys.modules[type(loader).__module__]
        if module.__name__ != "__main__":
            cloudpickle.register_pickle_by_value(module)

    class Items(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> ItemsReader:
            return ItemsReader(loaders)

        def streamReader(self, schema) -> ItemsStreamReader:
            return ItemsStreamReader(loaders)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Items)
    return name


def split_failures(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, failures): failures are (loader, part, error) rows; items leave out what was
    read of a failed part. What was loaded is stored first, as a source may not give the
    same twice."""
    stored = loaded.checkpoint(eager=True)
    failures = stored.where(F.col("error").isNotNull()).select("loader", "part", "error")
    items = stored.where(F.col("error").isNull()).join(failures.select("loader", "part"), ["loader", "part"], "left_anti")
    return items.select(*FIELDS, "ord", "loader"), failures

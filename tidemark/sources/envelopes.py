"""The registry as a Spark data source: ``spark.read.format("registry")`` and ``spark.readStream.format("registry")``.

A folder holds the registry's answers, one envelope a line. A file, or a folder of one file as Spark writes it, has a
number in its name; file k holds the pages k * pagesPerFile and on. Pages are planned on the driver
from names and the first envelope, and read in the tasks, a run of pages each; no record passes through the driver.

Options: path (any URI that pyarrow's file systems read), size (records asked for per page, clamped), maxPages (the cap of a
poll), pagesPerFile, and for a capped stream ``progress``, a file in which it notes the pages it has planned.

* Batch: with totalPages in the first envelope all pages up to it or to the cap are read in parallel; without it
  pages are read in order by one task, to the first short page. Filters on ``page`` prune runs of pages.
* Stream: the offset is the next page. A trigger takes what has arrived without a gap, ``maxPages`` at most, and goes on from
  the checkpoint after a restart.

A body that is no envelope, a page with more records than were asked for and a page that is missing are errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources.registry import page_size, unwrapped

SCHEMA = "page int, place int, number string, updated string, record string"
#: Pages that a task reads.
RUN = 64
_NUMBER = re.compile(r"(\d+)(?:\.jsonl?|/part-[^/]*)$")


@dataclass
class Pages(InputPartition):
    """A run of pages; ``to_short``: it ends at the first short one."""

    start: int
    stop: int
    to_short: bool = False


class Archive:
    """The envelopes of a folder, by page."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.per_file = int(options.get("pagesPerFile", 1))
        self.size = page_size(int(options.get("size", 50)))

    def files(self) -> dict[int, str]:
        """Path by number; parts that Spark left empty don't count."""
        system, root = pafs.FileSystem.from_uri(self.path)
        found = [(int(m[1]), f.path) for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.size and (m := _NUMBER.search(f.path))]
        numbers = dict(found)
        if len(numbers) < len(found):
            raise ValueError(f"{self.path}: two files of one number")
        return numbers

    def bodies(self, path: str) -> Iterator[str]:
        with pafs.FileSystem.from_uri(self.path)[0].open_input_stream(path) as file:
            rest = b""
            while chunk := file.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from (line.decode() for line in lines if line.strip())
            if rest.strip():
                yield rest.decode()

    def arrived(self) -> int:
        """Pages there are from the first one on, without a gap."""
        files = self.files()
        last = next(k for k in range(len(files) + 1) if k not in files) - 1
        return last * self.per_file + sum(1 for _ in self.bodies(files[last])) if last >= 0 else 0

    def total(self) -> int | None:
        """totalPages of the first envelope (0: there is no page; None: it doesn't say)."""
        first = self.files().get(0)
        if first is None:
            return 0
        body = json.loads(next(self.bodies(first)))
        return body.get("totalPages") if isinstance(body, dict) else None

    def records(self, pages: Pages) -> Iterator[pa.RecordBatch]:
        files = self.files()
        for k in range(pages.start // self.per_file, -(-pages.stop // self.per_file)):
            if k not in files:
                if pages.to_short:
                    return
                raise ValueError(f"page {max(pages.start, k * self.per_file)} is missing")
            for page, body in enumerate(self.bodies(files[k]), k * self.per_file):
                if pages.start <= page < pages.stop:
                    found = self._opened(page, body)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([page] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([_first(r, "applicationNumber", "application_number") for r in found], pa.string()),
                            pa.array([_first(r, "updateDate", "update_date") for r in found], pa.string()), pa.array([json.dumps(r, ensure_ascii=False) for r in found], pa.string()),
                        ],
                        ["page", "place", "number", "updated", "record"],
                    )
                    if pages.to_short and len(found) < self.size:
                        return

    def _opened(self, page: int, body: str) -> list[dict]:
        try:
            opened = json.loads(body)
        except ValueError as why:
            raise ValueError(f"page {page}: no envelope") from why
        found = unwrapped(opened)
        if not isinstance(opened, dict | list) or not all(isinstance(r, dict) for r in found):
            raise ValueError(f"page {page}: no envelope")
        if len(found) > self.size:
            raise ValueError(f"page {page}: {len(found)} records where {self.size} were asked for")
        return found


def _first(record: dict, *names: str) -> str | None:
    value = next((record[n] for n in names if record.get(n) is not None), None)
    return None if value is None else str(value)


def _runs(start: int, stop: int) -> list[Pages]:
    return [Pages(at, min(at + RUN, stop)) for at in range(start, stop, RUN)]


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RegistryReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  (Spark's name)
        return RegistryStream(self.options)


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.archive = Archive(options)
        self.cap = int(options.get("maxPages", 1 << 30))
        self.low, self.high = 0, 1 << 30

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds on the page limit the pages that are read."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        total = self.archive.total()
        if total is None:
            # Pages below a pushed bound must be seen to know that no short one ends the poll before it.
            return [Pages(0, self.cap, True)]
        return _runs(self.low, min(total, self.cap, self.high))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        # Spark reads None where there is no partition.
        for batch in self.archive.records(partition or Pages(0, 0)):
            if batch.num_rows and self.low <= batch.column(0)[0].as_py() < self.high:
                yield batch


class RegistryStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.archive = Archive(options)
        self.cap = int(options["maxPages"]) if "maxPages" in options else None
        self.progress = options.get("progress")
        if self.cap is not None and not self.progress:
            raise ValueError("a stream with maxPages needs the option progress")

    def _planned(self) -> int:
        """The page up to which batches have been planned."""
        system, path = pafs.FileSystem.from_uri(self.progress)
        if system.get_file_info(path).type == pafs.FileType.NotFound:
            return 0
        with system.open_input_stream(path) as file:
            return json.loads(file.read())["page"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        arrived = self.archive.arrived()
        return {"page": arrived if self.cap is None else min(arrived, self._planned() + self.cap)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.cap is not None:
            # Noted when a batch is planned: the checkpoint runs a planned batch again, whatever became of it.
            system, path = pafs.FileSystem.from_uri(self.progress)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as file:
                file.write(json.dumps(end).encode())
        return _runs(start["page"], end["page"])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.archive.records(partition or Pages(0, 0))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source; Spark demands its setting of any Python source that takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)
    return spark

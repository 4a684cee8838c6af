"""Pages of an API as a streaming source whose offset is the page offset.

``PageApi`` says how to ask: ``status(offset)`` of a page without reading it whole, and its body. The
stream goes on from the offset in its checkpoint. It ends a batch before the first page that is not
there yet or that is an error message, so such a page does not advance the stream, and the next run
asks for it again. Every page of a batch is a task of its own; its body is read by that task alone.
"""

from __future__ import annotations

import csv
import glob
import io
import sys
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

READY, MISSING, FAILED = "ready", "missing", "failed"
# Page statuses asked for by one look of the driver; a batch is no longer than that.
MOST_PAGES = 10_000


class PageApi:
    """A page source; subclasses travel to the tasks, so they hold plain values only."""

    limit: int

    def status(self, offset: int) -> str:
        raise NotImplementedError

    def body(self, offset: int) -> str:
        raise NotImplementedError


class FolderApi(PageApi):
    """A shared folder that stands for the API: ``offset=5000/*.csv`` is the page at 5000."""

    def __init__(self, folder: str, limit: int) -> None:
        parsed = urlparse(folder)
        self.folder, self.limit = unquote(parsed.path) if parsed.scheme == "file" else folder, limit

    def _files(self, offset: int) -> list[str]:
        return sorted(glob.glob(f"{glob.escape(self.folder)}/offset={offset}/*.csv"))

    def status(self, offset: int) -> str:
        files = self._files(offset)
        if not files:
            return MISSING
        with open(files[0], encoding="utf-8-sig") as f:
            return FAILED if f.read(256).lstrip().startswith("{") else READY

    def body(self, offset: int) -> str:
        parts = []
        for name in self._files(offset):
            with open(name, encoding="utf-8-sig", newline="") as f:
                parts.append(f.read())
        # one header line, that of the first file
        return parts[0] + "".join(p.split("\n", 1)[1] if "\n" in p else "" for p in parts[1:])


class _Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class _Reader(DataSourceStreamReader):
    def __init__(self, api: PageApi, names: list[str], known: int, most: int) -> None:
        self.api, self.names, self.most, self.at = api, names, most, known

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        end = self.at
        for _ in range(self.most):
            if self.api.status(end) != READY:
                break
            end += self.api.limit
        self.at = end
        return {"offset": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart the checkpoint, not this object, knows where the stream is
        self.at = max(self.at, end["offset"])
        return [_Page(o) for o in range(start["offset"], end["offset"], self.api.limit)]

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["offset"])

    def read(self, partition: _Page) -> Iterator[tuple]:
        rows = csv.reader(io.StringIO(self.api.body(partition.offset)))
        next(rows, None)
        for row in rows:
            if len(row) == len(self.names):  # as everywhere, rows of the wrong length are left out
                yield (*(v if v != "" else None for v in row), partition.offset)


def page_source(api: PageApi, names: list[str], name: str = "page_api", known: int = 0, most: int = MOST_PAGES) -> type[DataSource]:
    """A data source class over ``api``: text columns ``names`` and the ``page_offset`` of each row.

    Pages before ``known`` were loaded by an earlier run and are not asked for again.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return StructType([*(StructField(n, StringType()) for n in names), StructField("page_offset", LongType())])

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Reader(api, names, known, most)

    return Pages


def load_pages(spark: SparkSession, api: PageApi, names: list[str], out: str, checkpoint: str, most: int = MOST_PAGES) -> None:
    """Loads the pages that follow on those loaded before, then stops; run again for more.

    The rows of a batch go to a folder of its own number, so a repeated batch replaces itself.
    """
    try:
        known = loaded_pages(spark, out).agg(F.max("page_offset")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    source = f"page_api_{uuid.uuid4().hex}"
    spark.dataSource.register(page_source(api, names, source, 0 if known is None else known + api.limit, most))
    stream = spark.readStream.format(source).load()

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def loaded_pages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")

"""A paged provider as a Python data source, for batches and streams: the offset of a stream is the provider's cursor.

Options: ``mode`` (pages, empty or error), ``pages`` and ``page_size``.  Items are numbered, so a reader can tell whether each
arrives once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "item_id long, page int, payload string"
NAME = "paged_provider"


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(_pages(self.options))]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is not None:  # what Spark passes where there are no partitions
            yield from _page(self.options, partition.value)


class _Stream(SimpleDataSourceStreamReader):
    """Each trigger reads one page; a page that does not advance the cursor yields nothing."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = start["page"]
        if page >= _pages(self.options):
            return iter(()), start
        return iter(list(_page(self.options, page))), {"page": page + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for page in range(start["page"], end["page"]):
            yield from _page(self.options, page)

    def commit(self, end: dict) -> None:
        pass


def _pages(options: dict) -> int:
    return 0 if options.get("mode", "pages") == "empty" else int(options.get("pages", 3))


def _page(options: dict, page: int) -> Iterator[tuple]:
    if options.get("mode") == "error":
        raise RuntimeError("COLLECTION_UPSTREAM_PERMANENT")
    size = int(options.get("page_size", 2))
    for i in range(page * size, (page + 1) * size):
        yield (i, page, f'{{"id":{i}}}')


class PagedProvider(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


_SOURCES: dict[str, type[DataSource]] = {}


def register(source: type[DataSource]) -> None:
    """Adds a source; a name that is taken is refused."""
    if source.name() in _SOURCES:
        raise ValueError(f"source {source.name()} is registered")
    _SOURCES[source.name()] = source


def reader(spark: SparkSession, name: str, *, stream: bool = False, **options: str) -> DataFrame:
    """A DataFrame over a registered source; an unknown name is an error, never a guess."""
    if name not in _SOURCES:
        raise ValueError(f"source {name} is not registered")
    spark.dataSource.register(_SOURCES[name])
    r = (spark.readStream if stream else spark.read).format(name)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


register(PagedProvider)

"""A paginated service as a data source, a page per partition.

The service is a callable ``fetch(page, page_size, search) -> list of dicts`` named by the option
``fetcher`` as ``module:function``, so that it can be replaced by a stub.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from notemill.sources.tables import KERNELS

FIELDS = [part.split()[0] for part in KERNELS.split(", ")]


def folder_pages(page: int, page_size: int, search: str) -> list[dict]:
    """Stub service: pages are cut from the JSON lines of the file that ``search`` names."""
    rows = [json.loads(line) for line in Path(search).read_text().splitlines() if line.strip()]
    return rows[(page - 1) * page_size : page * page_size]


def load(name: str) -> Callable[[int, int, str], list[dict]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class KernelReader(DataSourceReader):
    """Asks for ``pages`` pages; without that option it looks for the first empty one, doubling and halving."""

    def __init__(self, options: dict[str, str]) -> None:
        self.fetcher = options.get("fetcher", "notemill.sources.pages:folder_pages")
        self.search, self.size = options.get("search", "tensor"), int(options.get("page_size", "50"))
        self.pages = int(options["pages"]) if "pages" in options else None

    def partitions(self) -> list[Page]:
        last = self.pages
        if last is None:
            fetch, low, high = load(self.fetcher), 0, 1
            while fetch(high, self.size, self.search):
                low, high = high, high * 2
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if fetch(middle, self.size, self.search) else (low, middle)
            last = low
        return [Page(n) for n in range(1, last + 1)] or [Page(1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in load(self.fetcher)(partition.number, self.size, self.search):
            ref = str(row.get("ref") or "")
            user, slug = ref.split("/") if ref.count("/") == 1 else (None, None)
            full = {**row, "user": user, "slug": slug}
            yield tuple(int(full["id"]) if f == "id" and full.get("id") is not None else None if full.get(f) is None else full[f] if f == "id" else str(full[f]) for f in FIELDS)


class KernelSource(DataSource):
    """``spark.read.format("kernels")``."""

    @classmethod
    def name(cls) -> str:
        return "kernels"

    def schema(self) -> str:
        return KERNELS

    def reader(self, schema: object) -> KernelReader:
        return KernelReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KernelSource)

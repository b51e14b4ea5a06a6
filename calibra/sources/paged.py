"""A paged API as a Spark data source: one partition for each class, pages until the quota is met, patience where asked.

    register(spark)
    spark.read.format("saved_pages").options(path=..., classes="bird,fish", per_class=50, schema=...).load()

A page is a JSON array of objects. A class ends with its quota or with a page of fewer than per_page objects. SavedPages
reads pages from files that a store of pyarrow reaches; HttpPages asks a URL. A stream goes on from the page it had reached
for each class.
"""
from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Answers that ask to try again (fixed values).
AGAIN = (429, 500, 502, 503, 504)
MAX_PAGES = 1000


@dataclass
class Answer:
    status: int
    body: str
    retry_after: int | None = None


class Refused(RuntimeError):
    """The API said no, or kept asking for patience."""


def patient(ask, tries: int = 6, wait: int = 2, pause=time.sleep) -> str:
    """The body of ask(): waits as long as an answer says, else twice as long each time; an error after the last try."""
    for left in range(tries - 1, -1, -1):
        answer = ask()
        if answer.status == 200:
            return answer.body
        if answer.status not in AGAIN or not left:
            raise Refused(f"status {answer.status}")
        pause(answer.retry_after or wait)
        wait *= 2
    raise Refused("no try allowed")


class Of(InputPartition):
    def __init__(self, name: str, first: int = 1, last: int | None = None) -> None:
        super().__init__(name)
        self.name, self.first, self.last = name, first, last


class PagedSource(DataSource):
    """Options: classes (comma-separated), per_class (quota; none by default), per_page (100), schema (DDL without kind), tries."""

    def schema(self) -> StructType | str:
        return "kind string, page int, " + self.options["schema"]

    def ask(self, kind: str, page: int) -> Answer:
        """One page of a class."""
        raise NotImplementedError

    def classes(self) -> list[str]:
        return [c for c in self.options.get("classes", "").split(",") if c]

    def keep(self, item: dict) -> bool:
        """Which objects count; a subclass may restrict it."""
        return True

    def page(self, kind: str, number: int) -> list[dict]:
        return json.loads(patient(lambda: self.ask(kind, number), int(self.options.get("tries", 6)), int(self.options.get("wait", 2))))

    def items(self, part: Of, fields: list[str]) -> Iterator[tuple]:
        """The kept objects of a partition's pages as rows."""
        quota, full, count = self.options.get("per_class"), int(self.options.get("per_page", 100)), 0
        for number in range(part.first, (part.last or MAX_PAGES) + 1):
            if quota is not None and count >= int(quota) and part.last is None:
                return
            found = self.page(part.name, number)
            for item in found:
                if quota is not None and count >= int(quota) and part.last is None:
                    return
                if self.keep(item):
                    count += 1
                    yield (part.name, number, *(item.get(f) for f in fields))
            if len(found) < full:
                return

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self, schema)


def _fields(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if f.name not in ("kind", "page")]


class _Reader(DataSourceReader):
    def __init__(self, source: PagedSource, schema: StructType) -> None:
        self.source, self.fields, self.wanted = source, _fields(schema), source.classes()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of the class; Spark filters by the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.wanted = [c for c in self.wanted if c == f.value]
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.wanted = [c for c in self.wanted if c in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Of(c) for c in self.wanted]

    def read(self, partition: Of) -> Iterator[tuple]:
        return self.source.items(partition, self.fields)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last page read of each class; a quota does not end a stream."""

    def __init__(self, source: PagedSource, schema: StructType) -> None:
        self.source, self.fields = source, _fields(schema)
        self.seen = {c: 0 for c in source.classes()}

    def initialOffset(self) -> dict:
        return {c: 0 for c in self.source.classes()}

    def latestOffset(self) -> dict:
        """The last full page that each class has now."""
        full = int(self.source.options.get("per_page", 100))
        for c in self.seen:
            while self.seen[c] < MAX_PAGES and len(self.source.page(c, self.seen[c] + 1)) >= full:
                self.seen[c] += 1
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Of(c, start.get(c, 0) + 1, last) for c, last in end.items() if last > start.get(c, 0)]

    def read(self, partition: Of) -> Iterator[tuple]:
        return self.source.items(partition, self.fields)


class SavedPages(PagedSource):
    """Pages in files path/kind=<class>/page=<number>/*: JSON lines, in order; a page without a folder is empty."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def ask(self, kind: str, page: int) -> Answer:
        from pyarrow import fs

        path = f"{self.options['path'].rstrip('/')}/kind={kind}/page={page}"
        store, where = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        found = store.get_file_info(fs.FileSelector(where, allow_not_found=True))
        lines: list[str] = []
        for f in sorted(found, key=lambda f: f.path):
            if f.is_file and not f.base_name.startswith(("_", ".")):
                with store.open_input_stream(f.path) as stream:
                    lines += stream.read().decode().splitlines()
        return Answer(200, "[" + ",".join(x for x in lines if x) + "]")


class HttpPages(PagedSource):
    """Pages of a URL with {kind} and {page} in it; the array is under the key `results` if the answer is an object."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def ask(self, kind: str, page: int) -> Answer:
        url = self.options["url"].replace("{kind}", kind).replace("{page}", str(page))
        time.sleep(float(self.options.get("every", 1.1)))  # at most a request a second
        try:
            with urlopen(Request(url, headers={"User-Agent": self.options.get("agent", "calibra")}), timeout=60) as r:
                body = r.read().decode()
        except HTTPError as e:
            after = e.headers.get("Retry-After") or ""
            return Answer(e.code, "", int(after) if after.isdigit() else None)
        made = json.loads(body)
        return Answer(200, json.dumps(made.get("results") or []) if isinstance(made, dict) else body)


def register(spark) -> None:
    """Makes both sources known to the session and lets filters by class reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SavedPages, HttpPages):
        spark.dataSource.register(source)


def save_pages(items, path: str, kind: str, per_page: int = 100) -> None:
    """Writes a table as saved pages of per_page rows for each class. items has a rank `_rank` within its class."""
    from pyspark.sql import functions as F

    fields = [c for c in items.columns if c not in (kind, "_rank", "_n")]
    paged = items.select(F.col(kind).alias("kind"), (F.floor((F.col("_rank") - 1) / per_page) + 1).cast("int").alias("page"), "_rank", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    paged.repartition("kind", "page").sortWithinPartitions("kind", "page", "_rank").select("kind", "page", "value").write.partitionBy("kind", "page").text(path)

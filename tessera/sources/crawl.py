"""A paged crawl as a data source: pages of message ids by token, whole messages fetched by executors, batch or stream.

A service lists pages one after the other, as each names the next. The driver follows that chain, of which it keeps the
tokens only; partitions are pages, and the tasks that read them fetch the messages. A stream's offset is the token
of the last page that was read, so that a restart goes on behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Ids of a page at most, and messages of a crawl unless asked otherwise.
PAGE, MOST = 500, 200
#: The token of the first page.
FIRST = ""


class FolderService:
    """A service whose answers are files: ``pages/<query>/first.json`` and ``pages/<query>/<token>.json`` with messages (of
    an id each) and nextPageToken, and ``messages/<id>.json``. ``path`` is any URI that Arrow's file systems read."""

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.files, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.query = options.get("query", "all")

    def _json(self, path: str) -> dict:
        with self.files.open_input_stream(f"{self.root}/{path}") as f:
            return json.loads(f.read())

    def page(self, token: str, size: int) -> tuple[list[str], str | None]:
        """Ids of the page of a token, and the token of the next one."""
        found = self._json(f"pages/{self.query}/{token or 'first'}.json")
        return [m["id"] for m in found.get("messages", [])], found.get("nextPageToken")

    def message(self, key: str) -> str:
        return json.dumps(self._json(f"messages/{key}.json"), ensure_ascii=False)


def service_of(options: dict[str, str]):
    """The service that the option ``service`` names (``module:Class``), or a folder."""
    named = options.get("service")
    if not named:
        return FolderService(options)
    module, name = named.split(":")
    return getattr(import_module(module), name)(options)


class Page(InputPartition):
    def __init__(self, token: str):
        super().__init__(token)
        self.token = token


def _messages(options: dict[str, str], token: str, size: int) -> Iterator[tuple]:
    service = service_of(options)
    for key in service.page(token, size)[0]:
        yield key, token, service.message(key)


class _Walk:
    """The chain of pages as far as it has been followed: tokens in order, and how many messages they have."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.most = int(options.get("maxresults", MOST))
        self.size = min(self.most, PAGE)
        self.tokens: list[str] = []
        self.count = 0

    def on(self) -> list[str]:
        """Follows the chain to its end, or to the page with which it has ``maxResults`` messages or more."""
        service = service_of(self.options)
        after = FIRST if not self.tokens else service.page(self.tokens[-1], self.size)[1]
        while after is not None and self.count < self.most:
            ids, further = service.page(after, self.size)
            self.tokens.append(after)
            self.count += len(ids)
            after = further or None
        return self.tokens


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Page]:
        return [Page(t) for t in _Walk(self.options).on()]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _messages(self.options, partition.token, _Walk(self.options).size)


class CrawlStream(DataSourceStreamReader):
    """Offsets: how many pages have been read, and the token of the last one."""

    def __init__(self, options: dict[str, str]):
        self.options, self.walk = options, _Walk(options)

    def initialOffset(self) -> dict:
        return {"pages": 0, "token": None}

    def latestOffset(self) -> dict:
        tokens = self.walk.on()
        return {"pages": len(tokens), "token": tokens[-1] if tokens else None}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if len(self.walk.tokens) < end["pages"]:  # after a restart
            self.walk.on()
        tokens = self.walk.tokens[: end["pages"]]
        begin = tokens.index(start["token"]) + 1 if start["token"] is not None else 0
        return [Page(t) for t in tokens[begin:]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _messages(self.options, partition.token, self.walk.size)

    def commit(self, end: dict) -> None:
        pass


class Crawl(DataSource):
    """``spark.read.format("tessera_crawl")``: id, token of its page, and the message as JSON. Options: ``path`` or
    ``service``, ``query``, ``maxResults`` (200; names in any case): no page is begun once there are so many messages."""

    @classmethod
    def name(cls) -> str:
        return "tessera_crawl"

    def schema(self) -> str:
        return "id string, token string, message string"

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(dict(self.options))

    def streamReader(self, schema) -> CrawlStream:
        return CrawlStream(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Crawl)

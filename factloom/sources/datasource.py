"""Pages and archive versions as data sources: spark.read.format("pages"), spark.readStream.format("pages"), spark.read.format("archive_versions").

Register them once per session with register(spark).  Options: addresses, the URI of a text file of addresses (one a line) that Arrow's
file systems can open, or list, the addresses themselves with spaces between; transport, "module:function" of what asks a host; fallback,
likewise, for hosts whose encryption fails; delay, tries and backoff as in web.Manners; batch, addresses a stream takes at once.
One input partition asks one host, so pauses hold inside it and hosts are asked side by side.  The driver holds the addresses of one read: a list
that is larger than that goes through web.fetch, which deals addresses from a table.
"""

from __future__ import annotations

import importlib
import time
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import web

#: Tries of an archive's index, which answers nothing under load, and seconds of waiting after each for each try made.
INDEX_TRIES, INDEX_WAIT = 3, 10.0


@dataclass
class HostPart(InputPartition):
    """Addresses of one host, in order."""

    host: str
    urls: tuple[str, ...]

    def __init__(self, host: str, urls: Sequence[str]) -> None:
        super().__init__(host)
        self.host, self.urls = host, tuple(urls)


def host_of(url: str) -> str:
    return url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower().removeprefix("www.")


def by_host(urls: Sequence[str]) -> list[HostPart]:
    """A partition for each host; an address that comes again is asked for once."""
    found: defaultdict[str, dict[str, None]] = defaultdict(dict)
    for url in urls:
        found[host_of(url)][url] = None
    return [HostPart(host, sorted(some)) for host, some in sorted(found.items())]


def loaded(name: str | None) -> Callable | None:
    """The function that "module:function" names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def addresses(options: dict) -> list[str]:
    """The addresses of an options list or file, in order.  Sources are planned in a process without a session, so the file is read through Arrow's file systems."""
    if "list" in options:
        return options["list"].split()
    store, path = fs.FileSystem.from_uri(options["addresses"])
    with store.open_input_stream(path) as f:
        return [line.strip() for line in f.read().decode().splitlines() if line.strip()]


def asked(part: HostPart, options: dict) -> Iterator[tuple]:
    manners = web.Manners(delay=float(options.get("delay", 1.0)), tries=int(options.get("tries", 2)), backoff=float(options.get("backoff", 2.0)))
    host = web.Host(loaded(options["transport"]), loaded(options.get("fallback")), manners)
    for url in part.urls:
        yield host.page(url)


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.parts = by_host(addresses(options))

    def partitions(self) -> Sequence[InputPartition]:
        return self.parts

    def read(self, partition: HostPart) -> Iterator[tuple]:
        return asked(partition, self.options)


class PageStreamReader(DataSourceStreamReader):
    """Offsets count addresses from the list's start, so a stream that starts again goes on behind the last batch in its checkpoint."""

    def __init__(self, options: dict) -> None:
        self.options, self.step = options, int(options.get("batch", 100))
        self.listed = addresses(options)
        self.sent = 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        self.sent = min(len(self.listed), self.sent + self.step)
        return {"next": self.sent}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.sent = max(self.sent, end["next"])
        return by_host(self.listed[start["next"] : end["next"]])

    def read(self, partition: HostPart) -> Iterator[tuple]:
        return asked(partition, self.options)

    def commit(self, end: dict) -> None:
        self.sent = max(self.sent, end["next"])


class Pages(DataSource):
    """A row of web.PAGE for each address."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return web.PAGE

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(dict(self.options))


def index_stamps(index: Callable[[str], list[str]], url: str, tries: int = INDEX_TRIES, wait: float = INDEX_WAIT) -> list[str]:
    """What an archive's index gives for an address: an error and an empty answer are both asked again, with growing waits, before none is believed."""
    for n in range(1, tries + 1):
        try:
            found = list(index(url))
        except (web.TransportError, ValueError):
            found = []
        if found:
            return found
        time.sleep(wait * n)
    return []


class VersionReader(PageReader):
    def read(self, partition: HostPart) -> Iterator[tuple]:
        index, wait = loaded(self.options["transport"]), float(self.options.get("wait", INDEX_WAIT))
        for url in partition.urls:
            for stamp in index_stamps(index, url, int(self.options.get("tries", INDEX_TRIES)), wait):
                yield url, stamp

    def partitions(self) -> Sequence[InputPartition]:
        """One, as all addresses ask the same index; its pauses hold for it."""
        return [HostPart("index", sorted({u for p in self.parts for u in p.urls}))]


class ArchiveVersions(DataSource):
    """(url, stamp): time stamps of archived versions of each address; none, if the index gives none in all its tries."""

    @classmethod
    def name(cls) -> str:
        return "archive_versions"

    def schema(self) -> str:
        return "url string, stamp string"

    def reader(self, schema) -> DataSourceReader:
        return VersionReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
    spark.dataSource.register(ArchiveVersions)

"""Pages fetched host by host: robots rules, a pause between requests, retries, a second transport where TLS fails."""

from __future__ import annotations

import time
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: url -> (status, content type, body); raises TransportError when there is no answer, TlsError when the encryption fails.
Transport = Callable[[str], tuple[int, str, bytes]]
PAGE = "url string, status int, ok boolean, kind string, body binary, error string"


class TransportError(Exception):
    pass


class TlsError(TransportError):
    pass


@dataclass(frozen=True)
class Manners:
    """Name shown to hosts, seconds between requests to a host, tries for a page, seconds before the next try for each try made."""

    agent: str = "factloom"
    delay: float = 1.0
    tries: int = 2
    backoff: float = 2.0


class Host:
    """Requests to one host, one after the other."""

    def __init__(self, transport: Transport, fallback: Transport | None, manners: Manners):
        self.transport, self.fallback, self.manners = transport, fallback, manners
        self.rules: urllib.robotparser.RobotFileParser | None = None
        self.asked, self.last = False, 0.0

    def get(self, url: str) -> tuple[int, str, bytes]:
        pause = self.manners.delay - (time.monotonic() - self.last)
        if self.last and pause > 0:
            time.sleep(pause)
        self.last = time.monotonic()
        try:
            return self.transport(url)
        except TlsError:
            if self.fallback is None:
                raise
            self.transport, self.fallback = self.fallback, None  # this host needs it from now on
            return self.transport(url)

    def allowed(self, url: str) -> bool:
        if not self.asked:
            self.asked = True
            root = "/".join(url.split("/", 3)[:3])
            try:
                status, _, body = self.get(f"{root}/robots.txt")
            except TransportError:
                status, body = 0, b""
            if status == 200:
                self.rules = urllib.robotparser.RobotFileParser()
                self.rules.parse(body.decode("utf-8", "replace").splitlines())
        return self.rules is None or self.rules.can_fetch(self.manners.agent, url)

    def page(self, url: str) -> tuple[str, int, bool, str | None, bytes | None, str | None]:
        if not self.allowed(url):
            return url, 0, False, None, None, "blocked by robots.txt"
        error = "fetch failed"
        for n in range(1, self.manners.tries + 1):
            try:
                status, kind, body = self.get(url)
            except TlsError as e:
                return url, 0, False, None, None, str(e)
            except TransportError as e:
                status, error = 0, str(e)
            if 0 < status < 400:
                form = "pdf" if "pdf" in kind or body[:5] == b"%PDF-" else "html" if not kind or "html" in kind or "xml" in kind else None
                return (url, status, True, form, body, None) if form else (url, status, False, None, None, f"unsupported content type {kind}")
            if 400 <= status < 500:
                return url, status, False, None, None, f"HTTP {status}"
            error = f"HTTP {status}" if status else error
            if n < self.manners.tries:
                time.sleep(self.manners.backoff * n)
        return url, 0, False, None, None, error


def fetch(urls: DataFrame, transport: Transport, fallback: Transport | None = None, manners: Manners = Manners()) -> DataFrame:
    """A row of PAGE for each distinct url of urls.

    All addresses of a host go to one partition, so its pauses hold; different hosts are fetched side by side.  A lost task fetches again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts: dict[str, Host] = {}
        for batch in batches:
            rows = []
            for host, url in zip(batch["host"], batch["url"], strict=True):
                if host not in hosts:
                    hosts[host] = Host(transport, fallback, manners)
                rows.append(hosts[host].page(url))
            yield pd.DataFrame(rows, columns=["url", "status", "ok", "kind", "body", "error"])

    asked = urls.select("url").distinct().withColumn("host", T.domain(F.col("url")))
    return asked.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, PAGE)


def versions(urls: DataFrame, index: Callable[[str], list[str]]) -> DataFrame:
    """(url, stamp): the time stamps that an archive's index gives for each url; none if the index can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows += [(url, stamp) for stamp in index(url)]
                except TransportError:
                    continue
            yield pd.DataFrame(rows, columns=["url", "stamp"])

    return urls.select("url").distinct().mapInPandas(run, "url string, stamp string")


def search(queries: DataFrame, engine: Callable[[str], list[str]], most: int) -> DataFrame:
    """(query, place, url): the first results of a search engine for each query; a query that fails gives none and the run goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query in batch["query"]:
                try:
                    rows += [(query, i, url) for i, url in enumerate(engine(query)[:most])]
                except TransportError:
                    continue
            yield pd.DataFrame(rows, columns=["query", "place", "url"])

    return queries.select("query").distinct().mapInPandas(run, "query string, place long, url string")

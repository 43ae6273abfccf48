"""A cursor-paged, rate-limited HTTP API as a Python data source, for batches and streams.

``spark.read.format("paged_api")`` with the options

* ``kind``: ``search`` (everything, newest first, ends at the first object older than ``since``), ``source`` (the pages of the
  sources in ``ids``, those edited at or after ``since``, oldest first, so that a broken read can go on from where it
  ended), ``children`` (the blocks below ``ids``) or ``users``;
* ``ids``: separated by commas; each is a partition of its own. ``since``: an instant as string, '' for all;
* ``base``, ``token``: where the API is, and the bearer token. ``transport``: ``module:function`` to send requests
  otherwise, called with (method, address, body or None, headers) and returning (status, headers, text);
* ``rate``: requests a second, shared by all partitions; ``retries``: how often a request is repeated.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from quillspark.sources.dump import OBJECT, as_row

# Requests a second, repeats, seconds before the first repeat and at most, objects a page.
RATE, RETRIES, FIRST_WAIT, MOST_WAIT, PAGE = 2.5, 5, 0.5, 30.0, 100


def send(method: str, address: str, body: str | None, headers: dict[str, str]) -> tuple[int, dict, str]:
    """One HTTP request by the standard library."""
    request = urllib.request.Request(address, None if body is None else body.encode(), headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


class ApiError(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(f"status {status}: {text[:200]}")
        self.status = status


class Client:
    """Requests at an even pace; 429 and 5xx are repeated after growing waits, or after what the service asks for."""

    def __init__(self, base: str, token: str, transport=send, rate: float = RATE, retries: int = RETRIES, sleep=time.sleep, clock=time.monotonic):
        self.base, self.transport, self.gap, self.retries, self.sleep, self.clock = base.rstrip("/"), transport, 1 / rate, retries, sleep, clock
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        self.next = 0.0

    def _pace(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap

    def call(self, method: str, path: str, body: dict | None = None) -> dict:
        for n in range(self.retries + 1):
            self._pace()
            status, headers, text = self.transport(method, f"{self.base}/{path}", None if body is None else json.dumps(body), self.headers)
            if status < 300:
                return json.loads(text)
            if n == self.retries or not (status == 429 or status >= 500):
                raise ApiError(status, text)
            asked = next((v for k, v in headers.items() if k.lower() == "retry-after"), "")
            wait = float(asked) if asked.replace(".", "", 1).isdigit() else FIRST_WAIT * 2**n
            self.sleep(min(wait, MOST_WAIT))
        raise AssertionError

    def pages(self, method: str, path: str, body: dict) -> Iterator[dict]:
        """Objects of all pages of a listing; the next page is asked for only when it is needed."""
        cursor = None
        while True:
            own = body | {"page_size": PAGE} | ({"start_cursor": cursor} if cursor else {})
            if method == "GET":
                got = self.call("GET", f"{path}?" + "&".join(f"{k}={v}" for k, v in own.items()))
            else:
                got = self.call(method, path, own)
            yield from got.get("results") or []
            cursor = got.get("next_cursor")
            if not got.get("has_more") or not cursor:
                return


def edited_since(since: str) -> dict:
    """The service's filter for objects edited at or after an instant."""
    return {"filter": {"timestamp": "last_edited_time", "last_edited_time": {"on_or_after": since}}} if since else {}


def by_edit(direction: str) -> dict:
    return {"timestamp": "last_edited_time", "direction": direction}


def objects(client: Client, kind: str, key: str, since: str) -> Iterator[dict]:
    if kind == "search":
        for o in client.pages("POST", "search", {"sort": by_edit("descending")}):
            if since and (o.get("last_edited_time") or "") < since:
                return  # all that follow are older
            yield o
    elif kind == "source":
        yield from client.pages("POST", f"data_sources/{key}/query", edited_since(since) | {"sorts": [by_edit("ascending")]})
    elif kind == "children":
        yield from client.pages("GET", f"blocks/{key}/children", {})
    elif kind == "users":
        yield from client.pages("GET", "users", {})
    else:
        raise ValueError(f"kind {kind} is none of search, source, children, users")


class PagedApi(DataSource):
    @classmethod
    def name(cls):
        return "paged_api"

    def schema(self):
        return OBJECT

    def reader(self, schema):
        return PagedApiReader(self.options)

    def simpleStreamReader(self, schema):
        return PagedApiStream(self.options)


class PagedApiReader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.since = options.get("kind", "search"), options.get("since", "")
        self.ids = [x.strip() for x in options.get("ids", "").split(",") if x.strip()]
        self.base, self.token, self.transport = options.get("base", ""), options.get("token", ""), options.get("transport", "")
        self.rate, self.retries = float(options.get("rate", RATE)), int(options.get("retries", RETRIES))
        if self.kind in ("source", "children") and not self.ids:
            raise ValueError(f"kind {self.kind} needs ids")

    def client(self, share: int) -> Client:
        module, _, function = self.transport.partition(":")
        return Client(self.base, self.token, getattr(importlib.import_module(module), function) if module else send, self.rate / max(share, 1), self.retries)

    def partitions(self):
        return [InputPartition(x) for x in self.ids] or [InputPartition("")]

    def read(self, partition):
        for o in objects(self.client(len(self.ids)), self.kind, partition.value, self.since):
            yield as_row(o)


class PagedApiStream(SimpleDataSourceStreamReader):
    """Changes of the sources in ``ids`` as a stream: the offset is the latest edit time seen of each source.

    A batch begins at the offset itself, as several edits may share a time; the mirror's upsert makes the repeats harmless.
    """

    def __init__(self, options):
        self.own = PagedApiReader(dict(options) | {"kind": "source"})

    def initialOffset(self):
        return dict.fromkeys(self.own.ids, self.own.since)

    def _since(self, start: dict) -> Iterator[dict]:
        client = self.own.client(1)
        for key in self.own.ids:
            for o in objects(client, "source", key, start.get(key, "")):
                yield key, o

    def read(self, start):
        rows, end = [], dict(start)
        for key, o in self._since(start):
            rows.append(as_row(o))
            end[key] = max(end.get(key, ""), o.get("last_edited_time") or "")
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter([as_row(o) for key, o in self._since(start) if (o.get("last_edited_time") or "") <= end.get(key, "")])


def read(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(PagedApi)
    return spark.read.format("paged_api").options(**options).load()


def stream(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(PagedApi)
    return spark.readStream.format("paged_api").options(**options).load()

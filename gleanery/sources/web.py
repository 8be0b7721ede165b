"""A batch data source of web pages: one row per site, each fetched in the task that reads it.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("sites", path_of_json_lines).load()

A fetcher is a function (url, verify) -> html that raises on failure. The one for plain requests is in the
standard library; a browser's is given by name, `module:function`, where one is installed.
"""

from __future__ import annotations

import importlib
import json
import random
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Waiting between requests and the limit of one, in seconds; the agents that a request may name, one at random each time.
PAUSE, TIMEOUT = (2.0, 5.0), 30
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/115.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.1.2 Safari/605.1.15",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:109.0) Gecko/20100101 Firefox/115.0",
)


def plain_fetch(url: str, verify: bool) -> str:
    import ssl
    import urllib.request

    context = ssl.create_default_context() if verify else ssl._create_unverified_context()
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": random.choice(AGENTS)}), timeout=TIMEOUT, context=context) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


class _Part(InputPartition):
    def __init__(self, rows: list[dict]):
        super().__init__(len(rows))
        self.rows = rows


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        with open(options["sites"]) as f:
            self.rows = [json.loads(x) for x in f if x.strip()]
        self.fetcher, self.parts = options.get("fetcher", ""), int(options.get("partitions", "8"))
        self.pause = float(options.get("pause", "-1"))

    def partitions(self):
        return [_Part(p) for i in range(self.parts) if (p := self.rows[i :: self.parts])]

    def read(self, partition) -> Iterator[tuple]:
        fetch = plain_fetch
        if self.fetcher:
            module, _, name = self.fetcher.partition(":")
            fetch = getattr(importlib.import_module(module), name)
        for r in partition.rows:
            time.sleep(random.uniform(*PAUSE) if self.pause < 0 else self.pause)
            try:
                yield r.get("url"), fetch(r["url"], r.get("verificar_ssl") is not False), None
            except Exception as e:  # noqa: BLE001  a page that fails is a row with its error
                yield r.get("url"), None, f"{type(e).__name__}: {e}"


class PageSource(DataSource):
    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return "url string, html string, error string"

    def reader(self, schema):
        return PageReader(self.options)

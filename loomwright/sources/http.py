"""Pages and JSON over HTTP as a Spark data source: one partition a URL.

``spark.read.format("http_json").option("urls", "\\n".join(urls)).load()`` gives ``url, status, body, error``. Too many
requests and server errors are tried again with growing pauses, as are failed connections; other failures give a row
without body, never an exception, so one bad page doesn't end a job. ``min_delay`` holds between requests of one task.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGAIN = {429, 500, 502, 503}


def fetch(url: str, retries: int = 3, timeout: float = 2.0, pause: float = 1.0, agent: str = "loomwright") -> tuple[str, int | None, str | None, str | None]:
    """url, status, body, error of one request with its repetitions."""
    status, error = None, None
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return url, r.status, r.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e)
            if e.code not in AGAIN:
                break
        except (OSError, ValueError) as e:
            status, error = None, str(e)
            if isinstance(e, ValueError):
                break
    return url, status, None, error


@dataclass
class Url(InputPartition):
    url: str


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Url]:
        return [Url(u) for u in self.options.get("urls", "").split("\n") if u.strip()]

    def read(self, partition: Url | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        o = self.options
        time.sleep(float(o.get("min_delay", 0)))
        yield fetch(partition.url, int(o.get("retries", 3)), float(o.get("timeout", 2)), float(o.get("pause", 1)))


class HttpJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, status int, body string, error string"

    def reader(self, schema: object) -> HttpReader:
        return HttpReader(dict(self.options))


def read_urls(spark: SparkSession, urls: list[str], **options: object) -> DataFrame:
    spark.dataSource.register(HttpJson)
    reader = spark.read.format("http_json").option("urls", "\n".join(urls))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def build_urls(ids: DataFrame, template: str, key: str) -> DataFrame:
    """url for each key of a list, from a template with %s: the detail pages of a summary."""
    return ids.where(F.col(key).isNotNull()).select(key, F.format_string(template, F.col(key).cast("string")).alias("url")).distinct()

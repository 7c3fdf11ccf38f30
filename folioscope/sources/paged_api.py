"""A paged content API as a Spark data source: one partition that follows the `next` links, since each page names the one after it.

    spark.dataSource.register(PagedApi)
    spark.read.format("paged_api").option("url", ...).option("next", "links.next").option("token_env", "CMS_TOKEN").load()
"""

from __future__ import annotations

import json
import os
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def dig(value, path: str):
    """A value by dotted path; a list on the way stands for its first element."""
    for part in path.split("."):
        if isinstance(value, list):
            value = value[0] if value else None
        value = value.get(part) if isinstance(value, dict) else None
    return value


def fetch(url: str, headers: dict[str, str]) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:  # noqa: S310
        return answer.read().decode("utf-8")


def responses(url: str, next_path: str, headers: dict[str, str], get=fetch):
    """(url, response) of a page and all that follow; ends at a page without next link or with one that was read before."""
    seen: set[str] = set()
    while url and url not in seen:
        seen.add(url)
        body = get(url, headers)
        yield url, body
        url = dig(json.loads(body), next_path)


class PagedApiReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        env = self.options.get("token_env")
        if env and not os.environ.get(env):
            raise RuntimeError(f"the environment has no {env}")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        env = self.options.get("token_env")
        headers = {"Authorization": f"Bearer {os.environ[env]}"} if env else {}
        yield from responses(self.options["url"], self.options.get("next", "next"), headers)


class PagedApi(DataSource):
    @classmethod
    def name(cls):
        return "paged_api"

    def schema(self):
        return "url string, response string"

    def reader(self, schema):
        return PagedApiReader(self.options)

"""OAI-PMH answers: pages that follow each other by resumption tokens, as a Python data source.

``fetch`` gives the XML of a token (None for the first page); a folder of saved answers is one such fetch.  Tokens are
only known page after page, so a chain is read by one task; several chains (repositories) are read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TOKEN = re.compile(r"<resumptionToken[^>]*>(.*?)</resumptionToken>", re.S)


def follow(fetch: Callable[[str | None], str], max_pages: int | None = None) -> Iterator[tuple[int, str]]:
    """(page, xml) until no token is left or ``max_pages`` are read; a token that comes back is an error, not an endless loop."""
    token, page, seen = None, 0, set()
    while max_pages is None or page < max_pages:
        xml = fetch(token)
        yield page, xml
        page += 1
        found = _TOKEN.search(xml)
        token = found.group(1).strip() if found else ""
        if not token:
            return
        if token in seen:
            raise ValueError(f"token {token!r} was given twice")
        seen.add(token)


def saved(folder: str) -> Callable[[str | None], str]:
    """Answers saved as ``first.xml`` and ``<token>.xml``."""
    return lambda token: Path(folder, f"{token or 'first'}.xml").read_text(encoding="utf-8")


class OaiDataSource(DataSource):
    """``spark.read.format("oai").option("folders", "a,b").load()``: (source, page, xml) of every chain of saved answers."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return "source string, page int, xml string"

    def reader(self, schema) -> DataSourceReader:
        return OaiReader([f for f in self.options.get("folders", "").split(",") if f], self.options.get("max_pages"))


class OaiReader(DataSourceReader):
    def __init__(self, folders: list[str], max_pages: str | None):
        self.folders, self.max_pages = folders, int(max_pages) if max_pages else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.folders]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        for page, xml in follow(saved(partition.value), self.max_pages):
            yield partition.value, page, xml

"""Sources as a Spark data source: a batch of what they have, or a stream whose offsets are the high-water marks.

A client knows the sources and asks one of them for what it published after a mark, up to another; Spark plans a task
for each source and stretch of time, runs failed ones again, and keeps the marks in the stream's checkpoint. What a client does
to get its answers (a network call, a recorded set) is its own matter; it is pickled to the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, mark bigint, payload string"


class Client(Protocol):
    def sources(self) -> list[str]: ...

    def newest(self, source: str) -> int | None:
        """The mark (seconds) of the newest answer there is; null if there is none. An error leaves the source out this time."""

    def fetch(self, source: str, after: int, upto: int) -> Iterable[tuple[int, str]]:
        """(mark, payload) of the answers after a mark, up to and with another."""


@dataclass
class Stretch(InputPartition):
    source: str
    after: int
    upto: int


class _Reading:
    def __init__(self, client: Client, options: dict[str, str]):
        self.client = client
        #: the mark that sources begin after, the seconds of a task at most, and the sources, if not all
        self.since, self.span = int(options.get("since", -1)), int(options.get("span", 86_400))
        self.only = set(options["sources"].split(",")) if "sources" in options else None

    def marks(self, held: dict[str, int]) -> dict[str, int]:
        """The newest mark of each source; where it can't be had, or went back, the one held."""
        out = dict(held)
        for source in self.client.sources():
            if self.only is None or source in self.only:
                try:
                    newest = self.client.newest(source)
                except Exception:  # noqa: BLE001, S112
                    continue
                if newest is not None:
                    out[source] = max(newest, out.get(source, self.since))
        return out

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        out = []
        for source, upto in sorted(end.items()):
            a = start.get(source, self.since)
            while a < upto:
                b = min(upto, a + self.span)
                out.append(Stretch(source, a, b))
                a = b
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition is None:
            return
        for mark, payload in self.client.fetch(partition.source, partition.after, partition.upto):
            if partition.after < mark <= partition.upto:
                yield partition.source, mark, payload


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self.stretches({}, self.marks({}))


class StreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, client: Client, options: dict[str, str]):
        super().__init__(client, options)
        self.held: dict[str, int] = {}

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        self.held = self.marks(self.held)
        return self.held

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        self.held = {**end, **self.held}
        return self.stretches(start, end)

    def commit(self, end: dict[str, int]) -> None:
        """Marks are Spark's to keep."""


def source_format(name: str, client: Client) -> type[DataSource]:
    """The data source of a client: ``spark.dataSource.register`` it, then read or stream its format by name."""

    class Sources(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(client, self.options)

        def streamReader(self, schema) -> StreamReader:
            return StreamReader(client, self.options)

    return Sources

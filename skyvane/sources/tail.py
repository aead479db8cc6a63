"""A growing CSV file as a stream: what was there at the start is a backlog and skipped; later rows come once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


MOST, BLOCK = 64_000_000, 65_536


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", file)``; option ``backlog`` "true" gives the rows that are there, too.
    Option ``maxBytes`` (64 MB) bounds what one batch reads; a longer line is read whole.

    The offset is a count of bytes up to the end of the last whole line, so a restart goes on exactly there, and a file
    that shrinks gives nothing until it has grown past its offset. One file has one reader; folders of many
    files are the file source's work.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "line_offset bigint, value string"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("backlog", "false").lower() == "true", int(self.options.get("maxBytes", MOST)))


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, backlog: bool, most: int = MOST):
        self.path, self.backlog, self.most = path, backlog, max(1, most)

    def last_line_end(self) -> int:
        """The offset after the last newline, looked for from the end."""
        try:
            with open(self.path, "rb") as f:
                at = f.seek(0, 2)
                while at:
                    start = max(0, at - BLOCK)
                    f.seek(start)
                    found = f.read(at - start).rfind(b"\n")
                    if found >= 0:
                        return start + found + 1
                    at = start
        except FileNotFoundError:
            pass
        return 0

    def whole(self, start: int, stop: int | None = None) -> tuple[list[tuple[int, str]], int]:
        """Whole lines between two offsets (without ``stop`` those of one batch), and the offset after the last."""
        try:
            with open(self.path, "rb") as f:
                f.seek(0, 2)
                size = f.tell()
                if size <= start:
                    return [], start
                f.seek(start)
                data = f.read(stop - start if stop is not None else self.most)
                while stop is None and b"\n" not in data and (more := f.read(self.most)):
                    data += more
        except FileNotFoundError:
            return [], start
        data = data[: data.rfind(b"\n") + 1]
        rows, at = [], start
        for line in data.splitlines(keepends=True):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text:
                rows.append((at, text))
            at += len(line)
        return rows, at

    def initialOffset(self) -> dict:
        return {"offset": 0 if self.backlog else self.last_line_end()}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        rows, at = self.whole(start["offset"])
        return iter(rows), {"offset": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        return iter(self.whole(start["offset"], end["offset"])[0])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)

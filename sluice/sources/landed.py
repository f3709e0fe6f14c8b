"""Landed event files as a streaming source whose offset is the event time.

``land`` puts events into folders by time, a folder per ``span`` seconds, so names alone tell which files a range of
time needs. The source starts at a cursor, rewound a little for a gapless overlap, or at the newest
events if the gap is too long to be replayed; each batch takes the folders that were
landed since the last one, its files are dealt out among tasks, and rows come as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds a cursor is rewound, and the longest gap in seconds that is replayed.
REWIND_S, REPLAY_S = 5, 30
#: Bytes read at once; an event is shorter.
BLOCK_BYTES = 16 << 20
FOLDER = re.compile(r"second=(\d+)")


def land(events: DataFrame, path: str, span: int = 1) -> None:
    """Writes JSON texts (value) with their time_us into folders by time; an event without a time is an error."""
    at = F.get_json_object("value", "$.time_us").try_cast("bigint")
    checked = F.when(at.isNull(), F.raise_error(F.lit("an event has no time_us")).cast("bigint")).otherwise(at)
    second = (F.floor(checked / (1_000_000 * span)) * span).cast("bigint")
    # line breaks between the tokens of a JSON text are white space; no JSON text holds a raw character 1
    line = F.concat(checked.cast("string"), F.lit("\x01"), F.translate("value", "\r\n", "  "))
    events.select(line.alias("value"), second.alias("second")).write.partitionBy("second").mode("append").text(path)


def start_us(cursor_us: int | None, now_us: int, rewind_s: int = REWIND_S, replay_s: int = REPLAY_S) -> int:
    """Where a stream begins: the cursor less the rewind, or now if there is no cursor, if the rewind
    would go before time 0, or if the replay would be longer than allowed."""
    if cursor_us is None or cursor_us < rewind_s * 1_000_000:
        return now_us
    start = cursor_us - rewind_s * 1_000_000
    return now_us if now_us - start > replay_s * 1_000_000 else start


@dataclass
class Files(InputPartition):
    paths: list[str]
    start: int
    end: int


class LandedReader(DataSourceStreamReader):
    """Options: path, span, cursor_us, now_us (both optional; now is the end of what is landed), tasks."""

    def __init__(self, options: dict) -> None:
        self.path, self.span = options["path"], int(options.get("span", 1))
        self.cursor = int(options["cursor_us"]) if options.get("cursor_us") else None
        self.now = int(options["now_us"]) if options.get("now_us") else None
        self.all = options.get("from", "") == "beginning"
        self.tasks = int(options.get("tasks", 8))

    def _folders(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted((int(m[1]), f.path) for f in found if (m := FOLDER.search(f.base_name)))

    def initialOffset(self) -> dict:  # noqa: N802
        folders = self._folders()
        if self.all:
            return {"time_us": folders[0][0] * 1_000_000 if folders else 0}
        newest = self.latestOffset()["time_us"]
        now = self.now if self.now is not None else newest
        return {"time_us": min(newest, start_us(self.cursor, now))}  # what lands from here on

    def latestOffset(self) -> dict:  # noqa: N802
        folders = self._folders()
        return {"time_us": (folders[-1][0] + self.span) * 1_000_000 if folders else 0}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        a, b = start["time_us"], end["time_us"]
        wanted = [p for s, p in self._folders() if s * 1_000_000 < b and (s + self.span) * 1_000_000 > a]
        files = [f for p in wanted for f in system.get_file_info(fs.FileSelector(p)) if f.is_file and not f.base_name.startswith(("_", "."))]
        files = sorted(files, key=lambda f: -f.size)  # large ones first, dealt out in turn
        return [Files([f.path for f in files[k :: self.tasks]], a, b) for k in range(min(self.tasks, len(files)))]

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import csv, fs

        system, _ = fs.FileSystem.from_uri(self.path)
        how = {
            "read_options": csv.ReadOptions(column_names=["time_us", "value"], block_size=BLOCK_BYTES), "parse_options": csv.ParseOptions(delimiter="\x01", quote_char=False, escape_char=False),
            "convert_options": csv.ConvertOptions(column_types={"time_us": pa.int64(), "value": pa.string()}, strings_can_be_null=False),
        }
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                for batch in csv.open_csv(stream, **how):
                    at = batch.column(0)
                    inside = pc.and_(pc.greater_equal(at, partition.start), pc.less(at, partition.end))
                    yield pa.RecordBatch.from_arrays([batch.column(1), at], names=["value", "time_us"]).filter(inside)

    def commit(self, end: dict) -> None:
        pass


class LandedEvents(DataSource):
    """``spark.dataSource.register(LandedEvents)``, then ``spark.readStream.format("landed_events")``."""

    @classmethod
    def name(cls) -> str:
        return "landed_events"

    def schema(self) -> str:
        return "value string, time_us bigint"

    def streamReader(self, schema: StructType) -> LandedReader:  # noqa: N802
        return LandedReader(self.options)

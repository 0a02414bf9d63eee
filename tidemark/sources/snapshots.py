"""A cache-through source of snapshots: what a series looked like on a day, kept as one JSON file each.

A partition is a series and a day. If its file is there, it is read; else the service's answer for the series is filtered to
what was known on the day, written, and returned: a snapshot that is there stays as it is. Filters on series_id and as_of
choose partitions, so that other files aren't opened. Answers and snapshots pass through a task observation by observation,
so that its memory doesn't grow with a series' vintages.
"""

from __future__ import annotations

import datetime as dt
import heapq
import io
import json
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual

from tidemark.sources.observations import MISSING

SCHEMA = "series_id string, as_of date, obs_date date, value double, realtime_start date"
#: In a snapshot's file: whether later vintages were let in, as the service has none for the series.
WAIVED = "client_side_pit"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Characters of text, and observations to be sorted, that a task holds at a time.
BLOCK, RUN = 1 << 18, 20_000
START, BETWEEN = re.compile(r'"observations"\s*:\s*\['), re.compile(r"[\s,]*")


def compact(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def observations(stream) -> Iterator[dict]:
    """The observations of a binary stream of answers, whatever their lines, from a block of text at a time."""
    text, decode = io.TextIOWrapper(stream, encoding="utf-8"), json.JSONDecoder().raw_decode
    buffer, at, inside, answers = "", 0, False, 0
    while block := text.read(BLOCK):
        buffer, at = buffer[at:] + block, 0
        while True:
            if not inside:
                found = START.search(buffer, at)
                if not found:
                    at = max(at, len(buffer) - 64)  # the name may go on in the next block
                    break
                at, inside, answers = found.end(), True, answers + 1
            at = BETWEEN.match(buffer, at).end()
            if at == len(buffer):
                break
            if buffer[at] == "]":
                at, inside = at + 1, False
                continue
            try:
                o, at = decode(buffer, at)
            except json.JSONDecodeError:  # the observation goes on in the next block
                break
            yield o
    if inside or not answers and buffer.strip():
        raise ValueError("not an answer with whole observations")


def in_order(rows: Iterable[dict], size: int = RUN) -> Iterator[dict]:
    """rows by date and start. Sorted runs of so many lie in files of the task and are merged."""
    key = lambda o: (o["date"], o["realtime_start"])
    with ExitStack() as files:
        runs, held = [], []

        def store() -> None:
            f = files.enter_context(tempfile.TemporaryFile("w+", encoding="utf-8"))
            f.writelines(compact(o) + "\n" for o in sorted(held, key=key))
            f.seek(0)
            runs.append(map(json.loads, f))
            held.clear()

        for o in rows:
            held.append(o)
            if len(held) == size:
                store()
        yield from heapq.merge(*runs, sorted(held, key=key), key=key)


@dataclass
class Snapshot(InputPartition):
    series_id: str
    as_of: dt.date


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.cache, self.service = options["cache"], options.get("service", "")
        self.unrevised = set(json.loads(options.get("unrevised", "[]")))
        self.wanted = [Snapshot(s, dt.date.fromisoformat(d)) for s in json.loads(options["series"]) for d in json.loads(options["days"])]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the partition's columns are answered here; the others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name not in ("series_id", "as_of"):
                yield f
            elif isinstance(f, EqualTo):
                self.wanted = [p for p in self.wanted if getattr(p, name) == f.value]
            elif isinstance(f, In):
                self.wanted = [p for p in self.wanted if getattr(p, name) in f.value]
            elif isinstance(f, GreaterThanOrEqual):
                self.wanted = [p for p in self.wanted if getattr(p, name) >= f.value]
            elif isinstance(f, LessThanOrEqual):
                self.wanted = [p for p in self.wanted if getattr(p, name) <= f.value]
            elif isinstance(f, IsNotNull):
                continue
            else:
                yield f

    def partitions(self) -> list[Snapshot]:
        return self.wanted

    def read(self, partition: Snapshot) -> Iterator[tuple]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.cache)
        path = f"{root}/{partition.series_id}/{partition.as_of}.json"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            self.fill(partition, files, path)
        with files.open_input_stream(path) as f:
            for o in observations(f):
                if o["value"] != MISSING:
                    yield partition.series_id, partition.as_of, dt.date.fromisoformat(o["date"]), float(o["value"]), dt.date.fromisoformat(o["realtime_start"])

    def answers(self, series_id: str) -> Iterator[dict]:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(self.service)
        for info in there.get_file_info(fs.FileSelector(f"{root}/series_id={series_id}", allow_not_found=True)):
            if info.is_file and info.base_name.startswith("part-"):
                with there.open_input_stream(info.path) as f:
                    yield from observations(f)

    def fill(self, p: Snapshot, files, path: str) -> None:
        day, waived = p.as_of.isoformat(), p.series_id in self.unrevised
        known = (o for o in self.answers(p.series_id) if o["date"] <= day and (o["realtime_end"] == "9999-12-31" if waived else o["realtime_start"] <= day <= o["realtime_end"]))
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(f'{{"{WAIVED}":{compact(waived)},"observations":['.encode())
            for k, o in enumerate(in_order(known)):
                f.write(f"{',' if k else ''}{compact(o)}".encode())
            f.write(b"]}")
        files.move(part, path)  # whole or not at all, whichever attempt of the task comes first


class SnapshotSource(DataSource):
    """Options: cache and service (folders; the service's has a folder series_id=... of JSON answers), series and days (JSON
    lists), unrevised (JSON list of series that have no vintages)."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_snapshots(spark: SparkSession, cache: str, service: str, series: list[str], days: list[str], unrevised: tuple[str, ...] = ()) -> DataFrame:
    """SCHEMA of each series and day. Filters must be planned while PUSHDOWN is set."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SnapshotSource)
    options = {"cache": cache, "service": service, "series": json.dumps(series), "days": json.dumps(days), "unrevised": json.dumps(list(unrevised))}
    return spark.read.format("snapshots").options(**options).load()

"""Charts, timed lyrics and scores as Spark formats: spark.read.format("song_chart" | "song_lyric" | "song_score") and df.write.format("song_chart").

Many small files make few partitions: files are sorted by size and dealt to the emptiest bin. Filters on ``path`` and ``name`` are
tried on the listing, so other files are never opened. The writer lays each task's files aside under a
name of the job and moves them in place only when all tasks are done.

Paths are folders or globs that the driver and all workers see at the same place (a shared mount).
"""

from __future__ import annotations

import glob
import heapq
import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SUFFIXES = {"song_chart": (".txt",), "song_lyric": (".lrc",), "song_score": (".xml", ".musicxml", ".mxl")}
SCHEMA = "path string, name string, bytes bigint, text string"
BIN_BYTES = 8 << 20
#: What opening a file costs, as bytes.
OPEN_BYTES = 64 << 10
_STAMP = re.compile(r"^\[\d+:\d+(?:\.\d+)?\](?=.*\S)", re.MULTILINE)


@dataclass
class FileBin(InputPartition):
    files: tuple[tuple[str, int], ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


def decoded(raw: bytes) -> str:
    """UTF-8 with or without a mark, UTF-16 by its mark, else Windows-1252; undefined bytes become the replacement character."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def score_text(raw: bytes) -> str | None:
    """The score of a file: of a compressed one its first score that is no container listing; null where there is none."""
    if raw[:2] != b"PK":
        return decoded(raw)
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as packed:
            names = [n for n in packed.namelist() if n.lower().endswith((".xml", ".musicxml")) and not n.startswith("META-INF/")]
            return decoded(packed.read(names[0])) if names else None
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError):
        return None


def lyric_text(raw: bytes) -> str | None:
    """The text of a lyric with a timed line; null where nothing is timed."""
    text = decoded(raw)
    return text if _STAMP.search(text) else None


READERS: dict[str, Callable[[bytes], str | None]] = {"song_chart": decoded, "song_lyric": lyric_text, "song_score": score_text}


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(file, bytes) under a folder, or of a glob, by name."""
    found = glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isdir(path) else glob.glob(path, recursive=True)
    return sorted((p, os.path.getsize(p)) for p in found if p.lower().endswith(suffixes) and os.path.isfile(p) and "/_" not in p[len(path) if os.path.isdir(path) else 0 :])


def binned(files: list[tuple[str, int]], bin_bytes: int = BIN_BYTES) -> list[tuple[tuple[str, int], ...]]:
    """Files dealt largest first to the emptiest of as many bins as their bytes and openings fill."""
    total = sum(size + OPEN_BYTES for _, size in files)
    count = min(len(files), -(-total // bin_bytes))
    bins: list[tuple[int, int, list[tuple[str, int]]]] = [(0, k, []) for k in range(count)]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        filled, k, own = heapq.heappop(bins)
        own.append((path, size))
        heapq.heappush(bins, (filled + size + OPEN_BYTES, k, own))
    return [tuple(own) for _, _, own in sorted(bins, key=lambda b: b[1])]


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class FileReader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("give a path")
        self.kind, self.path = kind, options["path"]
        self.bin_bytes = int(options.get("binbytes", BIN_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) in (("path",), ("name",)) and isinstance(f, (EqualTo, In, StringContains, StringEndsWith, StringStartsWith)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        holds = {
            EqualTo: lambda own, v: own == v, In: lambda own, v: own in v, StringContains: lambda own, v: v in own,
            StringEndsWith: str.endswith, StringStartsWith: str.startswith,
        }
        return all(holds[type(f)](path if f.attribute == ("path",) else stem(path), f.value) for f in self.tests)

    def partitions(self) -> list[InputPartition]:
        files = [f for f in listed(self.path, SUFFIXES[self.kind]) if self._wanted(f[0])]
        return [FileBin(b) for b in binned(files, self.bin_bytes)] or [FileBin(())]

    def read(self, partition: FileBin) -> Iterator[tuple]:
        for path, size in partition.files:
            with open(path, "rb") as file:
                yield path, stem(path), size, READERS[self.kind](file.read())


class FileWriter(DataSourceWriter):
    """Rows with name and text to one file each. Names are kept inside the folder; the last commit of a name wins."""

    def __init__(self, kind: str, options: dict[str, str], names: list[str], overwrite: bool):
        if not options.get("path"):
            raise ValueError("give a path")
        if not {"name", "text"} <= set(names):
            raise ValueError("the columns name and text are needed")
        self.path, self.suffix, self.overwrite = options["path"], SUFFIXES[kind][0], overwrite
        self.at = names.index("name"), names.index("text")
        self.aside = os.path.join(self.path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        own = os.path.join(self.aside, uuid.uuid4().hex)  # of one attempt of one task
        os.makedirs(own)
        files = []
        for row in iterator:
            name, text = row[self.at[0]], row[self.at[1]]
            if name is None or text is None:
                continue
            if not name or name in (".", "..") or "/" in name or "\0" in name or name.startswith("_"):
                raise ValueError(f"not a file name: {name!r}")
            target = os.path.join(own, name + self.suffix)
            with open(target, "w", encoding="utf-8", newline="") as file:
                file.write(text)
            files.append(target)
        return Written(tuple(files))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        new = [f for m in messages if m for f in m.files]
        kept = {os.path.basename(f) for f in new}
        if self.overwrite:
            for old, _ in listed(self.path, (self.suffix,)):
                if os.path.dirname(old) == self.path.rstrip("/") and os.path.basename(old) not in kept:
                    os.remove(old)
        for f in new:
            os.replace(f, os.path.join(self.path, os.path.basename(f)))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class _Songs(DataSource):
    kind: str

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.kind, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.kind, self.options, schema.names, overwrite)


class ChartSource(_Songs):
    kind = "song_chart"


class LyricSource(_Songs):
    kind = "song_lyric"


class ScoreSource(_Songs):
    kind = "song_score"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ChartSource, LyricSource, ScoreSource):
        spark.dataSource.register(source)

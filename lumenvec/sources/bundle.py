"""The single-file bundle: three to five Parquet parts, joined by a delimiter.

Parts in order: annotations, projection metadata, projection data, settings, statistics; the last two can be absent,
and a settings slot of no bytes keeps statistics in their place.

Reading is by ranges. Parts are found from the file's end: a footer tells where its part's data ends, so the delimiter before
the part is one short read away, whatever the file's size (``locate``). A partition then reads its own row group's chosen columns,
and row groups whose statistics exclude a filter make no partition. ``read_part`` does so on file systems that pyarrow opens on the
executors; on any other that Spark knows it streams the part into a Parquet file of its own first, on the JVM side.

A bundle is one file and is written by one task, so it is for results of bounded size (``MAX_BYTES``); large tables belong in
plain Parquet, which ``extract`` produces.
"""

from __future__ import annotations

import io
import json
import os
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lumenvec.sources.shared import file_system, fresh_path

#: Fixed values of the format.
DELIMITER = b"---PARQUET_DELIMITER---"
MAGIC = b"PAR1"
#: A part's metadata names the format's version under any key with this ending; writers take the key as an argument.
VERSION_ENDING, VERSION_KEY = b"_format_version", b"bundle_format_version"
PARTS = ("annotations", "metadata", "projections", "settings", "statistics")
MAX_BYTES = 500 << 20


def split_bundle(data: bytes) -> dict[str, bytes]:
    """The parts that are there, by name."""
    parts = data.split(DELIMITER)
    if not 3 <= len(parts) <= 5:
        raise ValueError(f"a bundle has 3 to 5 parts, not {len(parts)}")
    out = {n: p for n, p in zip(PARTS, parts, strict=False) if p or n in PARTS[:3]}
    for n, p in out.items():
        if p[:4] != MAGIC or p[-4:] != MAGIC:
            raise ValueError(f"part {n} is not Parquet")
    return out


def is_bundle(head: bytes) -> bool:
    """Whether bytes hold the delimiter."""
    return DELIMITER in head


def join_bundle(parts: Mapping[str, bytes]) -> bytes:
    """A bundle's bytes; trailing absent parts are left off, an absent part before a present one has no bytes."""
    missing = [n for n in PARTS[:3] if n not in parts]
    if missing:
        raise ValueError(f"parts {missing} are missing")
    for n, p in parts.items():
        if DELIMITER in p:
            raise ValueError(f"part {n} contains the delimiter")
    last = max(i for i, n in enumerate(PARTS) if n in parts)
    return DELIMITER.join(parts.get(n, b"") for n in PARTS[: last + 1])


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file's bytes from any file system that Spark knows, if its size is within the format's limit."""
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or size[0] > MAX_BYTES:
        raise ValueError(f"{path} is no bundle of at most {MAX_BYTES} bytes")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """The file replaced as a whole, on whichever file system it lies."""
    with tempfile.NamedTemporaryFile() as f:
        f.write(data)
        f.flush()
        fs, target = file_system(spark, path)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        aside = hadoop.Path(f"{path}.writing")
        fs.copyFromLocalFile(False, True, hadoop.Path(f"file://{f.name}"), aside)
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(aside, target):
            raise OSError(f"{path} could not be written")


# Ranges


Read = Callable[[int, int], bytes]
#: Bytes of a step of the search for a delimiter that isn't where the footer lets expect it (indexes and filters lie between).
STEP = 1 << 16


def _data_end(meta: pq.FileMetaData) -> int:
    """The last byte of a part's column chunks, from its start."""
    end = 4
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            col = meta.row_group(g).column(c)
            first = min((x for x in (col.dictionary_page_offset, col.data_page_offset) if x), default=0)  # an empty chunk has no page
            end = max(end, first + col.total_compressed_size)
    return end


def footer(read: Read, end: int) -> tuple[pq.FileMetaData, int]:
    """The metadata of the part that ends at ``end``, and the bytes that its footer takes."""
    tail = read(max(end - 8, 0), min(end, 8))
    if len(tail) < 8 or tail[4:] != MAGIC:
        raise ValueError(f"no Parquet part ends at byte {end}")
    size = int.from_bytes(tail[:4], "little") + 8
    if size > end:
        raise ValueError(f"the footer before byte {end} is longer than the file")
    return pq.read_metadata(pa.BufferReader(read(end - size, size))), size


def _start(read: Read, end: int) -> int:
    """Where the part that ends at ``end`` starts: at the file's start or after the last delimiter before its data."""
    meta, size = footer(read, end)
    high, mark = end - size - _data_end(meta), len(DELIMITER)  # the latest start that its data allow
    if high < 0:
        raise ValueError(f"the part before byte {end} is cut off")
    held, low = b"", high
    if high >= mark and read(high - mark, mark) == DELIMITER:
        return high
    while low > 0:
        step = min(STEP, low)
        low -= step
        held = read(low, step) + held[: mark - 1]
        if (found := held.rfind(DELIMITER)) >= 0:
            return low + found + mark
    return 0


def locate(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """Start and end of each part of a bundle of ``size`` bytes, from footers and the bytes before parts alone."""
    ends, mark = [], len(DELIMITER)
    end = size
    if size >= mark and read(size - mark, mark) == DELIMITER:
        raise ValueError("the last part is empty")
    while True:
        start = _start(read, end)
        if read(start, 4) != MAGIC:
            raise ValueError(f"the part at byte {start} is not Parquet")
        ends.append((start, end))
        if start == 0:
            break
        end = start - mark
        if end >= mark and read(end - mark, mark) == DELIMITER:  # a slot of no bytes
            ends.append((end, end))
            end -= mark
    ends.reverse()
    if not 3 <= len(ends) <= 5:
        raise ValueError(f"a bundle has 3 to 5 parts, not {len(ends)}")
    empty = [n for n, (a, b) in zip(PARTS, ends, strict=False) if a == b]
    if set(empty) - {"settings"}:
        raise ValueError(f"parts {empty} are empty")
    return {n: at for n, at in zip(PARTS, ends, strict=False) if n not in empty}


class Window(io.RawIOBase):
    """A stretch of a file as a file of its own; ``taken`` counts the bytes read."""

    def __init__(self, file: pa.NativeFile, start: int, end: int):
        self.file, self.start, self.size, self.at, self.taken = file, start, end - start, 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        out = self.file.read_at(n, self.start + self.at) if n > 0 else b""
        self.at += len(out)
        self.taken += len(out)
        return out


def _opened(path: str) -> pa.NativeFile:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def ranged(path: str) -> bool:
    """Whether pyarrow opens a path by itself, and so every executor can read ranges of it."""
    try:
        _opened(path).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


class Stream:
    """Ranges of a file of any file system that Spark knows, read by the driver's JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.fs, self.path = file_system(spark, path)
        self.size = self.fs.getFileStatus(self.path).getLen()

    def read(self, start: int, n: int) -> bytes:
        f = self.fs.open(self.path)
        try:
            f.seek(start)
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f, n)) if n else b""
        finally:
            f.close()

    def copy(self, start: int, end: int, to: str) -> None:
        """The bytes of a range as a file; they don't pass through Python."""
        fs, target = file_system(self.spark, to)
        out = fs.create(target, True)
        try:
            self.append(start, end, out)
        finally:
            out.close()

    def append(self, start: int, end: int, out) -> None:
        """The bytes of a range added to an open stream."""
        f = self.fs.open(self.path)
        try:
            f.seek(start)
            self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(f, out, 0, end - start)
        finally:
            f.close()


def format_version(table_or_schema: pa.Table | pa.Schema) -> int:
    """The format's version from a part's own metadata; 1 where it is absent or no number."""
    meta = (table_or_schema.schema if isinstance(table_or_schema, pa.Table) else table_or_schema).metadata or {}
    found = [v for k, v in meta.items() if k.endswith(VERSION_ENDING)]
    return int(found[0]) if found and found[0].isdigit() else 1


def stamp(table: pa.Table, version: int = 2, key: bytes = VERSION_KEY) -> pa.Table:
    return table.replace_schema_metadata({**(table.schema.metadata or {}), key: str(version).encode()})


def checked_size(*tables: DataFrame) -> None:
    """Raises, before anything is collected, where tables hold more bytes than a bundle may."""
    total = 0
    for t in tables:
        each = F.lit(0).cast("long")
        for c in t.columns:
            each = each + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
        total += t.agg(F.sum(each)).first()[0] or 0
    if total > MAX_BYTES:
        raise ValueError(f"{total} bytes are more than the {MAX_BYTES} of a bundle; write plain Parquet instead")


def _parquet(table: pa.Table) -> bytes:
    out = io.BytesIO()
    pq.write_table(table, out)
    return out.getvalue()


def settings_table(settings: Mapping) -> pa.Table:
    return pa.table({"settings_json": [json.dumps(settings)]})


def write_bundle(path: str, annotations: DataFrame, metadata: DataFrame, projections: DataFrame, settings: Mapping | None = None, statistics: DataFrame | None = None, version_key: bytes = VERSION_KEY) -> None:
    """Tables as a bundle of bounded size; annotation columns become text with blanks for nulls, and the part is stamped."""
    checked_size(annotations, metadata, projections, *([statistics] if statistics is not None else []))
    text = annotations.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in annotations.columns])
    parts = {"annotations": _parquet(stamp(text.toArrow(), key=version_key)), "metadata": _parquet(metadata.toArrow()), "projections": _parquet(projections.toArrow())}
    if settings is not None:
        parts["settings"] = _parquet(settings_table(settings))
    if statistics is not None:
        parts["statistics"] = _parquet(statistics.toArrow())
    write_bytes(annotations.sparkSession, path, join_bundle(parts))


def replace_part(data: bytes, name: str, table: pa.Table | None) -> bytes:
    """A bundle with one part replaced (or taken out); all others stay byte for byte."""
    parts = split_bundle(data)
    if table is None:
        parts.pop(name, None)
    else:
        parts[name] = _parquet(table)
    return join_bundle(parts)


def replace_in(spark: SparkSession, path: str, to: str, name: str, table: pa.Table | None) -> None:
    """A bundle with one part replaced (or taken out) as a new file; the others are copied as they are, outside Python's memory."""
    stream = Stream(spark, path)
    old = locate(stream.read, stream.size)
    names = [n for n in PARTS if (n in old or n == name) and not (n == name and table is None)]
    if table is not None and DELIMITER in (new := _parquet(table)):
        raise ValueError(f"part {name} contains the delimiter")
    if set(PARTS[:3]) - set(names):
        raise ValueError("the first three parts can't be taken out")
    fs, target = file_system(spark, to)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}.writing")
    out = fs.create(aside, True)
    try:
        for k, n in enumerate(PARTS[: PARTS.index(names[-1]) + 1]):
            if k:
                out.write(bytearray(DELIMITER))
            if n == name and n in names:
                out.write(bytearray(new))
            elif n in names:
                stream.append(*old[n], out)
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{to} could not be written")


def extract(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Each part of a bundle as a Parquet file in ``folder``; the paths, which Spark reads like any others."""
    stream = Stream(spark, path)
    fs, p = file_system(spark, folder)
    fs.mkdirs(p)
    out = []
    for n, (start, end) in locate(stream.read, stream.size).items():
        out.append(f"{folder.rstrip('/')}/{n}.parquet")
        stream.copy(start, end, out[-1])
    return out


def _excluded(f: Filter, stats: Mapping[str, pq.Statistics]) -> bool:
    """Whether a row group's statistics leave no row for a filter."""
    s = stats.get(f.attribute[0]) if len(f.attribute) == 1 else None
    if s is None:
        return False
    if isinstance(f, IsNotNull):
        return s.has_null_count and s.num_values == 0
    if not s.has_min_max or isinstance(s.min, bytes):
        return False
    low, high = s.min, s.max
    try:
        if isinstance(f, EqualTo):
            return f.value < low or f.value > high
        if isinstance(f, In):
            return all(v is None or v < low or v > high for v in f.value)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return high < f.value or (isinstance(f, GreaterThan) and high == f.value)
        if isinstance(f, (LessThan, LessThanOrEqual)):
            return low > f.value or (isinstance(f, LessThan) and low == f.value)
    except TypeError:
        pass
    return False


class RowGroup(InputPartition):
    """A row group of a part: where the part lies in the file, which group, and the path."""

    def __init__(self, path: str, start: int, end: int, group: int):
        self.path, self.start, self.end, self.group = path, start, end, group


class BundleReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.path, self.part, self.columns = options["path"], options.get("part", "annotations"), schema.fieldNames()
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters choose row groups by their statistics; Spark still applies each of them to the rows."""
        self.filters = [f for f in filters if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull))]
        yield from filters

    def partitions(self) -> Sequence[InputPartition]:
        start, end, meta = _part(self.path, self.part)
        out = []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns)) if c.is_stats_set}
            if not any(_excluded(f, stats) for f in self.filters):
                out.append(RowGroup(self.path, start, end, g))
        return out

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as file:
            part = pq.ParquetFile(pa.PythonFile(Window(file, partition.start, partition.end)), pre_buffer=False)
            for batch in part.iter_batches(row_groups=[partition.group], columns=self.columns):
                yield batch.select(self.columns)


def _part(path: str, part: str) -> tuple[int, int, pq.FileMetaData]:
    with _opened(path) as file:
        read = lambda start, n: file.read_at(n, start)
        found = locate(read, file.size())
        if part not in found:
            raise ValueError(f"{path} has no part {part}")
        return *found[part], footer(read, found[part][1])[0]


class BundleSource(DataSource):
    """After ``register``: ``spark.read.format("bundle").option("part", "projections").load(path)``: a partition for each row group; with
    ``.schema(...)`` only the columns named there are read."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_part(self.options["path"], self.options.get("part", "annotations"))[2].schema.to_arrow_schema())

    def reader(self, schema: StructType) -> DataSourceReader:
        return BundleReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand filters to Python sources."""
    spark.dataSource.register(BundleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_part(spark: SparkSession, path: str, part: str = "annotations", columns: Sequence[str] | None = None) -> DataFrame:
    """A part of a bundle, or some of its columns, from any file system that Spark knows."""
    if ranged(path):
        register(spark)
        reader = spark.read.format("bundle").option("part", part)
        if columns is not None:
            whole = reader.load(path).schema
            reader = reader.schema(StructType([whole[c] for c in columns]))
        return reader.load(path)
    stream = Stream(spark, path)
    found = locate(stream.read, stream.size)
    if part not in found:
        raise ValueError(f"{path} has no part {part}")
    to = f"{fresh_path(spark, 'part')}/{part}.parquet"
    stream.copy(*found[part], to)
    df = spark.read.parquet(to)
    return df.select(*columns) if columns is not None else df


def number_kind(df: DataFrame, column: str) -> str:
    """The narrowest of int, bigint and double that holds a numeric column's values."""
    c = F.col(column)
    r = df.agg(F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True)).alias("whole"), F.max(F.abs(c)).alias("most")).first()
    return "double" if not r["whole"] or (r["most"] or 0) > 9007199254740991 else "int" if (r["most"] or 0) <= 2147483647 else "bigint"


def serialize(df: DataFrame, labels: list[str], numeric: list[str]) -> DataFrame:
    """Label arrays as cells (missing ones null) and numbers in their narrowest type."""
    out = df.withColumns({c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.array_join(c, ";")) for c in labels})
    return out.withColumns({c: F.col(c).cast(number_kind(df, c)) for c in numeric})

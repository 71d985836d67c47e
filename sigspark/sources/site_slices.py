"""Slices of site stores: the lines of the wanted ids, found in a byte index, are all that is read.

``data.index`` says of each id in which file of ``data.json`` its line is and which bytes it takes. The data source ``site_slices`` takes
equality and ``in`` filters on ``idx``, plans tasks over the byte ranges of those ids only, and reads nothing else. Without such a filter it reads every line.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sigspark.sources import commits
from sigspark.sources.lines import line_spans

SITES = "idx string, position long, kmer string, y array<double>"
#: Bytes that a task reads, about.
TASK_BYTES = 32 << 20
_ROWS = pa.schema([("idx", pa.string()), ("position", pa.int64()), ("kmer", pa.string()), ("y", pa.list_(pa.float64()))])


def index_of(spark: SparkSession, store: str) -> DataFrame:
    """(idx, start, end, file) of a site store's lines."""
    key = F.regexp_extract("value", r'^\s*\{\s*"((?:[^"\\]|\\.)*)"', 1)
    idx = F.from_json(F.concat(F.lit('["'), key, F.lit('"]')), "array<string>")[0]
    spans = line_spans(spark, store, idx=F.when(F.trim("value") != "", idx))
    return spans.filter("idx is not null").select("idx", "start", "end", "file")


def write_index(spark: SparkSession, store: str, path: str) -> None:
    """data.index beside a site store that is written: idx, start, end, file."""
    index_of(spark, store).write.mode("overwrite").option("header", True).csv(path)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


@dataclass
class Ranges(InputPartition):
    file: str
    #: First byte and end of each range.
    ranges: list[tuple[int, int]]

    def __post_init__(self) -> None:
        self.value = None


class SliceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.indexes: list[str] = json.loads(options["indexes"])
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("idx",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = wanted if self.ids is None else self.ids & wanted
            else:
                yield f

    def entries(self) -> Iterator[tuple[str, int, int]]:
        """(file, first byte, end) of the wanted ids' lines."""
        wanted = None if self.ids is None else pa.array(sorted(x for x in self.ids if x is not None), pa.string())
        kinds = csv.ConvertOptions(column_types={"idx": pa.string(), "start": pa.int64(), "end": pa.int64(), "file": pa.string()}, strings_can_be_null=False)
        for index in self.indexes:
            system, path = _opened(index)
            for part in system.get_file_info(fs.FileSelector(path)):
                if not part.is_file or part.base_name.startswith(("_", ".")) or not part.size:
                    continue
                for batch in csv.open_csv(system.open_input_stream(part.path), parse_options=csv.ParseOptions(escape_char="\\", newlines_in_values=True), convert_options=kinds):
                    rows = batch if wanted is None else batch.filter(pc.is_in(batch.column("idx"), wanted))
                    yield from zip(rows.column("file").to_pylist(), rows.column("start").to_pylist(), rows.column("end").to_pylist(), strict=True)

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        size = 0
        for file, start, end in sorted(self.entries()):
            if not out or out[-1].file != file or size + end - start > TASK_BYTES:
                out.append(Ranges(file, []))
                size = 0
            own = out[-1].ranges
            if own and own[-1][1] == start:
                own[-1] = own[-1][0], end
            else:
                own.append((start, end))
            size += end - start
        return out or [Ranges("", [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, path = _opened(partition.file)
        with system.open_input_file(path) as file:
            for start, end in partition.ranges:
                for line in file.read_at(end - start, start).splitlines():
                    for idx, positions in json.loads(line).items():
                        rows = [(idx, int(p), kmer, y) for p, kmers in positions.items() for kmer, y in kmers.items()]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)


class SiteSlices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_slices"

    def schema(self) -> str:
        return SITES

    def reader(self, schema) -> SliceReader:  # noqa: ANN001
        return SliceReader(self.options)


def read_slices(spark: SparkSession, folder: str, ids: Sequence[str] | None = None) -> DataFrame:
    """(idx, position, kmer, y) of a folder's store, through its index; filters on ``idx`` decide which bytes are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SiteSlices)
    rows = spark.read.format("site_slices").option("indexes", json.dumps(commits.paths(spark, f"{folder}/data.index"))).load()
    return rows if ids is None else rows.filter(F.col("idx").isin(*ids))


def planned_bytes(indexes: Sequence[str], ids: Sequence[str] | None = None) -> int:
    """Bytes of the store that reading these ids takes."""
    reader = SliceReader({"indexes": json.dumps(list(indexes))})
    reader.ids = None if ids is None else set(ids)
    return sum(end - start for p in reader.partitions() for start, end in p.ranges)

"""A stream source whose offset is a sequence number: an archive is swept first, then the live tail is followed.

Archive and tail are folders of Parquet files with a column `seq`.  A batch is a range of numbers, cut into ranges of
`step`, each a task that reads the files which overlap it.  Up to the archive's last number rows come from the archive,
beyond it from the tail, so what the tail repeats of the archive is not read; what it repeats of itself lies in one range
and is dropped there.  The checkpoint holds the number; a query that starts again goes on after it, wherever it stopped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there; a bare path is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Range(InputPartition):
    """Numbers above lo up to hi, and the files that may hold them."""

    lo: int
    hi: int
    files: tuple[str, ...]


class SequenceReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        self.archive, self.tail = options["archive"], options["tail"]
        self.after, self.until = int(options.get("after", 0)), options.get("until")
        self.step = int(options.get("step", 100_000))
        self.known: dict[str, tuple[int, int]] = {}

    def _spans(self, folder: str) -> dict[str, tuple[int, int]]:
        """First and last number of each file, from its footer, which is read once."""
        fs, at = _opened(folder)
        found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        out = {}
        for f in found:
            if f.base_name.startswith(("_", ".")) or not f.base_name.endswith(".parquet"):
                continue
            if f.path not in self.known:
                meta = pq.read_metadata(f.path, filesystem=fs)
                place = meta.schema.to_arrow_schema().get_field_index("seq")
                stats = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups)]
                if not stats:
                    continue
                self.known[f.path] = (min(s.min for s in stats), max(s.max for s in stats))
            out[f.path] = self.known[f.path]
        return out

    def initialOffset(self) -> dict:
        return {"seq": self.after}

    def latestOffset(self) -> dict:
        last = max([self.after, *(hi for folder in (self.archive, self.tail) for _, hi in self._spans(folder).values())])
        return {"seq": min(last, int(self.until)) if self.until else last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        archive, tail = self._spans(self.archive), self._spans(self.tail)
        seam = max((hi for _, hi in archive.values()), default=self.after)
        out = []
        for files, lo, hi in ((archive, start["seq"], min(end["seq"], seam)), (tail, max(start["seq"], seam), end["seq"])):
            for a in range(lo, hi, self.step):
                b = min(a + self.step, hi)
                held = tuple(sorted(f for f, (first, last) in files.items() if first <= b and last > a))
                if held:
                    out.append(Range(a, b, held))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.archive)
        seq = ds.field("seq")
        table = ds.dataset(list(partition.files), filesystem=fs, format="parquet").to_table(columns=self.columns, filter=(seq > partition.lo) & (seq <= partition.hi))
        numbers = table["seq"].combine_chunks()
        first = pa.table({"seq": numbers, "at": pa.array(range(len(numbers)), pa.int64())}).group_by("seq").aggregate([("at", "min")])
        yield from table.take(pc.array_take(first["at_min"].combine_chunks(), pc.array_sort_indices(first["seq"].combine_chunks()))).to_batches()

    def commit(self, end: dict) -> None:
        pass


class SequenceLog(DataSource):
    """format("sequence_log"): options archive, tail, columns (DDL with `seq` long); after, until and step are optional."""

    @classmethod
    def name(cls) -> str:
        return "sequence_log"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema: StructType) -> SequenceReader:
        return SequenceReader(schema, dict(self.options))

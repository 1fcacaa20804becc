"""The ledger as a stream: a source that follows a folder by segment and byte, and folds kept batch by batch.

A file source takes a file once and misses what is appended to it later; this one's offsets are (segment, byte), so it
reads exactly the whole rows that were added, each segment by a task of its own; no row passes the driver. Folds guard by position: a batch that comes again changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from quillfold.operators import state
from quillfold.schema import TAPE
from quillfold.sources.tape import scan_segment, segment_name
from quillfold.sources.writer import segments


class TapeStreamSource(DataSource):
    """Register with spark.dataSource.register, then readStream.format("quillfold_tape").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "quillfold_tape"

    def schema(self) -> str:
        return TAPE

    def streamReader(self, schema) -> DataSourceStreamReader:
        """Segments are read by tasks, each its own. With ``maxBytes`` the driver reads instead, so many bytes at a time."""
        if "maxBytes" in self.options:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader with maxBytes"})
        return TapePartitionReader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TapeStreamReader(self.options["path"], int(self.options.get("maxBytes", 8 << 20)))


class SegmentRange(InputPartition):
    """The rows of a segment that begin at or after one byte and end before another."""

    def __init__(self, first: int, start: int, stop: int):
        self.first, self.start, self.stop = first, start, stop


class TapePartitionReader(DataSourceStreamReader):
    """Offsets are (segment, byte) behind a whole row; the driver looks at names, sizes and the end of the last segment only."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, first: int) -> str:
        return os.path.join(self.folder, segment_name(first))

    def initialOffset(self) -> dict:
        return {"segment": -1, "byte": 0}

    def latestOffset(self) -> dict:
        for first in reversed(segments(self.folder)):
            if stop := whole_rows(self._path(first)):
                return {"segment": first, "byte": stop}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[SegmentRange]:
        out = []
        for first in segments(self.folder):
            if start["segment"] <= first <= end["segment"]:
                low = start["byte"] if first == start["segment"] else 0
                high = end["byte"] if first == end["segment"] else whole_rows(self._path(first))
                if low < high:
                    out.append(SegmentRange(first, low, high))
        return out

    def read(self, partition: SegmentRange) -> Iterator[tuple]:
        with open(self._path(partition.first), "rb") as f:
            lines, left = 0, partition.start
            while left:
                part = f.read(min(left, 1 << 20))
                lines, left = lines + part.count(b"\n"), left - len(part)
            data = f.read(partition.stop - partition.start)
        for row in scan_segment(data, partition.first):
            yield (*row[:11], row[11] + lines, row[12])

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are past."""


def whole_rows(path: str, window: int = 64 << 10) -> int:
    """The byte behind the last newline, 0 if there is none; looked for from the end, in windows."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end:
            begin = max(0, end - window)
            f.seek(begin)
            if (at := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return 0


class TapeStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes = folder, max_bytes

    def initialOffset(self) -> dict:
        return {"segment": -1, "byte": 0, "line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start, end)[0])

    def _rows(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        at, out, left = dict(start), [], self.max_bytes
        for first in segments(self.folder):
            if first < at["segment"] or end is not None and first > end["segment"]:
                continue
            if first > at["segment"]:
                at = {"segment": first, "byte": 0, "line": 0}
            with open(os.path.join(self.folder, segment_name(first)), "rb") as f:
                f.seek(at["byte"])
                stop = end["byte"] - at["byte"] if end is not None and first == end["segment"] else left if end is None else -1
                data = f.read(stop)
                # As many bytes as asked for: the segment may have more, and the next one isn't begun before its end.
                more = end is None and len(data) == stop
                if more and b"\n" not in data:
                    data += f.readline()
                    more = data.endswith(b"\n")
            data = data[: data.rfind(b"\n") + 1]
            for row in scan_segment(data, first):
                out.append((*row[:11], row[11] + at["line"], row[12]))
            at = {"segment": first, "byte": at["byte"] + len(data), "line": at["line"] + data.count(b"\n")}
            left -= len(data)
            if more or end is None and left <= 0:
                break
        return out, at


class CellsFold:
    """Cells and caps kept in a folder, one version for each batch; a batch that was folded already is skipped.

    A version has the batch's own cells only; a cell's state is its row in the latest version that has one. Every
    ``MERGED`` versions one is written with all cells, and those before it go when the next batch comes. A version is
    whole before the pointer to it stands, so a batch is applied once whatever fails: the facts are the pointer and come
    last, after the caps and the mark, which has the position of the last cap period tick and the version to read from.
    """

    MERGED = 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _versions(self) -> list[int]:
        path = self._path()
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path(n, "facts", "_SUCCESS")))

    def _read(self, version: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{version}/{part}")

    def _since(self) -> list[int]:
        """The versions that make up the state."""
        found = self._versions()
        return [v for v in found if v >= self._read(found[-1], "mark").first()["base"]] if found else []

    def last(self) -> DataFrame | None:
        """The latest fact of each cell as of the last batch, with opened_ns and pos_last."""
        return self._state(self._since())

    def _state(self, versions: list[int]) -> DataFrame | None:
        if not versions:
            return None
        rows = None
        for v in versions:
            own = self._read(v, "facts").withColumn("_version", F.lit(v))
            rows = own if rows is None else rows.unionByName(own)
        if len(versions) == 1:
            return rows.drop("_version")
        columns = [c for c in rows.columns if c not in ("cell", "_version")]
        return rows.groupBy("cell").agg(F.max_by(F.struct(*columns), "_version").alias("r")).select("cell", "r.*")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch, over a stream of tape rows."""
        since = self._since()
        if since and batch_id <= since[-1]:
            return
        self._prune(since)
        mark = self._read(since[-1], "mark").first() if since else None
        rows = batch.where("scan_reason is null")
        facts = state.delivered_once(state.facts_of(rows))
        facts = facts.select("pos", "idx", "t_epoch_ns", "cell", "cls", "source_pos", "amount_minor", "due_ns", "state", "flags", F.col("t_epoch_ns").alias("opened_ns"), F.col("pos").alias("pos_last"), F.lit(True).alias("fresh")).persist()
        whole = self._state(since)
        if whole is not None:
            touched = facts.select("cell").distinct()
            old = whole.join(touched, "cell", "left_semi")
            # Redelivered positions: those at or below what a cell has seen.
            seen = old.select(F.col("cell").alias("_c"), F.col("pos_last").alias("_seen"))
            new = facts.join(seen, F.col("cell") == F.col("_c"), "left").where("_seen is null or pos > _seen").drop("_c", "_seen")
            judged = old.withColumn("fresh", F.lit(False)).select(facts.columns).unionByName(new)
        else:
            judged = facts
        judged = state.replayed(judged).persist()
        order = F.struct("pos", "idx")
        applied = F.when(F.col("verdict") == "applied", order)
        row = F.struct("pos", "idx", "t_epoch_ns", "cls", "source_pos", "amount_minor", "due_ns", "state", "flags")
        latest = judged.groupBy("cell").agg(F.max_by(row, applied).alias("r"), F.min_by("opened_ns", order).alias("opened_ns"), F.max("pos_last").alias("pos_last")).select("cell", "r.*", "opened_ns", "pos_last")
        before = mark["last_tick"] if mark else -1
        tick = max(before, state.last_cap_tick(rows))
        # A cell's last fact stands for what it added before; only the batch's own facts add to it.
        caps = state.increases(judged).where("fresh").where(F.col("pos") > tick).select("cls", F.col("increase").alias("cap_used"))
        if mark and tick == before:
            caps = self._read(since[-1], "caps").unionByName(caps)
        merge = not since or len(since) >= self.MERGED
        if merge and whole is not None:
            latest = whole.join(touched, "cell", "left_anti").unionByName(latest)
        base = batch_id if merge else mark["base"]
        put = lambda df, part: df.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/{part}")
        put(caps.groupBy("cls").agg(F.sum("cap_used").alias("cap_used")), "caps")
        put(self.spark.range(1).select(F.lit(tick).cast("long").alias("last_tick"), F.lit(base).cast("long").alias("base")), "mark")
        put(latest, "facts")
        judged.unpersist()
        facts.unpersist()

    def _prune(self, since: list[int]) -> None:
        """Versions before the merged one that the state begins with."""
        for v in self._versions():
            if since and v < since[0]:
                path = self._path(v)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cells(self) -> DataFrame:
        last = self.last()
        return last.select("cell", "cls", "amount_minor", "due_ns", "state", "flags", F.col("source_pos").alias("src_pos_last"), "opened_ns", "pos_last")

    def caps(self) -> DataFrame:
        """Exposure used by class since the last cap period tick."""
        return self._read(self._versions()[-1], "caps")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TapeStreamSource)
    return spark.readStream.format("quillfold_tape").option("path", folder).load()



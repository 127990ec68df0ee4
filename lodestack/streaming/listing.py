"""A listing of files as a stream: each file once, as it comes, and after a restart from where the stream was.

    spark.dataSource.register(ListingSource)
    spark.readStream.format("listing").option("suffixes", ".png,.jpg").load("/data/images")
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestack.operators.pairing import IMAGE_SUFFIXES
from lodestack.sources.volumes import located

#: Files that one task tells of.
FILES_A_TASK = 10_000


class Files(InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        super().__init__(len(rows))
        self.rows = rows


class ListingReader(DataSourceStreamReader):
    """Files in order of (time of their last change, path); an offset is the last file told of, so the checkpoint holds one name however many there are.

    A file that is changed is told of again. One that comes with an older time than what was told of already (moved in with its time kept) is not seen.
    """

    def __init__(self, options: dict) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.root = given["path"]
        self.suffixes = tuple((given.get("suffixes") or ",".join(IMAGE_SUFFIXES)).lower().split(","))
        self.recursive = given.get("recursive", "true").lower() == "true"

    def _listed(self) -> list[tuple[int, str, int]]:
        system, at = located(self.root)
        found = system.get_file_info(pafs.FileSelector(at, recursive=self.recursive))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(self.suffixes))

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._listed()
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        rows = [(path, size, changed // 1000) for changed, path, size in self._listed() if low < (changed, path) <= high]
        return [Files(rows[k : k + FILES_A_TASK]) for k in range(0, len(rows), FILES_A_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch, so there is nothing to let go."""


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, size bigint, changed_us bigint"

    def streamReader(self, schema: object) -> ListingReader:
        return ListingReader(self.options)

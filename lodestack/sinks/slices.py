"""A Spark data source that writes sections with their labels: images/<split>/<name>.png and labels/<split>/<name>.txt, both or neither.

    spark.dataSource.register(SliceSink)
    rows.write.format("slices").mode("append").save("/data/set")

Tasks write below a folder of the job's own; only when all have ended well are the files moved to their places. A task or job that fails leaves nothing there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestack.operators.imaging import section_bytes
from lodestack.operators.outlines import label_lines, with_outlines
from lodestack.operators.pairing import slice_name
from lodestack.sinks.files import png
from lodestack.sources.volumes import located

#: What a set holds, by folder: the end of its names, and the ends of names that are cleared when a set is written anew.
ENDS = {"images": ".png", "labels": ".txt"}
CLEARED = (".png", ".jpg", ".jpeg", ".txt")
#: Files that are moved at a time; the folder that tells tasks that their job goes on; quarters of a second that a failed job waits for its tasks to end.
MOVERS, BEGUN, QUIET = 16, "begun", 6


@dataclass
class Written(WriterCommitMessage):
    """The names (split/name) that a task has written below its folder."""

    folder: str
    names: list[str]


class SliceWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"
        system, at = self._folder()
        system.create_dir(f"{at}/{self.pending}/{BEGUN}", recursive=True)

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return located(self.root)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = self._folder()
        own, names, made = f"{root}/{self.pending}/{TaskContext.get().taskAttemptId()}", [], set()
        for row in iterator:
            split, name = row["split"], row["name"]
            if "/" in name or "/" in split or name.startswith("."):
                raise ValueError(f"{split}/{name} is no name of a file")
            values = bytes(row["values"])
            if len(values) != row["height"] * row["width"]:
                raise ValueError(f"{name} has {len(values)} values instead of {row['height']} x {row['width']}")
            label = "".join(f"{line}\n" for line in row["labels"] or [])
            if system.get_file_info(f"{root}/{self.pending}/{BEGUN}").type == pafs.FileType.NotFound:
                raise RuntimeError("the job has ended")
            for kind, data in (("images", png(values, row["width"], row["height"])), ("labels", label.encode())):
                folder = f"{own}/{kind}/{split}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/{name}{ENDS[kind]}") as out:
                    out.write(data)
            names.append(f"{split}/{name}")
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._folder()
        done = [m for m in messages if m is not None]
        splits = {n.split("/")[0] for m in done for n in m.names}
        for kind in ENDS:
            for split in splits:
                system.create_dir(f"{root}/{kind}/{split}", recursive=True)
            if self.overwrite:
                old = system.get_file_info(pafs.FileSelector(f"{root}/{kind}", recursive=True, allow_not_found=True))
                for f in old:
                    if f.is_file and f.path.lower().endswith(CLEARED):
                        system.delete_file(f.path)
        moves = [(f"{m.folder}/{kind}/{n}{end}", f"{root}/{kind}/{n}{end}") for m in done for n in m.names for kind, end in ENDS.items()]
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the job's folder. Tasks that still run find it gone and end; what they have written meanwhile goes, too."""
        self._clear()
        for _ in range(QUIET):
            time.sleep(0.25)
            self._clear()

    def _clear(self) -> None:
        system, root = self._folder()
        if system.get_file_info(f"{root}/{self.pending}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.pending}")


class SliceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slices"

    def schema(self) -> str:
        return "split string, name string, height int, width int, values array<int>, labels array<string>"

    def writer(self, schema: StructType, overwrite: bool) -> SliceWriter:
        return SliceWriter(self.options["path"], overwrite)


def slice_rows(pairs: DataFrame, split: Column, volume: Column) -> DataFrame:
    """(split, name, height, width, values, labels) of paired sections (volumes.paired_slices()): grey values over the robust range, label lines of the fault mask. No shuffle."""
    rows = pairs.select(split.alias("split"), slice_name(volume, F.col("slice_idx")).alias("name"), "height", "width", section_bytes(F.col("seis")).alias("values"), "fault")
    found = with_outlines(rows, "fault")
    return found.withColumn("labels", label_lines(F.col("outlines"), F.col("height"), F.col("width"))).drop("fault", "outlines")


def write_slices(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """slice_rows() as files below root; with overwrite, images and labels of earlier runs go when the new ones are whole."""
    rows.sparkSession.dataSource.register(SliceSink)
    columns = ["split", "name", "height", "width", "values", "labels"]
    rows.select(*columns).write.format("slices").mode("overwrite" if overwrite else "append").save(root)

"""Binary planes read by byte range, as a Spark data source in Python.

A file is cut into splits of rows; a task reads the bytes of its rows, its columns and its bands only, so a plane can be larger than memory (or
2 GB), and a bounding box costs its own bytes. Files are reached through Arrow's file systems (local paths, hdfs, s3, gs).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a split.
SPLIT = 32 << 20
#: Bytes of one band that a task holds at a time.
HELD = 4 << 20


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Rows(InputPartition):
    """Rows [first, last) of one grid: the files of its bands, each with the number of the plane in its file, and the grid's rows and columns."""

    def __init__(self, grid: str, planes: list[tuple[str, int]], rows: int, columns: int, first: int, last: int):
        self.grid, self.planes, self.rows, self.columns, self.first, self.last = grid, planes, rows, columns, first, last


class PlaneReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.grids = json.loads(options["grids"])
        self.names = json.loads(options["names"])
        self.kind, self.flip, self.no_data = np.dtype(options["kind"]), options["flip"] == "true", float(options["no_data"])
        self.split, self.box = int(options["split"]), dict(json.loads(options["box"]))

    def _span(self, axis: str, size: int) -> tuple[int, int]:
        return max(0, self.box.get(f"{axis}_min", 0)), min(size, self.box.get(f"{axis}_max", size))

    def partitions(self):
        out = []
        for g in self.grids:
            rows, columns = g["rows"], g["columns"]
            i0, i1 = self._span("i", rows)
            if self._span("j", columns)[0] >= self._span("j", columns)[1]:
                continue
            if self.flip:  # i counts from the last row of the file
                i0, i1 = rows - i1, rows - i0
            step = max(1, self.split // (columns * self.kind.itemsize * len(g["planes"])))
            out += [Rows(g["id"], [tuple(p) for p in g["planes"]], rows, columns, k, min(k + step, i1)) for k in range(i0, i1, step)]
        return out

    def ranges(self, part: Rows, plane: int, first: int, last: int) -> list[tuple[int, int]]:
        """Offset and length of what holds rows [first, last) of the box in a plane: one range for whole rows, else one for each row."""
        j0, j1 = self._span("j", part.columns)
        at = lambda i: ((plane * part.rows + i) * part.columns + j0) * self.kind.itemsize
        if j1 - j0 == part.columns:
            return [(at(first), (last - first) * part.columns * self.kind.itemsize)]
        return [(at(i), (j1 - j0) * self.kind.itemsize) for i in range(first, last)]

    def read(self, partition: Rows):
        part = partition
        if part is None:  # a box without rows
            return
        j0, j1 = self._span("j", part.columns)
        step = max(1, HELD // ((j1 - j0) * self.kind.itemsize))
        opened = {}
        for path, _ in part.planes:
            if path not in opened:
                system, name = file_system(path)
                opened[path] = system.open_input_file(name)
        try:
            for first in range(part.first, part.last, step):
                last = min(first + step, part.last)
                values = []
                for path, plane in part.planes:
                    raw = b"".join(opened[path].read_at(length, offset) for offset, length in self.ranges(part, plane, first, last))
                    values.append(np.frombuffer(raw, self.kind).astype(float).reshape(last - first, j1 - j0))
                stack = np.stack(values)
                stack = np.where(stack > self.no_data, stack, np.nan)
                i, j = np.nonzero(~np.isnan(stack).all(axis=0))
                own = part.rows - 1 - (i + first) if self.flip else i + first
                columns = [pa.array([part.grid] * len(i), pa.string()), pa.array(own, pa.int32()), pa.array(j + j0, pa.int32())]
                columns += [pa.array(stack[m, i, j], from_pandas=True) for m in range(len(part.planes))]
                if len(i):
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "i", "j", *self.names])
        finally:
            for f in opened.values():
                f.close()


class Planes(DataSource):
    """The data source ``driftgrid_planes``."""

    @classmethod
    def name(cls) -> str:
        return "driftgrid_planes"

    def schema(self) -> str:
        return "id string, i int, j int, " + ", ".join(f"{n} double" for n in json.loads(self.options["names"]))

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(self.options)


def read_plane_files(
    spark: SparkSession, grids: list[dict], names: tuple[str, ...], kind: str = ">f4", box: dict[str, int] | None = None, flip: bool = False, no_data: float = -1.9e9, split: int = SPLIT
) -> DataFrame:
    """Cells id, i, j and names of grids, each a dict of id, rows, columns and planes: for each of names the file and the number of the plane in it.

    box has any of i_min, i_max, j_min, j_max (ends excluded). Only the bands in names are opened. Cells without data in all of them have no row.
    """
    spark.dataSource.register(Planes)
    options = {"grids": json.dumps(grids), "names": json.dumps(list(names)), "kind": kind, "flip": str(flip).lower(), "no_data": str(no_data), "split": str(split), "box": json.dumps(box or {})}
    return spark.read.format("driftgrid_planes").options(**options).load()


def grid_files(path: str, columns: int, bands: tuple[str, ...], kind: str = ">f4", together: bool = False) -> list[dict]:
    """The grids of a folder: <id>.<band>, or with together <id>.<ending> with all bands one after another; rows follow from the size of a file."""
    from pyarrow import fs

    system, name = file_system(path)
    width, found = columns * np.dtype(kind).itemsize, {}
    base = path[: len(path) - len(name)] if path.endswith(name) else ""
    for info in system.get_file_info(fs.FileSelector(name)):
        stem, _, band = info.base_name.rpartition(".")
        if not info.is_file or not stem or not (together or band in bands):
            continue
        if info.size % (width * (len(bands) if together else 1)):
            raise ValueError(f"{info.path} doesn't hold whole rows of {columns} columns")
        own = found.setdefault(stem, {"id": stem, "columns": columns, "planes": {}, "rows": set()})
        own["rows"].add(info.size // width // (len(bands) if together else 1))
        own["planes"] |= {b: (base + info.path, k) for k, b in enumerate(bands)} if together else {band: (base + info.path, 0)}
    out = []
    for g in found.values():
        if set(g["planes"]) != set(bands) or len(g["rows"]) != 1:
            raise ValueError(f"{g['id']} lacks bands, or their sizes differ")
        out.append(g | {"rows": g["rows"].pop(), "planes": [g["planes"][b] for b in bands]})
    return sorted(out, key=lambda g: g["id"])

"""Places of the layers of layered pictures (PSD and PSB files), without their pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quiltframe.sources.canvas import _filesystem

SCHEMA = "path string, layer int, name string, top int, left int, bottom int, right int, width int, height int, error string"


class NotLayered(ValueError):
    pass


def records(stream) -> Iterator[tuple]:
    """layer, name, top, left, bottom, right, and the picture's width and height, in the order of the file; reads the records only."""

    def take(n: int) -> bytes:
        out = stream.read(n)
        if len(out) < n:
            raise NotLayered("the file ends early")
        return out

    number = lambda kind: struct.unpack(">" + kind, take(struct.calcsize(">" + kind)))[0]
    if take(4) != b"8BPS":
        raise NotLayered("not a layered picture")
    version = number("H")
    if version not in (1, 2):
        raise NotLayered(f"version {version}")
    take(8)
    height, width = number("I"), number("I")
    take(4)
    for _ in range(2):  # colours, resources
        stream.seek(number("I"), 1)
    size = "I" if version == 1 else "Q"
    if not number(size) or not number(size):
        return
    for layer in range(abs(number("h"))):
        top, left, bottom, right = struct.unpack(">4i", take(16))
        take(number("H") * (6 if version == 1 else 10))
        if take(4) != b"8BIM":
            raise NotLayered(f"layer {layer} is damaged")
        take(8)
        rest = take(number("I"))
        at = 0
        for _ in range(2):  # mask, blending
            at += 4 + struct.unpack_from(">I", rest, at)[0]
        n = rest[at]
        name = rest[at + 1 : at + 1 + n].decode("latin-1")
        at += (n + 4) // 4 * 4
        while at + 12 <= len(rest):  # further blocks: one of them holds the whole name
            key, long = rest[at + 4 : at + 8], struct.unpack_from(">I", rest, at + 8)[0]
            if key == b"luni":
                n = struct.unpack_from(">I", rest, at + 12)[0]
                name = rest[at + 16 : at + 16 + 2 * n].decode("utf-16-be")
            at += 12 + long + long % 2
        yield layer, name.rstrip("\0"), top, left, bottom, right, width, height


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _LayerReader(DataSourceReader):
    """A partition for each file whose name fits the pattern; the others are never opened."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[_File]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == FileType.File and f.extension.lower() in ("psd", "psb") and fnmatchcase(f.base_name, self.pattern)]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.path) as stream:
            try:
                for layer, name, *place in records(stream):
                    yield (partition.path, layer, name, *place, None)
            except (NotLayered, struct.error, IndexError, UnicodeDecodeError) as e:
                yield (partition.path, None, None, None, None, None, None, None, None, str(e))


class Layers(DataSource):
    """``spark.read.format("layers").load(folder)``: a row for each layer of each .psd and .psb file; a file that can't be read (further) gives a row with its error. Option ``files`` takes a pattern of file names."""

    @classmethod
    def name(cls) -> str:
        return "layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _LayerReader:
        return _LayerReader(self.options["path"], self.options.get("files", "*"))


def in_reading_order(layers, scope: str = "path", pattern: str = r"(?i)^gun_\d+_(.+)$"):
    """scope, place, code, columns, rows: the layers whose name fits ``pattern``, from the top, then from the left; code is the lower-cased group of the pattern."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = layers.where(F.col("error").isNull() & F.col("name").rlike(pattern)).withColumn("code", F.lower(F.regexp_extract("name", pattern, 1)))
    sizes = rows.groupBy(scope).agg(F.countDistinct("left").alias("columns"), F.countDistinct("top").alias("rows"))
    place = F.row_number().over(Window.partitionBy(scope).orderBy("top", "left", "code", "layer")) - 1
    return rows.withColumn("place", place).join(sizes, scope).select(scope, "place", "code", "columns", "rows")

"""Pictures made of placed rectangles, and their files."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quiltframe.operators.grouped import per_group
from quiltframe.sources.looking import painted


def drawn(shapes: DataFrame, scope: str, width: int, height: int) -> DataFrame:
    """One image row per scope: its shapes (z, x, y, w, h, colour as 0xRRGGBB, data or null) painted in the order of z.

    data holds BGR bytes of w times h pixels and goes before the colour. What lies outside the picture is cut off. A picture is one group.
    """
    kinds = dict(shapes.dtypes)

    def paint(key, z, x, y, w, h, colour, data):
        return [key], np.array([painted(height, width, z, x, y, w, h, colour, data).tobytes()], object)

    rows = per_group(shapes, scope, ["z", "x", "y", "w", "h", "colour", "data"], paint, f"{scope} {kinds[scope]}, data binary")
    image = F.struct(F.col(scope).cast("string").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data")
    return rows.select(scope, image.alias("image"))


def png(bgr: np.ndarray) -> bytes:
    """A picture as a PNG file: 8 bits a channel, rows without a filter."""
    h, w = bgr.shape[:2]
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = bgr[..., ::-1].reshape(h, 3 * w)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray | None:
    """BGR pixels of a PNG of 8 bits a channel that isn't interlaced; None for anything else, also for damaged files."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette, head = 8, [], None, None
    try:
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if len(body) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            at += 12 + n
        w, h, depth, kind, _, _, woven = head
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
        if depth != 8 or woven:
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    except (TypeError, KeyError, ValueError, struct.error, zlib.error):
        return None
    out, above = np.zeros((h, w, n), np.uint8), np.zeros((w, n), int)
    for y in range(h):
        rule, line = raw[y, 0], raw[y, 1:].reshape(w, n).astype(int)
        if rule == 1:
            line = np.cumsum(line, axis=0) & 255
        elif rule == 2:
            line = (line + above) & 255
        elif rule in (3, 4):
            left, corner = np.zeros(n, int), np.zeros(n, int)
            for x in range(w):
                if rule == 3:
                    guess = (left + above[x]) // 2
                else:
                    near = np.stack([left, above[x], corner])
                    guess = np.take_along_axis(near, np.abs(near - (left + above[x] - corner)).argmin(0)[None], 0)[0]
                left, corner = (line[x] + guess) & 255, above[x]
                line[x] = left
        elif rule > 4:
            return None
        out[y] = above = line
    if kind == 3:
        out = palette[out[..., 0]] if palette is not None and out.max(initial=0) < len(palette) else None
    elif kind in (0, 4):
        out = np.repeat(out[..., :1], 3, axis=2)
    return None if out is None else np.ascontiguousarray(out[..., 2::-1])


def unpnm(data: bytes) -> np.ndarray | None:
    """BGR pixels of a binary grey or colour map (P5, P6) of at most 255 values a channel; None for anything else, also for cut files."""
    head = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head:
        return None
    n, w, h, most = {b"5": 1, b"6": 3}[head[1]], *(int(v) for v in head.group(2, 3, 4))
    raw = data[head.end() : head.end() + w * h * n]
    if not 0 < most < 256 or not w * h or len(raw) < w * h * n:
        return None
    out = np.frombuffer(raw, np.uint8).reshape(h, w, n)
    if most < 255:
        out = (out.clip(0, most).astype(int) * 255 // most).astype(np.uint8)
    return np.ascontiguousarray(np.repeat(out, 3, axis=2) if n == 1 else out[..., ::-1])


class _Done(WriterCommitMessage):
    """A task's number; the names of its files are in a list that it wrote beside them."""

    def __init__(self, task: str):
        self.task = task


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: How many files are given their names at once.
AT_ONCE = 16


class _FileWriter(DataSourceWriter):
    """A task writes its files under a name of its own, in a hidden folder of this run; they get theirs when all tasks have succeeded, or go with that folder.

    The names stay in a list of the task in that folder, so that the driver is sent nothing but the task's number; it holds 8 bytes of a file while it looks for equal
    names, and one list at a time. A task that is still writing when others have failed may bring the hidden folder back; readers don't see it.
    """

    def __init__(self, path: str, overwrite: bool, encode: Callable[[Row], tuple[str, bytes]]):
        self.path, self.overwrite, self.encode, self.run = path, overwrite, encode, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Done:
        fs, root = _filesystem(self.path)
        task, names, hidden = uuid.uuid4().hex, [], f"{root}/.writing-{self.run}"
        try:
            fs.create_dir(hidden, recursive=True)
            for i, row in enumerate(iterator):
                name, content = self.encode(row)
                if any(p in ("", ".", "..") or p.startswith(".") for p in name.split("/")) or "\\" in name or "\0" in name:
                    raise ValueError(f"not a file name: {name!r}")
                names.append(name)
                with fs.open_output_stream(f"{hidden}/{task}-{i}") as out:
                    out.write(content)
            with fs.open_output_stream(f"{hidden}/{task}-names") as out:
                out.write("\0".join(names).encode())
        except BaseException:
            from pyarrow.fs import FileType

            for held in [*(f"{hidden}/{task}-{i}" for i in range(len(names))), f"{hidden}/{task}-names"]:
                if fs.get_file_info(held).type != FileType.NotFound:
                    fs.delete_file(held)
            raise
        return _Done(task)

    def commit(self, messages: list[_Done | None]) -> None:
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow.fs import FileSelector, FileType

        fs, root = _filesystem(self.path)
        hidden = f"{root}/.writing-{self.run}"
        tasks = [m.task for m in messages if m]

        def names(task: str) -> list[str]:
            with fs.open_input_stream(f"{hidden}/{task}-names") as f:
                return [n for n in f.read().decode().split("\0") if n]

        mark = lambda n: int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest())
        folders, marks, there = set(), [np.empty(0, np.uint64)], []
        for task in tasks:
            own = names(task)
            folders |= {n.rpartition("/")[0] for n in own}
            marks.append(np.fromiter(map(mark, own), np.uint64, len(own)))
            if not self.overwrite and own:
                there += [f.path for f in fs.get_file_info([f"{root}/{n}" for n in own]) if f.type != FileType.NotFound][:5]
        held = np.sort(np.concatenate(marks))
        twice = set(held[1:][held[1:] == held[:-1]].tolist())
        if twice and not there:  # names of one hash need not be equal
            seen: set[str] = set()
            for name in (n for task in tasks for n in names(task) if mark(n) in twice):
                there += [name] if name in seen and len(there) < 5 else []
                seen.add(name)
        if there:
            self.abort(messages)
            raise ValueError(f"files of one name, or files that exist: {sorted(set(there))[:5]}")
        for folder in folders:
            fs.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for task in tasks:
                own = names(task)
                for _ in pool.map(lambda x: fs.move(f"{hidden}/{task}-{x[0]}", f"{root}/{x[1]}"), enumerate(own)):
                    pass
        self.abort([])

    def abort(self, messages: list[_Done | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/.writing-{self.run}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/.writing-{self.run}")


def _needs(schema, *names: str) -> None:
    missing = set(names) - set(schema.names)
    if missing:
        raise ValueError(f"the columns {sorted(missing)} are missing")


class Files(DataSource):
    """``df.write.format("files").save(folder)``: a file for each row (name, which may have folders, and content).

    Mode append refuses files that exist, mode overwrite replaces them; other files of the folder stay. The folder
    may be in any store that pyarrow reaches.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        _needs(schema, "name", "content")
        return _FileWriter(self.options["path"], overwrite, lambda row: (row["name"] or "", bytes(row["content"] or b"")))


class Pictures(DataSource):
    """``df.write.format("pictures").save(folder)``: a PNG file for each row (name without its ending, width, height, data as BGR bytes); else as :class:`Files`."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        _needs(schema, "name", "width", "height", "data")
        encode = lambda row: (f"{row['name'] or '.'}.png", png(np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)))
        return _FileWriter(self.options["path"], overwrite, encode)


def decoded(files: DataFrame, *decoders: Callable[[bytes], np.ndarray | None]) -> DataFrame:
    """path, width, height, data (BGR bytes; all null where no decoder reads it) of files (path, content), by the first of ``decoders`` that reads it, else by those of this module."""
    import pandas as pd

    tried = decoders or (unpng, unpnm)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [None if c is None else next((p for d in tried if (p := d(bytes(c))) is not None), None) for c in b["content"]]
            yield pd.DataFrame({
                "path": b["path"],
                "width": pd.array([None if p is None else p.shape[1] for p in found], "Int32"),
                "height": pd.array([None if p is None else p.shape[0] for p in found], "Int32"),
                "data": [None if p is None else p.tobytes() for p in found],
            })

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, data binary")


def contents(files: DataFrame) -> DataFrame:
    """path, content of the files named by ``path``: tasks read them, and no folder is listed. A file that isn't there ends the job."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 500):
                out = []
                for path in b["path"].iloc[a : a + 500]:
                    fs, at = _filesystem(path)
                    with fs.open_input_stream(at) as f:
                        out.append((path, f.read()))
                yield pd.DataFrame(out, columns=["path", "content"])

    return files.select("path").mapInPandas(run, "path string, content binary")


def pictures(spark: SparkSession, path: str, *decoders: Callable[[bytes], np.ndarray | None]) -> DataFrame:
    """One image row per file below ``path``, as the image source gives them; what it can't read goes through ``decoders`` (see :func:`decoded`).

    A file that nothing reads gives an invalid row (width -1); an empty one gives none, since scans leave empty files out. Paths meet by a join; the contents of files are read a second time for it, since a scan of
    files can't be limited to paths that other rows name.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image")
    read = images.where("image.width >= 0").select(plain(F.col("image.origin")).alias("__p"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    again = decoded(files.join(read, plain(F.col("path")) == F.col("__p"), "left_anti"), *decoders)
    image = F.struct(
        F.col("path").alias("origin"), F.coalesce("height", F.lit(-1)).alias("height"), F.coalesce("width", F.lit(-1)).alias("width"),
        F.when(F.col("width").isNotNull(), 3).otherwise(-1).alias("nChannels"), F.when(F.col("width").isNotNull(), 16).otherwise(-1).alias("mode"), F.coalesce("data", F.lit(b"")).alias("data"),
    )
    return images.where("image.width >= 0").unionByName(again.select(image.alias("image")))

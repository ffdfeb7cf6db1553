"""Export requests, one in each file, as a Python data source, for batches and for streams.

``spark.dataSource.register(ExportRequests)``, then ``spark.readStream.format("export_requests").load(folder)`` gives
(path, bytes, body, reason): the request's JSON, or null with the reason why it was refused. Nothing is dropped unseen.
Options: ``wire`` and ``unpacked``, the most bytes of a file as it lies there and after gzip, and ``together``, the bytes
that one task is dealt (a single file may have more).

A stream's offset is the last name that it has read, so names are to rise, as those of a rolling writer do (by time or
number); a restart goes on behind the checkpoint's name and reads each request once. Hidden files (``_`` or ``.`` in front)
are none. Folders are read through ``pyarrow.fs``, so any address that it knows will do. A task holds one request.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Most bytes of a request as sent, and unpacked.
WIRE_BYTES, UNPACKED_BYTES = 4 * 1024 * 1024, 64 * 1024 * 1024
TOGETHER_BYTES = 64 * 1024 * 1024


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def _filesystem(folder: str):
    import os

    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def _unpacked(data: bytes, most: int) -> bytes | None:
    """What gzip ``data`` holds, all members of it, or None beyond ``most`` bytes; never more than those is unpacked."""
    out = b""
    while data:
        z = zlib.decompressobj(31)
        out += z.decompress(data, most + 1 - len(out))
        if len(out) > most:
            return None
        if not z.eof:
            raise zlib.error("ends early")
        data = z.unused_data
    return out


class _Folder:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.wire, self.most, self.together = (int(options.get(k, d)) for k, d in (("wire", WIRE_BYTES), ("unpacked", UNPACKED_BYTES), ("together", TOGETHER_BYTES)))

    def listed(self, after: str = "", upto: str | None = None) -> list[tuple[str, int]]:
        """(path, size) of the files behind a name, by name."""
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        found = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name[0] not in "_."]
        return sorted((f.path, f.size or 0) for f in found if f.base_name > after and (upto is None or f.base_name <= upto))

    def dealt(self, files: list[tuple[str, int]]) -> list[Files]:
        """Neighbouring files together, up to so many bytes."""
        parts, size = [], 0
        for path, n in files:
            if not parts or size + n > self.together:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def rows(self, part: Files) -> Iterator[tuple]:
        system, _ = _filesystem(self.folder)
        for path in part.paths:
            with system.open_input_stream(path, compression=None) as f:
                data = f.read(self.wire + 1)
            body, reason = data, None
            if len(data) > self.wire:
                body, reason = None, "wire"
            elif data[:2] == b"\x1f\x8b":
                try:
                    body = _unpacked(data, self.most)
                    reason = "unpacked" if body is None else None
                except zlib.error:
                    body, reason = None, "gzip"
            try:
                text = None if body is None else body.decode()
            except UnicodeDecodeError:
                text, reason = None, "utf8"
            yield path, len(data), text, reason


class _Batch(_Folder, DataSourceReader):
    def partitions(self):
        return self.dealt(self.listed())

    def read(self, partition):
        return self.rows(partition) if isinstance(partition, Files) else iter(())


class _Stream(_Folder, DataSourceStreamReader):
    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        files = self.listed()
        return {"after": files[-1][0].rsplit("/", 1)[-1] if files else ""}

    def partitions(self, start, end):
        return self.dealt(self.listed(start["after"], end["after"]))

    def read(self, partition):
        return self.rows(partition)


class ExportRequests(DataSource):
    @classmethod
    def name(cls):
        return "export_requests"

    def schema(self):
        return "path string, bytes long, body string, reason string"

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Requests in the shape that ``otlp`` flattens; those refused, or no JSON of that shape, are left out (see ``reason``)."""
    body: Column = F.from_json("body", schema)
    return rows.where("reason is null").select(body.alias("r")).where("r is not null").select("r.*")

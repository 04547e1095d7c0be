"""Files that are still being written, as a stream: every reader starts at byte 0 and gets what is there, as it comes.

A file ``name`` grows until ``name.complete`` or ``name.failed`` (whose text is the reason) stands beside it; then its last bytes
come, and one row that says how it ended: a failed file is an error row and not a failed query.  Register ``SpoolSource`` and read the
format ``spool`` with the option ``path``, a folder of any store that pyarrow's file systems reach.

Offsets are the bytes known of each file, so a restarted query goes on where it was; pieces of at most ``piece`` bytes are read by the
executors.  A file's end is kept in the offset until the folder has neither it nor its mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

COLUMNS = "name string, at long, content binary, state string, error string"
ENDS = ("complete", "failed")
PIECE = 1 << 20


class Span(InputPartition):
    """Bytes of a file, or its end."""

    def __init__(self, name: str, at: int, length: int, state: str):
        self.name, self.at, self.length, self.state = name, at, length, state


class SpoolSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpoolReader(self.options["path"], int(self.options.get("piece", PIECE)))


class SpoolReader(DataSourceStreamReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """name -> [bytes, how it has ended or ""].  Marks are looked up before sizes: what has ended doesn't grow."""
        store, folder = self.place()
        listed = lambda: {f.base_name: f.size for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file}
        before, now = listed(), listed()
        names = [n for n in now if not n.endswith(ENDS) and not n.startswith((".", "_"))]
        return {n: [now[n], next((e for e in ENDS if f"{n}.{e}" in before), "")] for n in sorted(names)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name, (size, state) in end.items():
            known, told = start.get(name, [0, ""])
            out += [Span(name, at, min(self.piece, size - at), "data") for at in range(known, size, self.piece)]
            if state and not told:
                out.append(Span(name, size, 0, state))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        store, folder = self.place()
        content, error = b"", None
        if partition.state == "failed":
            with store.open_input_stream(f"{folder}/{partition.name}.failed") as f:
                error = f.read().decode("utf-8", "replace") or "failed"
        elif partition.length:
            with store.open_input_file(f"{folder}/{partition.name}") as f:
                content = f.read_at(partition.length, partition.at)
        schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("content", pa.binary()), ("state", pa.string()), ("error", pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((partition.name, partition.at, content, partition.state, error), schema, strict=True)], schema=schema)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass

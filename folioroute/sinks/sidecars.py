"""Text files as a sink: one file per row, each there as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folioroute import constants as K
from folioroute.sources.files import open_filesystem

# Folders whose file systems a task keeps; rows of many folders come in turn.
_OPEN_FOLDERS = 1_000


class SidecarFiles(DataSource):
    """Rows of ``sidecar_path, text`` to UTF-8 files with a byte order mark.

    The path given to ``save`` goes before all file paths.
    """

    @classmethod
    def name(cls) -> str:
        return "folioroute_sidecars"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options.get("path", ""), schema.names)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    """A file is written under another name beside its place and moved there when
    it is complete. A task that is repeated, or a run, replaces its own files,
    so nothing has to be remembered on the driver but how many there were."""

    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root.rstrip("/"), columns

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        path_at, text_at = self.columns.index("sidecar_path"), self.columns.index("text")
        opened: dict[str, tuple] = {}
        files = 0
        for row in iterator:
            folder, name = (self.root + row[path_at]).rsplit("/", 1)
            if folder not in opened:
                if len(opened) >= _OPEN_FOLDERS:
                    opened.clear()
                opened[folder] = open_filesystem(folder)
                opened[folder][0].create_dir(opened[folder][1])
            system, plain = opened[folder]
            self._put(system, f"{plain}/{name}", f"{plain}/.{uuid.uuid4().hex}.part", row[text_at])
            files += 1
        return _Written(files)

    @staticmethod
    def _put(system, path: str, part: str, text: str) -> None:
        try:
            with system.open_output_stream(part) as stream:
                stream.write((K.BYTE_ORDER_MARK + text).encode("utf-8"))
            system.move(part, path)
        except BaseException:
            if system.get_file_info(part).is_file:
                system.delete_file(part)
            raise

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing is left to do: every file is in place."""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of finished tasks are whole and the same in the next run; unfinished ones have removed their parts."""

"""A sink of one ``patch_<id>.diff`` file per prediction.

Each attempt of a task writes into a staging folder of its own. When all tasks have
succeeded, the files of the attempts that Spark accepted are moved into place; what
other attempts wrote, of lost or repeated tasks, goes with the staging folder. Paths are
opened by Arrow's file systems: a local or mounted folder, or a URI that Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "patch_files"
MOVERS = 16


def file_name(instance_id: str) -> str:
    """What cannot stand in a file name is percent-encoded, and the percent sign."""
    return f"patch_{re.sub(r'[%/\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', instance_id)}.diff"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class PatchFileWriter(DataSourceWriter):
    def __init__(self, path: str, run: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging/{run}"

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        system, top = self._opened()
        folder = f"{self.staging}/{uuid4().hex}"
        system.create_dir(f"{top}/{folder}")
        names: set[str] = set()
        for instance_id, patch in iterator:
            name = file_name(instance_id)
            if name in names:
                raise ValueError(f"several patches of {instance_id}")
            names.add(name)
            with system.open_output_stream(f"{top}/{folder}/{name}") as out:
                out.write((patch or "").encode())
        return Written(folder, sorted(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, top = self._opened()
        moves = {}
        for message in messages:
            for name in message.names if message else []:
                if name in moves:
                    raise ValueError(f"several patches of {name}")
                moves[name] = f"{top}/{message.folder}/{name}"
        if self.overwrite:
            present = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
            for old in present:
                if old.is_file and re.match(r"patch_.*\.diff\Z", old.base_name) and old.base_name not in moves:
                    system.delete_file(old.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda name: system.move(moves[name], f"{top}/{name}"), moves))
        self._clean(system, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._opened())

    def _clean(self, system: fs.FileSystem, top: str) -> None:
        if system.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.staging}")


class PatchFiles(DataSource):
    """``df.write.format("patch_files")`` for rows of (instance_id, patch), each id once."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PatchFileWriter:
        if schema.fieldNames() != ["instance_id", "patch"]:
            raise ValueError(f"patch files take (instance_id, patch), not {schema.fieldNames()}")
        return PatchFileWriter(self.options["path"], uuid4().hex, overwrite)

"""Sets of tables that change together: data folders, and manifests that say which of them count.

Below a set's path, data/ holds Parquet folders that are written once and never changed, and versions/ a manifest for each version: the folders of each table. A
manifest is written last, under a name that no other writer can take, so a reader sees all tables of a version or none of it, whenever a writer stops; who takes a version's number second
reads the new one and applies its change to that. A folder may have a tag; a change that brings a folder of the same tag replaces it, so a batch that is done again counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: table -> its folders, as (path below the set, tag).
Tables = dict[str, list[list[str]]]


class Set(NamedTuple):
    """A set of tables below a path that driver and executors share."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """The names in a folder of the set; none if it isn't there."""
        where, fs = self._fs(f"{self.path}/{folder}" if folder else self.path)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.names("versions") if x.endswith(".json") and not x.startswith("."))

    def tables(self, version: int | None = None) -> Tables:
        """Of a version, the last one by default. No version yet: no tables."""
        have = self.versions()
        if version is None and not have:
            return {}
        if version is not None and version not in have:
            raise ValueError(f"{self.path} has no version {version}")
        where, fs = self._fs(f"{self.path}/versions/{have[-1] if version is None else version}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _claimed(self, version: int, tables: Tables) -> bool:
        """Whether the manifest of this version is now ours."""
        draft, fs = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        whole = fs.makeQualified(draft)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration()).rename(whole, fs.makeQualified(self._fs(f"{self.path}/versions/{version}.json")[0]), none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def write(self, df: DataFrame) -> str:
        """Writes a folder that counts for nothing until a commit names it."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, replace: Mapping[str, DataFrame] | None = None, add: Mapping[str, DataFrame] | None = None, tag: str | None = None) -> int:
        """The next version: `replace` tables have these rows alone, `add` tables these too (in place of earlier ones of the tag), all others are as before."""
        new = {t: self.write(df) for t, df in {**(replace or {}), **(add or {})}.items()}
        while True:
            have, tables = self.versions(), self.tables()
            for table, folder in new.items():
                old = [] if table in (replace or {}) else [x for x in tables.get(table, []) if tag is None or x[1] != tag]
                tables[table] = [*old, [folder, tag or ""]]
            if self._claimed(version := (have[-1] + 1 if have else 0), tables):
                return version

    def paths(self, table: str, version: int | None = None) -> list[str]:
        return [f"{self.path}/{folder}" for folder, _ in self.tables(version).get(table, [])]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table's rows, of columns that any of its folders has."""
        paths = self.paths(table, version)
        if not paths:
            raise ValueError(f"{self.path} has no table {table}")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last `keep`, and the data folders that none of those names; call it when no writer is at work. How many folders went."""
        have = self.versions()
        last = have[-keep:]
        live = {folder for v in last for folders in self.tables(v).values() for folder, _ in folders}
        for v in have[:-keep]:
            where, fs = self._fs(f"{self.path}/versions/{v}.json")
            fs.delete(where, False)
        dead = [x for x in self.names("data") if f"data/{x}" not in live]
        for x in dead:
            where, fs = self._fs(f"{self.path}/data/{x}")
            fs.delete(where, True)
        return len(dead)

"""Loads that readers see whole or not at all (K1, K2).

A load writes its rows to a folder of its own; nothing that is published is
overwritten.  A manifest under the root names the folders that count for each
(table, edition).  Publishing writes the next manifest, one small file that is
created whole under a number not used before, so a load of many tables and
editions takes effect at once, a load that stops halfway changes nothing, and
a reader keeps the state it has opened.  Two loads that publish at the same
time take turns: the later one builds on the earlier one's state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from microstar.operators.quality import REJECT_COL

STATUS, GOOD, REJECTED = "_status", "good", "rejected"
#: Files that a writing task keeps open at once; with more statuses and editions it sorts the rest of its rows.
OPEN_FILES = 16


@dataclass(frozen=True)
class Staged:
    """A written load of one table: its folder, the schema of its rows, its edition column (if any)."""
    table: str
    folder: str
    schema: str
    edition_column: str | None = None


class Publication:
    """The published tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------- manifest ----

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _exists(self, path: str) -> bool:
        fs, folder = self._fs(path)
        return fs.exists(folder)

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(f"{self.root}/_manifest")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def state(self) -> tuple[int, dict]:
        """(number of the manifest, table -> edition -> list of staged loads); 0 and empty before the first load.

        A manifest that is not readable to its end belongs to a load that
        stopped while publishing: the one before it counts.
        """
        for number in reversed(self._numbers()):
            fs, path = self._fs(f"{self.root}/_manifest/{number:09d}.json")
            stream = fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return number, json.loads(text)["tables"]
            except (ValueError, KeyError):
                continue
        return 0, {}

    def publish(self, loads: Iterable[tuple[Staged, Iterable[str]]], append: bool = False) -> int:
        """Make staged loads count, each for its editions: in place of what counted there (K1) or, with ``append``, beside it (K2)."""
        loads = [(s, [str(e) for e in editions]) for s, editions in loads]
        while True:
            _, tables = self.state()
            for staged, editions in loads:
                entry = {"folder": staged.folder, "schema": staged.schema, "edition_column": staged.edition_column}
                for edition in editions:
                    held = tables.setdefault(staged.table, {})
                    held[edition] = [*held.get(edition, []), entry] if append else [entry]
            number = max(self._numbers(), default=0) + 1
            if self._create(f"{self.root}/_manifest/{number:09d}.json", json.dumps({"tables": tables})):
                return number

    def _create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet; False if another load was first."""
        fs, target = self._fs(path)
        try:
            out = fs.create(target, False)
        except Exception:  # noqa: BLE001 - the Java error of an existing file differs between file systems
            if fs.exists(target):
                return False
            raise
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        return True

    # ---------------------------------------------------------- loads ----

    def stage(self, checked: DataFrame, table: str, edition_column: str | None = None) -> Staged:
        """Write checked rows (with ``_reject_reason``) once, good and rejected ones apart; nothing is published."""
        folder = f"{self.root}/{table}/load-{uuid.uuid4().hex[:16]}"
        status = F.when(F.col(REJECT_COL).isNull(), GOOD).otherwise(REJECTED)
        parts = [STATUS] + ([edition_column] if edition_column else [])
        # a file open for each status and edition, so that the wide rows need not be sorted by them
        writers, before = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        self.spark.conf.set(writers, str(OPEN_FILES))
        try:
            # the folder's name shows an edition, and keeps it apart from a null one
            checked.withColumn(STATUS, status).write.partitionBy(*parts).parquet(folder)
        finally:
            self.spark.conf.set(writers, before)
        return Staged(table, folder, checked.schema.json(), edition_column)

    def rows(self, staged: Staged, status: str = GOOD, editions: Iterable[str] | None = None) -> DataFrame:
        """Rows of a staged load: without the reason if good, with it if rejected; of all editions or the given ones."""
        schema = StructType.fromJson(json.loads(staged.schema))
        base = f"{staged.folder}/{STATUS}={status}"
        if self._exists(base):
            found = self.spark.read.schema(schema).option("basePath", base).parquet(base)
        else:
            found = self.spark.createDataFrame([], schema)
        if editions is not None and staged.edition_column:
            found = found.where(F.col(staged.edition_column).isin([str(e) for e in editions]))
        found = found.select(*schema.names)
        return found.drop(REJECT_COL) if status == GOOD else found

    def editions(self, table: str) -> list[str]:
        return sorted(self.state()[1].get(table, {}))

    def loads(self, table: str, editions: Iterable[str] | None = None) -> list[tuple[Staged, list[str]]]:
        """Published loads of a table, each with the editions for which it counts."""
        wanted = None if editions is None else {str(e) for e in editions}
        held: dict[str, tuple[Staged, list[str]]] = {}
        for edition, entries in sorted(self.state()[1].get(table, {}).items()):
            if wanted is None or edition in wanted:
                for e in entries:
                    held.setdefault(e["folder"], (Staged(table, e["folder"], e["schema"], e["edition_column"]), []))[1].append(edition)
        return list(held.values())

    def read(self, table: str, editions: Iterable[str] | None = None, status: str = GOOD) -> DataFrame:
        """The published rows of a table, of all editions or the given ones (a filter that prunes folders)."""
        loads = self.loads(table, editions)
        if not loads:
            raise LookupError(f"{self.root}: nothing is published for {table}" + (f", editions {sorted(map(str, editions))}" if editions else ""))
        return reduce(lambda a, b: a.unionByName(b), [self.rows(s, status, of) for s, of in loads])

    def vacuum(self) -> list[str]:
        """Remove load folders that the newest manifest does not name; no load or older reader may be running."""
        number, tables = self.state()
        kept = {e["folder"].rsplit("/", 1)[1] for t in tables.values() for entries in t.values() for e in entries}
        fs, top = self._fs(self.root)
        gone = []
        for table in (fs.listStatus(top) if fs.exists(top) else []):
            if table.isDirectory() and not table.getPath().getName().startswith("_"):
                for load in fs.listStatus(table.getPath()):
                    name = load.getPath().getName()
                    if name.startswith("load-") and name not in kept:
                        fs.delete(load.getPath(), True)
                        gone.append(f"{table.getPath().getName()}/{name}")
        return sorted(gone)


def published(spark: SparkSession, root: str, table: str) -> bool:
    """Whether any edition of a table is published under the root."""
    return bool(Publication(spark, root).editions(table))

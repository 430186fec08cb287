"""A commit log of runs on files.

A run writes its tables below folders of its own. Nobody sees them until one small commit record names them,
and from then on everybody does: the record is created under the next free number, which only one writer can do.
Tables are read as of a commit, so a reader's view does not move while others publish.

``<path>/commits/<number>.json``  run, parent, and per table its folder, rows and columns
``<path>/data/<table>/attempt=<run>-<nonce>/``  what one attempt of a run wrote
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_RECORD = (
    "number int, run_id string, parent int, "
    "tables array<struct<name: string, folder: string, rows: bigint, columns: string, replaces: boolean, "
    "low: string, high: string>>"
)


class Conflict(RuntimeError):
    """Another run was committed first; what was derived from the older state must be derived again."""


@dataclass(frozen=True)
class Commit:
    number: int
    run_id: str
    parent: int
    tables: tuple[dict, ...]


class RunLog:
    """Committed runs below ``path``, a folder that every executor reaches.

    A record is written aside and moved to its number, whole or not at all. The folder's file system must refuse
    to move a file onto another, as HDFS does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        folder = self._hadoop(f"{self.path}/commits")
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(folder)
        self._known: list[Commit] = []  # commits never change, so those once read need no second look

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    # Reading ---------------------------------------------------------------
    def commits(self, at: int | None = None) -> list[Commit]:
        """Commits up to number ``at`` in order: one small record a run."""
        if at is None or not self._known or at > self._known[-1].number:
            rows = self.spark.read.schema(_RECORD).option("pathGlobFilter", "*.json").json(f"{self.path}/commits").collect()
            found = [Commit(r["number"], r["run_id"], r["parent"], tuple(t.asDict() for t in r["tables"])) for r in rows]
            self._known = sorted(found, key=lambda c: c.number)
        return [c for c in self._known if at is None or c.number <= at]

    def head(self) -> int:
        """Number of the last commit, 0 before any."""
        return max((c.number for c in self.commits()), default=0)

    def committed(self, run_id: str) -> Commit | None:
        return next((c for c in self.commits() if c.run_id == run_id), None)

    def table(
        self, name: str, at: int | None = None, since: int = 0, schema: StructType | str | None = None,
        within: tuple[str | None, str | None] = (None, None),
    ) -> DataFrame:
        """Rows of a table as of commit ``at`` (the last one), of commits after ``since`` only.

        A commit that replaces the table ends what stood before it. A table nobody has written is empty if
        ``schema`` is given. ``within`` leaves out commits whose rows, by the table's span column, all lie outside
        the two ends; rows of the others still need the filter.
        """
        folders, columns = [], None
        for commit in self.commits(at):
            for t in commit.tables:
                if t["name"] != name:
                    continue
                columns = t["columns"]
                if t["replaces"]:
                    folders = []
                low, high = within
                apart = t["low"] is not None and ((low and t["high"] < low) or (high and t["low"] > high))
                if t["folder"] and commit.number > since and not apart:
                    folders.append(f"{self.path}/{t['folder']}")
        if columns is None and schema is None:
            raise KeyError(f"no committed run has written {name}")
        empty = self.spark.createDataFrame([], StructType.fromJson(json.loads(columns)) if columns is not None else schema)
        if not folders:
            return empty
        layout = empty.schema
        base = f"{self.path}/data/{name}"
        return self.spark.read.schema(layout).option("basePath", base).parquet(*folders).select(*layout.names)

    def listing(self, at: int | None = None) -> DataFrame:
        """``number, run_id, table, rows, replaces`` of every committed table."""
        rows = [(c.number, c.run_id, t["name"], t["rows"], t["replaces"]) for c in self.commits(at) for t in c.tables]
        return self.spark.createDataFrame(rows, "number int, run_id string, table string, rows bigint, replaces boolean")

    # Writing ---------------------------------------------------------------
    def stage(
        self, run_id: str, tables: dict[str, DataFrame], parts: dict[str, str] | None = None,
        replaces: tuple[str, ...] = (), spans: dict[str, str] | None = None,
    ) -> list[dict]:
        """Write the tables of a run, unseen. ``parts`` names the column that a table's files are laid out by.

        ``spans`` names a column (text, date or time) whose least and greatest value the commit remembers.
        """
        if not re.fullmatch(r"[\w.-]+", run_id):
            raise ValueError("a run id holds letters, digits, '.', '_' and '-'")
        nonce, out = uuid.uuid4().hex, []
        for name, df in tables.items():
            folder, part = f"data/{name}/attempt={run_id}-{nonce}", (parts or {}).get(name)
            target = f"{self.path}/{folder}"
            if part:
                # Rows of one part are written together, split where they are many.
                df.hint("rebalance", part).write.partitionBy(part).parquet(target)
                columns = StructType([f for f in df.schema if f.name != part] + [df.schema[part]])
            else:
                df.write.parquet(target)
                columns = df.schema
            written = self.spark.read.schema(columns).parquet(target)
            rows, low, high = written.count(), None, None  # the count is that of the files' footers
            if rows and name in (spans or {}):
                ends = F.min(spans[name]).cast("string"), F.max(spans[name]).cast("string")
                low, high = written.agg(*ends).first()
            out.append({
                "name": name, "folder": folder if rows else None, "rows": rows,
                "columns": json.dumps(columns.jsonValue()), "replaces": name in replaces, "low": low, "high": high,
            })
        return out

    def commit(self, run_id: str, staged: list[dict], parent: int) -> Commit:
        """Make staged tables visible, if ``parent`` is still the last commit."""
        number = parent + 1
        record = {"number": number, "run_id": run_id, "parent": parent, "tables": staged}
        aside = self._hadoop(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        mode = getattr(hadoop, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        try:
            context.rename(aside, self._hadoop(f"{self.path}/commits/{number:012d}.json"), modes)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict(f"commit {number} was taken by another run") from error
        return Commit(number, run_id, parent, tuple(staged))

    def publish(
        self, run_id: str, build: Callable[[int], dict[str, DataFrame]], parts: dict[str, str] | None = None,
        replaces: tuple[str, ...] = (), spans: dict[str, str] | None = None, attempts: int = 5,
    ) -> Commit:
        """Run ``build`` on the last commit and commit its tables; a run already committed is not run again.

        ``build`` gets the number of the commit it may read up to. It is called anew when another run was
        faster, so it must derive everything from that state and from its own input.
        """
        for _ in range(attempts):
            done = self.committed(run_id)
            if done is not None:
                return done
            parent = self.head()
            staged = self.stage(run_id, build(parent), parts, replaces, spans)
            try:
                return self.commit(run_id, staged, parent)
            except Conflict:
                continue
        raise Conflict(f"{run_id} lost to other runs {attempts} times")

    def compact(
        self, run_id: str, names: tuple[str, ...], parts: dict[str, str] | None = None,
        spans: dict[str, str] | None = None,
    ) -> Commit:
        """Rewrite tables of many runs as one; what reads see stays the same."""
        return self.publish(run_id, lambda at: {n: self.table(n, at) for n in names}, parts, names, spans)

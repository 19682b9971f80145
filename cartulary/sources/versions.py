"""Several tables changed as one: versions in a folder that readers see whole or not at all.

A run stages its tables in new folders and then puts one small file, the commit, which names the folder of every table.
Commits are numbered; the last one is what readers see. A run that dies before its commit leaves folders that nothing names.
Two runs that began at the same version can't both commit: the second finds its number taken and fails.

The commit appears by a rename that doesn't replace, which is atomic in HDFS and local file systems; stores without such a
rename need one that puts a file only where none is.
"""

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


class Versions:
    """The tables of a folder, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.java = spark._jvm.org.apache.hadoop.fs
        self.files = self.java.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.java.Path("/".join((self.folder, *parts)))

    def number(self) -> int:
        """The last committed version; 0 where there is none."""
        commits = self.path("commits")
        names = [f.getPath().getName() for f in self.files.listStatus(commits)] if self.files.exists(commits) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def folders(self, number: int | None = None) -> dict[str, str]:
        """The folder of every table at a version, the last by default."""
        number = self.number() if number is None else number
        if not number:
            return {}
        rows = self.spark.read.text(self.path("commits", f"{number:020d}.json").toString(), wholetext=True).collect()
        return json.loads(rows[0].value)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.folders(number)[name]}")

    @contextmanager
    def transaction(self):
        """Tables written inside come to stand together at the end; on an error none does. Tables that aren't written
        stay as they were when the transaction began."""
        change = Change(self, self.number())
        yield change
        change.commit()

    def cleared(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last `keep` versions names, and returns how many. Only for times when no
        run writes, whose staged tables look the same, or reads an older version."""
        last = self.number()
        named = {f for n in range(max(1, last - keep + 1), last + 1) for f in self.folders(n).values()}
        data, gone = self.path("data"), 0
        for table in self.files.listStatus(data) if self.files.exists(data) else []:
            for version in self.files.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{version.getPath().getName()}" not in named:
                    gone += self.files.delete(version.getPath(), True)
        return gone


class Change:
    def __init__(self, tables: Versions, began: int):
        self.tables, self.began, self.staged = tables, began, {}

    def read(self, name: str) -> DataFrame:
        """The table as this transaction sees it: what it has staged, else the version it began at."""
        held = self.tables.folders(self.began) | self.staged
        return self.tables.spark.read.parquet(f"{self.tables.folder}/{held[name]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Stages a table, computed once, and returns it."""
        self.staged[name] = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.tables.folder}/{self.staged[name]}")
        return self.read(name)

    def commit(self) -> None:
        held = self.tables.folders(self.began) | self.staged
        number = f"{self.began + 1:020d}"
        staged, final = self.tables.path("commits", f".{number}-{uuid.uuid4().hex}"), self.tables.path("commits", f"{number}.json")
        out = self.tables.files.create(staged)
        out.write(json.dumps(held).encode())
        out.close()
        moved = not self.tables.files.exists(final) and renamed(self.tables, staged, final)
        if not moved:
            self.tables.files.delete(staged, False)
            raise Conflict(f"version {self.began + 1} has been committed by another run")


def renamed(tables: Versions, old, new) -> bool:
    """Renames unless the new name is taken."""
    context = tables.java.FileContext.getFileContext(old.toUri() if old.toUri().getScheme() else tables.files.getUri(), tables.spark._jsc.hadoopConfiguration())
    try:
        none = tables.spark._jvm.java.lang.reflect.Array.newInstance(tables.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(old, new, none)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True

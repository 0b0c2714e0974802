"""Several tables that change together.

A transaction writes its rows of each table to folders of its own, which no reader looks at, and is committed by one small file
that names them.  A reader takes the folders that commit files name and nothing else: a job that is killed between two
tables leaves nothing visible, and running it again under the same name replaces what it had written.  A commit file is
created without overwriting, so of two writers that go for the same number one has to try again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """number, transaction and tables of every commit, in order."""
        files, folder = self._files(), self._path("_commits")
        if not files.exists(folder):
            return []
        numbers = sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(folder) if f.getPath().getName().endswith(".json"))
        return [{"number": n, **json.loads(self._read(f"_commits/{n}.json"))} for n in numbers]

    def _read(self, name: str) -> str:
        stream = self._files().open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, table: str, ddl: str) -> DataFrame:
        """All committed rows; columns that older rows lack are NULL."""
        paths = [f"{self.root}/{c['tables'][table]}" for c in self.commits() if table in c["tables"]]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def write(self, transaction: str, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Writes the rows of a transaction where no reader sees them; table -> folder."""
        folders = {name: f"{name}/{transaction}" for name in tables}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{folders[name]}")
        return folders

    def commit(self, transaction: str, tables: dict[str, DataFrame]) -> int:
        """Number of the commit that makes the rows visible, all or none; one that is there already is left as it is."""
        for c in self.commits():
            if c["transaction"] == transaction:
                return c["number"]
        folders = self.write(transaction, tables)
        while True:
            number = max((c["number"] for c in self.commits()), default=0) + 1
            if self._publish(number, json.dumps({"transaction": transaction, "tables": folders})):
                return number

    def _publish(self, number: int, text: str) -> bool:
        """Writes the file under another name first, so that a half-written one is never seen; False if the number is taken."""
        files, at = self._files(), self._path(f"_commits/{number}.json")
        draft = self._path(f"_drafts/{self._jvm.java.util.UUID.randomUUID().toString()}")
        stream = files.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files.mkdirs(self._path("_commits"))
        if files.exists(at):
            files.delete(draft, False)
            return False
        return files.rename(draft, at)  # renaming onto a file that is there fails

    def expire(self, keep: set[str]) -> int:
        """Deletes folders of transactions that neither a commit nor ``keep``, those still at work, names; how many."""
        files, named, gone = self._files(), {p for c in self.commits() for p in c["tables"].values()}, 0
        for table in files.listStatus(self._path("")) if files.exists(self._path("")) else []:
            name = table.getPath().getName()
            if table.isDirectory() and not name.startswith("_"):
                for part in files.listStatus(table.getPath()):
                    transaction = part.getPath().getName()
                    if f"{name}/{transaction}" not in named and transaction not in keep:
                        gone += files.delete(part.getPath(), True)
        return gone

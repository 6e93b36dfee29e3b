"""Live revalidation: one stream over the folders of all tables, violations as versioned state, differences per batch.

A batch of new files says which tables changed.  Their violations and those of the
tables that refer to them are worked out anew and stored under the batch's number;
what was stored for other tables stays.  A batch counts once its manifest is there,
which is written last: a batch that is run again after a crash overwrites its own
folders, one that is run again after its manifest does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcheck.plans.compile import RuleSet, TableSet, compile_contract
from gridcheck.plans.contract import Contract
from gridcheck.violations import SCHEMA, carry_forward, diff_violations, merge_violations, violations


def affected(contract: Contract, changed: Sequence[str], transitive: bool = False) -> list[str]:
    """Changed tables and the tables that refer to them; with ``transitive``, those that refer to these too.

    A table's violations depend on its own rows and on the keys of its targets,
    so without rules of one's own one step is enough.
    """
    edges = [(s.lower(), t.lower()) for s, _, t, _ in contract.references()]
    found = {c.lower() for c in changed}
    while True:
        more = {s for s, t in edges if t in found} - found
        found |= more
        if not more or not transitive:
            return sorted(found)


def _path(spark: SparkSession, *parts: str):
    where = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass
class Revalidation:
    """Folders of tables (``paths``, Parquet, ``schemas``), a contract, and where violations, differences and progress lie."""

    spark: SparkSession
    paths: Mapping[str, str]
    schemas: Mapping[str, T.StructType]
    contract: Contract
    store: str
    rules: RuleSet | None = None
    transitive: bool = False
    duplicate_rule: str = "unique"

    def __post_init__(self) -> None:
        self.paths = {k.lower(): v for k, v in self.paths.items()}
        self.schemas = {k.lower(): v for k, v in self.schemas.items()}

    def changes(self) -> DataFrame:
        """The stream: a row for each new file's row, with its table; one source for each folder, one query."""
        parts = [self.spark.readStream.schema(self.schemas[n]).parquet(p).select(F.lit(n).alias("table")) for n, p in self.paths.items()]
        return reduce(DataFrame.unionByName, parts)

    def start(self, once: bool = True):
        """Starts the query; ``once`` ends when all files that are there have been seen."""
        writer = self.changes().writeStream.foreachBatch(self.run_batch).option("checkpointLocation", f"{self.store}/progress")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

    # what is stored

    def _manifest(self, number: int) -> str:
        return f"{self.store}/manifests/{number:012d}"

    def _violations(self, number: int, table: str) -> str:
        return f"{self.store}/violations/batch={number:012d}/{table}"

    def versions(self) -> dict[str, int]:
        """The batch under which each table's violations are stored; from the newest manifest."""
        where, fs = _path(self.spark, self.store, "manifests")
        if not fs.exists(where):
            return {}
        names = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory())
        done = [n for n in names if fs.exists(_path(self.spark, self.store, "manifests", n, "_SUCCESS")[0])]
        if not done:
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.store}/manifests/{done[-1]}").collect()))

    def stored(self, tables: Sequence[str] | None = None, versions: Mapping[str, int] | None = None) -> DataFrame:
        """The violations as they are, of all tables or of some."""
        versions = self.versions() if versions is None else versions
        paths = [self._violations(b, t) for t, b in versions.items() if tables is None or t in tables]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def differences(self) -> DataFrame:
        """Published differences of all finished batches: violations with ``status``, ``n`` and ``batch``."""
        schema = T.StructType([*SCHEMA.fields, T.StructField("status", T.StringType()), T.StructField("n", T.LongType())])
        kept = [f for f in schema if f.name != "args"]
        where, fs = _path(self.spark, self.store, "manifests")
        done = sorted(x.getPath().getName() for x in fs.listStatus(where) if fs.exists(_path(self.spark, str(x.getPath()), "_SUCCESS")[0])) if fs.exists(where) else []
        parts = [self.spark.read.schema(T.StructType(kept)).parquet(f"{self.store}/differences/batch={n}").withColumn("batch", F.lit(int(n))) for n in done]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.StructType([*kept, T.StructField("batch", T.IntegerType())]))

    # a batch

    def run_batch(self, batch: DataFrame, number: int) -> None:
        changed = [r.table for r in batch.select("table").distinct().collect()]  # as many rows as there are tables at most
        if changed:
            self.revalidate(changed, number)

    def revalidate(self, changed: Sequence[str], number: int) -> bool:
        """Works out, stores and publishes what a change affects; False if this batch had been finished before."""
        where, fs = _path(self.spark, self._manifest(number), "_SUCCESS")
        if fs.exists(where):
            return False
        names = [t for t in affected(self.contract, changed, self.transitive) if t in self.paths]
        versions = self.versions()
        have = {}
        for n, p in self.paths.items():
            at, fs = _path(self.spark, p)
            if fs.exists(at) and len(fs.listStatus(at)):
                have[n] = self.spark.read.schema(self.schemas[n]).parquet(p)
        have = TableSet(have, self.contract)
        now, failed = [], []
        for n in names:
            try:
                now.append(self._checked(n, have, number))
            except Exception as e:  # an input that can't be read: what was known of it stays
                failed.append(n)
                now.append(violations(self.spark.createDataFrame([(n, str(e)[:500])], "row_key string, value string"), n, "syntax", "unreadable", "error"))
        before = self.stored(names, versions)
        if failed:  # what stands is part of what is worked out: written aside first
            after = carry_forward(before, merge_violations(now), self.spark.createDataFrame([(t,) for t in failed], "table string"), "syntax", self.duplicate_rule)
            for n in names:
                after.filter(F.col("table") == n).write.mode("overwrite").parquet(f"{self.store}/aside/batch={number:012d}/{n}")
            for n in names:
                self.spark.read.schema(SCHEMA).parquet(f"{self.store}/aside/batch={number:012d}/{n}").write.mode("overwrite").parquet(self._violations(number, n))
        versions = {**versions, **{n: number for n in names}}
        diff_violations(before, self.stored(names, versions)).filter("status <> 'unchanged'").write.mode("overwrite").parquet(f"{self.store}/differences/batch={number:012d}")
        self.spark.createDataFrame([(json.dumps(versions),)], "value string").coalesce(1).write.mode("overwrite").text(self._manifest(number))
        return True

    def _checked(self, name: str, have: TableSet, number: int) -> DataFrame:
        """A table's violations, stored: a fault of its files shows here, and stops only this table."""
        keys = {k.lower(): k for k in self.contract.tables}
        parts = []
        if name in keys:
            only = {k: (t if k == keys[name] else replace(t, key=(), order=None, columns=(), slots=())) for k, t in self.contract.tables.items()}
            parts += compile_contract(replace(self.contract, tables={keys[name]: only[keys[name]], **{a: self.contract.tables[a] for a in self.contract.tables if a != keys[name] and a.lower() not in self.paths}}), have)
        if self.rules:
            parts += [found.filter(F.lower("table") == name) for found in self.rules.run(have, self.contract)]
        found = merge_violations(parts) if parts else self.spark.createDataFrame([], SCHEMA)
        path = self._violations(number, name)
        found.withColumn("table", F.lit(name)).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(SCHEMA).parquet(path)

"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: ``runs/<name>`` (Parquet, written once) and ``manifest/<version>.json``, the list of the live runs with their rows
and bytes. ``append`` writes each arrival as a run and commits the next version. ``compact`` sorts runs into tiers by size, each
tier ``fan`` times the one below; ``fan`` or more runs of one tier become one run of files of ``target_bytes``, which is a run of a
higher tier, until no tier is that full; then one commit replaces what was merged. Work is proportional to the bytes
merged, and a row is rewritten at most once a tier. Merging is one scan and one write, without a shuffle: the scan's splits are
put together to as many tasks as the run is to have files, so no key decides where a row goes; a split larger than a file gives several.

A commit creates ``<version>.json`` whole: it is written under another name and renamed, and a rename doesn't replace a version that is
there, so of two writers one wins and the other raises ``Conflict`` and may retry on the new version. Readers see a version or the
next, nothing between; runs of a failed job are in no manifest. ``vacuum`` removes runs that no kept version lists.

Defined cases: null and very long values and repeated rows are kept as they are; an empty arrival adds an empty run, which
the next compaction drops, unless all runs are empty: one of them stays as the columns' bearer; a store without versions reads as version 0 and can't be read as a table.
Columns are the caller's, whatever they are called. Arrivals may have different ones: the manifest holds each run's schema, a run is read by its own, and a table has the
columns of all its runs (null where a run has none), so nothing is lost in a merge; the columns are compared before it commits. A column of another type than
before is refused when it arrives. Names that differ in case alone are one column.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm._base import filesystem, remove


def run_name() -> Column:
    """The run that holds a row."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/runs/(.+)/[^/]+$", 1)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    name: str
    rows: int
    bytes: int
    made_of: tuple[str, ...] = ()
    schema: str = ""  # as JSON


def fields(schema: str) -> dict[str, T.DataType]:
    return {f.name.lower(): f.dataType for f in T.StructType.fromJson(json.loads(schema)).fields} if schema else {}


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 256 << 20, fan: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.path, self.target_bytes, self.fan, self.least_bytes = spark, path.rstrip("/"), target_bytes, fan, least_bytes

    # --- manifest

    def versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, []
        fs, p = filesystem(self.spark, f"{self.path}/manifest/{version:010}.json")
        with_stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()
        return version, [Run(**r | {"made_of": tuple(r["made_of"])}) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Make ``runs`` the version after ``version``, or raise Conflict."""
        final = f"{self.path}/manifest/{version + 1:010}.json"
        fs, temp = filesystem(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = fs.create(temp, False)
        stream.write(bytearray(json.dumps({"version": version + 1, "runs": [asdict(r) for r in runs]}).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, jvm.org.apache.hadoop.fs.Path(final), none)  # atomic; fails if the version is there
        except Exception as e:
            fs.delete(temp, False)
            raise Conflict(f"version {version + 1} is there") from e
        return version + 1

    # --- data

    def _written(self, names: list[str], schema: str, made_of: tuple[str, ...] = ()) -> list[Run]:
        """The runs of these folders, their rows counted by one scan (of footers; one row a run comes back)."""
        size = {}
        for name in names:
            fs, p = filesystem(self.spark, f"{self.path}/runs/{name}")
            size[name] = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        there = [n for n in names if size[n]]
        rows = {r[0]: r[1] for r in self._scan(there, schema).groupBy(run_name().alias("run")).count().collect()} if there else {}
        return [Run(n, rows.get(n, 0), size[n], made_of, schema) for n in names]

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Commit the rows as new small shards: one run, or one for each value of the column ``arrival``, which isn't kept.

        Raises TypeError if a column is of another type than in the runs that are there.
        """
        batch, rows = uuid.uuid4().hex[:12], df if arrival is None else df.drop(arrival)
        version, runs = self.manifest()
        schema = rows.schema.json()
        for r in {r.schema: r for r in runs}.values():
            for c, kind in fields(r.schema).items():
                if (new := fields(schema).get(c, kind)).simpleString() != kind.simpleString():
                    raise TypeError(f"column {c} is {kind.simpleString()} in the store and {new.simpleString()} here")
        if arrival is None:
            df.write.parquet(f"{self.path}/runs/{batch}")
            names = [batch]
        else:
            by = f"_arrival_{batch}"  # no column of the caller's
            df.withColumnRenamed(arrival, by).write.partitionBy(by).parquet(f"{self.path}/runs/{batch}")
            fs, p = filesystem(self.spark, f"{self.path}/runs/{batch}")
            names = [f"{batch}/{x}" for x in sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())]
            if not names:
                return self.append(rows)
        new = self._written(names, schema)
        return self.commit(version, [*runs, *new])

    def tier(self, n: int) -> int:
        """0 below least_bytes, and one more for each factor of ``fan``."""
        t, edge = 0, self.least_bytes
        while n >= edge:
            t, edge = t + 1, edge * self.fan
        return t

    def plan(self, runs: list[Run]) -> list[list[Run]]:
        """The merges of one compaction: each a list of runs that become one. A tier's merge may fill the next: its size is
        known before it is written, as the sum, so merges of merges are done at once and no row is written twice."""
        groups = [[r] for r in runs if r.rows]
        while True:
            tiers: dict[int, list[list[Run]]] = {}
            for g in groups:
                tiers.setdefault(self.tier(sum(r.bytes for r in g)), []).append(g)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return [g for g in groups if len(g) > 1]
            chosen = tiers[full]
            groups = [g for g in groups if g not in chosen] + [[r for g in chosen for r in g]]

    def compact(self) -> int:
        """Merge, and commit if anything changed. Returns the version."""
        version, runs = self.manifest()
        full = any(r.rows for r in runs)
        gone, new = {r.name for r in (runs if full else runs[1:]) if not r.rows}, []
        for group in self.plan(runs):
            name = f"c{uuid.uuid4().hex[:12]}"
            size, rows = sum(r.bytes for r in group), sum(r.rows for r in group)
            files = max(1, -(-size // self.target_bytes))
            most = max(1, rows * self.target_bytes * 5 // (size * 4))  # of a file, with a quarter to spare
            whole = self._of(group)
            whole.coalesce(files).write.option("maxRecordsPerFile", most).parquet(f"{self.path}/runs/{name}")
            new += self._written([name], whole.schema.json(), tuple(r.name for r in group))
            if new[-1].rows != rows:
                raise RuntimeError(f"{name} has {new[-1].rows} rows, its runs {rows}")
            there = fields(self.spark.read.parquet(f"{self.path}/runs/{name}").schema.json())
            if lost := {c for r in group for c in fields(r.schema)} - there.keys():
                raise RuntimeError(f"{name} lacks columns of its runs: {sorted(lost)}")
            gone |= {r.name for r in group}
        return self.commit(version, [r for r in runs if r.name not in gone] + new) if gone else version

    def vacuum(self, keep: int = 1) -> None:
        """Drop all versions but the last ``keep``, then runs that only those listed."""
        versions = self.versions()
        live = {r.name for v in versions[-keep:] for r in self.manifest(v)[1]}
        for v in versions[:-keep]:
            for r in self.manifest(v)[1]:
                if r.name not in live:
                    remove(self.spark, f"{self.path}/runs/{r.name}")
        for v in versions[:-keep]:
            remove(self.spark, f"{self.path}/manifest/{v:010}.json")

    def _scan(self, names: list[str], schema: str) -> DataFrame:
        """The rows of runs of one schema, as one scan: partition folders count as plain ones."""
        read = self.spark.read.option("recursiveFileLookup", "true")
        return (read.schema(T.StructType.fromJson(json.loads(schema))) if schema else read).parquet(*[f"{self.path}/runs/{n}" for n in names])

    def _of(self, runs: list[Run], run: str | None = None) -> DataFrame:
        """The rows of these runs, by name of column; ``run``: a column for the run that holds each row."""
        by: dict[str, list[str]] = {}
        for r in runs:
            by.setdefault(r.schema, []).append(r.name)
        parts = [self._scan(names, schema) for schema, names in by.items()]
        if run:
            if any(run.lower() == c.lower() for p in parts for c in p.columns):
                raise ValueError(f"the table has a column {run}")
            parts = [p.withColumn(run, run_name()) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None, run: str | None = None) -> DataFrame:
        """A version's rows; ``run``: a column to be added, the name of the run that holds each."""
        _, runs = self.manifest(version)
        if not runs:
            raise ValueError(f"nothing is stored at {self.path}")
        full = [r for r in runs if r.rows]
        empty = {r.schema: r for r in runs if not r.rows and r.schema not in {x.schema for x in full}}
        return self._of([*full, *empty.values()], run)

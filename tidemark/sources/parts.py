"""Tables of which a change writes only the parts it touches.

A table holds its rows in folders by version and part (a key bucket, a day, a month), and one small list per version that names
the folders of each part. A change writes its folders and then its list; the list is the commit. So a change of many parts is seen
whole or not at all, a failed one leaves nothing behind that is read, and a repeated one (a writer numbers its
changes) is left out. A table has one writer at a time; a reader keeps its version for as long as ``KEPT`` later ones are written.

Additions go beside what a part holds. Once ``MOST`` folders of one level have come together they are merged to one of the
next level, so a part consists of few folders and a row is rewritten a logarithmic number of times. Lists have a
row per folder of a part, never per row of data. Names of parts are plain: letters, digits, ``-`` and ``_``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.session import child_folders, remove_folder

PART, NONE = "__part", "none"
LISTED = "part STRING, version BIGINT, level INT, writer STRING, number BIGINT"
MOST, KEPT = 8, 2
Folders = dict[str, list[tuple[int, int]]]  # part to (version, level)


def bucket(keys: list[str], buckets: int) -> Column:
    """The part of a key when parts are hash buckets."""
    return F.lpad(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"), 5, "0")


def named(rows: DataFrame) -> DataFrame:
    """Rows without a part belong to one of that name."""
    return rows.withColumn(PART, F.coalesce(F.col(PART), F.lit(NONE)))


class Parts:
    def __init__(
        self, spark: SparkSession, root: str, schema: str, combine: Callable[[DataFrame], DataFrame] | None = None, options: dict[str, str] | None = None, kept: int = KEPT
    ) -> None:
        """``combine`` reduces the rows that a merge brings together; ``options`` go to the Parquet writer."""
        self.spark, self.root, self.schema, self.combine, self.options, self.kept = spark, root, schema, combine, options or {}, kept
        self.columns = schemas.struct(schema).names
        self._known: dict[int, list] = {}  # lists do not change once committed

    # What is there

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(name.split("=")[1]) for name in child_folders(self.spark, f"{self.root}/list", committed=True))

    def _listed(self, version: int | None) -> tuple[Folders, dict[str, int]]:
        folders: Folders = defaultdict(list)
        marks: dict[str, int] = {}
        if version is not None:
            if version not in self._known:
                self._known[version] = self.spark.read.schema(LISTED).parquet(f"{self.root}/list/version={version}").collect()
            for r in self._known[version]:
                if r["part"] is None:
                    marks[r["writer"]] = r["number"]
                else:
                    folders[r["part"]].append((r["version"], r["level"]))
        return folders, marks

    def _now(self, before: tuple[str, int] | None = None) -> tuple[int | None, Folders, dict[str, int]]:
        """The last version; or the last one before a writer's change of some number, which may have been committed already."""
        for version in reversed(self.versions()):
            folders, marks = self._listed(version)
            if before is None or marks.get(before[0], -1) < before[1]:
                return version, folders, marks
        return None, *self._listed(None)

    def parts(self) -> list[str]:
        return sorted(self._now()[1])

    def done(self, writer: str, number: int) -> bool:
        """Whether a writer's change of this number has been committed."""
        return self._now()[2].get(writer, -1) >= number

    def _rows(self, folders: Iterable[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.root}/data/__version={version}/{PART}={part}" for part, version in folders]
        schema = f"{self.schema}, {PART} STRING"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).select(*self.columns, PART)

    def read(self, parts: Iterable[str] | None = None, before: tuple[str, int] | None = None) -> DataFrame:
        """The rows of some parts, or of all, with the part as ``__part``. Folders of other parts are not listed.

        ``before`` names a writer's change and gives the table as that change found it, also when it is being repeated.
        """
        held = self._now(before)[1]
        chosen = held if parts is None else [p for p in parts if p in held]
        return self._rows((p, v) for p in chosen for v, _ in held[p])

    def reduced(self, parts: Iterable[str] | None = None) -> DataFrame:
        """As ``read``, reduced over what lies in several folders."""
        rows = self.read(parts)
        return self.combine(rows) if self.combine else rows

    # Changes

    def change(self, rows: DataFrame, replaced: Iterable[str] = (), writer: str | None = None, number: int = 0) -> None:
        """Rows (with ``__part``) in place of all that the replaced parts hold, and beside what others hold. A replaced part without rows goes."""
        last, held, marks = self._now()
        if writer is not None and marks.get(writer, -1) >= number:
            return
        gone = set(replaced)
        held = {p: f for p, f in held.items() if p not in gone}
        merged: dict[str, int] = {}
        for part, folders in held.items():
            levels = [level for _, level in folders]
            full = [level for level in set(levels) if levels.count(level) >= MOST]
            if full:
                merged[part] = min(full)
        rows = named(rows.select(*self.columns, PART))
        if merged:
            rows = rows.unionByName(self._rows((p, v) for p, level in merged.items() for v, at in held[p] if at == level))
            rows = self.combine(rows).select(*self.columns, PART) if self.combine else rows
        kept = {p: [(v, at) for v, at in folders if p not in merged or at != merged[p]] for p, folders in held.items()}
        self._commit(last, rows, kept, {p: level + 1 for p, level in merged.items()}, marks, writer, number)

    def append(self, rows: DataFrame, writer: str | None = None, number: int = 0) -> None:
        """Rows beside those of their parts."""
        self.change(rows, (), writer, number)

    def rewrite(self, rows: DataFrame, parts: Iterable[str], writer: str | None = None, number: int = 0) -> None:
        """Rows in place of all that these parts hold."""
        self.change(rows, parts, writer, number)

    def drop(self, parts: Iterable[str], writer: str | None = None, number: int = 0) -> None:
        """Whole parts go; no row is read."""
        self.rewrite(self.spark.createDataFrame([], f"{self.schema}, {PART} STRING"), parts, writer, number)

    def _commit(self, last: int | None, rows: DataFrame, kept: Folders, levels: dict[str, int], marks: dict[str, int], writer: str | None, number: int) -> None:
        version = 0 if last is None else last + 1
        path = f"{self.root}/data/__version={version}"
        # Parts of any size: adaptive execution splits large ones and joins small ones.
        rows.hint("rebalance", PART).write.mode("overwrite").options(**self.options).partitionBy(PART).parquet(path)
        for name in child_folders(self.spark, path):
            part = name.split("=", 1)[1]
            kept.setdefault(part, []).append((version, levels.get(part, 0)))
        if writer is not None:
            marks[writer] = number
        lines = [(p, v, level, None, None) for p, folders in kept.items() for v, level in folders]
        lines += [(None, None, None, w, n) for w, n in marks.items()]
        self.spark.createDataFrame(lines, LISTED).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/list/version={version}")
        self._forget()

    def _forget(self) -> None:
        """Remove lists beyond the kept ones, and the folders that only they name."""
        versions = self.versions()
        old, new = versions[: -self.kept], versions[-self.kept :]
        if not old:
            return
        used = {(p, v) for version in new for p, folders in self._listed(version)[0].items() for v, _ in folders}
        for version in old:
            for part, folders in self._listed(version)[0].items():
                for v, _ in folders:
                    if (part, v) not in used:
                        remove_folder(self.spark, f"{self.root}/data/__version={v}/{PART}={part}")
            remove_folder(self.spark, f"{self.root}/list/version={version}")
            self._known.pop(version, None)


def touched(rows: DataFrame) -> list[str]:
    """The parts of some rows: as many as the table has parts at most."""
    return [r[PART] for r in named(rows.select(PART)).distinct().collect()]


def upsert(table: Parts, changes: DataFrame, keys: list[str], writer: str | None = None, number: int = 0) -> list[str]:
    """Rows replace those of equal keys, or are added. Only parts with changes are read and written; they are returned.

    ``changes`` carries ``__part``, a function of the keys, and each key once.
    """
    changes = named(changes)
    parts = touched(changes)
    kept = table.read(parts).join(changes.select(*keys, PART), [*keys, PART], "left_anti")
    table.rewrite(kept.unionByName(changes.select(*table.columns, PART)), parts, writer, number)
    return parts


def insert(table: Parts, rows: DataFrame, keys: list[str], writer: str | None = None, number: int = 0) -> None:
    """Rows whose keys the table does not hold are added. Only parts with new rows are read; ``rows`` carries ``__part`` and each key once."""
    rows = named(rows)
    known = table.read(touched(rows)).select(*keys, PART)
    table.append(rows.join(known, [*keys, PART], "left_anti"), writer, number)

"""What people taught the crosswalk and the sheet reader: aliases and template profiles, kept as a log.

A table is a row of generations. Each confirmation or deletion adds one, a deletion as a
tombstone; nothing that is there is changed. Reading takes the last entry of each key. Compaction
writes the last entries as a new base; from then on readers start there, so a compaction that
fails leaves the table as it was, and one whose clean-up fails leaves files that nobody reads.
What a generation says is entered in the audit log in the same step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.crosswalk import decision_aliases
from tallyline.operators.history import audit_entry, last_wins
from tallyline.sources.tables import Store

ENTRY = "generation bigint, at timestamp, by string, deleted boolean"


class Learned:
    """A keyed table in which the last word counts."""

    def __init__(self, store: Store, name: str, key: str, values: str, entity: str):
        self.store, self.name, self.key, self.values, self.entity = store, name, key, values, entity
        self.schema = f"{key} string, {values}"
        self.columns = [v.split()[0] for v in values.split(", ")]

    # --- generations ---------------------------------------------------------
    def _folders(self) -> dict[int, str]:
        """Finished generations and bases by number; a base of a number stands for all up to it."""
        path = self.store.spark._jvm.org.apache.hadoop.fs.Path
        where = path(self.store.path(self.name))
        fs = where.getFileSystem(self.store.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = [n for n in names if fs.exists(path(f"{self.store.path(self.name)}/{n}/_SUCCESS"))]
        bases = [int(n.split("=")[1]) for n in done if n.startswith("base=")]
        since = max(bases, default=-1)
        live = {int(n.split("=")[1]): n for n in done if n.startswith("generation=") and int(n.split("=")[1]) > since}
        return ({since: f"base={since:08d}"} if bases else {}) | dict(sorted(live.items()))

    def _written(self, number: int) -> str:
        return f"{self.store.path(self.name)}/generation={number:08d}"

    def log(self) -> DataFrame:
        """All entries that still count or may be overruled, tombstones included."""
        folders = self._folders()
        schema = f"{self.schema}, {ENTRY}"
        if not folders:
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.schema(schema).parquet(*(f"{self.store.path(self.name)}/{n}" for n in folders.values()))

    def current(self) -> DataFrame:
        """The last entry of each key, deleted ones gone."""
        return last_wins(self.log(), [self.key], F.struct("generation", "at"), F.col("deleted")).select(self.key, *self.columns, "at", "by")

    # --- saying something ----------------------------------------------------
    def _say(self, rows: DataFrame, deleted: bool, by: Column, action: str, generation: int | None) -> int:
        number = max(self._folders(), default=-1) + 1 if generation is None else generation
        given = [c if c in rows.columns else F.lit(None).alias(c) for c in self.columns]
        entries = rows.select(F.col(self.key), *given)
        order = F.struct(*[x for c in self.columns for x in (F.col(c).isNotNull(), F.to_json(F.struct(c)))])
        one = entries.groupBy(self.key).agg(F.max_by(F.struct(*self.columns), order).alias("v")).select(self.key, "v.*")
        fields = self.store.spark.createDataFrame([], self.schema).schema.fields
        shaped = one.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        stamped = shaped.select(
            "*", F.lit(number).cast("bigint").alias("generation"), F.current_timestamp().alias("at"), by.cast("string").alias("by"), F.lit(deleted).alias("deleted"),
        )
        stamped.write.mode("overwrite").parquet(self._written(number))
        said = self.store.spark.read.schema(f"{self.schema}, {ENTRY}").parquet(self._written(number))
        detail = {c: F.col(c) if dict(said.dtypes)[c] == "string" else F.to_json(F.struct(c)) for c in self.columns} | {"generation": F.col("generation")}
        entries = audit_entry(said, F.col("by"), action, self.entity, F.col(self.key), detail).withColumn("part", F.lit(f"{self.name}/{number:08d}"))
        self.store.replace_partitions(entries, "learned_audit", ("part",))
        return number

    def save(self, rows: DataFrame, by: str | Column = "reviewer", generation: int | None = None) -> int:
        """Entries by key; of several for one key in one call the greatest values hold. Returns the
        generation; given again after a failure it replaces what that generation said."""
        return self._say(rows, False, by if isinstance(by, Column) else F.lit(by), "confirm", generation)

    def delete(self, rows: DataFrame, by: str | Column = "reviewer", generation: int | None = None) -> int:
        """Tombstones for the keys of rows."""
        return self._say(rows.select(self.key), True, by if isinstance(by, Column) else F.lit(by), "forget", generation)

    def compact(self) -> None:
        """All generations as one base. Tombstones are not needed any more, as nothing older is read."""
        folders = self._folders()
        if not folders:
            return
        number = max(folders)
        last = last_wins(self.log(), [self.key], F.struct("generation", "at"), F.col("deleted"))
        columns = [c.split()[0] for c in f"{self.schema}, {ENTRY}".split(", ")]
        last.select(*columns).write.mode("overwrite").parquet(f"{self.store.path(self.name)}/base={number:08d}.new")
        path = self.store.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.store.root).getFileSystem(self.store.spark._jsc.hadoopConfiguration())
        new, base = (path(f"{self.store.path(self.name)}/base={number:08d}{end}") for end in (".new", ""))
        if folders.get(number) == f"base={number:08d}":
            fs.delete(new, True)  # nothing was said since
            return
        fs.delete(base, True)
        if not fs.rename(new, base):
            raise OSError(f"could not place {base}")
        for name in folders.values():
            fs.delete(path(f"{self.store.path(self.name)}/{name}"), True)

    def audit(self) -> DataFrame:
        """What was said, as audit rows."""
        schema = "ts timestamp, actor string, action string, entity string, entity_id string, detail map<string,string>, part string"
        return self.store.read("learned_audit", schema).filter(F.col("part").startswith(f"{self.name}/")).drop("part")


def aliases(store: Store) -> Learned:
    """Learned mappings of normalised texts to codes, over all projects."""
    return Learned(store, "alias", "normalized_desc", "code string, confidence double", "alias")


def template_profiles(store: Store) -> Learned:
    """Saved column maps of contractors' sheets."""
    return Learned(store, "template_profile", "contractor", "header_row int, table_index int, columns map<string,int>", "template_profile")


def learn(table: Learned, decisions: DataFrame, by: str = "reviewer") -> None:
    """Take over a log of review decisions: texts mapped are learned, reopened ones forgotten."""
    known, gone = decision_aliases(decisions)
    table.save(known, by)
    table.delete(gone, by)

"""Changes of a table as a table: planned, looked at, verified and only then applied, by moving a pointer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.records import claim_path, delete_path, names_in


def planned(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action (insert, update, delete), before, after: what turns old into new. Each has a key once; rows that stay the same are left out."""
    rest = [c for c in old.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    both = side(old, "before").join(side(new, "after"), keys, "full_outer")
    action = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.select(*keys, action.alias("action"), "before", "after").where("action is not null")


def applied(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the changes made."""
    stay = table.join(changes.select(*keys), keys, "left_anti")
    return stay.unionByName(changes.where("action <> 'delete'").select(*keys, "after.*").select(*table.columns))


def summary(changes: DataFrame) -> DataFrame:
    """action, n: what a dry run reports."""
    return changes.groupBy("action").agg(F.count("*").alias("n"))


class FailedCheck(ValueError):
    """The table stays as it was."""


class StagedTable:
    """A table in versions of which a pointer names the current one. A change writes the next version, verifies it as it stands there, and moves the pointer; until then
    readers see the old one, and after a failure they still do. Two writers at a time: the second finds the pointer's place taken and fails.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _moves(self) -> list[str]:
        """The pointer's moves, a name `<number>-<version>` each."""
        return sorted(names_in(self.spark, f"{self.path}/pointer"))

    def version(self) -> int | None:
        return int(held[-1].split("-")[1]) if (held := self._moves()) else None

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version() if version is None else version}")

    def _point(self, version: int, after: list[str]) -> None:
        # a name holds number and version; the place itself is claimed first, by number alone, so that one writer wins
        number = f"{len(after):08d}"
        if not claim_path(self.spark, f"{self.path}/claims/{number}"):
            raise FailedCheck("another change was made in the meantime")
        claim_path(self.spark, f"{self.path}/pointer/{number}-{version}")

    def create(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v0")
        self._point(0, self._moves())

    def apply(self, changes: DataFrame, checks: dict[str, Column] | None = None) -> int:
        """Makes the changes if they fit the table as it is and the result passes every check, a condition by name that has to hold for all rows; the new version's number.

        They fit if what they hold as `before` is what stands there, inserts have no row yet, and no key is named twice.
        """
        moves, old = self._moves(), self.version()
        at = f"{self.path}/v{len(moves)}"
        plan = f"{self.path}/changes-{len(moves)}"
        changes.write.mode("overwrite").parquet(plan)  # what is verified is what is made
        changes, table = self.spark.read.parquet(plan), self.read(old)
        try:
            rest = [c for c in table.columns if c not in self.keys]
            held = changes.join(table.select(*self.keys, F.struct(*rest).alias("_now"), F.lit(True).alias("_there")), self.keys, "left")
            fits = F.when(F.col("action") == "insert", F.col("_there").isNull()).otherwise(F.coalesce(F.col("_there"), F.lit(False)) & F.col("_now").eqNullSafe(F.col("before")))
            told = held.agg(F.count("*").alias("n"), F.count_if(~fits).alias("odd"), *[F.count_if(F.col("action") == a).alias(a) for a in ("insert", "update", "delete")]).first()
            if told["odd"]:
                raise FailedCheck(f"{told['odd']} changes don't fit the table")
            if changes.groupBy(*self.keys).count().where("count > 1").limit(1).count():
                raise FailedCheck("a key is changed twice")
            applied(table, changes, self.keys).write.mode("overwrite").parquet(at)
            new, before = self.spark.read.parquet(at), table.count()
            seen = new.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate((checks or {}).values())]).first()
            if seen["n"] != before + told["insert"] - told["delete"]:
                raise FailedCheck(f"{seen['n']} rows where {before} + {told['insert']} - {told['delete']} were expected")
            for i, name in enumerate(checks or {}):
                if seen[f"_{i}"]:
                    raise FailedCheck(f"{name}: {seen[f'_{i}']} rows fail")
            self._point(len(moves), moves)
        except Exception:
            delete_path(self.spark, at)
            raise
        finally:
            delete_path(self.spark, plan)
        return len(moves)

    def rollback(self) -> int:
        """Points to the version before the current one, which stays readable by its number."""
        moves = self._moves()
        earlier = [int(m.split("-")[1]) for m in moves if int(m.split("-")[1]) < self.version()]
        if not earlier:
            raise FailedCheck("there is no version before")
        self._point(earlier[-1], moves)
        return earlier[-1]


def moved_rows(source: DataFrame, target: DataFrame, candidate: Column, named: Column, link: str, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of one table that go over to another: what the target gains, what the source loses, and what is refused.

    A candidate without a name is refused unless forced; one whose link (blank ones aside) the target holds already is only taken from the source.
    """
    told = source.where(candidate).withColumn("_named", F.coalesce(named, F.lit(False)))
    refused = told.where("not _named").drop("_named") if not force else told.limit(0).drop("_named")
    go = (told if force else told.where("_named")).drop("_named")
    there = target.where(F.col(link) != "").select(link).distinct()
    return go.join(there, link, "left_anti").select(*source.columns), go.select(*source.columns), refused

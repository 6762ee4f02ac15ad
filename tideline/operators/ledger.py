"""Seen postings at scale: immutable bucketed pieces under numbered commits.

A run adds a piece with what it records, so what it writes is in proportion to the run.  Each piece is
stored twice, bucketed by id and, where there is one, by key; all pieces share the number of
buckets, so new rows meet the state without a shuffle of the state: only the run's own ids
and keys move.  Old pieces are merged, and records pruned, by :meth:`Ledger.compact`.

A version is a commit that lists its pieces (:mod:`tideline.operators.commits`): a stopped run leaves the
version before it, and of two runs that read one version the second to commit fails.
A folder that holds pieces but no commit is an error, never empty state.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.commits import Commits, Files, StateError
from tideline.operators.state import checkpoint, prune

SEEN = "id string, first_seen timestamp, company string, title string, ats_key string, seeded boolean"


class Ledger:
    """Saved state in ``path``.  ``buckets`` holds for a new ledger; an old one keeps its own.

    Ids and keys are strings; a null id is recorded but meets nothing, nor does a null key.
    Without ``key_col`` rows meet by id alone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = SEEN, id_col: str = "id", key_col: str | None = "ats_key", buckets: int = 64, files: Files | None = None) -> None:
        self.spark, self.path, self.schema, self.id_col, self.key_col, self.buckets = spark, path.rstrip("/"), schema, id_col, key_col, buckets
        self.files = files or Files(spark)
        self.commits = Commits(spark, self.path, self.files)

    # --- versions -----------------------------------------------------------------

    def newest(self) -> tuple[int, dict]:
        """The highest version and what it lists; version 0 is empty."""
        found = self.commits.newest()
        if found:
            return found
        if self.files.names(f"{self.path}/pieces"):
            raise StateError(f"{self.path} holds pieces but no commit")
        return 0, {"pieces": [], "buckets": self.buckets}

    def at(self, version: int | None) -> tuple[int, dict]:
        if version is None:
            return self.newest()
        return (0, {"pieces": [], "buckets": self.buckets}) if version == 0 and 0 not in self.commits.numbers() else (version, self.commits.read(version))

    # --- reading --------------------------------------------------------------------

    def _table(self, by: str, version: int, listed: dict) -> DataFrame:
        """The pieces of a version as one table that Spark knows to be bucketed by id or key."""
        column, columns = (self.id_col, self.schema) if by == "ids" else (self.key_col, f"{self.key_col} string")
        name = f"tideline_{hashlib.md5(f'{self.path} {by} {version}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, piece INT) USING parquet PARTITIONED BY (piece) CLUSTERED BY (`{column}`) INTO {listed['buckets']} BUCKETS"
                f" LOCATION '{self.path}/none'"
            )
            places = " ".join(f"PARTITION (piece = {i}) LOCATION '{self.path}/pieces/{p}/{by}'" for i, p in enumerate(listed["pieces"]))
            if places:
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {places}")
        return self.spark.table(name).drop("piece")

    def rows(self, version: int | None = None) -> DataFrame:
        """All records of a version (the newest)."""
        return self._table("ids", *self.at(version))

    def unseen(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of ``df`` whose id and (non-null) key are not recorded.

        The state is scanned by bucket and not moved: it meets the distinct ids (keys) of ``df``
        in hash joins, and what they have in common is taken out of ``df``.
        """
        number, listed = self.at(version)
        out = df
        for by, column in (("ids", self.id_col), *((("keys", self.key_col),) if self.key_col else ())):
            own = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__own")).distinct()
            known = self._table(by, number, listed).select(F.col(column).alias("__seen"))
            hits = known.join(own.hint("shuffle_hash"), F.col("__seen") == F.col("__own"), "left_semi").distinct()
            out = out.join(hits, F.col(column) == F.col("__seen"), "left_anti")
        return out

    # --- writing --------------------------------------------------------------------

    def _write(self, df: DataFrame, column: str, buckets: int, folder: str) -> None:
        name = f"tideline_{uuid.uuid4().hex}"
        df.repartition(buckets, F.col(column)).write.bucketBy(buckets, column).option("path", folder).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def _commit(self, base: int, listed: dict, pieces: list[str], rows: DataFrame, note: dict | None = None) -> int:
        if base == 0 and not self.commits.numbers():
            # From now on a folder without commits has lost them.
            self.commits.add(0, listed)
        piece = f"{base + 1:012d}-{uuid.uuid4().hex}"
        self._write(rows, self.id_col, listed["buckets"], f"{self.path}/pieces/{piece}/ids")
        if self.key_col:
            keys = rows.where(F.col(self.key_col).isNotNull()).select(self.key_col).distinct()
            self._write(keys, self.key_col, listed["buckets"], f"{self.path}/pieces/{piece}/keys")
        self.commits.add(base + 1, {"pieces": [*pieces, piece], "buckets": listed["buckets"], "note": note or {}})
        return base + 1

    def append(self, rows: DataFrame, base: int | None = None, note: dict | None = None) -> int:
        """Record those of ``rows`` whose ids are new, and return the new version; earlier records stay.

        ``base`` is the version that ``rows`` were made from; if it is not the newest any more, :class:`Conflict` is raised.
        ``note`` stays with the commit.
        """
        number, listed = self.at(base)
        names = [f.name for f in self._table("ids", number, listed).schema]
        own = checkpoint(rows.select(*names).dropDuplicates([self.id_col]))
        known = self._table("ids", number, listed).select(F.col(self.id_col).alias("__seen"))
        hits = known.join(own.select(F.col(self.id_col).alias("__own")).hint("shuffle_hash"), F.col("__seen") == F.col("__own"), "left_semi")
        new = checkpoint(own.join(hits, F.col(self.id_col) == F.col("__seen"), "left_anti"))
        return self._commit(number, listed, listed["pieces"], new, note)

    def compact(self, days: int = 0, now: dt.datetime | None = None, base: int | None = None) -> int:
        """One piece of all records, without those first seen more than ``days`` before ``now`` (0 keeps all)."""
        number, listed = self.at(base)
        rows = self._table("ids", number, listed)
        return self._commit(number, listed, [], prune(rows, days, now) if days > 0 else rows)

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Delete pieces older than ``hours`` that none of the last ``keep`` versions lists, and those versions' commits; returns the pieces."""
        numbers = self.commits.numbers()
        used = {p for n in numbers[-keep:] for p in self.commits.read(n)["pieces"]}
        for n in numbers[:-keep]:
            self.files.delete(f"{self.commits.folder}/{n:012d}")
        gone = [name for name, changed in self.files.names(f"{self.path}/pieces") if name not in used and changed < (time.time() - hours * 3600) * 1000]
        for name in gone:
            self.files.delete(f"{self.path}/pieces/{name}")
        return sorted(gone)


def landed_state(spark: SparkSession, path: str, now: dt.datetime) -> tuple[DataFrame, bool]:
    """Records of a JSON state file, and whether the state was ever filled.

    The file is an object with ``postings`` (id -> record) and ``bootstrapped``, or a bare list of
    ids, which count as first seen ``now``.  No file is empty state; one that cannot be read is an error.
    """
    files = Files(spark)
    if not files.exists(path):
        return spark.createDataFrame([], SEEN), False
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    strict = {"mode": "FAILFAST"}
    try:
        if raw.select(F.col("value").startswith("[")).first()[0]:
            ids = raw.select(F.explode(F.from_json("value", "array<string>", strict)).alias("id"))
            none = (F.lit(None).cast("string").alias(c) for c in ("company", "title", "ats_key"))
            found, filled = checkpoint(ids.select("id", F.lit(now).alias("first_seen"), *none, F.lit(False).alias("seeded"))), True
        else:
            record = "struct<first_seen: string, company: string, title: string, ats_key: string, seeded: boolean>"
            whole = raw.select(F.from_json("value", f"struct<bootstrapped: boolean, postings: map<string, {record}>>", strict).alias("s"))
            at = F.col("r.first_seen").try_cast("timestamp").alias("first_seen")
            found = checkpoint(whole.select(F.explode("s.postings").alias("id", "r")).select("id", at, "r.company", "r.title", "r.ats_key", "r.seeded"))
            said = whole.select("s.bootstrapped").first()[0]  # one file, one row
            filled = not found.isEmpty() if said is None else said
    except Exception as e:
        raise StateError(f"{path} cannot be read") from e
    return found, filled

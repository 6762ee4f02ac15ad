"""Commits that survive stops and races, and state that stays in its buckets."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import state
from tideline.operators.commits import Commits, Conflict, Files, StateError
from tideline.operators.ledger import SEEN, Ledger, landed_state

NOW = dt.datetime(2026, 8, 26)


def records(spark, *ids, day=26, key=True):
    rows = [(i, dt.datetime(2026, 8, day), "Co", "T", f"k{i}" if key else None, False) for i in ids]
    return spark.createDataFrame(rows, SEEN)


class Stopping(Files):
    """Ends the run before the n-th change of files."""

    def __init__(self, spark, left):
        super().__init__(spark)
        self.left = left

    def _step(self):
        if self.left == 0:
            raise KeyboardInterrupt
        self.left -= 1

    def write(self, *a):
        self._step()
        return super().write(*a)

    def rename(self, *a):
        self._step()
        return super().rename(*a)


def test_a_stop_between_any_two_steps_leaves_the_last_version(spark, tmp_path):
    for n in range(3):
        path = f"{tmp_path}/{n}"
        for version, ids in (("a", "x"), ("b", "xy")):
            state.write_state(records(spark, *ids), path, version)
        if n < 2:
            with pytest.raises(KeyboardInterrupt):
                state.write_state(records(spark, *"xyz"), path, "c", Stopping(spark, n))
        else:
            state.write_state(records(spark, *"xyz"), path, "c")
        assert state.read_state(spark, path, SEEN).count() == (2 if n < 2 else 3)
        state.write_state(records(spark, *"xyzw"), path, "d")
        assert state.read_state(spark, path, SEEN).count() == 4


def test_a_stop_of_the_ledger(spark, tmp_path):
    """The first run: commit 0 in two steps, then commit 1; a later one: commit 2."""
    for n in range(5):
        path = f"{tmp_path}/{n}"
        if n < 4:
            with pytest.raises(KeyboardInterrupt):
                Ledger(spark, path, buckets=4, files=Stopping(spark, n)).append(records(spark, "a"))
        after = Ledger(spark, path, buckets=4)
        assert after.newest()[0] == 0 and after.rows().count() == 0
        assert after.append(records(spark, "a", "b")) == 1 and after.append(records(spark, "b", "c")) == 2
        with pytest.raises(KeyboardInterrupt):
            Ledger(spark, path, files=Stopping(spark, 1)).append(records(spark, "d"))
        assert sorted(r.id for r in Ledger(spark, path).rows().collect()) == ["a", "b", "c"] and Ledger(spark, path).newest()[0] == 2


def test_state_without_commits_is_never_empty(spark, tmp_path):
    path = str(tmp_path / "s")
    state.write_state(records(spark, "a"), path, "1")
    Files(spark).delete(f"{path}/_commits")
    with pytest.raises(StateError):
        state.read_state(spark, path, SEEN)
    spark.createDataFrame([("1",)], "value string").coalesce(1).write.text(f"{path}/current")
    assert state.read_state(spark, path, SEEN).count() == 1
    path = str(tmp_path / "l")
    Ledger(spark, path, buckets=2).append(records(spark, "a"))
    Files(spark).delete(f"{path}/_commits")
    with pytest.raises(StateError):
        Ledger(spark, path).rows()


def test_the_second_of_two_writers_fails(spark, tmp_path):
    one, two = Ledger(spark, str(tmp_path), buckets=2), Ledger(spark, str(tmp_path), buckets=2)
    base = one.append(records(spark, "a"))
    assert one.append(records(spark, "b"), base) == base + 1
    with pytest.raises(Conflict):
        two.append(records(spark, "c"), base)
    assert sorted(r.id for r in two.rows().collect()) == ["a", "b"]
    commits = Commits(spark, str(tmp_path))
    with pytest.raises(Conflict):
        commits.add(1, {})
    assert not [n for n, _ in Files(spark).names(commits.folder) if "-" in n]


def test_new_rows_meet_state_without_a_shuffle_of_it(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=8)
    ledger.append(records(spark, *(f"i{n}" for n in range(300))))
    ledger.append(records(spark, *(f"j{n}" for n in range(5))))
    rows = [(0, "i7", None), (1, "new", "kj3"), (2, "new2", "kx"), (3, None, None), (4, "j1", "kz"), (5, None, "ki9")]
    df = spark.createDataFrame(rows, "ord int, id string, ats_key string")
    got = ledger.unseen(df)
    assert sorted(r.ord for r in got.collect()) == [2, 3]
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    scans = [i for i, line in enumerate(plan.splitlines()) if "tideline_" in line and "Scan" in line or "FileScan" in line and "Bucketed: true" in line]
    lines = plan.splitlines()
    assert len(scans) >= 2
    for i in scans:
        # Up from a scan of the state the first operator that moves rows or joins is a join.
        above = next(line for line in reversed(lines[:i]) if "Exchange" in line or "Join" in line)
        assert "Join" in above, plan


def test_an_append_writes_its_own_rows_only(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=2)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    ledger.append(records(spark, *(f"a long identifier {n * 7919}" for n in range(20_000))))
    large = size()
    ledger.append(records(spark, "one", "two"))
    assert size() - large < large / 10


def test_prune_and_vacuum(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=2)
    ledger.append(records(spark, "old", day=1))
    ledger.append(records(spark, "new", key=False))
    assert ledger.compact(10, NOW) == 3 and [r.id for r in ledger.rows().collect()] == ["new"]
    assert sorted(r.id for r in ledger.rows(2).collect()) == ["new", "old"]
    assert ledger.vacuum(keep=1) == [] and len(ledger.vacuum(keep=1, hours=-1)) == 2
    assert [r.id for r in Ledger(spark, str(tmp_path)).rows().collect()] == ["new"] and ledger.append(records(spark, "more")) == 4


def test_landed_state(spark, tmp_path):
    def read(content):
        p = tmp_path / f"{abs(hash(content))}.json"
        p.write_text(content)
        seen, filled = landed_state(spark, str(p), NOW)
        return sorted((r.id, r.first_seen) for r in seen.collect()), filled

    assert read(json.dumps(["a", "b"])) == ([("a", NOW), ("b", NOW)], True)
    assert read("[]") == ([], True)
    at = {"first_seen": "2026-08-01T10:00:00+00:00", "company": "Co"}
    assert read(json.dumps({"postings": {"a": at}, "version": 1}, indent=1)) == ([("a", dt.datetime(2026, 8, 1, 10))], True)
    assert read(json.dumps({"postings": {}})) == ([], False) and read(json.dumps({"postings": {}, "bootstrapped": True})) == ([], True)
    seen, filled = landed_state(spark, str(tmp_path / "none"), NOW)
    assert not filled and seen.isEmpty()
    with pytest.raises(StateError):
        read('{"postings": {')


def test_the_old_pointer_is_still_read(spark, tmp_path):
    records(spark, "a").write.parquet(f"{tmp_path}/v=1")
    spark.range(1).select(F.lit("1").alias("value")).coalesce(1).write.text(f"{tmp_path}/current")
    assert state.read_state(spark, str(tmp_path), SEEN).count() == 1
    state.write_state(records(spark, "a", "b"), str(tmp_path), "2")
    assert state.read_state(spark, str(tmp_path), SEEN).count() == 2

"""Managed tables: constraints, conflicts and transactions."""

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CatalogError, ConflictError, ConstraintError, TransactionError, TypeMismatch, Unsupported
from tidemark.sources.store import Spec, Store, affinity


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.create_table("t", [Spec("id", "INTEGER", primary_key=True), Spec("e", "TEXT", unique=True, collation="NOCASE"), Spec("n", "INTEGER", not_null=True, default="5", check="n >= 0")])
    s.insert("t", spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id long, e string, n long"))
    return s


def rows(s, name="t"):
    return sorted((tuple(r) for r in s.frame(name).collect()), key=str)


def test_affinity():
    assert [affinity(x) for x in ("FLOATING POINT", "VARCHAR(3)", "DOUBLE", "DECIMAL(8,2)", "", "VECTOR(3)")] == ["INTEGER", "TEXT", "REAL", "NUMERIC", "BLOB", "VECTOR"]


def test_defaults_ids_and_constraints(store, spark):
    store.insert("t", spark.createDataFrame([("b",)], "e string"))
    assert (3, "b", 5) in rows(store)
    for bad in ((9, "A", 1), (9, "q", -1), (9, "q", None), (1, "q", 1)):
        with pytest.raises(ConstraintError):
            store.insert("t", spark.createDataFrame([bad], "id long, e string, n long"))
    store.insert("t", spark.createDataFrame([(7, None, 1)], "id long, e string, n long"))  # NULLs are distinct
    with pytest.raises(CatalogError):
        store.frame("none")


def test_conflict_clauses(store, spark):
    new = spark.createDataFrame([(1, "z", 10), (4, "a", 20), (5, "c", 30)], "id long, e string, n long")
    store.insert("t", new, "ignore")
    assert rows(store) == [(1, "a", 1), (2, None, 2), (5, "c", 30)]
    store.insert("t", new, "replace")
    assert rows(store) == [(1, "z", 10), (2, None, 2), (4, "a", 20), (5, "c", 30)]
    store.insert("t", spark.createDataFrame([(5, "c", 1)], "id long, e string, n long"), "update", ["id"], {"n": "n + excluded_n"}, "n > 20")
    assert (5, "c", 31) in rows(store)


def test_transactions_and_changes(store, spark):
    since = store.version
    store.begin()
    store.delete("t", "id = 1")
    store.rollback()
    assert len(rows(store)) == 2
    with pytest.raises(TransactionError):
        store.commit()
    store.begin()
    store.update("t", {"n": "n + 1"})
    other = Store(spark, store.root)
    other.delete("t", "id = 2")
    with pytest.raises(ConflictError):
        store.commit()
    assert [(r["id"], r["kind"]) for r in store.changes(since).select("id", "kind").collect()] == [(2, "delete")]
    assert not store.lost(since)


def test_stream_of_changes(store, spark):
    from tidemark.streaming.changes import change_stream

    store.update("t", {"n": "9"}, "id = 1")
    q = change_stream(spark, store.root).writeStream.format("memory").queryName("changes_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("changes_seen").filter(F.col("kind") == "update").count() == 1


def one_by_one(kept, new, keys, conflict):
    """Rows written one after another."""
    kept = list(kept)
    for r in new:
        clash = [k for k in kept if any(r[c] is not None and k[c] is not None and str(r[c]).lower() == str(k[c]).lower() for c in keys)]
        if conflict == "replace":
            kept = [k for k in kept if k not in clash] + [r]
        elif not clash:
            kept.append(r)
    return sorted(kept, key=str)


@pytest.mark.parametrize("conflict", ["ignore", "replace"])
def test_batches_end_as_single_rows_would(store, spark, conflict):
    import random

    rng = random.Random(4)
    for size in (3, 30):
        new = [(rng.randint(1, 12), rng.choice(["a", "A", "b", "B", "c", "d", None]), rng.randint(0, 9)) for _ in range(size)]
        before = rows(store)
        store.insert("t", spark.createDataFrame(new, "id long, e string, n long").coalesce(1), conflict)
        assert rows(store) == one_by_one(before, new, (0, 1), conflict)
    s = Store(spark, store.root + "-pairs")
    s.create_table("p", [Spec("a", unique=True), Spec("b", unique=True)])
    s.insert("p", spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "a long, b long").coalesce(1), "ignore")
    assert rows(s, "p") == [(1, 1), (2, 2)]


def test_proposals_of_one_key_are_folded_in_order(store, spark):
    new = spark.createDataFrame([(1, "a", 10), (9, "z", 1), (1, "a", 100), (9, "z", 2)], "id long, e string, n long").coalesce(1)
    store.insert("t", new, "update", ["id"], {"n": "n * 2 + excluded_n"})
    assert rows(store) == [(1, "a", 124), (2, None, 2), (9, "z", 4)]
    with pytest.raises(Unsupported):
        store.insert("t", spark.createDataFrame([(1, "a", 1)] * 65, "id long, e string, n long"), "update", ["id"], {"n": "1"})


def test_ids_stay_ahead_of_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ids"))
    s.create_table("t", [Spec("id", "INTEGER", primary_key=True), Spec("x")])
    s.insert("t", spark.createDataFrame([(3, 0)], "id long, x long"))
    s.insert("t", spark.createDataFrame([(1,), (2,)], "x long").coalesce(1))
    assert rows(s) == [(3, 0), (4, 1), (5, 2)]
    mixed = [None, 20, None, 7, None, 40, None, None]
    s.insert("t", spark.createDataFrame([(i, 10 + k) for k, i in enumerate(mixed)], "id long, x long").repartitionByRange(3, "x").sortWithinPartitions("x"))
    want, at = {}, 6
    for k, i in enumerate(mixed):
        want[10 + k] = at if i is None else i
        at = max(at, want[10 + k] + 1)
    assert {x: i for i, x in rows(s) if x >= 10} == want
    s.update("t", {"id": "id + 100"}, "x = 0")
    s.insert("t", spark.createDataFrame([(50,)], "x long"))
    assert {x: i for i, x in rows(s)}[50] == 104 and {r["id"] for r in s.changes(s.version - 1).collect()} == {104}


def test_commit_is_one_file(store, spark):
    """An unfinished file of a crashed writer is no version, and stops nobody for long; a complete one refuses others."""
    before, version = rows(store), store.version
    fs, p = store._path(f"catalog/{version + 1:012d}.json")
    fs.create(p, False).close()
    assert store.version == version and rows(store) == before
    with pytest.raises(ConflictError):
        store.delete("t", "id = 1")
    fs.setTimes(p, 1, -1)
    store.delete("t", "id = 1")
    assert store.version == version + 2 and len(rows(store)) == len(before) - 1
    other = Store(spark, store.root)
    state = other._get()
    store.delete("t", "id = 2")
    with pytest.raises(ConflictError):
        other._put(state | {"version": state["version"] + 1})


def test_values_of_another_kind_are_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path / "kinds"))
    s.create_table("k", [Spec("i"), Spec("r", "REAL"), Spec("t", "TEXT"), Spec("v", "VECTOR(2)")])
    s.insert("k", spark.createDataFrame([(1, 2, "x", [1.0, 2.0])], "i int, r long, t string, v array<double>"))
    s.insert("k", spark.createDataFrame([(None, None)], "i int, v array<float>"))
    for value, kind in ((1.5, "i double"), ("1", "i string"), ("1", "r string"), (1, "t int"), ([1.0], "v array<double>"), ("[1,2]", "v string")):
        with pytest.raises(TypeMismatch):
            s.insert("k", spark.createDataFrame([(value,)], kind))
    assert s.frame("k").count() == 2

"""Versions, keys, deltas: crashes, writers that meet, and what a change costs."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessellar.operators import store
from tessellar.sources import versioned
from tessellar.sources.versioned import Conflict, KeyRefused, Table

SCHEMA = "owner string, id long, value string"


def table(spark, path, **more):
    return Table(spark, str(path), SCHEMA, ("owner", "id"), **more)


def rows(spark, *of):
    return spark.createDataFrame(list(of), SCHEMA)


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def written(t, v):
    """Rows in the folders of a version that the version before did not have."""
    before = t.version(v - 1).folders()
    now = t.version(v)
    return sum(n for f, n in [(b[1], b[2]) for b in now.base] + [(d[0], d[1]) for d in now.deltas] if f not in before)


def test_against_a_dictionary(spark, tmp_path):
    """Upserts, deletes, folds and old versions, against a dictionary."""
    rng, t, want, past = random.Random(1), table(spark, tmp_path, buckets=4), {}, {}
    for step in range(14):
        if rng.random() < 0.3 and want:
            owner = rng.choice(sorted({k[0] for k in want}))
            gone = {k for k in want if k[0] == owner and k[1] % 2}
            assert t.delete((F.col("owner") == owner) & (F.col("id") % 2 == 1), first=owner) == len(gone)
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            new = {(rng.choice("abcdef"), rng.randrange(12)): f"v{step}" for _ in range(rng.choice([1, 2, 30]))}
            assert t.upsert(rows(spark, *[(*k, v) for k, v in new.items()])) == len(new)
            want |= new
        past[t.version().number] = dict(want)
        assert held(t) == sorted((*k, v) for k, v in want.items())
        assert len(t.version().deltas) <= versioned.DELTAS
    for number, then in past.items():
        assert held(t, number) == sorted((*k, v) for k, v in then.items())
    assert sorted(map(tuple, t.read(first="a").collect())) == sorted((*k, v) for k, v in want.items() if k[0] == "a")
    t.compact()
    assert not t.version().deltas and held(t) == sorted((*k, v) for k, v in want.items())
    opened = t.read()
    assert t.vacuum(keep=1, older_than_seconds=-1) > 0 and len(t.numbers()) == 1
    assert opened.count() == len(want) and held(t) == sorted((*k, v) for k, v in want.items())
    t.reset()
    assert held(t) == [] and opened.count() == len(want)


def test_a_change_costs_what_it_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace(spark.range(4000).select((F.col("id") % 40).cast("string").alias("owner"), "id", F.lit("x").alias("value")))
    assert sum(b[2] for b in t.version().base) == 4000 and len(t.version().base) > 8
    assert t.upsert(rows(spark, ("1", 1, "y"), ("new", 1, "y"))) == 2 and written(t, t.version().number) == 2
    assert t.delete(F.col("owner") == "7", first="7") == 100 and written(t, t.version().number) == 100
    gone = t.delete_matching(spark.createDataFrame([("8",), ("9",), ("none",)], "owner string"))
    assert {tuple(r) for r in gone.collect()} == {("8", 100), ("9", 100)} and written(t, t.version().number) == 200
    assert t.read().count() == 4001 - 300 and t.delete(F.col("owner") == "8") == 0
    before = t.version()
    t.compact()  # only the buckets that changes touch
    assert {b for b in before.base} & {b for b in t.version().base} and t.read().count() == 3701
    # one bucket alone is read for one owner
    assert t.read(first="3").count() == 100 and len(t.read(first="3").inputFiles()) < len(t.read().inputFiles())


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.upsert(rows(spark, ("a", 0, "x"), ("a", 1, "x"), ("a", 2, "x")))
    put, met = Table._put, []

    def late(self, name, content):
        """The other writer commits just before this one."""
        if not met:
            met.append(1)
            b.upsert(rows(spark, ("b", 20, "x")))
        return put(self, name, content)

    monkeypatch.setattr(Table, "_put", late)
    a.upsert(rows(spark, ("a", 10, "x"), ("a", 11, "x")))
    monkeypatch.undo()
    assert [r[1] for r in held(a)] == [0, 1, 2, 10, 11, 20] and a.numbers() == [1, 2, 3]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: table(spark, tmp_path).upsert(rows(spark, ("t", i, "x"), ("all", 0, str(i)))), range(8)))
    assert {r[1] for r in held(a) if r[0] == "t"} == set(range(8)) and len([r for r in held(a) if r[0] == "all"]) == 1
    monkeypatch.setattr(Table, "_put", lambda *_: False)
    with pytest.raises(Conflict):
        a.upsert(rows(spark, ("z", 1, "x")))


def test_a_check_is_made_again_after_a_conflict(spark, tmp_path, monkeypatch):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    put, met = Table._put, []

    def late(self, name, content):
        if not met:
            met.append(1)
            b.insert(rows(spark, ("k", 1, "first")))
        return put(self, name, content)

    monkeypatch.setattr(Table, "_put", late)
    with pytest.raises(KeyRefused):
        a.insert(rows(spark, ("k", 1, "second"), ("k", 2, "second")))
    assert held(a) == [("k", 1, "first")]


@pytest.mark.parametrize("step", ["data", "commit"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("a", 1, "x")))

    def dies(*_):
        raise OSError("lost")

    if step == "commit":
        monkeypatch.setattr(Table, "_put", dies)
        for change in (lambda: t.upsert(rows(spark, ("a", 1, "y"))), lambda: t.delete(F.lit(True)), t.reset, lambda: t.replace(rows(spark))):
            with pytest.raises(OSError):
                change()
    else:
        bad = rows(spark, ("a", 1, "y")).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
        for change in (t.upsert, t.insert, t.replace):
            with pytest.raises(Exception, match="lost"):
                change(bad)
    monkeypatch.undo()
    assert held(t) == [("a", 1, "x")] and t.numbers() == [1]
    t.vacuum(older_than_seconds=-1)
    assert held(t) == [("a", 1, "x")]


def test_put_is_whole_or_not_at_all(spark, tmp_path):
    t = table(spark, f"file://{tmp_path}/a b%20c")
    assert t._put("commits/x", "one") and not t._put("commits/x", "two") and t._text("commits/x") == "one"
    assert t.upsert(rows(spark, ("a", 1, "x"))) == 1 and held(t) == [("a", 1, "x")]


def test_keys_are_enforced(spark, tmp_path):
    customers = store.named(spark, str(tmp_path), "customers")
    row = lambda c, m, name="n": (c, m, name, "p", 0.0, None)
    frame = lambda *r: spark.createDataFrame(list(r), store.CUSTOMERS)
    assert customers.insert(frame(row("c1", "01"), row("c2", "02"), row("c3", None), row("c4", None))) == 4
    for bad in (frame(row("c5", "05"), row("c5", "06")), frame(row(None, "05")), frame(row("c5", "05"), row("c6", "05"))):
        for change in (customers.insert, customers.upsert, customers.replace):
            with pytest.raises(KeyRefused):
                change(bad)
    for change, bad in ((customers.insert, frame(row("c1", "09"))), (customers.insert, frame(row("c9", "02"))), (customers.upsert, frame(row("c1", "02")))):
        with pytest.raises(KeyRefused):
            change(bad)
    assert customers.insert_absent(frame(row("c1", "77", "new"), row("c7", "07")), ["customer_id"]) == 1
    assert customers.upsert(frame(row("c1", "01", "other"))) == 1
    assert {(r.customer_id, r.msisdn, r.full_name) for r in customers.read().collect()} == {("c1", "01", "other"), ("c2", "02", "n"), ("c3", None, "n"), ("c4", None, "n"), ("c7", "07", "n")}
    grants = store.named(spark, str(tmp_path), "permissions")
    ask = spark.createDataFrame([("s", "c", "x"), ("s", "c", "y"), ("s", "c", "x")], store.PERMISSIONS)
    assert grants.insert_absent(ask, ["session_id", "customer_id", "scope"]) == 2 and grants.insert_absent(ask, ["session_id", "customer_id", "scope"]) == 0


def test_chunks_keep_their_vectors(spark, tmp_path):
    from tessellar.operators import search

    chunks = store.Chunks(spark, str(tmp_path), search.stub_embedding)
    make = lambda i, s, text="x": (i, text, "", "", "en", store.OWN, s, "f", 1, None)
    frame = lambda *r: spark.createDataFrame(list(r), store.CHUNK)
    assert chunks.add_own(frame(make("a", "s1"), make("b", "s1")), "s1") == 2 and chunks.add_own(frame(make("a", "s2", "y")), "s2") == 1
    assert [len(r.embedding) for r in chunks.rows_of_session("s1").collect()] == [16, 16]
    assert {tuple(r) for r in chunks.delete_sessions(spark.createDataFrame([("s1",), ("none",), ("",)], "session_id string")).collect()} == {("s1", 2)}
    assert chunks.session_size("s2") == 1 and chunks.session_size("s1") == 0
    bare = store.Chunks(spark, str(tmp_path / "bare"))
    bare.add_own(frame(make("a", "s1")), "s1")
    assert bare.rows_of_session("s1").first().embedding is None

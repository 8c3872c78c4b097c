"""Every catalog query against DuckDB's result for its SQL, and the log's laws."""

import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from keyfold.operators import cluster, hashes, lists, oplog
from keyfold.plans import catalog
from keyfold.plans.rank import global_rank, running_total
from keyfold.sources import storage
from keyfold.streaming import feeds

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(rows, columns):
    """Rows as sorted tuples in the order of column names."""
    order = sorted(columns)
    return sorted((tuple(r[c] for c in order) for r in rows), key=lambda t: [(v is None, str(v)) for v in t])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert plain(df.collect(), df.columns) == plain(expected, rel.columns)


def test_list_log_against_replay(spark):
    rows = [(i, f"k{i % 3}", ["LPUSH", "RPUSH", "RPUSH", "LPOP", "RPOP"][i * 7 % 5], str(i)) for i in range(60)]
    found = {r["key"]: r["items"] for r in lists.interleaved(spark.createDataFrame(rows, "seq long, key string, op string, value string")).collect()}
    replay = {}
    for _, key, op, value in rows:
        items = replay.setdefault(key, [])
        if op == "LPUSH":
            items.insert(0, value)
        elif op == "RPUSH":
            items.append(value)
        elif items:
            items.pop(0 if op == "LPOP" else -1)
    assert found == replay


LOGS = hs.lists(hs.tuples(hs.sampled_from("abcd"), hs.sampled_from(["PUT", "PUT", "DEL"]), hs.integers(0, 9)), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LOGS, hs.integers(0, 40))
def test_fold_against_replay(spark, ops, snapshot):
    rows = [(i + 1, op, key, str(v)) for i, (key, op, v) in enumerate(ops)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    state = {}
    for seq, op, key, value in rows:
        if seq <= snapshot:
            state[key] = value if op == "PUT" else None
    expected = {k: v for k, v in state.items() if v is not None}
    for found in (oplog.fold(log, snapshot=snapshot), oplog.fold_max_by(log, ["value"], snapshot=snapshot), oplog.fold(oplog.compact(log, [snapshot]), snapshot=snapshot)):
        assert {r["key"]: r["value"] for r in found.collect()} == expected


def test_range_tombstones_by_sweep_equal_broadcast(spark):
    rows = spark.range(500).select(F.col("id").alias("seq"), F.lit("PUT").alias("op"), F.concat(F.lit("user:"), (F.col("id") * 13 % 97).cast("string")).alias("key"))
    t = spark.createDataFrame([("user:1", "user:3", 250), ("", "user:05", 400), ("user:9", "z", 10)], "begin_key string, end_key string, seq long")
    few = oplog.hide_ranges(rows, t).select("seq").collect()
    many = oplog.hide_ranges(rows, t, limit=1).select("seq").collect()
    assert sorted(few) == sorted(many) and len(few) < 500


RANGES = hs.lists(hs.tuples(hs.text("abc", max_size=3), hs.text("abc", max_size=3), hs.integers(0, 30)), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(RANGES, hs.lists(hs.tuples(hs.text("abcd", max_size=3), hs.integers(0, 30)), min_size=1, max_size=30))
def test_range_tombstones_against_a_loop(spark, ranges, keys):
    rows = spark.createDataFrame([*keys, (None, 1)], "key string, seq long")
    t = spark.createDataFrame(ranges, "begin_key string, end_key string, seq long")
    want = [(k, s) for k, s in keys if not any(b <= k < e and s < q for b, e, q in ranges)] + [(None, 1)]
    got = [tuple(r) for r in oplog.hide_ranges(rows, t, limit=0).select("key", "seq").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


OPS = hs.lists(hs.tuples(hs.sampled_from("kl"), hs.sampled_from(["PUT", "PUT", "PUT", "REM", "DEL"]), hs.sampled_from("xyz"), hs.integers(-5, 5)), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS)
def test_replies_of_parts_against_replay(spark, ops):
    state, want = {}, []
    for i, (key, op, part, n) in enumerate(ops):
        parts = state.setdefault(key, {})
        if op == "DEL":
            parts.clear()
        elif op == "REM":
            parts.pop(part, None)
        else:
            want.append((i, int(part not in parts), parts.get(part, 0) + n))
            parts[part] = parts.get(part, 0) + n
    log = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "seq long, key string, op string, field string, n long")
    new = {r["seq"]: r["new"] for r in oplog.additions(log, "field").collect()}
    total = {r["seq"]: r["reply"] for r in oplog.part_sums(log, "field", F.col("n")).collect()}
    assert [(i, new[i], total[i]) for i in sorted(new)] == want and set(new) == set(total)
    left = {(r["key"], r["field"]) for r in hashes.hmset(log.withColumn("value", F.col("n"))).collect()}
    assert left == {(k, p) for k, parts in state.items() for p in parts}


def test_ranks_of_keys_that_spread(spark):
    rows = [(k, (i * 7) % 50, i) for k, n in (("a", 300), ("b", 3), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, score long, member long")
    got = {(r["key"], r["member"]): r["rank"] for r in global_rank(df, [F.col("score"), F.col("member")], 6, key=("key",)).collect()}
    want = {(k, m): n for key in ("a", "b", None) for n, (_, k, m) in enumerate(sorted((s, k, m) for k, s, m in rows if k == key))}
    assert got == want
    total = running_total(df.where("key = 'a'"), [F.col("member")], F.col("score"), "total", 5)
    assert {r["member"]: r["total"] for r in total.collect()} == {m: sum(s for k, s, i in rows if k == "a" and i <= m) for m in range(300)}


def test_nodes(spark):
    nodes = cluster.assign(spark, ["a", "b"])
    moved = cluster.remove_node(cluster.add_node(nodes, "c", 8000, 9000), "b", "a")
    assert sorted(tuple(r)[:3] for r in moved.collect()) == [("a", 0, 7999), ("a", 9001, 16383), ("c", 8000, 9000)]
    assert cluster.mark_failed(nodes, "b").where("state = 'fail'").count() == 1
    logs = spark.createDataFrame([("x", 2, 9), ("y", 3, 1), ("z", 3, 1)], "node string, last_term int, last_index int")
    assert cluster.best_candidate(logs).first()["node"] == "y"
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "index int, term int")
    b = spark.createDataFrame([(1, 1), (2, 2)], "index int, term int")
    assert cluster.first_mismatch(a, b).first()["index"] == 2


def test_options_and_pointer(spark, tmp_path):
    o = storage.Options.from_json('{"path": "x", "files": 3, "unknown": 1}')
    assert o.files == 3 and storage.Options.from_json(o.to_json()) == o
    folder = f"file://{tmp_path}"
    for version in (1, 2):
        storage.replace_pointer(spark, folder, {"version": version})
        assert storage.read_pointer(spark, folder) == {"version": version}
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["CURRENT"]


def test_log_stops_at_a_torn_batch_and_raises_on_damage(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda n: spark.range(n, n + 3).select(F.col("id").alias("seq"))
    assert storage.read_log(spark, path, "seq long").count() == 0
    assert [storage.append_log(rows(n), path) for n in (0, 3, 6)] == [1, 2, 3]
    assert storage.read_log(spark, path).count() == 9
    os.remove(tmp_path / "log/batch=000000000002/_SUCCESS")
    assert sorted(r["seq"] for r in storage.read_log(spark, path).collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="batch 2"):
        storage.read_log(spark, path, torn="raise")
    one = next((tmp_path / "log/batch=000000000001").glob("*.parquet"))
    one.write_bytes(one.read_bytes()[:40])
    for crc in (tmp_path / "log/batch=000000000001").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):  # noqa: B017, PT011
        storage.read_log(spark, path, "seq long").collect()


def test_checksum_sees_pairs_of_equal_rows(spark):
    one = spark.createDataFrame([("a",)], "key string")
    other = spark.createDataFrame([("b",)], "key string")
    assert storage.checksum(one.union(one)).first() != storage.checksum(other.union(other)).first()


def test_migration_goes_on_where_it_stopped(spark, tmp_path):
    target = f"file://{tmp_path}/moved"
    strings = spark.createDataFrame([("a", "1"), ("b", "2"), ("x", "3")], "key string, value string")
    hashed = spark.createDataFrame([("a", "f", "1")], "key string, field string, value string")
    assert storage.migrate_to(target, {"string": strings}, prefix="a").count() == 1
    moved = storage.migrate_to(target, {"string": strings, "hash": hashed}, keys=["a", "b"])
    assert sorted((r["type"], r["key"]) for r in moved.collect()) == [("hash", "a"), ("string", "b")]
    assert spark.read.parquet(target).count() == 3


def read_rows(df):
    """Rows that the scan of a query gave, before its filter."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    while text.children().size():
        text = text.children().apply(0)
    return text.metrics().apply("numOutputRows").value()


def test_snapshots_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    rows = spark.range(20_000).select(F.format_string("key:%05d", F.col("id") * 2).alias("key"), F.lit("v").alias("value"))
    storage.write_snapshot(rows, path, storage.Options(files=8))
    stored = spark.read.parquet(path)
    prefix = stored.where(F.col("key").startswith("key:3"))
    plan = prefix._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), StringStartsWith(key,key:3)]" in plan
    assert prefix.count() == 5000 and read_rows(prefix) < 9000
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")  # counts rows, not batches
    missing, there = (stored.where(F.col("key") == k) for k in ("key:10001", "key:10002"))
    assert missing.count() == 0 and read_rows(missing) == 0 and there.count() == 1 and read_rows(there) > 0
    spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    files = storage.manifest(spark, path)
    assert files.count() == 8 and files.agg(F.sum("n_rows")).first()[0] == 20_000


def test_stream_without_files(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    log = feeds.log_stream(spark, f"file://{tmp_path}/none", "seq long, key string, op string, value string, ts timestamp")
    for mode, stream in (("append", feeds.watch(log, ["a*"])), ("update", feeds.folded_stream(log)), ("complete", feeds.folded_stream(log))):
        out = feeds.run_once(stream, mode)
        assert out.count() == 0 and set(stream.columns) <= set(out.columns)


def test_backlog_continues_inside_the_ring(spark):
    log = spark.createDataFrame([(i, "x" * i) for i in range(1, 11)], "seq long, value string")
    placed = feeds.offsets(log)
    last = placed.agg(F.max("end")).first()[0]
    how, rows = feeds.backlog(placed, last - 20, 40)
    assert how == "continue" and rows.count() == 1
    assert feeds.backlog(placed, 0, 40)[0] == "full"


def test_top_plans_have_no_python_and_push_down(spark):
    for name in ("live_top", "prefix_scan", "lww_fold", "zrevrange", "keyslot", "geo_cell"):
        text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "ArrowEval" not in text
    plan = QUERIES["lww_fold"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    top = QUERIES["live_top"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "PushedFilters: [IsNotNull(event_id), LessThanOrEqual(event_id,8000)]" in top


def test_queries_without_the_extras(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "keyfold.llm", None)  # importing it raises ImportError
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(SMALL)

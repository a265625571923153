"""Intake, stores and text comparisons: replayed batches, branches that the driver's tables do not reach, brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from parchmill.operators import comparison as M
from parchmill.operators import intake as I
from parchmill.plans import registry
from parchmill.session import scratch_path
from parchmill.sources.json_files import write_json_atomically
from parchmill.streaming import ledger as L


def test_a_replayed_batch_changes_nothing(spark):
    table, schema = scratch_path(spark, "ledger"), "owner long, message string"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    write = L.once(table, ["owner", "message"], schema)
    first, second = batch((1, "a"), (1, "a"), (2, "a"), (None, "x"), (3, None)), batch((1, "a"), (1, "b"), (2, "c"))
    write(first, 0)
    write(second, 1)
    before = sorted(map(tuple, L.read_ledger(spark, table, schema).collect()))
    assert before == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]
    write(second, 1)
    write(first, 0)
    assert sorted(map(tuple, L.read_ledger(spark, table, schema).collect())) == before
    assert L.read_ledger(spark, scratch_path(spark, "none"), schema).count() == 0


def test_a_stream_that_starts_again_goes_on(spark, tmp_path):
    source, table, checkpoint = str(tmp_path / "in"), scratch_path(spark, "ledger"), str(tmp_path / "check")
    schema = "message long"
    for k in (0, 5):
        spark.range(k, k + 10).select(F.col("id").alias("message")).coalesce(1).write.mode("append").parquet(source)
        L.drain(spark.readStream.schema(schema).parquet(source), L.once(table, ["message"], schema), checkpoint)
    rows = L.read_parts(spark, table, schema).collect()
    assert sorted(r.message for r in rows) == list(range(15)) and {r.batch for r in rows} == {0, 1}


@pytest.mark.parametrize("exact", [True, False])
def test_two_drains_into_one_table_keep_all_rows(spark, tmp_path, exact):
    """Each stream counts its batches from 0; neither writes over the other's parts."""
    table, schema = scratch_path(spark, "ledger"), "message long"
    write = L.once(table, ["message"], schema) if exact else L.append(table)
    for k in (0, 10):
        spark.range(k, k + 10).select(F.col("id").alias("message")).write.parquet(str(tmp_path / f"in{k}"))
        L.drain(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}")), write)
    assert sorted(r.message for r in L.read_ledger(spark, table, schema).collect()) == list(range(20))
    if exact:
        L.drain(spark.readStream.schema(schema).parquet(str(tmp_path / "in0")), write)
        assert L.read_ledger(spark, table, schema).count() == 20


def test_scratch_without_a_setting(monkeypatch):
    """A session that names no folder gets one of its own, the same each time; a cluster's session must name one."""
    from types import SimpleNamespace

    from parchmill import session

    def made(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    local = made("local[2]")
    assert session.scratch_dir(local) == session.scratch_dir(local) and session.scratch_dir(local).startswith("file:///")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x"):
        with pytest.raises(ValueError):
            session.scratch_dir(made(master))


def test_insert_keeps_new_and_protected_rows_and_the_limit(spark):
    schema = "k long, id long, owner long, status string"
    store = spark.createDataFrame([(1, 1, 1, "active"), (2, 2, 1, "done"), (3, 3, 1, "done"), (4, 4, 2, "done")], schema)
    batch = spark.createDataFrame([(2, 9, 1, "done"), (5, 5, 1, "done"), (5, 6, 1, "active"), (None, 7, 3, "done")], schema)
    got = L.insert(store, batch, "k", "owner", ["id"], "status", ["active"], 2)
    assert sorted((r.k or 0, r.id, r.removed) for r in got.collect()) == [(0, 7, False), (1, 1, False), (2, 2, True), (3, 3, True), (4, 4, False), (5, 5, False)]
    seven = spark.createDataFrame([(k, k, 1, "active" if k < 3 else "done") for k in range(1, 8)], schema)
    assert sorted(r.k for r in L.insert(seven, batch.limit(0), "k", "owner", ["id"], "status", ["active"], 5).where("removed").collect()) == [3, 4]


def test_store_is_written_as_a_unit(spark):
    schema = "k long, id long, owner long, status string"
    store = L.Store(scratch_path(spark, "store"), schema, "k", "owner", ["id"], "status", ["active"], 2)
    assert store.rows(spark).collect() == [] and store.archive(spark).collect() == []
    rows = lambda *r: spark.createDataFrame([(k, k, owner, "done") for k, owner in r], schema)
    held = lambda df: sorted(r.k for r in df.collect())
    store.put(rows((1, 1), (2, 1), (3, 2)), 0)
    second = rows((4, 1), (4, 1), (3, 2))
    store.put(second, 1)
    assert held(store.rows(spark)) == [2, 3, 4] and held(store.archive(spark)) == [1]
    store.put(second, 1)  # again
    assert held(store.rows(spark)) == [2, 3, 4] and held(store.archive(spark)) == [1]
    # A batch that was lost before its commit is not there.
    spark.createDataFrame([(9, 9, 1, "done", 0)], schema + ", bucket int").write.partitionBy("bucket").parquet(f"{store.path}/rows/version=2")
    assert held(store.rows(spark)) == [2, 3, 4]
    store.put(rows((5, 2)), 2)
    assert held(store.rows(spark)) == [2, 3, 4, 5]


def test_json_is_replaced_whole(spark):
    path = scratch_path(spark, "json")
    for n in (5, 3):
        write_json_atomically(spark.range(n), path)
        assert spark.read.schema("id long").json(path).count() == n
    with pytest.raises(Exception):
        write_json_atomically(spark.range(2).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.schema("id long").json(path).count() == 3


def test_cursors_quarantine_and_stalled_work(spark):
    c = lambda rows: spark.createDataFrame(rows, "owner string, cursor long")
    got = I.lowered_cursors(c([("a", 10), ("b", 5), ("d", 1)]), c([("a", 12), ("b", 3), ("b", 0), ("e", -1), ("f", None), ("g", 9)]), "owner", "cursor", c([("d", 0)]))
    assert dict(map(tuple, got.collect())) == {"a": 10, "b": 3, "g": 9}
    a = spark.createDataFrame([("m", k, "transient") for k in range(5)] + [("n", 1, "permanent"), ("n", 2, "free"), ("o", 1, "permanent"), ("o", 2, "permanent"), ("o", 9, "permanent")], "m string, at long, kind string")
    requeued = spark.createDataFrame([("o", 5), ("o", 2)], "m string, at long")
    assert {r.m: r.quarantined for r in I.quarantine(a, "m", "at", "kind", requeued).collect()} == {"m": True, "n": False, "o": False}
    now = F.lit("2026-01-01 01:00:00").cast("timestamp")
    rows = spark.createDataFrame([("in_progress", "2026-01-01 00:00:00"), ("in_progress", "2026-01-01 00:59:50"), ("in_progress", None), ("done", "2020-01-01 00:00:00")], "s string, t string").select("s", F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in rows.select(I.shown_status(F.col("s"), F.col("t"), now, 60)).collect()] == ["stalled", "in_progress", "in_progress", "done"]
    assert [r.s for r in I.reconciled(rows, "s", "t", F.lit(False), now, 60).collect()] == ["interrupted", "in_progress", "in_progress", "done"]


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_differences_are_shortest_and_delete_first(spark):
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        ops = M.operations(a, b)
        assert [t for o, t in ops if o != "insert"] == a and [t for o, t in ops if o != "delete"] == b
        assert sum(o == "same" for o, _ in ops) == plain_length(a, b)
    assert M.operations(list("ab"), list("ba")) == [("delete", "a"), ("same", "b"), ("insert", "a")]
    pairs = spark.createDataFrame([("The fee is 1,000.50 now", "The fee is 2 now"), (None, "a b"), ("x", None), (None, None), ("word " * 300, "other " * 300)], "a string, b string")
    got = [[(o.op, o.token) for o in r[0]] for r in pairs.select(M.inline_diff(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [("same", "The"), ("same", " fee"), ("same", " is"), ("delete", " 1,000.50"), ("insert", " 2"), ("same", " now")]
    assert got[1:4] == [[("insert", "a"), ("insert", " b")], [("delete", "x")], []] and [o for o, _ in got[4]] == ["delete", "insert"]
    letters = pairs.limit(1).select(M.inline_diff(F.lit("color"), F.lit("colour"), letters=True)).first()[0]
    assert [(o.op, o.token) for o in letters if o.op != "same"] == [("insert", "u")]


def test_difference_queries_rebuild_both_texts(spark):
    folder = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    for name in ("t15_token_diff", "t16_letter_diff"):
        rows = registry.QUERIES[name](spark, folder).collect()
        assert len(rows) == sum((c, t + 1) in texts for c, t in texts)
        for row in rows:
            ops = json.loads(row.operations)
            assert "".join(o["token"] for o in ops if o["op"] != "insert") == texts[row.conv_id, row.turn]
            assert "".join(o["token"] for o in ops if o["op"] != "delete") == texts[row.conv_id, row.turn + 1]


def test_matching_is_largest(spark):
    r = random.Random(7)
    cases = [[sorted({r.randrange(5) for _ in range(r.randint(0, 3))}) for _ in range(r.randint(1, 5))] for _ in range(300)]
    best = [max(len({p for p in c if p is not None}) if len([p for p in c if p is not None]) == len({p for p in c if p is not None}) else 0 for c in itertools.product(*[[None, *e] for e in edits])) for edits in cases]
    assert [M.largest(e) for e in cases] == best
    rows = [(d, e, p) for d, edits in enumerate(cases) for e, places in enumerate(edits) for p in places]
    got = dict(map(tuple, M.matched(spark.createDataFrame([*rows, (None, 1, 1), (0, None, 1)], "doc long, edit long, place long"), "doc", "edit", "place").collect()))
    assert got == {d: n for d, n in enumerate(best) if any(cases[d])}


def test_matching_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    may = {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").collect():
        may.setdefault(r[0], {}).setdefault(r[1], set()).update({r[2] % 4, r[3] % 4})
    got = dict(map(tuple, registry.QUERIES["j15_matching"](spark, folder).collect()))
    size = lambda picks: len(picks) if len(set(picks)) == len(picks) else 0
    want = {d: max(size([p for p in c if p is not None]) for c in itertools.product(*[[None, *e] for e in list(edits.values())[:12]])) for d, edits in may.items() if len(edits) <= 8}
    assert want and {d: got[d] for d in want} == want and set(got) == set(may)


def test_nested_strings(spark):
    rows = spark.createDataFrame([('{"a": "x", "b": [1, {"c": "y"}, ["z", null]]}',), ("[",), (None,), ('"s"',), ("[" * 100_000,)], "v string")
    assert [r[0] for r in rows.select(M.nested_strings("v")).collect()] == [["x", "y", "z"], [], [], ["s"], []]


def test_coverage(spark):
    s = "doc long, index int, text string"
    source = [(1, 1, "a  b"), (1, 2, "c"), (2, 1, "a long text that matters"), (2, 2, "end"), (3, 1, " "), (4, 1, "a"), (4, 2, "b"), (5, 1, "x")]
    export = [(1, 1, "a b"), (1, 2, " "), (1, 3, "c"), (2, 2, "end"), (4, 1, "b"), (4, 2, "a")]
    got = {r.doc: (r.verdict, r.first) for r in M.coverage(spark.createDataFrame(source, s), spark.createDataFrame(export, s), "doc").collect()}
    assert {k: tuple(v) for k, v in got.items()} == {1: ("covered", None), 2: ("short", None), 4: ("diverging", 1), 5: ("empty", None)}


def test_lineage_of_chains_forks_and_cycles(spark):
    from parchmill.operators import reconcile

    rows = [(1, k, k - 1 if k else None, "r") for k in range(200)] + [(2, 1, None, "b"), (2, 2, 1, "b"), (2, 3, 1, "a"), (2, 4, 9, "a"), (2, 5, 6, "a"), (2, 6, 5, "a"), (2, 7, 5, "a")]
    table = spark.createDataFrame(rows, "doc long, id long, up_id long, role string")
    got = {(r.doc, r.id): (r.depth, r.cyclic) for r in reconcile.lineage(table, "id", "up_id", ["role"], "doc").collect()}
    assert got == {(1, k): (k, False) for k in range(200)} | {(2, 1): (0, False), (2, 2): (1, False), (2, 3): (1, False), (2, 4): (0, False), (2, 5): (0, True), (2, 6): (0, True), (2, 7): (0, True)}
    paths = reconcile.lineage(table.where("doc = 2 and id < 5"), "id", "up_id", ["role"], "doc", paths=True).orderBy("path").collect()
    assert [r.id for r in paths] == [4, 1, 3, 2] and [x.id for x in paths[2].path] == [1, 3]


@pytest.mark.parametrize("width", ["3", "50"])
def test_retention_in_ranges_equals_one_sort(spark, width):
    from parchmill.operators import retention

    r = random.Random(5)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), r.randint(1, 50), r.random() < 0.7) for k in range(300)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "id long, owner string, bytes long, closed boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        for ceiling in (0, 100, 250, 300, 999):
            want = [x[0] for x in sorted(rows) if x[3]][: max(0, 300 - ceiling)]
            assert sorted(x.id for x in retention.over_ceiling(table, F.col("closed"), ["id"], ceiling).collect()) == want
        gone = []
        for owner in ("a", "b", None):
            own = sorted(x for x in rows if x[1] == owner)
            for k, x in enumerate(own):
                if sum(y[2] for y in own[k:]) > 500 and len(own) - k > 5:
                    gone.append(x[0])
        assert sorted(x.id for x in retention.rotated(table, "owner", ["id"], "bytes", 500, 5).collect()) == sorted(gone)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

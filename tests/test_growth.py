"""Steps whose work must be spread over all cores, and done once, however the input is cut."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from keyspan.functions.keyspace import KeyRange
from keyspan.plans import log, sql
from keyspan.plans.catalog import GLOBAL, ShardCatalog, TableDef, TableName
from keyspan.plans.planner import Planner
from keyspan.sources import pgoutput, pgoutput_batch
from keyspan.sources.store import Store
from keyspan.streaming import apply, changes
from keyspan.streaming.changes import net_changes, row_changes, transactions

SCHEMA = {TableName("public", "orders"): TableDef("k", "int", sequences=(("id", "orders_id"),)), TableName("public", "nation"): GLOBAL}
SHARDS = ShardCatalog.even(4)


def one_part(spark, text, n=40):
    """(id, text, args) of n statements in a single partition."""
    return spark.range(0, n, 1, 1).select("id", F.replace(F.lit(text), F.lit("{k}"), F.col("id").cast("string")).alias("text"), F.lit(None).cast("array<string>").alias("args"))


def spread(df, least=4):
    """The rows, which several tasks must have made."""
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in rows}) >= least
    return sorted(rows, key=lambda r: r["id"])


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM orders WHERE k = 7 AND a = 'it''s'", "SELECT * FROM orders WHERE k = '7'", "SELECT * FROM orders WHERE k = 0x7", "SELECT * FROM orders WHERE k = 1.5", "SELECT * FROM orders WHERE k=-7", "SELECT * FROM orders WHERE k=--7\n8", "SELECT * FROM orders WHERE k=/*7*/8",
        "SELECT * FROM orders WHERE k = 7 -- '8\n", "SELECT * FROM orders WHERE k = 'x -- \n'", "SELECT * FROM orders WHERE k = E'7'", "SELECT * FROM orders WHERE k = $$7$$", "SELECT * FROM orders WHERE k = $7", "SELECT * FROM orders WHERE k = 7 OR k = 8", "SELECT * FROM orders WHERE k IN (7, 8, 9)",
        "UPDATE orders SET 'k' = 1 WHERE k = 7", "UPDATE orders SET 'j' = 1 WHERE k = 7", "SELECT \"a7\" FROM nation", "SELECT * FROM orders WHERE k = 'a", "SELECT 7 7 FROM", "SELECT 7; SELECT 8", "INSERT INTO orders (k) VALUES (7), (8)", "", "7",
    ],
)
def test_a_shape_is_read_as_each_of_its_texts(text):
    """Whatever text of a shape came before, a statement is planned as it is by itself."""
    planner = Planner(SCHEMA, SHARDS)
    of = lambda p: p.code if isinstance(p, sql.SqlError) else (p.kinds, p.fingerprint, p.tables, planner.plan_all(p))
    try:
        alone = of(sql.parse(text))
    except sql.SqlError as error:
        alone = error.code
    shapes = sql.Shapes(of)
    for before in (text, text.replace("7", "9"), text.replace("7", "70000000000000000000"), text.replace("7", "6"), text.replace("'k'", "'j'"), text.replace("'j'", "'k'")):
        shapes(before)
    assert shapes(text) == alone and sql.Shapes(of)(text) == alone


def test_statements_of_a_shape_are_parsed_once(monkeypatch):
    parses = []
    parsed = sql._parsed
    monkeypatch.setattr(sql, "_parsed", lambda *x: parses.append(1) or parsed(*x))
    planner = Planner(SCHEMA, SHARDS)
    shapes = sql.Shapes(lambda p: planner.plan_all(p)[0], most=2)
    assert len({shapes(f"SELECT * FROM orders WHERE k = {k}").shard for k in range(100)}) == 4 and len(parses) == 1
    for i in range(5):  # no more shapes are kept than `most`
        shapes(f"SELECT {'a, ' * i}b FROM nation")
    assert len(shapes.known) <= 2


def test_f1_ids_are_given_by_many_tasks(spark):
    rows = one_part(spark, "INSERT INTO orders (k, a) VALUES ({k}, ')'), ({k}, 'b')")
    needed = log.ids_needed(rows, SCHEMA)
    assert {(tuple(r["columns"]), r["rows"]) for r in spread(needed)} == {(("id",), 2)}
    out = spread(log.with_ids(needed.coalesce(1).withColumn("first", F.col("id") * 2)))
    assert [r["text"] for r in out] == [f"INSERT INTO orders (k, a, id) VALUES ({k}, ')', {2 * k}), ({k}, 'b', {2 * k + 1})" for k in range(40)]


def test_f3_reads_are_routed_by_many_tasks(spark):
    found = spread(log.route_log(one_part(spark, "SELECT * FROM orders WHERE k = {k}"), SCHEMA, SHARDS))
    planner = Planner(SCHEMA, SHARDS)
    assert [r["shards"] for r in found] == [planner.plan_all(sql.parse(f"SELECT * FROM orders WHERE k = {k}"))[0].shard for k in range(40)]


def test_f5_parameters_are_bound_by_many_tasks(spark):
    """Statements of one shape, each with values of its own."""
    rows = one_part(spark, "DELETE FROM orders WHERE k IN ($1, $2)").withColumn("args", F.array(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("x")))
    found = spread(log.route_log(rows, SCHEMA, SHARDS))
    assert [r["route"] for r in found] == ["single", "reject"] * 20 and len({r["shards"] for r in found if r["shards"]}) == 4


def test_f6_fingerprints_are_taken_by_many_tasks(spark):
    rows = one_part(spark, "SELECT a FROM orders WHERE k = {k}").unionByName(one_part(spark, "SELECT b FROM orders WHERE k = '{k}'").withColumn("id", F.col("id") + 40)).coalesce(1)
    found = spread(log.route_log(rows, SCHEMA, SHARDS))
    assert [r["fingerprint"] for r in found] == [sql.parse(f"SELECT {c} FROM orders WHERE k = 1").fingerprint for c in "ab" for _ in range(40)]


def test_f7_shapes_are_classified_by_many_tasks(spark):
    """The position in ORDER BY is a literal, and counts."""
    result = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(40)]).schema
    found = spread(log.scatter_log(one_part(spark, "SELECT * FROM orders ORDER BY {k}"), result))
    assert [(r["shape"], r["keys"], r["positions"]) for r in found] == [("unsupported", "", "")] + [("ordered", f"{k} asc last", str(k - 1)) for k in range(1, 40)]


def test_f9_writes_are_routed_by_many_tasks(spark):
    rows = one_part(spark, "INSERT INTO orders (k) VALUES ({k}), (7)")
    found = spread(log.route_log(rows, SCHEMA, SHARDS))
    planner = Planner(SCHEMA, SHARDS)
    home = [planner.plan_all(sql.parse(f"SELECT * FROM orders WHERE k = {k}"))[0].shard for k in range(40)]
    assert [(r["route"], r["shards"], r["code"]) for r in found] == [("single", h, "") if h == home[7] else ("reject", "", "0A000") for h in home]


def decoded(frames, in_stream=None):
    """(batch decoder's rows, single decoder's rows) of frames; an error's text instead of rows."""
    arrow = to_arrow_schema(_parse_datatype_string(pgoutput.SCHEMA))
    inside, n = in_stream or [False] * len(frames), len(frames)
    batch = pa.RecordBatch.from_arrays([pa.array(["s"] * n), pa.array(range(n), pa.int64()), pa.array(frames, pa.binary()), pa.array(range(n), pa.int64()), pa.array(inside, pa.bool_())], names=["shard", "seq", "frame", "txn", "in_stream"])

    def singly():
        d, out = pgoutput.Decoder(), []
        for i, f in enumerate(frames):
            d.in_stream = inside[i]
            out.append({"shard": "s", "seq": i, "txn": i} | d.decode(f))
        return [{f.name: r.get(f.name) for f in arrow} for r in out]

    def told(run):
        try:
            return run()
        except pgoutput.DecodeError as error:
            return str(error)

    return told(lambda: pgoutput.decode_batch(batch, arrow).to_pylist()), told(singly)


def test_f10_a_batch_of_frames_is_decoded_as_each_by_itself(spark):
    rows = [[], [None], [b"", ..., b"abc"], [b"x" * 9, None]]
    good = [pgoutput.begin(1 << 63, (1 << 32) - 1, -5), pgoutput.commit(7, (1 << 64) - 1), pgoutput.relation(7, "public", "t", [("id", 20, True)]), b"I\0\0\0\7N\0\1b\0\0\0\2\0\xff"]
    for row in rows:
        good += [pgoutput.insert((1 << 32) - 1, row), pgoutput.update(7, row), *(pgoutput.update(7, row, key) for key in rows), pgoutput.delete(7, row), pgoutput.delete(7, row).replace(b"K", b"O", 1)]
    for frames in ([], good, good[::-1], good[2:3], good[:1]):
        batch, single = decoded(frames)
        assert batch == single and isinstance(batch, list)
    inside = [b"I\0\0\0\7" + good[4][1:], good[0]]
    assert decoded(inside, [True, False])[0] == decoded(inside, [True, False])[1]
    for f in good:
        for bad in [f[:n] for n in range(len(f))] + [f + b"x", f[:5] + b"?" + f[6:], f[:6] + b"\xff" + f[7:], f[:8] + b"\xff" + f[9:]]:
            batch, single = decoded([good[0], bad, good[1]])
            assert batch == single, bad


def frames_of(spark, n):
    out = [pgoutput.relation(7, "public", "t", [("id", 20, True), ("v", 25, False)])]
    for i in range(n):
        if i == n // 2:
            out.append(pgoutput.relation(7, "public", "t", [("id", 20, True), ("w", 25, False)]))
        out += [pgoutput.begin(i), pgoutput.insert(7, [str(i).encode(), b"a"]), pgoutput.commit(i, i)]
    return spark.createDataFrame([("s0", i, bytearray(f)) for i, f in enumerate(out)], "shard string, seq long, frame binary")


def test_f10_frames_are_decoded_once(spark):
    plan = transactions(pgoutput.decode_frames(frames_of(spark, 4)))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("few", [0, 1000])
def test_f8_relations_are_looked_up_as_of_each_change(spark, monkeypatch, few):
    """Few descriptions are sent to the changes, which then need no order; many are merged with them; the rows are the same."""
    monkeypatch.setattr(changes, "FEW", few)
    found = row_changes(transactions(pgoutput.decode_frames(frames_of(spark, 6))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Window" in plan) == (few == 0)
    assert [[c["name"] for c in r["cells"]] for r in sorted(found.collect(), key=lambda r: r["seq"])] == [["id", "v"]] * 3 + [["id", "w"]] * 3


def test_f2_the_rows_of_a_range_are_told_once(spark, tmp_path, monkeypatch):
    """What is read many times is a table of the range's changes: hashes are not worked out in each reading."""
    store = Store(spark, str(tmp_path / "store"))
    store.create("public.t", _parse_datatype_string("id bigint, v string, w string"), TableDef("id", "int"))
    plans = []
    monkeypatch.setattr(apply, "steps", lambda df: plans.append(df._jdf.queryExecution().toString()) or changes.steps(df))
    rows = frames_of(spark, 8).filter("seq < 13")
    apply.Applier(store, "c", {"public.t": ["id"]}, SHARDS).apply_frames(rows, KeyRange(0, 1 << 63), {"public.t": ("id", "int")})
    assert plans and not any("xxhash64" in p for p in plans)
    inside = [k for k in range(4) if Planner(SCHEMA, SHARDS).plan_all(sql.parse(f"SELECT * FROM orders WHERE k = {k}"))[0].shard in ("-40", "40-80")]
    assert inside and sorted(r["id"] for r in store.read("public.t").collect()) == inside


@pytest.mark.parametrize("wait", [0, 3, 20_000])
@pytest.mark.parametrize("size", [1, 4, 1000])
def test_f8_frames_are_told_their_commit_where_they_are(monkeypatch, wait, size):
    """However a part of a log is cut into batches: sums go on, and a commit that is not at hand is one that can be looked up."""
    monkeypatch.setattr(pgoutput_batch, "WAIT", wait)
    rows, i = [], 0
    for shard, kinds in ((None, "IC R BIIC"), ("a", "C"), ("b", "BIIIIIIIC R SIE BC BIIC BII"), ("c", "E BI")):
        for kind in kinds.replace(" ", ""):
            frame = {"B": pgoutput.begin(i), "C": pgoutput.commit(i * 10, i * 10 + 5), "R": pgoutput.relation(7, "public", "t", [])}.get(kind, kind.encode())
            rows.append({"shard": shard, "seq": i, "frame": frame, "part": 0})
            i += 1
    arrow = to_arrow_schema(_parse_datatype_string("shard string, seq long, frame binary, part int, mark long, upto long, txn_lsn long, txn_end long, closes boolean"))
    given = pa.schema([arrow.field(n) for n in ("shard", "seq", "frame", "part")])
    batches = [pa.RecordBatch.from_pylist(rows[at : at + size], schema=given) for at in range(0, len(rows), size)]
    found = [r for b in pgoutput_batch.mark(iter(batches), arrow) for r in b.to_pylist()]
    assert [{k: r[k] for k in given.names} for r in found] == rows
    value, sums, txns = {"B": 1 << 32, "S": 1, "E": -1}, {}, {}
    for r in found:
        shard, tag = r["shard"], r["frame"][:1].decode()
        sums[shard] = sums.get(shard, 0) + value.get(tag, 0)
        assert (r["mark"], r["upto"]) == (value.get(tag, 0), sums[shard])
        of = txns.setdefault((shard, sum(x["frame"][:1] == b"B" for x in found if x["shard"] == shard and x["seq"] <= r["seq"])), [])
        of.append(r)
    for of in txns.values():
        commits = [r for r in of if r["frame"][:1] == b"C"]
        want = (commits[0]["seq"] * 10, commits[0]["seq"] * 10 + 5) if commits else (None, None)
        for r in of:
            assert (r["txn_lsn"], r["txn_end"]) == want or (r["txn_lsn"] is None and commits[0]["closes"])


def test_f8_commits_are_found_across_parts(spark):
    """A transaction of many frames, longer than a part; frames before, between and after transactions."""
    frames = [pgoutput.relation(7, "public", "t", [("id", 20, True)]), pgoutput.begin(1), *[pgoutput.insert(7, [b"%d" % i]) for i in range(50)], pgoutput.commit(1, 2), pgoutput.begin(3), pgoutput.commit(3, 4), pgoutput.begin(5), pgoutput.insert(7, [b"x"])]
    df = spark.createDataFrame([(s, i, bytearray(f)) for s in ("a", "b", None) for i, f in enumerate(frames)], "shard string, seq long, frame binary")
    want = [(0, None, None)] + [(1, 1, 2)] * 52 + [(2, 3, 4)] * 2 + [(3, None, None)] * 2
    found = pgoutput.decode_frames(df).collect()
    for s in ("a", "b", None):
        assert [(r["txn"], r["txn_lsn"], r["txn_end"]) for r in sorted((r for r in found if r["shard"] == s), key=lambda r: r["seq"])] == want


def test_f8_steps_of_a_key_are_read_once(spark, tmp_path):
    """Steps are folded in one reading; a whole row ends what is carried over, unless it has fewer cells."""
    cell = lambda name, value: {"name": name, "kind": "unchanged" if value is ... else "text", "value": None if value is ... else value}
    histories = {
        "whole": [("insert", "abc"), ("update", "def")], "part": [("insert", "abc"), ("update", ["x", ..., ...]), ("update", [..., "y", ...])], "twice": [("insert", "abc"), ("update", "def"), ("update", ["x", ..., ...])],
        "narrow": [("insert", "abc"), ("update", "de")], "anew": [("insert", "abc"), ("delete", None), ("insert", "d")], "gone": [("insert", "abc"), ("delete", None)], "held": [("update", [..., "x"])], "held, gone": [("update", "ab"), ("delete", None)],
    }
    want = {"whole": "def", "part": ["x", "y", "c"], "twice": ["x", "e", "f"], "narrow": "dec", "anew": "d", "held": [..., "x"]}
    rows = [([k], i, i, 0, op, None if c is None else [cell("abc"[j], v) for j, v in enumerate(c)], "absent" if op == "insert" else "present") for k, h in histories.items() for i, (op, c) in enumerate(h)]
    schema = "key array<string>, commit_lsn long, seq long, part int, op string, cells array<struct<name:string,kind:string,value:string>>, before string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "steps"))
    net = net_changes(spark.read.parquet(str(tmp_path / "steps")), spark.createDataFrame([(["held"],), (["held, gone"],)], "key array<string>"))
    found = {r["key"][0]: r for r in net.collect()}
    assert {k: (r["op"], r["cells"] and [... if c["kind"] == "unchanged" else c["value"] for c in r["cells"]]) for k, r in found.items()} == {k: ("upsert", list(v)) for k, v in want.items()} | {"held, gone": ("delete", None)}
    assert net._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_f4_transactions_applied_before_are_dropped(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.create("public.t", _parse_datatype_string("id bigint, v string, w string"), TableDef("id", "int"))
    looked = []
    monkeypatch.setattr(apply, "row_changes", lambda df: looked.append(df.filter("op <> 'relation'").count()) or row_changes(df))
    applier = apply.Applier(store, "c", {"public.t": ["id"]}, SHARDS)
    done = [applier.apply_frames(frames_of(spark, 8).filter(f"seq < {n}")) for n in (13, 13, 100, 100)]
    assert looked == [4, 0, 4, 0] and [d["lsn"] for d in done] == [3, 3, 7, 7]
    assert sorted((r["id"], r["w"]) for r in store.read("public.t").collect()) == [(i, None if i < 4 else "a") for i in range(8)]


def test_f4_transactions_applied_before_are_not_decoded_again(spark):
    """But for the relations that they describe."""
    found = sorted((r["seq"], r["op"]) for r in pgoutput.decode_frames(frames_of(spark, 4), after=2).collect())
    assert found == [(0, "relation"), (7, "relation"), (11, "begin"), (12, "insert"), (13, "commit")]

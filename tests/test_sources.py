"""File sources and sinks: declared schemas, missing-file fallback, reuse."""
import os

from conftest import SF_SMALL
from creditlake.operators import aggregates as A
from creditlake.sources import io as IO
from creditlake.sources import roles
from creditlake.sources.roles import role


def test_missing_csv_gives_empty_frame_with_schema(spark):
    df = IO.read_csv_or_empty(spark, "/tmp/definitely-not-here-creditlake", "age int, balance double")
    assert df.count() == 0 and df.columns == ["age", "balance"]


def test_csv_round_trip_with_row_cap(spark):
    app = role(spark, SF_SMALL, "application")
    path = IO.write_csv(app, IO.shared_path(spark, "t_app_csv"))
    back = IO.read_csv(spark, path, app.schema, row_cap=10)
    assert back.count() == 10 and [f.dataType for f in back.schema] == [f.dataType for f in app.schema]
    assert IO.schema_only(spark, path, app.schema).count() == 0


def test_materialize_or_reuse_builds_once(spark):
    path = IO.shared_path(spark, "t_reuse")
    calls = []

    def build():
        calls.append(1)
        return role(spark, SF_SMALL, "bank_marketing")

    a = IO.materialize_or_reuse(spark, path, build)
    b = IO.materialize_or_reuse(spark, path, build)
    assert len(calls) == 1 and a.count() == b.count() > 0
    assert os.path.exists(path.replace("file:", "") + "/_SUCCESS")


def test_large_joined_roles_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Tasks of the joins over lineitem hold a bounded share of it, whatever size the
    session merges tasks to; null and repeated keys give what the plain join gives."""
    keys = [None, *range(40), 7, 7]
    orders = [(k, k and k % 5, "O", 10.0, "1-URGENT") for k in keys]
    lines = [(k, 3, n, 2.0, 5.0, 0.1, "NR"[n % 2], "F") for k in keys for n in range(1, 5)]
    (spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
     .selectExpr("*", "timestamp '2001-12-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet")))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {}
    for small in (roles.SMALL_JOIN, 0):
        monkeypatch.setattr(roles, "SMALL_JOIN", small)
        monkeypatch.setattr(roles, "TASK_BYTES", max(1, roles._table_bytes(spark, str(tmp_path), "lineitem") // 40))
        pos, inst = (role(spark, str(tmp_path), n) for n in ("pos_cash_balance", "installments_payments"))
        assert (min(pos.rdd.getNumPartitions(), inst.rdd.getNumPartitions()) >= 40) == (small == 0)
        found[small] = [sorted(map(repr, x.collect())) for x in (pos, inst, A.aggregate_pos_cash(pos))]
    assert found[0] == found[32 << 20] and len(found[0][0]) == 31 * 4 + 3 * 12  # 8 orders of customer 0 filtered out, key 7 thrice


def test_tasks_of_a_join_grow_with_its_bytes(spark):
    assert roles.join_tasks(spark, roles.SMALL_JOIN) == 0
    assert roles.join_tasks(spark, 600 << 20) == 150 and roles.join_tasks(spark, 3600 << 20) == 900
    assert roles.join_tasks(spark, 1 << 50) == roles.MAX_TASKS

"""Operators that do a whole job, on small tables of known results."""

from corvane import relational


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return sorted(map(tuple, relational.QUERIES[name](spark, str(tmp_path)).collect()))


def test_bindings_of_every_position(spark, tmp_path):
    rows = [(1, 0, "a b c d e f"), (1, 1, "p q r s t u v"), (1, 3, "x"), (2, 1, "y")]
    want = [(1, 0, i, x, y) for i, (x, y) in enumerate(zip("abcdef", "pqrstu", strict=True))]
    assert run(spark, tmp_path, "param_binding_positional", conversations=(rows, "conv_id long, turn int, text string")) == want


def test_reach_and_cycles_of_every_type(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    # 1 -> 2 -> 3 -> 1 by views, 4 -> 5 by errors, and 8 too late after them
    seen = [(0, "view", 1), (5, "view", 2), (10, "view", 3), (15, "view", 1), (1, "error", 4), (6, "error", 5), (600, "error", 8)]
    rows = [(i, start + timedelta(seconds=s), kind, user) for i, (s, kind, user) in enumerate(seen)]
    events = (rows, "event_id long, ts timestamp_ntz, event_type string, user_id long")
    customer = ([(2, "BUILDING"), (4, "BUILDING"), (8, "BUILDING"), (1, "OTHER")], "c_custkey long, c_mktsegment string")
    want = [("error", 4), ("error", 5), ("view", 1), ("view", 2), ("view", 3)]
    assert run(spark, tmp_path, "graph_reach_multi", events=events, customer=customer) == want
    assert run(spark, tmp_path, "graph_scc_cycles") == [("view", a, 1) for a in (1, 2, 3)]


def test_every_secret_of_a_document(spark, tmp_path):
    a, b = 'Token = "é漢1"', 'api_key="zz zz"'
    rows = [(1, f"x {a} y\n{b}{b}"), (2, a), (3, "none"), (4, None)]
    want = [(1, 0, 2, "token", 3), (1, 1, len(f"x {a} y\n"), "api_key", 5), (1, 2, len(f"x {a} y\n{b}"), "api_key", 5), (2, 0, 0, "token", 3)]
    assert run(spark, tmp_path, "hardcoded_secret_scan", documents=(rows, "doc_id long, text string")) == want

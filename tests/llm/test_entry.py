import __spark_entry__ as entry


def test_one_query_for_each_operator():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {"op6_mixing", "op8_nearest_neighbours"} <= set(entry.oracle_sql())

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() == 1
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 45


def test_every_query_of_the_library_can_be_planned(spark):
    from tablewright.plans import queries as own

    for query in own.queries().values():
        assert query(spark, entry.SMALL).columns

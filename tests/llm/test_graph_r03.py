"""What the driver keeps of an operator of many rounds."""

from tessellate.llm import graph
from tessellate.llm.storage import stored


def test_what_a_stored_table_came_from_is_collected(spark):
    jvm = spark.sparkContext._jvm
    thing = jvm.java.lang.Object()
    held = jvm.java.lang.ref.WeakReference(thing)
    spark.sparkContext._gateway.detach(thing)
    stored(spark.range(3), "three")
    assert held.get() is None


def test_groups_go_on_from_the_groups_so_far(spark, monkeypatch):
    first = spark.createDataFrame([(k, k + 1) for k in range(1, 64)] + [(200, 201)], "a long, b long")
    more = spark.createDataFrame([(64, 0), (201, 300)], "a long, b long")
    tables, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: (tables.append(label), write(df, label))[1])
    parts = write(graph.components(first), "parts")
    tables.clear()
    whole = {tuple(r) for r in graph.components(first.unionByName(more)).collect()}
    rounds = len(tables)
    tables.clear()
    assert {tuple(r) for r in graph.components(graph.edges_of(parts).unionByName(more)).collect()} == whole
    assert len(tables) < rounds and whole == {(k, 0) for k in range(65)} | {(k, 200) for k in (200, 201, 300)}

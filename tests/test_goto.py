import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factloom.operators.navigate import goto_definition, lookup_symbol, rank_by_scope


@pytest.mark.parametrize("layered", [False, True])
def test_goto_equals_the_best_of_all_candidates(spark, layered):
    rng = random.Random(4)
    paths = [f"d{rng.randrange(4)}/{'s/' * rng.randrange(2)}f{i}.x" for i in range(40)] + ["top.x"]
    names = ["hot", "a", "b.a", "o.hot", "lone"]
    decl = [(p, n, n, rng.choice(["class", "function"]), rng.randrange(9)) for p in paths for n in rng.sample(names, 2) if rng.random() < 0.6]
    symbols = spark.createDataFrame(decl + decl[:3], "path string, name string, qualified_name string, kind string, line int")
    asked = [(n, p) for p in [*paths, "not/indexed.x"] for n in ("hot", "a", "b.a", "none")]
    queries = spark.createDataFrame(asked + asked[:4], "name string, from_path string")
    visible = spark.createDataFrame([(rng.choice(paths), rng.choice(paths)) for _ in range(120)], "from_path string, path string")
    layers = spark.createDataFrame([(p, f"l{rng.randrange(4)}") for p in paths if rng.random() < 0.9], "path string, layer string")
    sees = spark.createDataFrame([("l0", "l0"), ("l0", "l1"), ("l1", "l1"), ("l2", "l3")], "layer string, visible string") if layered else None
    found = lookup_symbol(symbols, queries).select("query", "path", "line", "qualified_name", "kind", "match")
    every = queries.select(F.col("name").alias("query"), "from_path").distinct().join(found, "query")
    best = rank_by_scope(every, visible, layers, sees).groupBy("query", "from_path").agg(
        F.min(F.struct("score", "path", "line", "qualified_name", "kind")).alias("b")
    )
    want = rows(best.select("query", "from_path", "b.*"))
    got = goto_definition(symbols, queries, visible, layers, sees)
    assert rows(got) == want and len({r[2] for r in want}) >= 5

import random

from pyspark.sql import functions as F

from plumbline.llm.common import Bitmap, Scratch, checkpoint_folder, components


def test_components_of_stars_chains_and_random_graphs(spark):
    dice = random.Random(1)
    edges = [(1000, i) for i in range(300)] + [(i + 5000, i + 5001) for i in range(60)]
    edges += [(20_000 + dice.randrange(200), 20_000 + dice.randrange(200)) for _ in range(130)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in up}


def test_bitmap_never_misses_a_key(spark):
    keys = spark.range(0, 50_000, 7).toDF("k")
    marked = Bitmap(keys, ["k"]).mark(spark.range(50_000).toDF("k").withColumn("bucket", F.lit("x")), "maybe").collect()
    assert all(r.maybe for r in marked if r.k % 7 == 0) and all(r.bucket == "x" for r in marked)
    assert sum(r.maybe for r in marked if r.k % 7) < 0.15 * 50_000
    none = Bitmap(keys.limit(0), ["k"]).mark(keys, "maybe")
    assert none.filter("maybe").count() == 0


def test_scratch_tables_are_dropped(spark):
    room = Scratch(spark)
    df = room.put("t", spark.range(5).toDF("x"))
    assert df.count() == 5 and room.root.startswith(checkpoint_folder(spark))
    room.drop("t", "never written")
    assert not room._at("t").exists(room._path("t"))

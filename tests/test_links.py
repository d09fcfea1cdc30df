import itertools

from pyspark.sql import functions as F

from lexiloom.core import links


def per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_expand_links_equals_brute_force(spark):
    left = [(1, k) for k in range(37)] + [(2, 100), (3, 200), (3, 201)]
    right = [(1, 1000 + k) for k in range(9)] + [(2, 2000 + k) for k in range(25)] + [(9, 1)]
    joined = [(1, 1), (1, 2), (2, 2), (3, 2), (3, 9), (4, 1)]
    ls, rs = spark.createDataFrame(left, "class long, l long"), spark.createDataFrame(right, "class long, r long")
    out = links.expand_links(spark.createDataFrame(joined, "class_a long, class_b long"), ls, rs, block=10)
    want = sorted((a, b, x, y) for a, b in joined for c, x in left if c == a for d, y in right if d == b)
    assert sorted(tuple(r) for r in out.select("class_a", "class_b", "l", "r").collect()) == want
    assert links.expand_links(spark.createDataFrame(joined, "class_a long, class_b long"), ls.limit(0), rs, block=10).count() == 0


def test_keyed_pairs_equal_brute_force(spark):
    rows = [(1, k, "x") for k in range(45)] + [(2, 1, "y"), (2, 2, "z"), (2, 2, "w"), (3, 7, "x"), (None, 8, "x"), (None, 9, "x")] + [(10 + k // 3, k, "q") for k in range(60)]
    df = spark.createDataFrame(rows, "key long, v long, t string").repartition(5)
    for block in (1, 10, 1000):
        out = links.keyed_pairs(df, "key", "v", block=block)
        want = sorted((a[1], b[1], a[2], b[2]) for a, b in itertools.product(rows, repeat=2) if a[0] is not None and a[0] == b[0] and a[1] < b[1])
        assert sorted(tuple(r) for r in out.select("v_a", "v_b", "t_a", "t_b").collect()) == want
    assert links.keyed_pairs(df.limit(0), "key", "v").count() == 0


def test_keyed_pairs_over_batches(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        rows = [(k // 5, k) for k in range(100)] + [(1000, 1000 + k) for k in range(40)] + [(2000, 5000 + k) for k in range(19)]
        out = links.keyed_pairs(spark.createDataFrame(rows, "key long, v long").coalesce(1), "key", "v", block=20)
        assert sorted(tuple(r) for r in out.collect()) == sorted((a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_a_huge_class_spreads_over_tasks(spark):
    n, block = 3000, 250
    members = spark.createDataFrame([(7, k) for k in range(n)], "class long, id long")
    self_link = spark.createDataFrame([(7, 7)], "class_a long, class_b long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        both = links.expand_links(self_link, members.withColumnRenamed("id", "l"), members.withColumnRenamed("id", "r"), block)
        loads = per_task(both)
        assert sum(loads) == n * n and max(loads) < 0.3 * n * n and len(loads) >= 12
        loads = per_task(links.keyed_pairs(members, "class", "id", block))
        assert sum(loads) == n * (n - 1) // 2 and max(loads) < 0.3 * sum(loads) and len(loads) >= 12
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert links.member_pairs(self_link, members, block).count() == n * (n - 1) // 2

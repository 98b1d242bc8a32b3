from tallyspark.functions import tables


def test_pack_lines(spark):
    tables.register(spark)
    rows = [("a", 1, "x" * 10), ("a", 2, "y" * 10), ("a", 3, "z" * 100), ("a", 4, None), ("a", 5, "w"), ("b", 7, ""), (None, 1, "n")]
    spark.createDataFrame(rows, "key string, n long, text string").repartition(3).createOrReplaceTempView("lines_to_pack")
    got = spark.sql("SELECT * FROM pack_lines(6, TABLE(SELECT key, n, text FROM lines_to_pack) PARTITION BY key ORDER BY n)").collect()
    assert sorted(((r.key or "", r.chunk, r.first, r.n_lines, r.tokens, r.text) for r in got)) == [
        ("", 1, 1, 1, 1, "n"), ("a", 1, 1, 2, 6, "x" * 10 + "\n" + "y" * 10), ("a", 2, 3, 1, 26, "z" * 100), ("a", 3, 4, 2, 1, "\nw"), ("b", 1, 7, 1, 1, ""),
    ]
    assert spark.sql("SELECT * FROM pack_lines(6, TABLE(SELECT key, n, text FROM lines_to_pack WHERE n > 9) PARTITION BY key ORDER BY n)").collect() == []

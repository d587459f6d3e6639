from marlstone.operators import joins


def test_watchlist_of_more_criteria_than_a_broadcast_holds(spark):
    df = spark.createDataFrame([(1, "a", 1990, 10.0), (2, "b", 1995, 20.0), (3, None, 1999, 5.0)], "n int, make string, year int, price double")
    many = spark.range(100_003).selectExpr("id", "case when id < 3 then 'a' when id < 100000 then 'c' end as make", "case when id in (1, 100001) then 1995 end as min_year", "case when id = 100002 then 12.0 end as max_price")
    got = joins.watchlist_matches(df, many, {"make": "make"}, {"min_year": "year"}, {"max_price": "price"})
    want = [(1, 0), (1, 2), (1, 100000), (1, 100002), (2, 100000), (2, 100001), (3, 100000), (3, 100001), (3, 100002)]
    assert sorted((r["n"], r["w_id"]) for r in got.collect()) == want


def test_first_matches_without_pairs(spark):
    """The first matches by price are those of all pairs ranked, and only k listings of a group ever meet a criterion."""
    df = spark.range(400).selectExpr("id as n", "case when id % 7 > 0 then concat('m', id % 3) end as make", "case when id % 11 > 0 then cast(1990 + id % 5 as int) end as year", "case when id % 13 > 0 then cast(id * 37 % 101 as double) end as price")
    watch = spark.range(60).selectExpr("id", "case when id % 4 > 0 then concat('m', id % 4) end as make", "case when id % 2 = 0 then cast(1990 + id % 5 as int) end as min_year", "case when id % 3 > 0 then id % 9 * 10.0 end as max_price")
    every = joins.top_per_group(joins.watchlist_matches(df, watch, {"make": "make"}, {"min_year": "year"}, {"max_price": "price"}), ["w_id"], [df["price"], df["n"]], 4)
    got = joins.watchlist_top(df, watch, "id", {"make": "make"}, {"min_year": "year"}, ("max_price", "price"), [df["n"]], 4)
    pairs = lambda x: sorted((r["w_id"], r["n"]) for r in x.select("w_id", "n").collect())
    assert pairs(got) == pairs(every) and len(pairs(got)) > 60

from difflib import SequenceMatcher
from itertools import combinations

from marlstone.functions import quantiles
from marlstone.operators import bundles, clean, fields, joins, matching
from marlstone.streaming import alerts, jobs
from pyspark.sql import functions as F


def test_fuzzy_pairs_against_all_pairs(spark):
    rows = [(1, "a", "blue widget", "x"), (2, "a", "blue widgets", "x"), (3, "a", "red gear", "y"), (4, "a", "blue widget", "x"), (5, "b", "blue widget", "x"), (6, "a", None, None), (7, "a", "", ""), (8, "a", "blve widget", "xz")]
    df = spark.createDataFrame(rows, "id long, block string, p string, q string")
    got = {(r["a"], r["b"]): round(r["ratio"], 9) for r in matching.fuzzy_pairs(df, "id", ["block"], ["p", "q"]).collect()}
    ratio = lambda x, y: SequenceMatcher(None, x or "", y or "").ratio()
    want = {}
    for x, y in combinations(rows, 2):
        # the ratio depends on the order of its arguments: texts compare in the order of their structs
        a, b = sorted([x, y], key=lambda r: (r[2] or "", r[3] or ""))
        m = (ratio(a[2], b[2]) + ratio(a[3], b[3])) / 2
        if x[1] == y[1] and m >= 0.8:
            want[(x[0], y[0])] = round(m, 9)
    assert got == want and (1, 4) in got and (6, 7) in got


def test_lookup_tiers(spark):
    names = spark.createDataFrame([("Golf GTI",), ("GOLF",), ("vw up",), ("golf variant x",), ("the classe a",), ("zzz",), (None,)], "n string")
    catalogue = spark.createDataFrame([("golf",), ("golf gti",), ("up!",), ("Classe A 180",), (None,)], "e string")
    got = {r["name"]: (r["entry"], r["tier"]) for r in matching.lookup(names, catalogue, "n", "e", {"vw up": "up"}).collect()}
    assert got == {"Golf GTI": ("golf gti", 1), "GOLF": ("golf", 1), "vw up": ("up!", 2), "golf variant x": ("golf", 3), "the classe a": ("Classe A 180", 4), "zzz": (None, None)}


def test_watchlist_counts_equal_the_pairs(spark):
    df = spark.createDataFrame([(m, y, float(p)) for m in ("a", "b", None) for y in (1990, 1995, None) for p in (50, 150, 150, 990, 1000)], "make string, year int, price double")
    watch = spark.createDataFrame([(1, "a", None, None), (2, None, 1995, 150.0), (3, "b", 1990, 999.0), (4, None, None, 10.0), (5, "c", None, None), (6, None, None, None), (7, None, None, 1e9)], "id int, make string, min_year int, max_price double")
    rules = {"make": "make"}, {"min_year": "year"}
    pairs = joins.watchlist_matches(df, watch, *rules, {"max_price": "price"}).groupBy("w_id").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("best"))
    got = joins.watchlist_counts(df, watch, "id", *rules, ("max_price", "price"))
    as_set = lambda d: {(r["w_id"], r["n"], r["best"]) for r in d.collect()}
    assert as_set(got) == as_set(pairs) and len(as_set(got)) == 5


def test_throttle_is_greedy_over_batches(spark):
    rows = [(i, k, F_) for k in ("x", "y") for i, F_ in enumerate([0, 10, 290, 300, 301, 650, 900, 960])]
    df = spark.createDataFrame([(k, i, t) for i, k, t in rows], "k string, i int, t long").select("k", "i", F.timestamp_seconds("t").alias("ts")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = sorted((r["k"], r["i"]) for r in alerts.throttle(df, ["k"], "ts", ["i"], 300).collect())
    assert got == [(k, i) for k in ("x", "y") for i in (0, 3, 5, 7)]


def test_positions_over_many_parts(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id")
    got = [(r["v"], r["id"], r["position"], r["total"]) for r in quantiles.positions(df, "v", "id").collect()]
    want = sorted((r["v"], r["id"]) for r in df.collect())
    assert sorted(got, key=lambda x: x[2]) == [(v, i, k, 1000) for k, (v, i) in enumerate(want, 1)]


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(0, 10).write.parquet(src)
    schema = spark.read.parquet(src).schema
    jobs.append_all(jobs.follow(spark, src, schema), out)
    spark.range(10, 15).write.mode("append").parquet(src)
    jobs.append_all(jobs.follow(spark, src, schema), out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_fields(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(fields.title_case(F.lit("  são  joão-da mAdeira's 2nd "))) == "São João-Da Madeira'S 2Nd"
    assert one(fields.relative_date(F.lit("Ontem às 9:00"), "2024-03-01")).isoformat() == "2024-02-29"
    assert one(fields.without_spam(F.lit("SÓ HOJE!!!!"))) == "só hoje!!" and one(clean.number(F.lit("1.234,56"))) == 1234.56
    page = '<script type="application/ld+json">[{"@type": "Car", "name": "x", "offers": {"price": 900}}]</script>'
    got = one(bundles.json_ld(F.lit(page)))
    assert (got["name"], got["offer_price"], got["currency"]) == ("x", 900.0, None)
    assert one(bundles.json_ld(F.lit("<p>none</p>")))["name"] is None

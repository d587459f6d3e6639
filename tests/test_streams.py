from pyspark.sql import functions as F

from marlstone.streaming import breakers, jobs, upserts

SCHEMA = "id int, v int, ts int"


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return sorted(map(tuple, jobs.keep_newest(spark, stream, f"{folder}/out", ["id"], [F.desc("ts"), F.desc("v")]).collect()))


def test_keep_newest_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upserts, "COMPACT_AFTER", 3)
    monkeypatch.setattr(upserts.put_batch, "__defaults__", (3,))
    feed(spark, tmp_path, "a", [(1, 10, 1), (2, 20, 1), (1, 11, 0)])
    assert run(spark, tmp_path) == [(1, 10, 1), (2, 20, 1)]
    feed(spark, tmp_path, "b", [(2, 21, 2), (3, 30, 2)])
    assert run(spark, tmp_path) == [(1, 10, 1), (2, 21, 2), (3, 30, 2)]
    assert run(spark, tmp_path) == [(1, 10, 1), (2, 21, 2), (3, 30, 2)]  # nothing new
    for k in range(4):
        feed(spark, tmp_path, f"c{k}", [(1, 100 + k, 10 + k), (9, k, -k)])
        run(spark, tmp_path)
    assert run(spark, tmp_path) == [(1, 103, 13), (2, 21, 2), (3, 30, 2), (9, 0, 0)]
    assert upserts._finished(spark, f"{tmp_path}/out")[0] is not None


def test_repeated_and_unfinished_batches(spark, tmp_path):
    out, newest = f"{tmp_path}/t", [F.desc("ts")]
    batch = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert upserts.current(spark, out, SCHEMA, ["id"], newest).count() == 0
    upserts.put_batch(spark, batch([(1, 1, 1)]), 0, out, ["id"], newest, 2)
    upserts.put_batch(spark, batch([(1, 2, 2)]), 1, out, ["id"], newest, 2)  # folds
    upserts.put_batch(spark, batch([(1, 2, 2)]), 1, out, ["id"], newest, 2)  # repeated after a failure
    (tmp_path / "t" / "delta-000000002").mkdir()  # no mark of success
    assert [tuple(r) for r in upserts.current(spark, out, SCHEMA, ["id"], newest).collect()] == [(1, 2, 2)]


OBS = "ord long, source string, source_id string, url string, price double, currency string, price_kind string, conflict boolean, quality string, brand string, observed_at timestamp, km int, title string"
BASE = "source string, source_id string, url string, price double, last_seen timestamp, brand string, km int, title string"


def test_gated_upsert(spark):
    t = lambda d: F.expr(f"timestamp '2024-01-0{d}'")
    base = spark.createDataFrame([("olx", "1", "http://a.pt/1", 100.0, None, "Fiat", 5, "old"), ("olx", "2", "http://a.pt/2", 200.0, None, "Opel", 7, "keep")], BASE).withColumn("last_seen", t(3))
    row = lambda o, **k: tuple({**dict(ord=o, source="olx", source_id=None, url=f"http://a.pt/x{o}", price=50.0, currency="EUR", price_kind="total", conflict=False, quality="valid", brand="Audi", observed_at=None, km=1, title="t"), **k}.values())
    rows = [
        row(1, source_id="1", price=90.0, km=0, title=""),  # known: price changes, nothing else
        row(2, source_id="1", price=90.0, km=6, title=" "),  # known again: mileage, price as before
        row(3, source_id="2", price=0.0, km=99),  # known, no price: nothing
        row(4, source=None), row(5, url="ftp://a.pt/long/enough"), row(6, url="http://"), row(7, price_kind="entry"), row(8, currency="USD"), row(9, conflict=True), row(10, quality="invalid"), row(11, brand=" Unknown "),
        row(12, source_id="n", url="http://a.pt/1"),  # address of a known row
        row(13, source_id="A", url="http://a.pt/X1", quality="quarantined"),  # new
        row(14, source_id="B", url="http://a.pt/X1"),  # address taken
        row(15, source_id="B", url="http://a.pt/Y1"),  # new: the row before was refused
        row(16, source_id="B", url="http://a.pt/Z1", price=None),  # identity taken, bad price: duplicate all the same
        row(17, source_id="C", url="http://a.pt/Q1", price=None), row(18, source_id="C", url="http://a.pt/Q1"),  # first is invalid, second is new
    ]
    table, out = upserts.gated_upsert(base, spark.createDataFrame(rows, OBS).withColumn("observed_at", t(2)), ["brand", "km", "title"])
    got = {r["ord"]: (r["outcome"], r["price_change"]) for r in out.collect()}
    bad = {k: ("invalid", False) for k in (3, 5, 6, 7, 8, 9, 10, 11, 17)}
    assert got == {**bad, 1: ("updated", True), 2: ("updated", False), 4: ("unknown_source", False), 12: ("duplicate", False), 13: ("inserted", True), 14: ("duplicate", False), 15: ("inserted", True), 16: ("duplicate", False), 18: ("inserted", True)}
    rows = {(r["source"], r["source_id"]): (r["price"], r["km"], r["title"], r["brand"], r["last_seen"].day) for r in table.collect()}
    assert rows == {("olx", "1"): (90.0, 6, "old", "Audi", 3), ("olx", "2"): (200.0, 7, "keep", "Opel", 3), **{("olx", k): (50.0, 1, "t", "Audi", 2) for k in "ABC"}}
    n = upserts.outcome_counts(out, ["brand", "title"]).first().asDict()
    assert n == {"discovered": 18, "persisted": 5, "updated": 2, "rejected": 13, "duplicates": 5, "quarantined": 1, "valid_price": 7, "complete_fields": 11, "unknown_sources": 1}
    table, out = upserts.gated_upsert(base, spark.createDataFrame([], OBS), ["brand", "km", "title"])
    assert table.count() == 2 and out.count() == 0


LOG = "k string, at int, failed boolean"


def steps():
    """Opens at the third failure in a row, blocks for ten seconds, probes, opens again, probes twice, closes."""
    x = [(1, True), (2, True), (3, False), (4, True), (5, True), (6, True), (7, False), (15, True), (16, True), (17, True), (20, True), (26, True), (27, False), (36, False), (37, False), (38, True)]
    want = ["closed"] * 5 + ["open", "open", "open", "open", "open", "open", "open", "open", "half_open", "closed", "closed"]
    allowed = [True] * 6 + [False] * 2 + [True] + [False] * 2 + [True] + [False] + [True] * 3
    return [("a", t, f) for t, f in x], want, allowed


def test_breaker_states_of_a_table_and_a_stream(spark, tmp_path):
    rows, want, allowed = steps()
    other = [("b", t, t % 2 == 0) for t in range(40)] + [(None, 1, None), ("c", None, True)]
    log = spark.createDataFrame(rows + other, LOG).withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, at)"))
    args = ("k", "ts", "failed", ["at"], 3, 10, 2)
    got = breakers.breaker_states(log, *args).collect()
    assert len(got) == len(rows) + 41
    mine = sorted((r for r in got if r["k"] == "a"), key=lambda r: r["at"])
    assert [r["state"] for r in mine] == want and [r["allowed"] for r in mine] == allowed
    assert {r["state"] for r in got if r["k"] == "b"} == {"closed"}
    for name, part in (("1", "at <= 6"), ("2", "at > 6 and at <= 20"), ("3", "at > 20")):
        log.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    jobs.append_all(breakers.breaker_stream(stream, *args), f"{tmp_path}/out")
    key = lambda r: (str(r["k"]), r["at"])
    streamed = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=key)
    assert [(key(r), r["state"], r["allowed"]) for r in streamed] == [(key(r), r["state"], r["allowed"]) for r in sorted(got, key=key)]

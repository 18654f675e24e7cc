import json
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockscope.plans import blobs
from blockscope.schemas import BLOCK_ROOTS, DECLARED, PAYLOADS, RECEIPTS, TABLES
from blockscope.session import run_dir, shared_dir
from blockscope.sources import days, landing, layouts, relays, tables, worklists
from blockscope.streaming import dedup, landing as stream_landing
from tests.tiny import rows

GOOD = {
    "blockHash": "0xb", "blockNumber": "0x10", "cumulativeGasUsed": "0x5", "effectiveGasPrice": hex(10**31),
    "gasUsed": 21000, "status": "0x1", "transactionHash": "0xt", "transactionIndex": "7", "type": "0x3",
    "from": "0xf", "to": None, "logs": [1, 2],
}


def lines(*bodies):
    """(key, attempt, status, body) of response bodies given as objects or raw text."""
    return [
        (f"k{i}", 1, 200, b if isinstance(b, (str, type(None))) else json.dumps(b)) for i, b in enumerate(bodies)
    ]


def landed(spark, data):
    return spark.createDataFrame(data, landing.LANDED_LINE)


def test_receipts_and_every_kind_of_reject(spark):
    raw = landed(
        spark,
        [
            *lines(
                {"result": GOOD},
                {"error": {"code": 1}},
                {"result": None},
                '{"result": ',
                "<html>busy</html>",
                {"result": {**GOOD, "gasUsed": "0xzz"}},
                {"result": {**GOOD, "status": "0x1" + "0" * 9}},
                {"result": {**GOOD, "effectiveGasPrice": hex(10**39)}},
                None,
            ),
            ("k9", 1, 503, json.dumps({"result": GOOD})),
        ],
    )
    got = landing.land_rpc(raw, RECEIPTS)
    good = got.good.collect()
    assert [r.key for r in good] == ["k0"]
    row = good[0]
    assert (row.blockNumber, row.effectiveGasPrice, row.gasUsed) == (16, Decimal(10**31), 21000)
    assert (row.status, row.transactionIndex, row["from"], row.to, row.contractAddress) == (1, 7, "0xf", None, None)
    assert {r.key: r.reason for r in got.rejects.collect()} == {
        "k1": "no_result", "k2": "no_result", "k3": "malformed", "k4": "malformed", "k5": "bad_number",
        "k6": "bad_number", "k7": "bad_number", "k8": "malformed", "k9": "http_status",
    }
    assert {r.key: r.raw for r in got.rejects.collect()}["k4"] == "<html>busy</html>"


def test_landed_lines_are_read_from_files(spark):
    path = run_dir(spark, "lines")
    landed(spark, lines({"result": GOOD})).write.json(path)
    assert rows(landing.read_landed(spark, path)) == [("k0", 1, 200, json.dumps({"result": GOOD}))]


def test_retries(spark):
    bad, good = json.dumps({"error": 1}), json.dumps({"result": GOOD})
    raw = landed(
        spark,
        [("a", i, 200, bad) for i in range(1, 7)]
        + [("b", 1, 200, bad), ("b", 2, 200, good), ("b", 3, 200, good)]
        + [("c", 1, 200, bad), ("c", 2, 200, bad)],
    )
    got = landing.land_rpc(raw, RECEIPTS)
    assert rows(landing.retry_list(got)) == [("c", 2)]
    assert rows(landing.retry_list(got, max_tries=7)) == [("a", 6), ("c", 2)]
    assert [r.key for r in landing.first_success(got).collect()] == ["b"]


def test_headers_get_defaults_and_keep_digits_in_text(spark):
    header = {"block_hash": "123", "block_number": "9", "extra_data": "42", "base_fee_per_gas": "7"}
    body = {"data": {"message": {"body": {"execution_payload_header": header}}}}
    got = landing.land_headers(landed(spark, lines(body, {"data": {}})))
    row = got.good.collect()[0]
    assert (row.block_root, row.block_hash, row.extra_data, row.parent_hash) == ("k0", "123", "42", "")
    assert (row.block_number, row.gas_used, row.blob_gas_used, row.excess_blob_gas) == (9, 0, None, None)
    assert [r.reason for r in got.rejects.collect()] == ["no_result"]
    assert set(f.name for f in BLOCK_ROOTS.fields) <= set(got.good.columns)


def test_day_range_manifest_and_refresh(spark):
    root = run_dir(spark, "days")
    for day, n in (("2024/2/28", 1), ("2024/2/29", 2), ("2024/3/1", 3), ("2024/3/2", 4)):
        spark.range(n).write.parquet(f"{root}/{day}.parquet")
    assert days.load_day_range(spark, root, "2024-02-29", "2024-03-01").count() == 5
    assert days.load_day_range(spark, root, "2024-02-28", "2024-02-28").count() == 1
    manifest = days.load_manifest(days.load_day_range(spark, root, "2024-02-28", "2024-03-01"))
    assert manifest.agg(F.sum("rows")).collect()[0][0] == 6
    with pytest.raises(PySparkException):
        days.load_day_range(spark, root, "2024-03-02", "2024-03-03").count()


def test_full_refresh_replaces_all_or_only_its_partitions(spark):
    path = run_dir(spark, "refresh")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string")
    days.full_refresh(old, path, by=["d"])
    days.full_refresh(spark.createDataFrame([(3, "b")], "v int, d string"), path, by=["d"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (3, "b")]
    whole = run_dir(spark, "refresh")
    days.full_refresh(old, whole)
    days.full_refresh(old.limit(1), whole)
    assert spark.read.parquet(whole).count() == 1


def test_typed_append_refuses_what_does_not_fit(spark):
    path = run_dir(spark, "append")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    layouts.typed_append(spark.createDataFrame([("x", "5")], "s string, n string"), schema, path)
    layouts.typed_append(spark.createDataFrame([("y", "6")], "s string, n string"), schema, path)
    assert rows(spark.read.parquet(path)) == [(5, "x"), (6, "y")]
    with pytest.raises(PySparkException):
        layouts.typed_append(spark.createDataFrame([("z", str(2**40))], "s string, n string"), schema, path)


def test_layouts_are_sorted_and_split_a_hot_category(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("c"), (F.col("id") % 100).alias("t"), "id"
    )
    path = run_dir(spark, "alternate")
    layouts.alternate_layout(df, path, "c", ["t"], spread=["id"])
    back = spark.read.parquet(path)
    assert back.count() == 5000
    hot_files = back.where("c = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    sorted_path = run_dir(spark, "sorted")
    layouts.sorted_layout(df, sorted_path, ["t"], spread=["id"])
    spans = (
        spark.read.parquet(sorted_path)
        .groupBy(F.input_file_name().alias("f"))
        .agg(F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi"))
        .orderBy("lo")
        .collect()
    )
    assert hot_files >= 1
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_landed_tables_are_written_in_their_declared_form(spark):
    root = run_dir(spark, "declared")
    for name, table in DECLARED.items():
        df = spark.range(2).select(
            *[F.col("id").cast("string").alias(f.name) for f in reversed(table.schema.fields)]
        )
        layouts.write_table(df, root, name)
        back = spark.read.parquet(f"{root}/{name}")
        assert [(f.name, f.dataType) for f in back.schema.fields] == [
            (f.name, f.dataType) for f in table.schema.fields
        ]
        assert back.count() == 2 and set(table.sort_key) <= set(back.columns)


def test_alternate_layout_prunes_by_category(spark):
    path = run_dir(spark, "prune")
    layouts.alternate_layout(spark.range(10).selectExpr("id % 2 as c", "id"), path, "c", ["id"])
    plan = spark.read.parquet(path).where("c = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(c" in plan


def test_work_lists(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("b", 2), ("c", 3)], "k string, t int")
    work = worklists.work_list(df, "k", F.col("t") == 3)
    assert rows(work) == [("a",), ("c",)]
    assert rows(worklists.remaining(work, df.where("k = 'a'"), "k")) == [("c",)]
    assert rows(worklists.number_work_list(spark, 254, 257)) == [(254, "0xfe"), (255, "0xff"), (256, "0x100")]
    assert rows(worklists.low_water_mark(spark.range(5, 9), "id")) == [(4,)]


def bid(slot, block, value):
    fields = {f.name: "x" for f in PAYLOADS.fields if isinstance(f.dataType, T.StringType)}
    numbers = {f.name: "1" for f in PAYLOADS.fields if not isinstance(f.dataType, T.StringType)}
    return {**fields, **numbers, "slot": str(slot), "block_hash": block, "value": str(value)}


def test_relay_pages_union_and_preference(spark, tmp_path):
    pages = {
        ("aestus", 0): [bid(5, "h1", 1), bid(4, "h2", 2)],
        ("ultrasound", 0): [bid(5, "h1", 10**30)],
        ("ultrasound", 1): [],
        ("nobody-knows", 0): [bid(5, "h1", 4), bid(3, "h3", 5)],
        ("aestus", 1): [bid(4, "h2", 2), bid(6, "h2", 9)],
    }
    for (relay, page), bids in pages.items():
        folder = tmp_path / f"relay={relay}"
        folder.mkdir(exist_ok=True)
        (folder / f"{page}.json").write_text(json.dumps(bids, indent=1))
    read = relays.read_relay_pages(spark, str(tmp_path))
    assert read.count() == 7
    first = {r.block_hash: (r.relay, r.slot, int(r.value)) for r in relays.first_reports(read).collect()}
    assert first == {
        "h1": ("ultrasound", 5, 10**30),
        "h2": ("aestus", 6, 9),
        "h3": ("nobody-knows", 3, 5),
    }
    assert relays.payload_table(read).columns == [f.name for f in PAYLOADS.fields]


def test_stored_tables_are_read_under_short_names(spark):
    root = run_dir(spark, "stored")
    kinds = {"slot": "1L", "position": "1", "type": "3", "blob_gas": "131072L"}
    for name, spec in TABLES.items():
        columns = [
            F.expr(kinds.get(short, "'0xAb'")).alias(stored) for short, stored in spec.columns.items()
        ]
        df = spark.range(1).select(*columns)
        if name == "transactions":
            df = df.withColumn("to", F.encode("to", "utf-8"))
        df.write.parquet(f"{root}/{spec.stored}")
    t = tables.read_chain_tables(spark, root)
    plan = blobs.blobs_per(t, "block_root")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(type), EqualTo(type,3)]" in plan
    assert "ReadSchema: struct<block_root:string,type:int,blob_gas:bigint>" in plan
    assert t.transactions.columns == list(TABLES["transactions"].columns)
    assert t.transactions.collect()[0].to_addr == "0xAb"
    assert t.block_details.columns == ["hash", "gas_used", "extra_data", "size", "base_fee"]


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert run_dir(spark, "x").startswith(shared_dir(spark)) and run_dir(spark, "x") != run_dir(spark, "x")


def test_stream_lands_each_response_once(spark):
    home = run_dir(spark, "stream")
    batch = lines({"result": GOOD}, {"error": 1}, {"result": {**GOOD, "to": "0xt"}})
    for n in (2, 3):
        landed(spark, batch[n - 2 : n]).write.mode("append").json(f"{home}/in")
        for _ in range(2):
            stream_landing.land_new(spark, f"{home}/in", f"{home}/out", f"{home}/check", RECEIPTS)
    got = stream_landing.landed_rows(spark, f"{home}/out", RECEIPTS)
    assert sorted(r.key for r in got.collect()) == ["k0", "k2"]
    everything = spark.read.parquet(f"{home}/out")
    assert {r.outcome: r["count"] for r in everything.groupBy("outcome").count().collect()} == {"good": 2, "reject": 2}
    want = landing.land_rpc(landed(spark, batch), RECEIPTS).good
    assert rows(got.select(*want.columns)) == rows(want)


def test_stream_keep_first_prefers_the_relay_over_arrival(spark):
    home = run_dir(spark, "bids")
    schema = "relay string, slot long, block_hash string, value double"
    drops = [
        [("b", 1, "h1", 1.0), ("b", 2, "h2", 2.0), ("b", 2, "h2", 3.0)],
        [("a", 1, "h1", 9.0), ("c", 3, "h3", 4.0)],
    ]
    order = relays.preference(("a", "b"))
    for drop in drops:
        spark.createDataFrame(drop, schema).write.mode("append").parquet(f"{home}/in")
        new = spark.readStream.schema(schema).parquet(f"{home}/in")
        dedup.run_keep_first(new, ["block_hash"], order, f"{home}/out", f"{home}/check")
    kept = dedup.kept_rows(spark, f"{home}/out", ["block_hash"], order)
    assert {r.block_hash: (r.relay, r.value) for r in kept.collect()} == {
        "h1": ("a", 9.0), "h2": ("b", 2.0), "h3": ("c", 4.0),
    }

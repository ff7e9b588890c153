import json

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import training as TR
from urlrisk.session import materialize
from urlrisk.sources import labelled as SL
from urlrisk.sources import registry as SR
from urlrisk.sources import reputation as RP
from urlrisk.sources.json_store import read_store

NOW = "2024-02-01 00:00:00"


def test_registry_file_is_merged_under_built_in_brands(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({
        "official_domains": {"Acme ": [".Acme.com", "nodot", "acme.org"], "google": ["google.dev"]},
        "exact_only_official_domains": ["ACME.org"],
        "shared_hosting_domains": ["pages.example"]}, indent=1))
    registry = SR.load_registry(spark, str(path))
    rows = {r.domain: r for r in registry.official.collect()}
    assert rows["acme.com"].brand == "acme" and "nodot" not in rows
    assert rows["google.dev"].brand_ord == rows["google.com"].brand_ord == 0
    assert rows["binance.com"].brand == "binance"
    assert [d for d, r in rows.items() if r.exact_only] == ["acme.org"]
    assert [r.domain for r in registry.shared.collect()] == ["pages.example"]


def test_term_keeps_first_place_and_last_source(spark, registry):
    rows = {(r.brand, r.term): r for r in registry.brand_terms.collect()}
    paypal = rows[("paypal", "paypal")]
    assert (paypal.place, paypal.source) == ("", "paypal.com.my")


def store(tmp_path, **sections):
    path = tmp_path / "store.json"
    path.write_text(json.dumps({"generated_at_utc": "2024-01-22T00:00:00Z", **sections}))
    return str(path)


def test_store_file(spark, tmp_path):
    path = store(tmp_path, url_fingerprints={"k": {"sources": [" PhishTank", "urlhaus", ""], "url_count": 3}},
                 hosts={"a.com": ["OpenPhish"], "b.com": {"sources": "x", "url_count": "many"}}, roots=[1, 2])
    tables = RP.load_tables(spark, path, F.lit(NOW))
    assert [tuple(r) for r in tables.fingerprints.collect()] == [("k", ["phishtank", "urlhaus"], 3)]
    hosts = {r.key: (r.sources, r.url_count) for r in tables.hosts.collect()}
    assert hosts == {"a.com": (["openphish"], 0), "b.com": (["x"], 0)}
    assert tables.roots.count() == 0
    meta = RP.metadata(tables).first()
    assert (meta.hosts, meta.age_days, meta.stale, meta.available) == (2, 10, False, True)


def awkward_store(rng, many):
    words = ["a.com", 'q"uo"te', "back\\slash", 'end\\"', "{br}ac[e]s", "é東", "", "x" * 300, "colon: ,", " blank "]
    sections = {name: {} for name in RP.SECTIONS}
    for i in range(many):
        record = rng.choice([
            {"sources": [rng.choice(words) for _ in range(rng.randint(0, 3))], "url_count": rng.choice([1, 7, "12", "x", None, -3])},
            [rng.choice(words)], {"sources": rng.choice(words)}, "bare", 5, None, {}, {"sources": None, "more": {"deep": [1, {"k": "v"}]}}])
        sections[rng.choice(RP.SECTIONS)][rng.choice(words) + str(i)] = record
    return {"generated_at_utc": "2024-01-22T00:00:00", "counts": {"url_fingerprints": 1}, **sections, "note": 'ends with "quotes"', "list": ["a", {"b": "c"}]}


@pytest.mark.parametrize("indent", [None, 1])
def test_store_reads_the_same_in_any_number_of_splits(spark, tmp_path, indent):
    import random

    wanted = awkward_store(random.Random(3), 120)
    path = tmp_path / "store.json"
    path.write_text(json.dumps(wanted, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    size, found = path.stat().st_size, []
    try:
        for splits in (1, 3, 16, 61):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // splits + 1))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            entries, values, error = read_store(spark, str(path))
            assert error is None
            found.append(({(r.section, r.key, r.record) for r in entries.collect()}, {r.name: r.value for r in values.collect()}))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(f == found[0] for f in found)
    entries, values = found[0]
    assert {(s, k) for s, k, _ in entries if s in RP.SECTIONS} == {(s, k) for s in RP.SECTIONS for k in wanted[s]}
    for s, k, record in entries:
        want = wanted[s][k]
        got = record if record is None or isinstance(want, str) else json.loads(record)
        assert got == want, (s, k, record)
    assert values["generated_at_utc"] == wanted["generated_at_utc"] and values["note"] == wanted["note"]


def test_written_store_reads_back(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit('k"'), F.col("id").cast("string")).alias("key"),
                                   F.array(F.lit("a\\"), F.lit('b"')).alias("sources"), F.col("id").alias("url_count"))
    tables = RP.ReputationTables(rows, rows.limit(3), rows.limit(0), F.lit(NOW), F.lit(NOW))
    path = str(tmp_path / "store")
    RP.write_tables(tables, path, "2024-01-22 00:00:00")
    text = "".join(p.read_text() for p in sorted((tmp_path / "store").glob("part-*")))
    assert len(json.loads(text)["url_fingerprints"]) == 500
    back = RP.load_tables(spark, path, F.lit(NOW))
    assert back.load_error is None and back.fingerprints.exceptAll(rows).isEmpty() and back.fingerprints.count() == 500
    assert (back.hosts.count(), back.roots.count()) == (3, 0) and RP.metadata(back).first().age_days == 10


@pytest.mark.parametrize("text,part", [("[1, 2]", "object"), ('{"hosts": {"a": [1]}', "complete"), ('{"hosts": {"a": ["x}}', "complete"), ("", "")])
def test_unreadable_store_is_empty_with_an_error(spark, tmp_path, text, part):
    path = tmp_path / "bad.json"
    path.write_text(text)
    tables = RP.load_tables(spark, str(path), F.lit(NOW))
    assert part in tables.load_error and tables.hosts.count() == 0 and not RP.metadata(tables).first().available


def test_missing_store_is_empty_with_an_error(spark, tmp_path):
    tables = RP.load_tables(spark, str(tmp_path / "none.json"), F.lit(NOW))
    assert tables.load_error == "reputation_store.json is not built yet" and tables.hosts.count() == 0
    assert not RP.metadata(tables).first().available


def test_csv_names_are_trimmed_and_bad_rows_dropped(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(" URL ,label ,extra\nhttps://a.b,1,x\nhttps://c.d,,y\n,0,z\nhttps://e.f,0.0,z\n")
    rows = SL.load_labelled_urls(spark, str(path), "base").collect()
    assert [(r.url, r.label) for r in rows] == [("https://a.b", 1), ("https://e.f", 0)]
    flipped = SL.load_labelled_urls(spark, str(path), "base", positive_label=0).collect()
    assert [r.label for r in flipped] == [0, 1]


def test_last_source_wins(spark):
    ddl = "url string, label int, source string, sample_weight double"
    a = spark.createDataFrame([("u", 1, "a", 1.0), ("u", 0, "a", 1.0), ("u", 1, "a", 1.0)], ddl)
    b = spark.createDataFrame([("u", 1, "b", 20.0)], ddl)
    rows = SL.dedupe_keep_last(SL.union_sources(a, b)).collect()
    assert {(r.label, r.source) for r in rows} == {(1, "b"), (0, "a")}


def test_split_share_is_exact_and_repeatable(spark):
    rows = spark.range(1003).select(F.format_string("https://h%d.example", "id").alias("url"),
                                    (F.col("id") % 3 == 0).cast("int").alias("label"))
    first = SL.stratified_split(rows)
    counts = {r.label: r.n for r in first.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 67, 0: 134} and first.count() == 1003
    again = SL.stratified_split(rows.repartition(5))
    assert first.exceptAll(again).isEmpty()


def test_generated_rows(spark):
    one = lambda ddl, *row: spark.createDataFrame([row], ddl)
    rows = TR.augment_cases(
        one("domain string", "safe.example"), one("brand string", "paypal"),
        one("brand string, token string", "paypal", "paypa1"), one("fake string", "goog1e"),
        one("path string", "i.whatAapp"), one("block string, idx int", "10.0.0", 1))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    # 4 safe; 12 terms * 4 + 7 + 14 * 4 + 3 + 14 * 6 + 3 phishing
    assert counts == {0: 4, 1: 48 + 7 + 56 + 3 + 84 + 3}
    urls = {r.url for r in rows.collect()}
    assert "http://paypal-login-security.click" not in urls and "http://paypal-login-security.ru" in urls
    assert "http://10.0.0.31/payment?session=1abc" in urls


def test_materialized_table_keeps_rows_and_schema(spark):
    rows = spark.range(10).withColumn("x", F.array("id"))
    copy = materialize(rows)
    assert copy.schema.simpleString() == rows.schema.simpleString() and copy.exceptAll(rows).isEmpty()

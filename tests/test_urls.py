import random
import unicodedata
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tests.brute import skeleton as brute_skeleton
from urlrisk.functions import url as U
from urlrisk.functions.text import idna, nfkc, skeleton, values
from urlrisk.operators import training as TR
from urlrisk.operators import urls as UP


def table(spark, rows, name="url"):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def test_normal_form_of_damaged_urls(spark):
    cases = {
        " https://a.b/c d ": "https://a.b/cd",
        "example.com": "https://example.com",
        "https://a.b,;": "https://a.b",
        ".https://a.b": "https://a.b",
        "http?//a.b": "http://a.b",
        "https:////a.b": "https://a.b",
        "https://https://a.b": "https://a.b",
        "https://.http://a.b": "http://a.b",
        "https：//a.b": "https://a.b",
        "HTTPS://A.b": "HTTPS://A.b",
        "": "",
        " , ": "",
    }
    got = {r.url: r.normalized_url for r in UP.normalize_urls(table(spark, cases)).collect()}
    assert got == cases


def test_all_written_forms_normalise_alike(spark):
    forms = TR.obfuscate_urls(table(spark, ["https://goo.su/i.whatAapp", "http://a.b/x?u=http://c.d"]))
    rows = UP.normalize_urls(forms, "variant_url").select("url", "normalized_url").distinct().collect()
    assert {(r.url, r.normalized_url) for r in rows} == {
        ("https://goo.su/i.whatAapp", "https://goo.su/i.whatAapp"),
        ("http://a.b/x?u=http://c.d", "http://a.b/x?u=http://c.d")}


def test_split_equals_the_standard_parser(spark):
    rng = random.Random(5)
    alphabet = "ab.c/?#;=&@:-%1w"
    urls = ["https://h" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    got = UP.split_urls(table(spark, urls)).collect()
    for row in got:
        want = urlparse(row.url)
        assert (row.netloc, row.path, row.query) == (want.netloc, want.path, want.query), row.url


def test_host_rules(spark):
    urls = ["https://WWW.Google.com:80/x", "http://user:pw@evil.ru", "http://a.b.co.uk/", "https://bücher.example/", "https://[::1/x"]
    rows = {r.url: r for r in UP.split_urls(table(spark, urls)).collect()}
    assert rows[urls[0]].domain == "google.com"
    assert rows[urls[1]].domain == "evil.ru"
    assert (rows[urls[2]].root, rows[urls[2]].sld, rows[urls[2]].tld) == ("b.co.uk", "b", "uk")
    assert rows[urls[3]].domain == "xn--bcher-kva.example"
    assert rows[urls[4]].parse_error


def test_unicode_folding_matches_the_standard_library(spark):
    texts = ["ｈｔｔｐ：／／ａ", "①②", "ﬁx", "é", "ϲ", "ｱﾞ", "plain", "Ａ１"]
    rows = table(spark, texts, "t").select("t", nfkc(F.col("t")).alias("n")).collect()
    assert all(r.n == unicodedata.normalize("NFKC", r.t) for r in rows)
    hosts = ["bücher.de", "пример.рф", "faß.de", "plain.com", "ü" * 70 + ".com"]
    for r in table(spark, hosts, "h").select("h", idna(F.col("h")).alias("i")).collect():
        try:
            want = r.h.encode("idna").decode()
        except UnicodeError:
            want = r.h
        assert r.i == want


def test_skeleton(spark):
    texts = ["Goog1e", "rnicrosoft", "vvord", "pаypal", "I!|ı", "ΑΒ", "MiXeD"]
    rows = table(spark, texts, "t").select("t", skeleton(F.col("t")).alias("s")).collect()
    assert all(r.s == brute_skeleton(r.t) for r in rows)


def test_gate(spark):
    cases = {"https://a.b": True, "https://a.b https://c.d": False, "ftp://a.b": False, "https://": False,
             "x https://a.b": False, "https://a.b/?u=http://c": False}
    rows = UP.single_http_url_gate(table(spark, cases)).collect()
    assert {r.url: r.accepted for r in rows} == cases


def test_fingerprint_ignores_scheme_case_and_fragment(spark):
    urls = ["https://www.A.com/X?q=1#f", "http://a.com/x?Q=1", "a.com", "http://[::1]:80/p;v"]
    rows = {r.url: r for r in UP.url_fingerprints(table(spark, urls)).collect()}
    assert rows[urls[0]].fingerprint == rows[urls[1]].fingerprint == "a.com/x?q=1"
    assert rows[urls[2]].fingerprint == "a.com/"
    assert rows[urls[3]].fingerprint == "::1/p"


def test_values_is_a_local_relation(spark):
    rows = values(spark, {"a": "string", "n": "int"}, [("it's \\", 1), (None, 2)])
    assert [tuple(r) for r in rows.collect()] == [("it's \\", 1), (None, 2)]
    assert "LocalTableScan" in rows._jdf.queryExecution().executedPlan().toString()


def test_registrable_domain(spark):
    rows = table(spark, ["a.b.com.my", "com.my", "localhost", "x.y.z"], "d").select(
        "d", U.root_domain(F.col("d")).alias("r"), U.sld(U.root_domain(F.col("d"))).alias("s")).collect()
    assert {r.d: (r.r, r.s) for r in rows} == {
        "a.b.com.my": ("b.com.my", "b"), "com.my": ("com.my", "com"),
        "localhost": ("localhost", "localhost"), "x.y.z": ("y.z", "y")}

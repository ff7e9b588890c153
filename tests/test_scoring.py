import random

import pytest
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.operators import scoring as SC
from urlrisk.operators.evidence import action_guidance, evidence_statements
from urlrisk.plans.score import score_urls
from urlrisk.sources.registry import registry_from_table
from urlrisk.sources.reputation import build_tables

# Hand-traced scores: indicators in reporting order, weighted, final score, band.
GOLDEN = {
    "https://www.google.com": ((0, 0, 0, 0, 0, 0, 0, 0, 0), 0.0, 0, "Trusted"),
    "http://example.com/login": ((20, 0, 31, 0, 0, 0, 40, 60, 0), 14.98, 15, "Trusted"),
    "https://goo.su/i.whatAapp": ((45, 0, 95, 0, 0, 100, 0, 0, 0), 32.5, 91, "High Risk"),
    "http://192.168.1.10/login": ((20, 0, 95, 95, 90, 100, 40, 60, 0), 73.5, 98, "High Risk"),
}
MORE = [
    "https://goog1e.com/login", "https://example.xyz/account/verify", "https://mail.google.com", "https://mail.yahoo.com",
    "https://docs.render.com", "https://dashboard.render.com/web/srv-1/settings", "https://d0cs.google.com",
    "https://paypaI.com", "https://rnicrosoft.com", "https://whatsapq.com/login", ".https://goo.su/i.whatAapp",
    "https://https://goo.su/i.whatAapp", ".https：//goo.su/i.whatAapp", "https://bit.ly/paypaI-login",
    "http://paypal-login-security.com", "http://paypal.com@evil-site.ru/login",
    "https://paypal.com.login.verify.security.xyz", "https://touchngo-wallet-update.corn", "https://xn--googl-3ve.com",
    "https://a.github.io/x", "http://secure-update-account-login.corn", "https://xn--80ak6aa92e.com",
    "https://" + "a" * 130 + ".example.com/%20?x=1&y=2&z=3&a=1&b=2&c=3&d=4&e=5",
]


@pytest.fixture(scope="module")
def scored(spark, registry):
    urls = spark.createDataFrame([(u,) for u in [*GOLDEN, *MORE]], "given string").withColumn("url", F.col("given"))
    return score_urls(urls, registry)


@pytest.fixture(scope="module")
def rows(scored):
    return {r.given: r for r in scored.collect()}


def scores(row):
    return tuple(row[f"{n}_score"] for n in C.INDICATOR_NAMES)


@pytest.mark.parametrize("url", GOLDEN)
def test_golden_trace(rows, url):
    row = rows[url]
    assert (scores(row), row.weighted_score, row.risk_score, row.result) == GOLDEN[url]


def test_contributions_sum_to_the_weighted_score(rows):
    for row in rows.values():
        parts = [round(i.score * C.INDICATOR_WEIGHTS[i.name] / 100, 2) for i in row.indicators]
        assert [i.contribution for i in row.indicators] == pytest.approx(parts)
        assert row.weighted_score == pytest.approx(round(sum(parts), 2))
        assert row.rounded_score == round(row.weighted_score)


def test_score_bounds(rows):
    for row in rows.values():
        assert 0 <= row.risk_score <= 100
        assert all(0 <= s <= 100 for s in scores(row))
        if row.critical:
            assert row.risk_score >= 80
        elif row.is_official:
            assert row.risk_score <= 10
        elif row.shared_provider:
            assert row.risk_score >= 20
        assert row.prediction == (row.risk_score >= 45)


def test_known_phishing_and_safe(rows):
    safe = ["https://mail.google.com", "https://dashboard.render.com/web/srv-1/settings"]
    assert [rows[u].prediction for u in safe] == [0, 0]
    for url in ("https://goog1e.com/login", "https://paypaI.com", "https://rnicrosoft.com", "https://whatsapq.com/login",
                "https://bit.ly/paypaI-login", "http://paypal-login-security.com", "https://d0cs.google.com",
                "http://paypal.com@evil-site.ru/login", "https://paypal.com.login.verify.security.xyz",
                "https://touchngo-wallet-update.corn", "https://xn--googl-3ve.com", "https://xn--80ak6aa92e.com"):
        assert rows[url].risk_score >= 80 and rows[url].critical, url


def test_written_forms_score_alike(rows):
    forms = [u for u in rows if "i.whatAapp" in u]
    assert len(forms) == 4 and {rows[u].risk_score for u in forms} == {91}
    assert {rows[u].url for u in forms} == {"https://goo.su/i.whatAapp"}


def test_near_spelling_of_real_labels_is_flagged(rows):
    assert rows["https://mail.yahoo.com"].subdomain_parent == "yahoo.com"
    assert rows["https://docs.render.com"].officialDomain_score == 98


def test_https_indicator(rows):
    row = rows["http://example.com/login"]
    https = next(i for i in row.indicators if i.name == "httpsUsage")
    assert (https.score, https.weight_percent, https.contribution, https.used_in_final_score) == (60, 5, 3.0, True)
    assert '"uses_https":false' in https.value


def test_config(spark, rows):
    config = SC.scoring_config(spark).collect()
    assert sum(r.weight_percent for r in config) == 100
    assert {r.name for r in config} == {i.name for i in rows["https://www.google.com"].indicators}
    assert SC.risk_levels(spark).count() == 4


def test_response_has_texts(scored):
    out = {r.url: r for r in SC.response(scored, "given").collect()}
    clean = out["https://www.google.com"]
    assert clean.explanations == ["No obvious phishing indicators were detected."]
    assert clean.critical_reasons == [] and len(clean.recommendations) == 2
    bad = out["http://192.168.1.10/login"]
    assert len(bad.recommendations) == 4 and "IP address used as domain" in bad.critical_reasons
    assert bad.score_audit.override_adjustment_points == 98 - 74


def test_evidence_and_guidance(scored):
    lines = {(r.given, r.name): [] for r in scored.select("given", F.explode("indicators.name").alias("name")).collect()}
    for r in evidence_statements(scored, "given").orderBy("position").collect():
        lines[(r.given, r.name)].append(r.line)
    assert all(lines.values())
    assert "Official reference root: google.com." in lines[("https://www.google.com", "officialDomain")]
    assert "Protected brand token: paypal." in lines[("http://paypal-login-security.com", "officialDomain")]
    guide = {r.given: r.g for r in scored.select("given", action_guidance().alias("g")).collect()}
    assert guide["https://www.google.com"][1] == "Verified official-domain registry entry: google.com."
    assert len(guide["http://192.168.1.10/login"]) == 3


def test_hot_host_costs_one_profile_row(spark, registry):
    """Many rows of one host reduce to one key before matching."""
    from urlrisk.operators.urls import prepared_urls
    from urlrisk.plans.score import site_facts, with_lure_text

    urls = spark.range(20000).select(F.format_string("https://paypal-login.com/p/%d", "id").alias("url"))
    assert site_facts(with_lure_text(prepared_urls(urls)), registry).count() == 1


def test_reputation_raises_the_score(spark, registry):
    feed = spark.createDataFrame(
        [("http://bad.example.com/x", "urlhaus"), ("http://google.com/", "openphish"), ("https://lone.org/a", "phishtank")],
        "url string, source string")
    tables = build_tables(feed, F.lit("2024-01-22 00:00:00"), F.lit("2024-02-01 00:00:00"))
    urls = spark.createDataFrame([(u,) for u in (
        "https://bad.example.com/x", "https://bad.example.com/y", "https://other.example.com/", "https://www.google.com/",
        "https://lone.org/b")], "url string")
    got = {r.url: (r.reputationEvidence_score, r.reputationEvidence_status, r.risk_score, r.reputation.evidence_class)
           for r in score_urls(urls, registry, tables).collect()}
    assert got["https://bad.example.com/x"] == (100, "danger", 100, "exact_url")
    assert got["https://bad.example.com/y"][:3] == (98, "danger", 98)
    assert got["https://other.example.com/"][0::3] == (0, "root_context_only")
    assert got["https://www.google.com/"] == (0, "safe", 0, "exact_url")
    assert got["https://lone.org/b"] == (35, "warning", 35, "root_host_single_source")


def test_store_is_met_in_one_join_and_stays_in_place(spark):
    """Without broadcasts the plan joins the bucketed store once, and moves only the asked side."""
    from urlrisk.operators.reputation import store_hits
    from urlrisk.operators.urls import url_fingerprints

    feed = spark.createDataFrame([(f"http://h{i}.example.com/x", "urlhaus") for i in range(40)], "url string, source string")
    tables = build_tables(feed, F.lit("2024-01-22 00:00:00"), F.lit("2024-02-01 00:00:00"))
    urls = spark.createDataFrame([(f"http://h{i}.example.com/{i % 2}",) for i in range(60)], "url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = store_hits(url_fingerprints(urls, "url"), tables)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Bucketed: true" in plan
        store = plan[plan.index("SortMergeJoin"):].split("FileScan")
        side = next(part for part in plan.split("\n") if "FileScan" in part and "Bucketed: true" in part)
        lines = plan.split("\n")
        above = lines[lines.index(side) - 3:lines.index(side)]
        assert len(store) >= 2 and not any("Exchange" in line for line in above[-2:])
        assert hits.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence_tells_of_the_store(spark):
    from urlrisk.operators.reputation import add_reputation
    from urlrisk.sources.reputation import load_tables

    feed = spark.createDataFrame([("http://bad.example.com/x", "urlhaus")], "url string, source string")
    tables = build_tables(feed, F.lit("2024-01-22 00:00:00"), F.lit("2024-02-01 00:00:00"))
    urls = spark.createDataFrame([("http://a.b/",)], "url string")
    r = add_reputation(urls, tables).first().reputation
    assert (r.generated_at_utc, r.counts.asDict(), r.load_error) == (
        "2024-01-22T00:00:00", {"url_fingerprints": 1, "hosts": 1, "roots": 1}, None) and r.policy.startswith("v12.1")
    gone = add_reputation(urls, load_tables(spark, "file:///nowhere/store.json", F.lit("2024-02-01 00:00:00"))).first().reputation
    assert not gone.available and gone.load_error and gone.counts.hosts == 0


def test_model_votes_are_blended(spark, registry):
    urls = spark.createDataFrame([("http://example.com/login", 0.9, 0.9), ("https://goo.su/i.whatAapp", 0.1, 0.9)],
                                 "url string, raw_probability double, confidence double")
    got = {r.url: r for r in score_urls(urls, registry, modelled=True).collect()}
    smooth = (0.9 * 100 + 1) / 102
    assert got["http://example.com/login"].calibrated_probability == pytest.approx(0.31 * 0.4 + smooth * 0.6)
    assert got["http://example.com/login"].aiModelProbability_status == "warning"
    smooth = (0.1 * 100 + 1) / 102
    assert got["https://goo.su/i.whatAapp"].calibrated_probability == pytest.approx(0.95 * 0.85 + smooth * 0.15)


def test_override_order_equals_plain_definition(spark):
    """Random score vectors through the override chain and through plain arithmetic."""
    rng = random.Random(9)
    names = C.INDICATOR_NAMES
    data = []
    for i in range(400):
        data.append((i, *[rng.choice([0, 20, 25, 40, 45, 60, 75, 90, 100]) for _ in names],
                     rng.random() < 0.3, rng.choice([None, "github.io"]), rng.random() < 0.2))
    ddl = "id int, " + ", ".join(f"{n}_score int" for n in names) + ", is_official boolean, shared_provider string, shortener boolean"
    table = spark.createDataFrame(data, ddl).withColumns({
        "at_sign": F.lit(False), "ip_host": F.lit(False),
        "aiModelProbability_status": F.lit("x"), "aiModelProbability_explanation": F.lit("x")})
    for step in (SC.clean_correction, SC.weighted_score, SC.critical_rules, SC.top_signals, SC.override_chain):
        table = step(table)
    for r in table.collect():
        s = {n: r[f"{n}_score"] for n in names}
        hundredths = sum(s[n] * C.INDICATOR_WEIGHTS[n] for n in names)
        risk = round(hundredths / 100)
        assert risk == r.rounded_score
        if r.critical:
            top = sorted(s.items(), key=lambda kv: kv[1], reverse=True)[:3]
            evidence = round(sum(v * (w / 100) for (_, v), w in zip(top, (65, 20, 15))))
            assert [t.name for t in r.top_signals] == [n for n, _ in top]
            risk = max(risk, max(80, min(100, evidence)))
        risk = max(risk, s["reputationEvidence"])
        if not r.is_official and not r.critical and (
                (s["aiModelProbability"] >= 45 and s["suspiciousKeywords"] >= 75 and s["urlStructure"] >= 25)
                or (s["aiModelProbability"] >= 50 and s["suspiciousKeywords"] >= 40 and s["urlStructure"] >= 60)):
            risk = max(risk, 45)
        if r.is_official and not r.critical:
            risk = min(risk, 10)
        if r.shared_provider and not r.critical:
            risk = max(risk, 20)
        assert risk == r.risk_score


def test_registry_of_a_table(spark):
    """Names of a caller's own registry are matched under the built-in ones."""
    own = spark.createDataFrame([("acme", 0, "acme-bank.example")], "brand string, brand_ord bigint, domain string")
    got = score_urls(spark.createDataFrame([("https://www.acme-bank.example/",), ("https://acme-pay.top",),
                                            ("https://google.com",)], "url string"), registry_from_table(own))
    assert {r.url: r.result for r in got.collect()} == {
        "https://www.acme-bank.example/": "Trusted", "https://acme-pay.top": "High Risk", "https://google.com": "Trusted"}

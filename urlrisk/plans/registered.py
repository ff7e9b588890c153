"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.functions import url as U
from urlrisk.functions.text import skeleton
from urlrisk.operators import detections as D
from urlrisk.operators import evaluation as E
from urlrisk.operators import features as FT
from urlrisk.operators import matching as MT
from urlrisk.operators import scoring as SC
from urlrisk.operators import training as TR
from urlrisk.operators import urls as UP
from urlrisk.operators.indicators import calibrated_probability
from urlrisk.operators.reputation import add_reputation
from urlrisk.plans import fixtures as FX
from urlrisk.plans.score import score_urls
from urlrisk.session import materialize, shared_path
from urlrisk.sources import detections as SD
from urlrisk.sources import labelled as SL
from urlrisk.sources import registry as SR
from urlrisk.sources import reputation as RP
from urlrisk.sources.json_store import write_store
from urlrisk.streaming import jobs as ST

c = F.col


def corpus(spark, sf):
    return FX.spark_view(spark, sf, FX.CORPUS)


def adversarial(spark, sf):
    return FX.spark_view(spark, sf, FX.ADVERSARIAL)


def detections(spark, sf):
    return FX.spark_view(spark, sf, FX.DETECTIONS)


def order_detections(spark, sf):
    return FX.spark_view(spark, sf, FX.DETECTIONS_ORDERS)


def predictions(spark, sf):
    return FX.spark_view(spark, sf, FX.PREDICTIONS)


def now():
    return F.lit(FX.NOW).cast("timestamp")


def orders_now():
    return F.lit(FX.ORDERS_NOW).cast("timestamp")


def prepared(spark, sf):
    return UP.prepared_urls(adversarial(spark, sf))


def hosts(spark, sf):
    return prepared(spark, sf).select("domain").distinct()


def profile(spark, sf):
    return MT.host_profile(hosts(spark, sf), SR.core_registry(spark))


def reputation_tables(spark, sf, generated="2024-01-22 00:00:00"):
    feed = FX.spark_view(spark, sf, FX.FEED)
    return RP.build_tables(feed, F.lit(generated), F.lit(FX.NOW))


def scored(spark, sf):
    return score_urls(adversarial(spark, sf), SR.core_registry(spark))


def scored_with_reputation(spark, sf):
    return score_urls(corpus(spark, sf), SR.core_registry(spark), reputation_tables(spark, sf))


def features(spark, sf):
    return FT.features_22(adversarial(spark, sf), SR.core_registry(spark))


def _marked(rows):
    label = F.when(c("kind").isin(0, 1, 12, 14, 15, 16, 18, 19), 0).otherwise(1)
    return rows.withColumn("label", label).withColumn("sample_weight", F.lit(1.0))


def training_rows(spark, sf):
    """Labelled adversarial URLs with the 22 features."""
    return materialize(E.class_weights(_marked(features(spark, sf))), "training")


def training_urls(spark, sf):
    """Labelled adversarial URLs alone, for models that read nothing but the URL."""
    return materialize(_marked(prepared(spark, sf)).select("url_id", "url", "label", "sample_weight"), "training-urls")


# --- sources and sinks ------------------------------------------------------

def load_labelled_urls(spark, sf):
    path = shared_path(spark, "labelled-csv")
    table = FX.spark_view(spark, sf, FX.LABELLED)
    table.select(c("url").alias(" URL "), c("label").alias("label ")).write.option("header", True).csv(path)
    return SL.load_labelled_urls(spark, path, "overlay")


def load_domain_registry(spark, sf):
    """A registry file of the page hosts, written and read back; brands are numbered in its order."""
    path = shared_path(spark, "registry-json")
    entries = FX.spark_view(spark, sf, FX.REGISTRY_ENTRIES).groupBy("brand").agg(F.sort_array(F.collect_set("domain")).alias("record"))
    write_store(entries.select(F.lit("official_domains").alias("section"), c("brand").alias("key"), "record"),
                {"exact_only_official_domains": list(C.EXACT_ONLY_DOMAINS), "shared_hosting_domains": list(C.SHARED_HOSTING_DOMAINS)}, path)
    return SR.load_registry(spark, path).official.select("brand", "brand_ord", "domain", "exact_only")


def _sections(tables):
    rows = None
    for section, table in (("url", tables.fingerprints), ("host", tables.hosts), ("root", tables.roots)):
        part = table.select(F.lit(section).alias("section"), "key", F.array_join("sources", ",").alias("sources"), "url_count")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def load_reputation_tables(spark, sf):
    """A store of the feed, written as one JSON object and read back in splits."""
    path = shared_path(spark, "store-json")
    RP.write_tables(reputation_tables(spark, sf), path, "2024-01-22 00:00:00")
    return _sections(RP.load_tables(spark, path, F.lit(FX.NOW)))


def build_reputation_tables(spark, sf):
    return _sections(reputation_tables(spark, sf))


def append_detections(spark, sf):
    """Write the log, merge corrections of some records into it, read it as it is."""
    path = shared_path(spark, "log")
    log = D.valid_detections(detections(spark, sf)).select("id", "url", "riskScore", "event_type", "timestamp")
    SD.append_detections(log.withColumn("version", F.lit(1)), path)
    fixes = log.filter("event_type = 'click'").withColumn("riskScore", 100 - c("riskScore"))
    SD.merge_detections(fixes.withColumn("version", F.lit(2)), path, "version")
    return SD.read_detections(spark, path).select("id", "url", "riskScore", "version", "month")


def scan_by_key_prefix(spark, sf):
    return SD.scan_by_key_prefix(detections(spark, sf), "detection:anonymous:").select("id", "url", "riskScore")


def _keys(spark, sf):
    return detections(spark, sf).filter("event_type = 'error' AND value > 60").select("id")


def lookup_by_keys(spark, sf):
    return SD.lookup_by_keys(detections(spark, sf), _keys(spark, sf)).select("id", "url", "riskScore")


def remove_by_keys(spark, sf):
    return SD.remove_by_keys(detections(spark, sf), _keys(spark, sf)).select("id", "url", "riskScore")


def export_cases(spark, sf):
    cases = SD.export_cases(detections(spark, sf), _keys(spark, sf))
    return cases.select("caseId", "source", "url", "riskScore", "isPhishing", "critical_phishing")


def export_header(spark, sf):
    cases = SD.export_cases(detections(spark, sf), _keys(spark, sf))
    return SD.export_header(cases, F.lit(FX.NOW))


def _report(spark, sf):
    rows = scored(spark, sf).withColumn(
        "label", F.when(c("kind").isin(0, 1, 12, 14, 15, 16, 18, 19), 0).otherwise(1)).withColumn(
        "source", F.lit("overlay"))
    cases = rows.select(F.format_string("url_%d", "url_id").alias("name"), "url", c("label").alias("expected"),
                        (c("risk_score") / 100).alias("probability"))
    return SL.report_lines(E.classification_metrics(rows), E.label_distribution(rows), E.source_distribution(rows),
                           E.regression_results(cases, 0.45))


def write_training_report(spark, sf):
    path = shared_path(spark, "report")
    SL.write_report(_report(spark, sf), path)
    return spark.read.text(f"{path}/text").select(c("value").alias("line"))


def validate_scores(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.when(
        c("event_type") == "view", "n/a").otherwise(F.floor("value").cast("string")).alias("risk_score"))
    return SD.validate_scores(raw)


# --- URL preparation --------------------------------------------------------

def normalize_urls(spark, sf):
    return UP.normalize_urls(adversarial(spark, sf)).select("url_id", "url", "normalized_url")


def obfuscate_urls(spark, sf):
    """Six written forms of every page URL and what they normalise to."""
    forms = TR.obfuscate_urls(corpus(spark, sf))
    return UP.normalize_urls(forms, "variant_url").select("url_id", "variant", "normalized_url")


def split_urls(spark, sf):
    return prepared(spark, sf).select("url_id", "scheme", "netloc", "path", "query", "raw_domain", "domain",
                                      "parse_error")


def idna_hosts(spark, sf):
    """Page hosts written with an umlaut, and their ASCII form."""
    written = corpus(spark, sf).withColumn("url", F.regexp_replace("url", "(?<=//)", "ü"))
    return UP.idna_hosts(UP.split_urls(written))


def registrable_domain(spark, sf):
    return prepared(spark, sf).select("domain", "root", "sld", "tld").distinct()


def confusable_skeleton(spark, sf):
    rows = prepared(spark, sf)
    return rows.select("url_id", skeleton(c("domain")).alias("domain_skeleton"),
                       skeleton(F.concat("path", "query")).alias("rest_skeleton"))


def confusable_marker_flag(spark, sf):
    labels = prepared(spark, sf).select(F.explode(U.labels(c("domain"))).alias("label")).distinct()
    return UP.confusable_markers(labels, "label")


def url_fingerprint(spark, sf):
    return UP.url_fingerprints(UP.reject_empty_urls(adversarial(spark, sf)), "normalized_url").select(
        "url_id", "fingerprint", "fingerprint_hash", "rep_host", "rep_root")


def lexical_counts(spark, sf):
    rows = UP.normalize_urls(adversarial(spark, sf))
    return FT.lexical_counts(rows, "normalized_url").drop("url", "kind", "normalized_url")


def features_22(spark, sf):
    return features(spark, sf).drop("url", "kind")


def features_5(spark, sf):
    return FT.features_5(adversarial(spark, sf)).drop("url", "kind")


def features_30(spark, sf):
    rows = FT.features_30(adversarial(spark, sf))
    return rows.select("url_id", *[F.round(n, 9).alias(n) for n in FT.FEATURES_30])


def sld_entropy(spark, sf):
    return FT.sld_entropy(prepared(spark, sf)).select("sld", F.round("entropy", 9).alias("entropy"))


def hashed_ngrams(spark, sf):
    """Size of the vectors and the norms of their two hashed parts, read in their sparse form."""
    vectors = FT.hashed_ngrams(adversarial(spark, sf)).select("url_id", F.unwrap_udt("features").alias("v"))
    split, end = 1 << TR.CHAR_BITS, (1 << TR.CHAR_BITS) + (1 << TR.WORD_BITS)
    entries = vectors.select("url_id", c("v.size").alias("size"), F.arrays_zip("v.indices", "v.values").alias("e"))

    def norm(low: int, high: int):
        squares = F.transform(F.filter("e", lambda x: (x["indices"] >= low) & (x["indices"] < high)), lambda x: x["values"] * x["values"])
        return F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)), 9)

    return entries.select("url_id", "size", norm(0, split).alias("char_norm"), norm(split, end).alias("word_norm"),
                          (F.array_min(F.transform("e", lambda x: x["values"])) >= 0).alias("non_negative"))


def ngram_tokens(spark, sf):
    return FT.ngram_tokens(adversarial(spark, sf)).drop("url", "kind")


def numeric_columns_only(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return FT.numeric_columns_only(items, "l_linenumber")


def response_projection(spark, sf):
    rows = SC.response(scored(spark, sf), "url_id")
    return rows.select(
        "url_id", "url", "prediction", "decision", "result", "risk_score", "safety_score", "critical_phishing",
        F.array_join("critical_reasons", "; ").alias("critical_reasons"),
        "feature_ai_probability_percent", "ai_score", F.array_join("explanations", " | ").alias("explanations"),
        F.array_join("recommendations", " | ").alias("recommendations"))


# --- filters ----------------------------------------------------------------

def valid_detections(spark, sf):
    return D.valid_detections(detections(spark, sf)).select("id", "riskScore")


def search_detections(spark, sf):
    return D.search_detections(detections(spark, sf), start_date="2024-01-05", end_date="2024-01-20",
                               risk_level="high-risk", critical_rule="not-applied", domain="example.",
                               user="user1").select("id", "url", "riskScore", "userId")


def single_http_url_gate(spark, sf):
    return UP.single_http_url_gate(adversarial(spark, sf)).select("url_id", "accepted")


def reject_empty_urls(spark, sf):
    blanked = adversarial(spark, sf).withColumn("url", F.when(c("url").contains("?"), F.lit(" , ")).otherwise(c("url")))
    return UP.reject_empty_urls(blanked).select("url_id", "normalized_url")


def ip_or_at_url_flag(spark, sf):
    return prepared(spark, sf).select(
        "url_id", UP.is_ip_like(c("domain")).alias("ip_host"), c("rule_url").contains("@").alias("at_sign"))


def confusable_tld_flag(spark, sf):
    return prepared(spark, sf).select("url_id", "tld", UP.confusable_tld(c("tld")).alias("confusable"))


def verified_official_filter(spark, sf):
    return SC.verified_official(scored(spark, sf)).select("url_id", "official_brand", "official_domain")


# --- joins ------------------------------------------------------------------

def match_official_domain(spark, sf):
    return profile(spark, sf).filter("is_official").select("domain", "official_brand", "official_domain")


def match_shared_hosting(spark, sf):
    return profile(spark, sf).filter("shared_provider IS NOT NULL").select("domain", "shared_provider")


def match_shortener(spark, sf):
    return hosts(spark, sf).select("domain", MT.is_shortener(c("domain")).alias("shortener"))


def lookalike_subdomain(spark, sf):
    found = profile(spark, sf).filter("subdomain_parent IS NOT NULL")
    text = F.array_join(F.transform("suspicious_labels", lambda h: F.concat_ws(
        "~", h["label"], h["service_skeleton"], h["distance"].cast("string"))), ",")
    return found.select("domain", "subdomain_brand", "subdomain_parent", text.alias("labels"))


def skeleton_domain_match(spark, sf):
    return profile(spark, sf).filter("skeleton_hit IS NOT NULL").select(
        "domain", c("skeleton_hit.brand").alias("brand"), c("skeleton_hit.official").alias("official"))


def brand_token_in_root(spark, sf):
    hit = c("token_hit")
    return profile(spark, sf).filter("token_hit IS NOT NULL").select(
        "domain", hit["brand"].alias("brand"), hit["raw_token"].alias("raw_token"), hit["term"].alias("term"),
        hit["source"].alias("source"))


def brand_like_token(spark, sf):
    texts = prepared(spark, sf).select(F.concat_ws(" ", "domain", "path", "query").alias("lure_text")).distinct()
    hit = c("lure_hit")
    return MT.lure_matches(texts, SR.core_registry(spark)).select(
        "lure_text", hit["brand"].alias("brand"), hit["token"].alias("token"), hit["term"].alias("term"),
        hit["distance"].alias("distance"), F.bround(hit["similarity"], 3).alias("similarity"))


def brand_substring_host(spark, sf):
    return profile(spark, sf).filter("substring_hit IS NOT NULL").select(
        "domain", c("substring_hit.brand").alias("brand"))


def typo_distance_match(spark, sf):
    hit = c("distance_hit")
    return profile(spark, sf).filter("distance_hit IS NOT NULL").select(
        "domain", hit["brand"].alias("brand"), hit["official"].alias("official"), hit["root"].alias("official_root"))


def typo_ratio_match(spark, sf):
    hit = c("typo_hit")
    return profile(spark, sf).filter("typo_hit IS NOT NULL").select(
        "domain", hit["brand"].alias("brand"), hit["official"].alias("official"),
        hit["distance"].alias("distance"), F.bround(hit["ratio"], 4).alias("ratio"), "typo_brands")


def brand_similarity_features(spark, sf):
    registry = SR.core_registry(spark)
    return MT.brand_similarity(hosts(spark, sf), registry, profile(spark, sf))


def keyword_hits(spark, sf):
    rows = prepared(spark, sf).withColumn("target", F.lower(F.concat_ws(" ", "domain", "path", "query")))
    rows = rows.withColumn("folded", skeleton(c("target"))).withColumn("found", MT.keyword_hits(c("target"), c("folded")))
    return rows.select("url_id", F.array_join("found", ",").alias("keywords"), F.size("found").alias("n"))


def tld_risk_lookup(spark, sf):
    return prepared(spark, sf).select("url_id", "tld", MT.bad_tld_points(c("tld")).alias("points"))


def _reputation_rows(rows):
    r = c("reputation")
    return rows.select(
        "url_id", r["match"].alias("match"), r["match_type"].alias("match_type"), r["score"].alias("score"),
        F.array_join(r["sources"], ",").alias("sources"), r["url_count"].alias("url_count"),
        r["evidence_class"].alias("evidence_class"), r["context_match"].alias("context_match"),
        F.array_join(r["context_sources"], ",").alias("context_sources"),
        r["context_url_count"].alias("context_url_count"), r["generated_at_utc"].alias("generated_at_utc"),
        F.concat_ws(",", *[r["counts"][n] for n in RP.SECTIONS]).alias("counts"), r["load_error"].alias("load_error"),
        r["policy"].alias("policy"))


def reputation_cascade(spark, sf):
    return _reputation_rows(add_reputation(corpus(spark, sf), reputation_tables(spark, sf)))


def reputation_cascade_stale(spark, sf):
    tables = reputation_tables(spark, sf, "2023-12-18 00:00:00")
    return _reputation_rows(add_reputation(corpus(spark, sf), tables))


def label_predictions(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", c("toxic").alias("label"))
    predicted = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", (c("n_chars") > 1000).cast("int").alias("prediction"))
    return E.pair_predictions(predicted, labels, "doc_id").select("doc_id", "label", "prediction")


# --- indicators and scores --------------------------------------------------

def _indicator(name, source=scored):
    def query(spark, sf):
        return source(spark, sf).select("url_id", *[
            c(f"{name}_{part}").alias(part) for part in ("score", "status", "explanation")])
    return query


def ind_ai_probability(spark, sf):
    return scored(spark, sf).select(
        "url_id", F.when(c("is_official"), F.least(F.rint(c("calibrated_probability") * 100), F.lit(15.0)))
        .otherwise(F.rint(c("calibrated_probability") * 100)).cast("int").alias("score"))


def lexical_probability(spark, sf):
    return scored(spark, sf).select("url_id", F.round("lexical_probability", 9).alias("probability"))


def calibrate_probability(spark, sf):
    """Blend the lexical estimate with a model vote taken from the URL's own digits."""
    raw = F.pmod(c("url_id"), F.lit(101)) / 100.0
    return scored(spark, sf).select("url_id", F.round(calibrated_probability(
        raw, c("lexical_probability")), 9).alias("calibrated"))


def official_clean_correction(spark, sf):
    return scored(spark, sf).select("url_id", "official_clean", c("aiModelProbability_score").alias("ai_score"))


def weighted_score(spark, sf):
    return scored(spark, sf).select("url_id", "weighted_score", "rounded_score")


def critical_reasons(spark, sf):
    return scored(spark, sf).select("url_id", "critical", F.array_join("critical_reasons", "; ").alias("reasons"))


def critical_top3(spark, sf):
    names = F.array_join(F.transform("top_signals", lambda s: F.concat_ws("=", s["name"], s["score"].cast("string"))), ",")
    return scored(spark, sf).select("url_id", names.alias("signals"), "critical_score")


def override_chain(spark, sf):
    return scored(spark, sf).select("url_id", "rounded_score", "risk_score", F.array_join("overrides", "; ").alias("overrides"))


def risk_band(spark, sf):
    return scored(spark, sf).select("url_id", "risk_score", "safety_score", "result", "decision", "prediction")


def explanations(spark, sf):
    return scored(spark, sf).select("url_id", F.array_join(SC.explanations(c("indicators")), " | ").alias("explanations"))


def recommendations(spark, sf):
    band = SC.band_column(c("risk_score"), 0)
    return scored(spark, sf).select("url_id", F.posexplode(SC.recommendations(band)).alias("position", "text"))


def score_audit(spark, sf):
    return scored(spark, sf).select("url_id", SC.score_audit().alias("a")).select(
        "url_id", "a.weighted_score_before_overrides", "a.rounded_weighted_score", "a.final_risk_score",
        "a.rounding_adjustment_points", "a.override_adjustment_points")


def scoring_config(spark, sf):
    """Indicator definitions with what each contributes over the scored table."""
    totals = SC.indicators_long(scored(spark, sf)).groupBy("name").agg(
        F.count("*").alias("n"), F.sum("score").alias("total_score"))
    # The definition table has nine rows.
    return SC.scoring_config(spark).join(totals, "name").select(
        "ord", "name", "label", "weight_percent", "used_in_final_score", "scoring_mode", "n", "total_score",
        (c("total_score") * c("weight_percent")).alias("weighted_hundredths"))


def indicators_long(spark, sf):
    return SC.indicators_long(scored(spark, sf), "url_id").select(
        "url_id", "name", "score", "safety_score", "status", "weight_percent", "contribution", "used_in_final_score")


def evidence_statements(spark, sf):
    from urlrisk.operators.evidence import evidence_statements as statements

    return statements(scored(spark, sf), "url_id")


def action_guidance(spark, sf):
    from urlrisk.operators.evidence import action_guidance as guidance

    return scored(spark, sf).select("url_id", F.posexplode(guidance()).alias("position", "text"))


def score_urls_query(spark, sf):
    return scored(spark, sf).select(
        "url_id", "url", "domain", *[c(f"{n}_score").alias(n) for n in C.INDICATOR_NAMES], "weighted_score",
        "risk_score", "result", "critical")


def score_urls_with_reputation(spark, sf):
    return scored_with_reputation(spark, sf).select(
        "url_id", c("reputationEvidence_score").alias("reputation"), "weighted_score", "risk_score", "result", "critical")


def pages_per_band(spark, sf):
    """Flagship: pages per risk band with their worst host."""
    rows = scored(spark, sf).withColumn("band", SC.band_column(c("risk_score"), 0))
    return rows.groupBy("band").agg(
        F.count("*").alias("pages"), F.count_if("critical").alias("critical"), F.max("risk_score").alias("worst_score"),
        F.max_by("domain", F.struct("risk_score", "domain")).alias("worst_host"))


# --- statistics -------------------------------------------------------------

def basic_statistics(spark, sf):
    return D.basic_statistics(detections(spark, sf))


def basic_statistics_per_user(spark, sf):
    return D.basic_statistics(detections(spark, sf), "userId")


def _text_time(rows, *names):
    return rows.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def indicator_status_counts(spark, sf):
    return D.indicator_status_counts(SC.indicators_long(scored(spark, sf)))


def feature_audit(spark, sf):
    """Values of every URL beside the importances of extra-trees fitted on all of them.

    Importances vary with the model, so the checkable columns say that each is a
    share and that a URL's shares make a whole.
    """
    rows = training_rows(spark, sf)
    model = TR.train_tree_ensemble(rows, C.MODEL_FEATURES, key="url_id")
    arrays = rows.select("url_id", F.array(*[c(n).cast("double") for n in C.MODEL_FEATURES]).alias("features"))
    audit = E.feature_audit(arrays, C.MODEL_FEATURES, model, "url_id")
    whole = audit.groupBy("url_id").agg(F.bround(F.sum("importance"), 6).alias("importance_total"),
                                        F.bround(F.sum("importance_percent"), 2).alias("percent_total"))
    return audit.join(whole, "url_id").select("url_id", "position", "feature", "value", c("importance").between(0, 1).alias("is_share"),
                                              "importance_total", "percent_total")


def build_brand_terms(spark, sf):
    registry = SR.registry_from_table(FX.spark_view(spark, sf, FX.REGISTRY_ENTRIES))
    return registry.brand_terms.select("brand", "term", "source")


def build_protected_labels(spark, sf):
    registry = SR.registry_from_table(FX.spark_view(spark, sf, FX.REGISTRY_ENTRIES))
    return registry.protected_labels.select("skel", F.array_join("approved", ",").alias("approved"))


def merge_registry_sets(spark, sf):
    entries = FX.spark_view(spark, sf, FX.REGISTRY_ENTRIES)
    merged = SR.merge_entries(SR.entries(spark, C.BUILT_IN_DOMAINS), SR.clean_entries(entries))
    return merged.groupBy("brand").agg(F.count("*").alias("domains"), F.min("domain").alias("first_domain"))


def reputation_store_metadata(spark, sf):
    return RP.metadata(reputation_tables(spark, sf))


def regression_pass_rate(spark, sf):
    cases = scored(spark, sf).select(
        F.when(c("kind").isin(0, 1, 12, 14, 15, 16, 18, 19), 0).otherwise(1).alias("expected"),
        (c("risk_score") / 100).alias("probability"))
    return E.regression_pass_rate(cases)


def quality_gate(spark, sf):
    return E.quality_gate(E.classification_metrics(predictions(spark, sf)), regression_pass_rate(spark, sf))


def _labelled(spark, sf):
    return SL.union_sources(FX.spark_view(spark, sf, FX.LABELLED), FX.spark_view(spark, sf, FX.RELABELLED))


def dedupe_keep_last(spark, sf):
    return SL.dedupe_keep_last(_labelled(spark, sf))


def global_statistics(spark, sf):
    """The one nested row, its months and hosts as text."""
    row = D.global_statistics(detections(spark, sf), now())
    seen = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    months = F.transform("months", lambda m: F.concat_ws(":", m["month"], m["total"], m["highRisk"]))
    hosts = F.transform("hosts", lambda h: F.concat_ws(" ", *[
        seen(h[n]) if n == "latestTimestamp" else h[n].cast("string") for n in D.HOST_RECORD]))
    return row.withColumn("months", F.array_join(months, ",")).withColumn("hosts", F.array_join(hosts, ","))


def recent_history(spark, sf):
    return _text_time(D.recent_history(detections(spark, sf)), "timestamp").select("userId", "id", "rank", "timestamp")


def latest_per_host(spark, sf):
    return _text_time(D.latest_per_host(detections(spark, sf)), "timestamp")


def first_match(spark, sf):
    """First registry match of every scored host."""
    return profile(spark, sf).select(
        "domain", F.coalesce("official_brand", "subdomain_brand", "token_hit.brand", "skeleton_hit.brand",
                             "substring_hit.brand", "typo_hit.brand").alias("first_brand"))


def top3_signals(spark, sf):
    rows = scored(spark, sf).select("url_id", F.posexplode("top_signals").alias("position", "s"))
    return rows.select("url_id", "position", "s.name", "s.score")


def detections_newest_first(spark, sf):
    own = SD.scan_by_key_prefix(detections(spark, sf), "detection:7:")
    return D.newest_first(D.valid_detections(own)).select("id", "riskScore")


# --- training ---------------------------------------------------------------

def augment_cases(spark, sf):
    """Generated rows around the names of the page hosts."""
    names = prepared(spark, sf).select("domain", "sld").distinct()
    brands = names.select(c("sld").alias("brand")).distinct()
    tokens = brands.select("brand", skeleton(c("brand")).alias("token"))
    fakes = brands.select(skeleton(c("brand")).alias("fake")).distinct()
    paths = brands.select(F.concat(c("brand"), F.lit("-login")).alias("path"))
    blocks = names.filter(UP.is_ip_like(c("domain"))).select(
        F.substring_index("domain", ".", 3).alias("block"), F.lit(0).alias("idx")).distinct()
    return TR.augment_cases(names.select("domain"), brands, tokens, fakes, paths, blocks)


def stratified_split(spark, sf):
    return SL.stratified_split(SL.dedupe_keep_last(_labelled(spark, sf))).select("url", "label", "is_test")


def class_weights(spark, sf):
    rows = E.class_weights(predictions(spark, sf).withColumn("sample_weight", F.lit(2.0)))
    return rows.select("doc_id", "label", F.round("weight", 9).alias("weight"))


def _measured(predicted, **more):
    """What every fit has in common: rows, positives, a confusion matrix of all rows, probabilities."""
    rows = materialize(predicted.select("label", "prediction", "raw_probability", "confidence"), "predicted")
    cells = E.confusion_matrix(rows).select((c("tn") + c("fp") + c("fn") + c("tp")).alias("n")).scalar()
    p = c("raw_probability")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(c("label") == 1).alias("positives"), F.max(cells).alias("in_cells"),
        F.bool_and(p.between(0, 1) & (c("confidence") >= 0.5) & ((p >= 0.5) == (c("prediction") == 1))).alias("consistent"),
        (F.avg((c("label") == c("prediction")).cast("int")) >= 0.9).alias("accurate"),
        *[F.lit(v).alias(k) for k, v in more.items()])


def train_tree_ensemble(spark, sf):
    rows = training_rows(spark, sf)
    model = TR.train_tree_ensemble(rows, C.MODEL_FEATURES, key="url_id")
    roots = model.nodes.filter("node = 1").agg(F.count_distinct("tree"), F.max("level") <= 24).first()
    return _measured(TR.batch_predict(model, rows), trees=roots[0], within_depth=roots[1])


def train_random_forest(spark, sf):
    """Over every numeric column of the wide table."""
    rows = training_rows(spark, sf).drop("url_id", "kind", "weight", "sample_weight")
    wide = FT.numeric_columns_only(rows, "label")
    model = TR.train_random_forest(wide, wide.columns[:-1])
    return _measured(TR.batch_predict(model, FT.assembled(wide, wide.columns[:-1])), trees=model.getNumTrees, inputs=model.numFeatures)


def train_hashed_logistic(spark, sf):
    rows = FT.hashed_ngrams(training_urls(spark, sf))
    model = TR.train_hashed_logistic(rows)
    return _measured(TR.batch_predict(model, rows), inputs=model.settings.size)


def _votes(spark, sf):
    rows = training_rows(spark, sf)
    return TR.batch_predict(TR.train_tree_ensemble(rows, C.MODEL_FEATURES, key="url_id"), rows)


def batch_predict(spark, sf):
    """One row per URL: its probability is one, its confidence the greater side, its class the one above a half."""
    p = c("raw_probability")
    return _votes(spark, sf).select(
        "url_id", p.between(0, 1).alias("is_probability"), (c("confidence") == F.greatest(p, 1 - p)).alias("is_confidence"),
        (c("prediction") == (p >= 0.5).cast("int")).alias("is_class"))


def score_urls_modelled(spark, sf):
    """Scores whose AI indicator comes from a trained model; the rest of a URL's score is what it is without one."""
    raw = materialize(_votes(spark, sf).select("url_id", "raw_probability", "confidence"), "votes")
    urls = adversarial(spark, sf).join(raw, "url_id")
    return score_urls(urls, SR.core_registry(spark), modelled=True).select(
        "url_id", "domain", c("ai_score").between(0, 100).alias("ai_in_range"), c("risk_score").between(0, 100).alias("risk_in_range"))


def evaluate_holdout(spark, sf):
    parts = materialize(SL.stratified_split(training_rows(spark, sf)), "holdout")
    model = TR.train_tree_ensemble(parts.filter("NOT is_test"), C.MODEL_FEATURES, key="url_id")
    tested = materialize(TR.batch_predict(model, parts.filter("is_test")), "tested")
    auc = E.roc_auc(tested.select("label", c("raw_probability").alias("score"))).scalar()
    return _measured(tested).withColumn("auc_in_range", auc.between(0.5, 1.0))


def evaluate_rules(spark, sf):
    label = F.when(c("kind").isin(0, 1, 12, 14, 15, 16, 18, 19), 0).otherwise(1)
    return E.evaluate_rules(scored(spark, sf), label)


# --- streaming --------------------------------------------------------------

def _page_stream(spark, sf):
    path = f"{sf}/pages.parquet"
    return ST.read_stream(spark, path, spark.read.parquet(path).select("page_id", "url").schema)


def stream_score_urls(spark, sf):
    registry = SR.core_registry(spark)

    def score(batch):
        rows = batch.select(c("page_id").alias("url_id"), "url")
        return score_urls(rows, registry).select("url_id", "url", "risk_score", "result", "critical")

    return ST.stream_score_urls(_page_stream(spark, sf), score)


def _delivered(spark, *deliveries):
    """A stream of what came, once after every delivery; its operator goes on where it ended, so each is a batch of its own."""
    path = shared_path(spark, "stream-log")
    for rows in deliveries:
        rows.write.mode("append").parquet(path)
        yield ST.read_stream(spark, path, rows.schema)


def stream_dedupe(spark, sf):
    """Click records come again, changed, in a later delivery; a last record moves the watermark past all."""
    log = D.valid_detections(detections(spark, sf)).select("id", "url", "riskScore", "event_type", "timestamp").withColumn("version", F.lit(1))
    later = log.filter("event_type = 'click'").withColumns({"riskScore": 100 - c("riskScore"), "version": F.lit(2)})
    end = log.agg(F.max("timestamp").alias("t")).select(
        F.lit("end").alias("id"), F.lit("").alias("url"), F.lit(0).alias("riskScore"), F.lit("").alias("event_type"),
        (c("t") + F.expr("interval 90 days")).alias("timestamp"), F.lit(1).alias("version"))
    folder = shared_path(spark, "deduped")
    for stream in _delivered(spark, log, later, end):
        rows = ST.stream_dedupe(stream, "version", "30 days", folder)
    return rows.filter("id <> 'end'").select("id", "riskScore")


def stream_band_counts(spark, sf):
    """Closed windows: a late empty marker row moves the watermark past the last day."""
    path = shared_path(spark, "stream-log")
    log = D.valid_detections(detections(spark, sf)).select("riskScore", "timestamp")
    log.write.parquet(path)
    marker = log.agg(F.lit(0).alias("riskScore"), (F.max("timestamp") + F.expr("interval 90 days")).alias("timestamp"))
    marker.select(log.columns).write.mode("append").parquet(path)
    rows = ST.stream_band_counts(ST.read_stream(spark, path, log.schema), "1 day", "1 hour")
    return _text_time(rows, "window_start")


def stream_top_hosts(spark, sf):
    log = detections(spark, sf).select("event_id", "url", "riskScore", "critical_phishing", "timestamp")
    parts = [log.filter(c("event_id") % 3 == i).drop("event_id") for i in range(3)]
    folder = shared_path(spark, "hosts")
    for stream in _delivered(spark, *parts):
        rows = ST.stream_top_hosts(stream, folder=folder)
    return _text_time(rows, "latestTimestamp")


def stream_mini_batch_fit(spark, sf):
    """Two batches of a stream, one round of learning each, at the full number of buckets."""
    urls = training_urls(spark, sf)
    folder = shared_path(spark, "model")
    for stream in _delivered(spark, *(urls.filter(c("url_id") % 2 == part) for part in (0, 1))):
        model = ST.stream_mini_batch_fit(stream, FT.hashed_ngrams, TR.hashed_settings(), folder)
    return _measured(TR.batch_predict(model, FT.hashed_ngrams(urls)), inputs=model.settings.size, steps=model.steps)


QUERIES = {
    # sources and sinks
    "load_labelled_urls": load_labelled_urls, "load_domain_registry": load_domain_registry,
    "load_reputation_tables": load_reputation_tables, "append_detections": append_detections,
    "scan_by_key_prefix": scan_by_key_prefix, "lookup_by_keys": lookup_by_keys, "remove_by_keys": remove_by_keys,
    "export_cases": export_cases, "export_header": export_header, "write_training_report": write_training_report,
    "validate_scores": validate_scores,
    # URL preparation
    "normalize_urls": normalize_urls, "split_urls": split_urls, "idna_hosts": idna_hosts,
    "registrable_domain": registrable_domain, "confusable_skeleton": confusable_skeleton,
    "confusable_marker_flag": confusable_marker_flag, "url_fingerprint": url_fingerprint,
    "lexical_counts": lexical_counts, "features_22": features_22, "features_5": features_5,
    "features_30": features_30, "sld_entropy": sld_entropy, "hashed_ngrams": hashed_ngrams,
    "ngram_tokens": ngram_tokens,
    "numeric_columns_only": numeric_columns_only, "response_projection": response_projection,
    # filters
    "valid_detections": valid_detections, "search_detections": search_detections,
    "single_http_url_gate": single_http_url_gate, "reject_empty_urls": reject_empty_urls,
    "ip_or_at_url_flag": ip_or_at_url_flag, "confusable_tld_flag": confusable_tld_flag,
    "verified_official_filter": verified_official_filter,
    # joins
    "match_official_domain": match_official_domain, "match_shared_hosting": match_shared_hosting,
    "match_shortener": match_shortener, "lookalike_subdomain": lookalike_subdomain,
    "skeleton_domain_match": skeleton_domain_match, "brand_token_in_root": brand_token_in_root,
    "brand_like_token": brand_like_token, "brand_substring_host": brand_substring_host,
    "typo_distance_match": typo_distance_match, "typo_ratio_match": typo_ratio_match,
    "brand_similarity_features": brand_similarity_features, "keyword_hits": keyword_hits,
    "tld_risk_lookup": tld_risk_lookup, "reputation_cascade": reputation_cascade,
    "reputation_cascade_stale": reputation_cascade_stale, "label_predictions": label_predictions,
    # indicators
    "ind_official_domain": _indicator("officialDomain"),
    "ind_reputation": _indicator("reputationEvidence", scored_with_reputation),
    "ind_ai_probability": ind_ai_probability, "ind_brand": _indicator("brandVerification"),
    "ind_homograph": _indicator("homographAttack"), "ind_url_structure": _indicator("urlStructure"),
    "ind_keywords": _indicator("suspiciousKeywords"), "ind_https": _indicator("httpsUsage"),
    "ind_length": _indicator("urlLengthComplexity"),
    # scores
    "lexical_probability": lexical_probability, "calibrate_probability": calibrate_probability,
    "official_clean_correction": official_clean_correction, "weighted_score": weighted_score,
    "critical_reasons": critical_reasons, "critical_top3": critical_top3, "override_chain": override_chain,
    "risk_band": risk_band, "explanations": explanations, "recommendations": recommendations,
    "score_audit": score_audit, "scoring_config": scoring_config, "indicators_long": indicators_long,
    "evidence_statements": evidence_statements, "action_guidance": action_guidance,
    "score_urls": score_urls_query, "score_urls_with_reputation": score_urls_with_reputation,
    "pages_per_band": pages_per_band,
    # statistics
    "basic_statistics": basic_statistics, "basic_statistics_per_user": basic_statistics_per_user,
    "risk_band_counts": lambda s, d: D.risk_band_counts(detections(s, d)),
    "monthly_stats": lambda s, d: D.monthly_stats(order_detections(s, d), orders_now()),
    "top_high_risk_hosts": lambda s, d: _text_time(D.top_high_risk_hosts(detections(s, d)), "latestTimestamp"),
    "abused_domain_counts": lambda s, d: D.abused_domain_counts(detections(s, d)),
    "global_statistics": global_statistics,
    "daily_risk_trend": lambda s, d: D.daily_risk_trend(detections(s, d)).withColumn("date", c("date").cast("string")),
    "recent_scan_count": lambda s, d: D.recent_scan_count(detections(s, d), now()),
    "indicator_status_counts": indicator_status_counts,
    "band_percentages": lambda s, d: D.band_percentages(detections(s, d)),
    "label_distribution": lambda s, d: E.label_distribution(_labelled(s, d)),
    "source_distribution": lambda s, d: E.source_distribution(_labelled(s, d)),
    "confusion_matrix": lambda s, d: E.confusion_matrix(predictions(s, d)),
    "classification_metrics": lambda s, d: E.classification_metrics(predictions(s, d)),
    "roc_auc": lambda s, d: E.roc_auc(predictions(s, d)),
    "regression_pass_rate": regression_pass_rate, "quality_gate": quality_gate, "feature_audit": feature_audit,
    "build_brand_terms": build_brand_terms, "build_protected_labels": build_protected_labels,
    "reputation_store_metadata": reputation_store_metadata,
    "build_reputation_tables": build_reputation_tables,
    # windows, sorts, sets
    "recent_history": recent_history, "first_match": first_match, "latest_per_host": latest_per_host,
    "top3_signals": top3_signals, "detections_newest_first": detections_newest_first,
    "top_k_hosts": lambda s, d: D.top_high_risk_hosts(detections(s, d), 3).select("host", "detectionCount"),
    "months_ascending": lambda s, d: D.months_ascending(order_detections(s, d), orders_now()),
    "union_training_sources": lambda s, d: _labelled(s, d), "dedupe_keep_last": dedupe_keep_last,
    "merge_registry_sets": merge_registry_sets,
    # training
    "augment_cases": augment_cases, "obfuscate_urls": obfuscate_urls, "stratified_split": stratified_split,
    "class_weights": class_weights, "train_tree_ensemble": train_tree_ensemble,
    "train_random_forest": train_random_forest, "train_hashed_logistic": train_hashed_logistic,
    "batch_predict": batch_predict, "score_urls_modelled": score_urls_modelled,
    "evaluate_holdout": evaluate_holdout, "evaluate_rules": evaluate_rules,
    # streaming
    "stream_score_urls": stream_score_urls, "stream_dedupe": stream_dedupe,
    "stream_band_counts": stream_band_counts, "stream_top_hosts": stream_top_hosts,
    "stream_mini_batch_fit": stream_mini_batch_fit,
}

"""The nine indicators, as columns over rows that carry the matching evidence.

Every indicator is one ``when`` chain (first branch wins) of a score, a status,
an explanation and a value; the rows carry them as flat columns
``<name>_score``, ``_status``, ``_explanation`` and ``_value`` (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk import messages as M
from urlrisk.functions.text import clamp, count_char, count_class, count_special, half_even, skeleton
from urlrisk.operators.matching import bad_tld_points, keyword_hits
from urlrisk.operators.urls import confusable_tld, is_ip_like

c = F.col
PARTS = ("score", "status", "explanation", "value")


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _outcome(score, status, explanation, value) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(score).cast("int").alias("score"), lit(status).alias("status"),
        lit(explanation).alias("explanation"), lit(value).cast("string").alias("value"))


def _chain(*branches) -> Column:
    """``(condition, outcome)`` pairs and a final outcome."""
    *tests, last = branches
    column = None
    for condition, outcome in tests:
        column = F.when(condition, outcome) if column is None else column.when(condition, outcome)
    return column.otherwise(last)


def _level(score: Column, danger: int, warning: int) -> Column:
    return F.when(score >= danger, "danger").when(score >= warning, "warning").otherwise("safe")


def _token_value() -> Column:
    hit = c("token_hit")
    return _json(brand=hit["brand"], domain=c("domain"), root_domain=c("root"), raw_token=hit["raw_token"],
                 token_skeleton=hit["term"], matched_term=hit["term"], matched_official_source=hit["source"],
                 used_confusable_character=hit["raw_token"] != hit["term"])


def _subdomain_value() -> Column:
    labels = F.transform("suspicious_labels", lambda h: F.struct(
        h["label"].alias("label"), h["service"].alias("matched_service"),
        h["service_skeleton"].alias("matched_service_skeleton"), h["distance"].alias("distance"),
        F.bround(h["ratio"], 3).alias("similarity")))
    return _json(domain=c("domain"), protected_parent_domain=c("subdomain_parent"),
                 matched_brand=c("subdomain_brand"), suspicious_labels=labels)


def _platform_value() -> Column:
    return _json(domain=c("domain"), platform_root=c("shared_provider"))


def official_domain() -> Column:
    skel = c("skeleton_hit")
    return _chain(
        (c("is_official"), _outcome(0, "safe", F.format_string(M.OFFICIAL_SAFE, c("official_domain")),
                                    _json(domain=c("domain"), brand=c("official_brand"),
                                          matched_domain=c("official_domain")))),
        (c("shared_provider").isNotNull(), _outcome(45, "warning", M.OFFICIAL_SHARED, _platform_value())),
        (c("subdomain_parent").isNotNull(), _outcome(95, "danger", M.OFFICIAL_SUBDOMAIN, _subdomain_value())),
        (c("token_hit").isNotNull(), _outcome(98, "danger", M.OFFICIAL_TOKEN, _token_value())),
        (skel.isNotNull(), _outcome(100, "danger", F.format_string(M.OFFICIAL_SKELETON, skel["official"]),
                                    _json(domain=c("domain"), matched_brand=skel["brand"],
                                          matched_official=skel["official"],
                                          domain_skeleton=skeleton(c("domain"))))),
        _outcome(20, "warning", M.OFFICIAL_UNKNOWN, _quoted(c("domain"))),
    )


def reputation_evidence() -> Column:
    rep = c("reputation")
    sources = F.array_join(rep["sources"], ", ")
    note = F.concat(
        F.format_string(M.REPUTATION_MATCH, rep["match_type"], F.when(sources == "", "local feed").otherwise(sources)),
        F.when(rep["stale"], M.REPUTATION_STALE).otherwise(""))
    value = F.to_json(rep)
    suppressed = F.to_json(F.struct(
        "reputation.*", F.lit(True).alias("override_suppressed"),
        F.lit("verified_official_domain").alias("suppression_reason"), "official_brand",
        c("official_domain").alias("official_matched_domain")))
    return _chain(
        (c("is_official"), _outcome(
            0, "safe", F.format_string(M.REPUTATION_SUPPRESSED, c("official_domain")), suppressed)),
        (rep["match"], _outcome(rep["score"], F.when(rep["score"] >= 80, "danger").otherwise("warning"), note, value)),
        (rep["context_match"], _outcome(
            0, F.when(rep["available"], "safe").otherwise("warning"), M.REPUTATION_CONTEXT, value)),
        (~rep["available"], _outcome(0, "warning", M.REPUTATION_UNAVAILABLE, value)),
        _outcome(0, "safe", M.REPUTATION_NONE, value),
    )


def brand_verification() -> Column:
    sub, near = c("substring_hit"), c("distance_hit")
    # Per brand the substring test comes before the distance test.
    by_name = sub.isNotNull() & (near.isNull() | (sub["brand_ord"] <= near["brand_ord"]))
    return _chain(
        (c("shared_provider").isNotNull(), _outcome(0, "warning", M.BRAND_SHARED, _platform_value())),
        (c("is_official"), _outcome(0, "safe", F.format_string(M.BRAND_OFFICIAL, c("official_brand")),
                                    _quoted(c("official_brand")))),
        (by_name, _outcome(100, "danger", F.format_string(M.BRAND_SUBSTRING, sub["brand"]),
                           _json(brand=sub["brand"], domain=c("domain"), domain_skeleton=skeleton(c("domain"))))),
        (near.isNotNull(), _outcome(95, "danger", F.format_string(M.BRAND_TYPO, c("root"), near["root"]),
                                    _json(brand=near["brand"], domain=c("domain"), official=near["root"],
                                          distance=1))),
        _outcome(0, "safe", M.BRAND_NONE, '"Not applicable"'),
    )


def homograph_attack() -> Column:
    skel, typo, folded = c("skeleton_hit"), c("typo_hit"), c("tld_skel")
    return _chain(
        (c("shared_provider").isNotNull(), _outcome(0, "warning", M.HOMOGRAPH_SHARED, _platform_value())),
        (c("is_official"), _outcome(0, "safe", M.HOMOGRAPH_OFFICIAL, _quoted(c("domain")))),
        (c("subdomain_parent").isNotNull(), _outcome(95, "danger", M.HOMOGRAPH_SUBDOMAIN, _subdomain_value())),
        (c("punycode"), _outcome(100, "danger", M.HOMOGRAPH_PUNYCODE, _quoted(c("domain")))),
        (c("confusable"), _outcome(100, "danger", F.format_string(M.HOMOGRAPH_TLD, c("tld"), folded),
                                            _json(domain=c("domain"), tld=c("tld"), tld_skeleton=folded))),
        (c("token_hit").isNotNull(), _outcome(95, "danger", M.HOMOGRAPH_TOKEN, _token_value())),
        (skel.isNotNull(), _outcome(100, "danger", F.format_string(M.HOMOGRAPH_SKELETON, skel["official"]),
                                    _json(domain=c("domain"), official=skel["official"], brand=skel["brand"],
                                          domain_skeleton=skeleton(c("domain"))))),
        (typo.isNotNull(), _outcome(90, "danger", F.format_string(M.HOMOGRAPH_TYPO, c("root"), typo["root"]),
                                    _json(domain=c("domain"), official=typo["root"], brand=typo["brand"],
                                          similarity=F.bround(typo["ratio"], 2), distance=typo["distance"]))),
        _outcome(0, "safe", M.HOMOGRAPH_NONE, _quoted(c("domain"))),
    )


def _reasons(*items) -> tuple[Column, Column]:
    """Sum of points and the list of texts of the rules that hold."""
    points = F.lit(0)
    for condition, score, _ in items:
        points = points + F.when(condition, score).otherwise(0)
    texts = F.array_compact(F.array(*[
        F.when(condition, text if isinstance(text, Column) else F.lit(text)) for condition, _, text in items]))
    return points, texts


def _listed(texts: Column) -> Column:
    return F.when(F.size(texts) > 0, F.to_json(texts)).otherwise('"None detected"')


def url_structure(rows: DataFrame) -> DataFrame:
    hyphens, tld_points = c("hyphens"), c("tld_points")
    points, reasons = _reasons(
        (c("shortener"), 45, M.STRUCTURE_SHORTENER),
        (c("brand_lure"), 60,
         F.format_string(M.STRUCTURE_LURE, c("lure_hit.token"))),
        (c("at_sign"), 100, M.STRUCTURE_AT),
        (c("ip_host"), 100, M.STRUCTURE_IP),
        (c("punycode"), 100, M.STRUCTURE_PUNYCODE),
        (tld_points.isNotNull(), tld_points, F.format_string(M.STRUCTURE_TLD, c("tld"))),
        (c("confusable"), 100, F.format_string(M.STRUCTURE_CONFUSABLE_TLD, c("tld"), c("tld_skel"))),
        (hyphens >= 3, 60, M.STRUCTURE_MANY_HYPHENS),
        ((hyphens > 0) & (hyphens < 3), 25, M.STRUCTURE_HYPHENS),
        (c("digits") > 0, 30, M.STRUCTURE_DIGITS),
        (c("dots") >= 4, 50, M.STRUCTURE_DEEP),
        (c("path").contains("%") | c("query").contains("%"), 30, M.STRUCTURE_ENCODED),
    )
    rows = rows.withColumns({"_points": F.least(F.lit(100), points), "_reasons": reasons})
    ordinary = c("is_official") & (c("_points") < 100)
    rows = rows.withColumns({
        "_points": F.when(ordinary, 0).otherwise(c("_points")),
        "_reasons": F.when(ordinary, F.array().cast("array<string>")).otherwise(c("_reasons")),
    })
    explanation = F.when(F.size("_reasons") > 0, F.format_string(
        M.STRUCTURE_ISSUES, F.array_join("_reasons", ", "))).otherwise(M.STRUCTURE_NONE)
    return rows.withColumn("urlStructure", _outcome(
        c("_points"), _level(c("_points"), 70, 30), explanation, _listed(c("_reasons")))).drop("_points", "_reasons")


def keyword_target() -> Column:
    return F.lower(F.concat_ws(" ", "domain", "path", "query"))


def suspicious_keywords() -> Column:
    n = F.size("keywords")
    score = F.when(c("is_official"), 0).when(n >= 3, 100).when(n == 2, 75).when(n == 1, 40).otherwise(0)
    text = F.when(c("is_official"), M.KEYWORDS_OFFICIAL).when(
        n > 0, F.format_string(M.KEYWORDS_FOUND, F.array_join("keywords", ", "))).otherwise(M.KEYWORDS_NONE)
    return _outcome(score, _level(score, 70, 30), text, _listed(c("keywords")))


def https_usage() -> Column:
    secure = c("scheme") == "https"
    value = _json(submitted_scheme=c("scheme"), uses_https=secure, certificate_validated=False)
    return _chain((secure, _outcome(0, "safe", M.HTTPS_SAFE, value)),
                  _outcome(60, "warning", M.HTTPS_WARNING, value))


def url_length_complexity() -> Column:
    size, special = c("url_size"), c("special")
    points, reasons = _reasons(
        (size > 120, 80, M.LENGTH_EXTREME),
        ((size > 90) & (size <= 120), 50, M.LENGTH_SUSPICIOUS),
        ((size > 70) & (size <= 90), 25, M.LENGTH_MODERATE),
        (special > 25, 35, M.LENGTH_SPECIAL),
    )
    score = F.least(points, F.when(c("is_official"), 10).otherwise(100))
    explanation = F.when(F.size(reasons) > 0, F.format_string(
        M.LENGTH_ISSUES, F.array_join(reasons, ", "))).otherwise(M.LENGTH_NONE)
    return _outcome(score, _level(score, 70, 30), explanation,
                    _json(length=size, special_characters=special))


def lexical_probability() -> Column:
    """Additive lexical evidence on [0.02, 0.95]; every term is a multiple of 0.25, so sums are exact."""
    def when(condition, points):
        return F.when(condition, points).otherwise(F.lit(0.0))

    official = c("is_official")
    size, hyphens, digits, tld_points = c("url_size"), c("hyphens"), c("digits"), c("tld_points")
    many_digits = (F.length("sld") > 0) & (digits >= F.length("sld") * 0.30)
    score = (
        F.when(official, 4.0).otherwise(12.0)
        + when(c("scheme") != "https", 12.0)
        + when(c("shortener"), 22.0)
        + when(c("brand_lure"), 48.0)
        + when(c("ip_host"), 36.0)
        + when(c("at_sign"), 36.0)
        + when(tld_points.isNotNull(), F.least(F.lit(22.0), tld_points * 0.25))
        + when(c("confusable"), 38.0)
        + F.least(F.lit(28.0), F.size("keywords") * 7.0)
        + when(~official & c("skeleton_hit").isNotNull(), 45.0)
        + when(~official & c("substring_hit").isNotNull(), 22.0)
        + when(~official, c("typo_brands") * 60.0)
        + F.when(many_digits, 12.0).when(digits > 0, 6.0).otherwise(0.0)
        + F.when(hyphens >= 3, 14.0).when(hyphens > 0, 6.0).otherwise(0.0)
        + F.when(size > 120, 16.0).when(size > 80, 10.0).when((size > 55) & ~official, 5.0).otherwise(0.0)
    )
    score = F.least(score, F.when(official, 8.0).otherwise(100.0))
    return clamp(score / 100, 0.02, 0.95)


def calibrated_probability(raw: Column, lexical: Column, trees: int = 100) -> Column:
    """Blend of a model vote, smoothed by the size of the ensemble, and lexical evidence."""
    smooth = (raw * trees + 1) / (trees + 2)
    blend = (
        F.when((raw <= 0.50) & (lexical >= 0.70), lexical * 0.85 + smooth * 0.15)
        .when((raw <= 0.02) | (raw >= 0.98), lexical * 0.70 + smooth * 0.30)
        .otherwise(lexical * 0.40 + smooth * 0.60)
    )
    return clamp(blend, 0.02, 0.95)


def ai_probability(modelled: bool) -> Column:
    """Score of the calibrated probability; capped at 15 on official hosts."""
    score = c("ai_score")
    raw, calibrated = c("raw_probability") * 100, c("calibrated_probability") * 100
    if modelled:
        status = _level(score, 70, 35)
        text = F.when(c("is_official"), F.format_string(M.AI_OFFICIAL, raw, calibrated, score)).otherwise(
            F.format_string(M.AI_PLAIN, raw, calibrated, score))
    else:
        status, text = F.lit("warning"), F.lit(M.AI_UNAVAILABLE)
    return _outcome(score, status, text, F.lit(None))


def add_ai_value(rows: DataFrame) -> DataFrame:
    """Evidence of the AI indicator, after the clean-official correction has set its final score."""
    score, clean = c("aiModelProbability_score"), c("official_clean")
    effective = F.when(clean, 0.0).when(c("is_official"), score / 100).otherwise(c("calibrated_probability"))
    rows = rows.withColumn("effective_probability", effective)
    shares = {
        "phishing_probability": "effective_probability", "effective_ai_probability": "effective_probability",
        "feature_ai_probability": "lexical_probability", "calibrated_phishing_probability": "calibrated_probability",
        "raw_phishing_probability": "raw_probability", "confidence": "confidence",
    }
    points = {
        "raw_ai_risk_score": "raw_probability", "feature_ai_risk_score": "lexical_probability",
        "calibrated_ai_risk_score": "calibrated_probability",
    }
    weight = C.INDICATOR_WEIGHTS["aiModelProbability"]
    fields = {}
    for name, column in shares.items():
        fields[name] = half_even(c(column), 4)
        fields[f"{name}_percent"] = half_even(c(column) * 100, 2)
    for name, column in points.items():
        fields[name] = F.rint(c(column) * 100).cast("int")
    fields |= {
        "effective_ai_risk_percent": score, "adjusted_ai_risk_score": score, "weight_percent": F.lit(weight),
        "weighted_contribution_points": score * weight / 100, "official_domain_correction": F.when(clean, True),
    }
    return rows.withColumn("aiModelProbability_value", _json(**fields))


def add_signals(rows: DataFrame) -> DataFrame:
    """Plain facts of a URL that several rules read, each computed once."""
    rows = rows.withColumns({
        "target": keyword_target(),
        "ip_host": is_ip_like(c("domain")),
        "at_sign": c("rule_url").contains("@"),
        "punycode": c("domain").contains("xn--"),
        "tld_points": bad_tld_points(c("tld")),
        "tld_skel": skeleton(c("tld")),
        "confusable": confusable_tld(c("tld")),
        "hyphens": count_char(c("domain"), "-"),
        "dots": count_char(c("domain"), "."),
        "digits": count_class(c("sld"), "[0-9]"),
        "url_size": F.length("rule_url"),
        "special": count_special(c("rule_url")),
        "brand_lure": c("shortener") & c("lure_hit").isNotNull(),
    })
    rows = rows.withColumn("target_skel", skeleton(c("target")))
    return rows.withColumn("keywords", keyword_hits(c("target"), c("target_skel")))


def evidence_defaults(rows: DataFrame) -> DataFrame:
    """Hosts that matched nothing have no profile row; fill in what that means."""
    return rows.withColumns({
        "is_official": F.coalesce("is_official", F.lit(False)),
        "typo_brands": F.coalesce("typo_brands", F.lit(0)),
    })


def add_indicators(rows: DataFrame, modelled: bool = False) -> DataFrame:
    """Add four columns per indicator, before the clean-official correction.

    With ``modelled`` the rows carry ``raw_probability`` and ``confidence`` of a
    trained model; otherwise the lexical estimate stands in for it.
    """
    rows = add_signals(rows).withColumn("lexical_probability", lexical_probability())
    if modelled:
        calibrated = calibrated_probability(c("raw_probability"), c("lexical_probability"))
    else:
        rows = rows.withColumns({"raw_probability": c("lexical_probability"), "confidence": F.lit(0.0)})
        calibrated = c("lexical_probability")
    rows = rows.withColumn("calibrated_probability", calibrated)
    score = F.rint(c("calibrated_probability") * 100).cast("int")
    rows = rows.withColumn("ai_score", F.when(c("is_official"), F.least(score, F.lit(15))).otherwise(score))
    rows = url_structure(rows)
    rows = rows.withColumns({
        "officialDomain": official_domain(),
        "reputationEvidence": reputation_evidence(),
        "aiModelProbability": ai_probability(modelled),
        "brandVerification": brand_verification(),
        "homographAttack": homograph_attack(),
        "suspiciousKeywords": suspicious_keywords(),
        "httpsUsage": https_usage(),
        "urlLengthComplexity": url_length_complexity(),
    })
    # Flat columns keep the optimizer from copying whole chains into later steps.
    return rows.withColumns({
        f"{name}_{part}": c(name)[part] for name in C.INDICATOR_NAMES for part in PARTS
    }).drop(*C.INDICATOR_NAMES)

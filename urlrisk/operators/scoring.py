"""From nine indicators to an auditable score and a risk band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk import messages as M
from urlrisk.functions.text import clamp, half_even, skeleton, values
from urlrisk.operators.indicators import add_ai_value

c = F.col


def _score(name: str) -> Column:
    return c(f"{name}_score")


def clean_correction(rows: DataFrame) -> DataFrame:
    """An official host without any finding has no AI risk; AI and length findings do not count."""
    others = [n for n in C.INDICATOR_NAMES if n not in ("aiModelProbability", "urlLengthComplexity")]
    clean = c("is_official")
    for name in others:
        clean = clean & (_score(name) == 0)
    rows = rows.withColumn("official_clean", clean)
    fixed = {"score": F.lit(0), "status": F.lit("safe"), "explanation": F.lit(M.AI_CLEAN)}
    return rows.withColumns({
        f"aiModelProbability_{part}": F.when(c("official_clean"), value).otherwise(c(f"aiModelProbability_{part}"))
        for part, value in fixed.items()
    }).withColumn("ai_score", _score("aiModelProbability"))


def weighted_score(rows: DataFrame) -> DataFrame:
    """Weighted sum in whole hundredths, so no binary rounding error enters."""
    hundredths = F.lit(0)
    for name, weight in C.INDICATOR_WEIGHTS.items():
        hundredths = hundredths + _score(name) * weight
    return rows.withColumn("weighted_score", hundredths / 100).withColumn(
        "rounded_score", F.rint("weighted_score").cast("int"))


def critical_rules(rows: DataFrame) -> DataFrame:
    brand, keyword = _score("brandVerification"), _score("suspiciousKeywords")
    rules = [
        (_score("officialDomain") >= 90, M.CRITICAL_OFFICIAL),
        (_score("reputationEvidence") >= 90, M.CRITICAL_REPUTATION),
        (_score("homographAttack") >= 90, M.CRITICAL_HOMOGRAPH),
        (brand >= 90, M.CRITICAL_BRAND),
        (_score("urlStructure") >= 90, M.CRITICAL_STRUCTURE),
        (c("shortener") & (brand >= 90), M.CRITICAL_SHORTENER),
        ((brand >= 90) & (keyword >= 40), M.CRITICAL_BRAND_KEYWORD),
        ((_score("httpsUsage") >= 60) & (keyword >= 70), M.CRITICAL_HTTP_KEYWORD),
        (c("at_sign"), M.CRITICAL_AT),
        (c("ip_host"), M.CRITICAL_IP),
    ]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))
    return rows.withColumn("critical_reasons", reasons).withColumn("critical", F.size("critical_reasons") > 0)


def top_signals(rows: DataFrame) -> DataFrame:
    """The three highest indicators, ties in reporting order, and the critical evidence score."""
    signals = F.array(*[
        F.struct((-_score(n)).alias("rank"), F.lit(i).alias("ord"), F.lit(n).alias("name"))
        for i, n in enumerate(C.INDICATOR_NAMES)])
    top = F.transform(F.slice(F.array_sort(signals), 1, 3), lambda s: F.struct(
        s["name"].alias("name"), (-s["rank"]).alias("score")))
    rows = rows.withColumn("top_signals", top)
    point = lambda i: F.get("top_signals", F.lit(i))["score"]
    evidence = F.rint(point(0) * 0.65 + point(1) * 0.20 + point(2) * 0.15).cast("int")
    return rows.withColumn("critical_score", F.when(c("critical"), clamp(evidence, 80, 100)))


def override_chain(rows: DataFrame) -> DataFrame:
    """Floors and caps in fixed order; each that changes the score leaves a note."""
    critical, official = c("critical"), c("is_official")
    ai, keyword, structure = _score("aiModelProbability"), _score("suspiciousKeywords"), _score("urlStructure")
    reputation = _score("reputationEvidence")
    combined = ~official & ~critical & (
        ((ai >= 45) & (keyword >= 75) & (structure >= 25))
        | ((ai >= 50) & (keyword >= 40) & (structure >= 60)))
    summary = F.array_join(F.transform("top_signals", lambda s: F.concat(
        s["name"], F.lit("="), s["score"].cast("string"))), ", ")
    steps = [
        (critical, lambda s: F.greatest(s, c("critical_score")),
         F.format_string(M.OVERRIDE_CRITICAL, summary, c("critical_score"))),
        (reputation > 0, lambda s: F.greatest(s, reputation), F.format_string(M.OVERRIDE_REPUTATION, reputation)),
        (combined, lambda s: F.greatest(s, F.lit(45)), F.lit(M.OVERRIDE_COMBINED)),
        (official & ~critical, lambda s: F.least(s, F.lit(10)), F.lit(M.OVERRIDE_OFFICIAL)),
        (c("shared_provider").isNotNull() & ~critical, lambda s: F.greatest(s, F.lit(20)),
         F.lit(M.OVERRIDE_SHARED)),
    ]
    rows = rows.withColumn("_s0", c("rounded_score"))
    notes = []
    for i, (test, change, note) in enumerate(steps):
        before, after = c(f"_s{i}"), f"_s{i + 1}"
        rows = rows.withColumn(after, F.when(test, change(before)).otherwise(before))
        notes.append(F.when(c(after) != before, note))
    rows = rows.withColumn("overrides", F.array_compact(F.array(*notes)))
    return rows.withColumn("risk_score", clamp(c(f"_s{len(steps)}"), 0, 100)).drop(
        *[f"_s{i}" for i in range(len(steps) + 1)])


def band_column(score: Column, field: int) -> Column:
    """Band key (0), label (1) or decision (2) of a score."""
    column = None
    for band in reversed(C.RISK_BANDS[1:]):
        column = F.when(score >= band[3], band[field]) if column is None else column.when(score >= band[3], band[field])
    return column.otherwise(C.RISK_BANDS[0][field])


def risk_band(rows: DataFrame, score: str = "risk_score") -> DataFrame:
    s = c(score)
    return rows.withColumns({
        "safety_score": 100 - s, "result": band_column(s, 1), "decision": band_column(s, 2),
        "prediction": (s >= 45).cast("int")})


def recommendations(band_key: Column) -> Column:
    column = None
    for key, texts in M.RECOMMENDATIONS.items():
        lines = F.array(*[F.lit(t) for t in texts])
        column = F.when(band_key == key, lines) if column is None else column.when(band_key == key, lines)
    return column


def _indicator_fields(order: int, name: str, weight: int) -> dict[str, Column]:
    score = _score(name)
    return {
        "name": F.lit(name), "ord": F.lit(order), "score": score, "risk_points": score,
        "safety_score": 100 - score, "status": c(f"{name}_status"), "explanation": c(f"{name}_explanation"),
        "value": c(f"{name}_value"), "weight_percent": F.lit(weight), "contribution": score * weight / 100,
        "used_in_final_score": F.lit(weight > 0),
    }


def indicator_array() -> Column:
    return F.array(*[
        F.struct(*[col.alias(field) for field, col in _indicator_fields(i, name, weight).items()])
        for i, (name, weight, _, _) in enumerate(C.INDICATORS)])


def explanations(indicators: Column) -> Column:
    texts = F.transform(F.filter(indicators, lambda i: i["status"].isin("warning", "danger")),
                        lambda i: i["explanation"])
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(M.NO_EXPLANATION)))


def score_audit() -> Column:
    weights = [F.lit(x) for item in C.INDICATOR_WEIGHTS.items() for x in item]
    return F.struct(
        F.create_map(*weights).alias("indicator_weights"),
        F.lit(sum(C.INDICATOR_WEIGHTS.values())).alias("indicator_weight_total_percent"),
        c("weighted_score").alias("weighted_score_before_overrides"),
        c("rounded_score").alias("rounded_weighted_score"),
        c("risk_score").alias("final_risk_score"),
        F.bround(c("rounded_score") - c("weighted_score"), 2).alias("rounding_adjustment_points"),
        (c("risk_score") - c("rounded_score")).alias("override_adjustment_points"),
        c("overrides").alias("applied_overrides"),
        c("critical_score").alias("critical_evidence_score"),
        F.when(c("critical"), c("top_signals")).alias("critical_top_signals"))


def add_score(rows: DataFrame) -> DataFrame:
    """Every scoring step over rows that carry the nine indicator structs."""
    for step in (clean_correction, add_ai_value, weighted_score, critical_rules, top_signals, override_chain, risk_band):
        rows = step(rows)
    return rows.withColumn("indicators", indicator_array())


def response(rows: DataFrame, *keys: str) -> DataFrame:
    """The scored record a caller receives."""
    band = band_column(c("risk_score"), 0)
    weight = C.INDICATOR_WEIGHTS["aiModelProbability"]
    shares = {
        "ai_phishing_probability": "effective_probability", "raw_ai_phishing_probability": "raw_probability",
        "feature_ai_probability": "lexical_probability", "calibrated_ai_phishing_probability": "calibrated_probability",
    }
    return rows.select(
        *keys, "url", "prediction", "decision", "result", "risk_score", "safety_score",
        c("critical").alias("critical_phishing"), "critical_reasons",
        half_even(c("confidence") * 100, 2).alias("confidence"),
        *[half_even(c(column), 4).alias(name) for name, column in shares.items()],
        *[half_even(c(column) * 100, 2).alias(f"{name}_percent") for name, column in shares.items()],
        "ai_score", F.lit(weight).alias("ai_weight_percent"),
        (c("ai_score") * weight / 100).alias("ai_weighted_contribution_points"),
        c("is_official").alias("official_domain"), "official_brand",
        c("official_domain").alias("official_matched_domain"), skeleton(c("domain")).alias("domain_skeleton"),
        c("reputation").alias("reputation_evidence"), score_audit().alias("score_audit"),
        explanations(c("indicators")).alias("explanations"), "indicators",
        recommendations(band).alias("recommendations"))


def indicators_long(scored: DataFrame, *keys: str) -> DataFrame:
    """One row per URL and indicator."""
    sets = [_indicator_fields(i, name, weight) for i, (name, weight, _, _) in enumerate(C.INDICATORS)]
    cells = [col for fields in sets for col in fields.values()]
    return scored.select(*keys, F.stack(F.lit(len(sets)), *cells).alias(*sets[0]))


def scoring_config(spark: SparkSession) -> DataFrame:
    """Indicator definitions and weights."""
    return values(spark, {
        "ord": "int", "name": "string", "label": "string", "method": "string", "weight_percent": "int",
        "used_in_final_score": "boolean", "scoring_mode": "string"},
        [(i, n, label, method, w, w > 0, "weighted" if w else "rule_override")
         for i, (n, w, label, method) in enumerate(C.INDICATORS)])


def risk_levels(spark: SparkSession) -> DataFrame:
    return values(spark, {"band": "string", "label": "string", "decision": "string",
                          "minimum": "int", "maximum": "int"}, list(C.RISK_BANDS))


def verified_official(scored: DataFrame) -> DataFrame:
    """Scored URLs whose host is official and whose official-domain indicator is safe."""
    return scored.filter((F.col("officialDomain_status") == "safe") & F.col("is_official"))

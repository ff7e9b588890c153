"""Readable evidence lines and guidance for a scored URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions import url as U

c = F.col

# --- Fixed values: two-label suffixes used when a registry entry is displayed.
DISPLAY_SUFFIXES = (
    "com.my edu.my gov.my org.my net.my co.uk org.uk ac.uk com.au net.au org.au co.jp ne.jp co.id or.id "
    "com.sg com.br"
).split()


def _field(name: str, *paths: str) -> Column:
    """First filled field of an indicator's JSON value."""
    value = c(f"{name}_value")
    found = [F.get_json_object(value, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def _line(template: str, value: Column) -> Column:
    """A line, or null when the value is absent."""
    return F.when(value.isNotNull(), F.format_string(template, value))


def _or(lines: list[Column], fallback: Column) -> Column:
    kept = F.array_compact(F.array(*lines))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(fallback))


def _points(name: str, template: str) -> Column:
    return F.format_string(template, c(f"{name}_score"))


def _listed(name: str) -> Column:
    """A JSON list value; the text of an empty finding gives null."""
    return F.when(c(f"{name}_value").startswith("["), F.from_json(c(f"{name}_value"), "array<string>"))


def _official() -> Column:
    n = "officialDomain"
    entry = _field(n, "matched_domain", "matched_official", "matched_official_source")
    shown = U.root_domain(F.regexp_replace(F.lower(F.trim(entry)), r"^www\.", ""), DISPLAY_SUFFIXES)
    return _or([
        _line("Protected brand: %s.", _field(n, "brand", "matched_brand")),
        _line("User-entered domain: %s.", _field(n, "domain")),
        _line("Official reference root: %s.", shown),
        F.when(entry != shown, F.format_string("Official registry reference: %s.", entry)),
        _line("Protected official parent domain: %s.", _field(n, "protected_parent_domain")),
        _line("Protected brand token: %s.", _field(n, "matched_term", "matched_token")),
    ], _points(n, "Official-domain registry risk points: %d/100."))


def _percent(path: str) -> Column:
    return _field("aiModelProbability", path).try_cast("double")


def _ai() -> Column:
    n = "aiModelProbability"
    # After the clean-official correction the adjusted score is zero.
    return _or([
        _line("Calibrated AI-assisted probability: %.2f%%.", _percent("calibrated_phishing_probability_percent")),
        _line("Raw model probability: %.2f%%.", _percent("raw_phishing_probability_percent")),
        _line("URL lexical-evidence probability: %.2f%%.", _percent("feature_ai_probability_percent")),
        F.format_string("Adjusted AI risk score: %d/100.", c(f"{n}_score")),
    ], _points(n, "AI-assisted risk points: %d/100."))


def _brand() -> Column:
    n = "brandVerification"
    return F.array_compact(F.array(
        _line("Protected brand evidence: %s.", _field(n, "brand", "matched_brand")),
        _line("User-entered domain: %s.", _field(n, "domain", "root_domain")),
        _line("Protected brand token: %s.", _field(n, "matched_term", "matched_token")),
        _points(n, "Brand-impersonation risk points: %d/100.")))


def _homograph() -> Column:
    n = "homographAttack"
    official = _field(n, "matched_official", "matched_official_source")
    return F.array_compact(F.array(
        _line("Protected brand evidence: %s.", _field(n, "brand", "matched_brand")),
        _line("User-entered domain: %s.", _field(n, "domain", "root_domain")),
        _line("Official reference root: %s.", U.root_domain(official, DISPLAY_SUFFIXES)),
        _line("Similarity token: %s.", _field(n, "matched_term", "matched_token")),
        _points(n, "Homograph and typosquatting risk points: %d/100.")))


def _structure() -> Column:
    n = "urlStructure"
    reasons = F.coalesce(_listed(n), F.array().cast("array<string>"))
    return F.concat(F.array(_points(n, "URL structure risk points: %d/100.")), F.transform(
        reasons, lambda r: F.concat(F.lit("Structure evidence: "), r, F.lit("."))))


def _keywords() -> Column:
    n = "suspiciousKeywords"
    words = _listed(n)
    return F.array(
        _points(n, "Suspicious keyword risk points: %d/100."),
        F.when(words.isNotNull(), F.format_string("Detected keyword tokens: %s.", F.array_join(words, ", ")))
        .otherwise("Detected keyword token count: 0."))


def _https() -> Column:
    n = "httpsUsage"
    return F.array_compact(F.array(
        _line("Submitted URL scheme: %s.", F.upper(_field(n, "submitted_scheme"))),
        F.lit("TLS certificate validation scope: URL-scheme analysis."),
        _points(n, "HTTPS usage risk points: %d/100.")))


def _length() -> Column:
    n = "urlLengthComplexity"
    return F.array_compact(F.array(
        _line("URL length: %s characters.", _field(n, "length")),
        _line("Special-character count: %s.", _field(n, "special_characters")),
        _points(n, "URL length and complexity risk points: %d/100.")))


def _reputation() -> Column:
    rep = c("reputation")
    sources, context = F.array_join(rep["sources"], ", "), F.array_join(rep["context_sources"], ", ")
    matched = F.array_compact(F.array(
        F.format_string("Offline reputation match type: %s.", F.coalesce(rep["match_type"], F.lit("recorded evidence"))),
        F.when(sources != "", F.format_string("Offline reputation sources: %s.", sources)),
        F.format_string("Offline reputation evidence score: %d/100.", rep["score"])))
    in_context = F.array_compact(F.array(
        F.lit("Offline reputation context: root-domain historical record."),
        F.when(context != "", F.format_string("Offline reputation context sources: %s.", context))))
    return F.when(rep["match"], matched).when(rep["context_match"], in_context).otherwise(
        F.array(F.lit("Offline reputation match count: 0.")))


STATEMENTS = {
    "officialDomain": _official, "reputationEvidence": _reputation, "aiModelProbability": _ai,
    "brandVerification": _brand, "homographAttack": _homograph, "urlStructure": _structure,
    "suspiciousKeywords": _keywords, "httpsUsage": _https, "urlLengthComplexity": _length,
}


def evidence_statements(scored: DataFrame, *keys: str) -> DataFrame:
    """One row per URL, indicator and evidence line."""
    made = scored.select(*keys, *[make().alias(n) for n, make in STATEMENTS.items()])
    sets = F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("lines")) for n in STATEMENTS])
    return made.select(*keys, F.inline(sets)).select(
        *keys, "name", F.posexplode("lines").alias("position", "line"))


def action_guidance() -> Column:
    """Guidance lines by official match, band and critical flag."""
    entry = _field("officialDomain", "matched_domain", "matched_official")
    verified = c("is_official") & (c("officialDomain_status") == "safe")
    head = F.format_string("Final risk score: %d/100.", c("risk_score"))
    confirm = F.lit("Service access path: confirm the provider domain through an official channel.")
    high = F.array_compact(F.array(
        head, F.lit("Service access path: use the verified official domain from the provider's official channel."),
        F.when(c("critical"), F.lit("Critical-rule evidence: recorded in the detailed calculation section."))))
    return (
        F.when(verified, F.array(
            head, F.format_string("Verified official-domain registry entry: %s.", entry),
            F.format_string("Service access path: %s.", entry)))
        .when(c("risk_score") < 20, F.array(
            head, F.lit("Analysis record: Trusted risk band with the displayed indicator evidence."), confirm))
        .when(c("risk_score") < 45, F.array(
            head, F.lit("Analysis record: Low Risk band with the displayed indicator evidence."), confirm))
        .otherwise(high)
    )

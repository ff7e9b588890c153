"""Feature vectors for URL classifiers."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk import constants as C
from urlrisk.functions import url as U
from urlrisk.functions.text import count_char, count_class, count_special, skeleton
from urlrisk.operators.matching import OFFICIAL_KINDS, brand_similarity, brands_inside, host_profile, lure_matches
from urlrisk.operators.urls import prepared_urls
from urlrisk.session import cut
from urlrisk.sources.registry import Registry

c = F.col


def lexical_counts(urls: DataFrame, column: str = "url") -> DataFrame:
    """Lengths and character counts of a URL."""
    u = c(column)
    return urls.withColumns({
        "url_length": F.length(u), "dot_count": count_char(u, "."), "hyphen_count": count_char(u, "-"),
        "at_count": count_char(u, "@"), "question_count": count_char(u, "?"), "equals_count": count_char(u, "="),
        "slash_count": count_char(u, "/"), "digit_count": count_class(u, r"(?U)\d"),
        "special_character_count": count_special(u),
        "ip_address_flag": u.rlike(C.IP_PATTERN).cast("int"),
    })


def _contained(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)))


def features_22(urls: DataFrame, registry: Registry) -> DataFrame:
    """The 22 model features, one column each, by :data:`constants.MODEL_FEATURES`.

    Host facts are found once per distinct host and joined back.
    """
    from urlrisk.plans.score import KEYS, with_lure_text

    rows = with_lure_text(prepared_urls(urls))
    # This vector normalises once more than the rules do.
    rows = rows.withColumn("feature_url", U.normalize_url(c("rule_url")))
    keys = cut(rows.select(*KEYS).distinct(), "feature-keys")
    hosts = keys.select("domain").distinct()
    profile = cut(host_profile(hosts, registry, OFFICIAL_KINDS).select("domain", "is_official"), "feature-official")
    similar = brand_similarity(hosts, registry, profile)
    lures = lure_matches(keys.filter("lure_text <> ''").select("lure_text").distinct(), registry)
    facts = cut(
        keys.join(profile, "domain", "left").join(similar, "domain", "left").join(lures, "lure_text", "left"),
        "feature-facts")
    lower = F.lower("feature_url")
    inside = cut(brands_inside(rows.select(lower.alias("text")), registry), "brands-inside")
    rows = lexical_counts(rows.join(facts, KEYS, "left"), "feature_url").join(inside, lower == c("text"), "left")
    return rows.withColumns({
        "uses_https": lower.startswith("https://").cast("int"),
        "netloc_length": F.length("netloc"),
        "path_length": F.length("path"),
        "suspicious_keyword_count": _contained(lower, C.KEYWORDS),
        "brand_literal_count": F.coalesce("brand_literals", F.lit(0)).cast("int"),
        "brand_confusable_count": F.coalesce("brand_skeletons", F.lit(0)).cast("int"),
        "official_domain_flag": F.coalesce("is_official", F.lit(False)).cast("int"),
        "domain_lookalike_flag": c("lookalike"),
        "minimum_brand_distance": c("min_distance"),
        "maximum_brand_similarity": c("max_similarity"),
        "shortener_domain_flag": c("shortener").cast("int"),
        "shortener_brand_path_flag": (c("shortener") & c("lure_hit").isNotNull()).cast("int"),
    }).select(*urls.columns, *C.MODEL_FEATURES)


def features_5(urls: DataFrame, column: str = "url") -> DataFrame:
    lower = F.lower(column)
    return urls.withColumns({
        "url_length": F.length(column), "uses_https": lower.startswith("https://").cast("int"),
        "dot_count": count_char(lower, "."), "hyphen_count": count_char(lower, "-"),
        "keyword_count": _contained(lower, C.SHORT_KEYWORDS)})


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of a short text."""
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    counts = F.transform(F.array_distinct(chars), lambda ch: F.size(F.filter(chars, lambda x: x == ch)))
    n = F.size(chars)
    return F.when(F.length(text) > 0, -F.aggregate(
        counts, F.lit(0.0), lambda total, k: total + (k / n) * F.log2(k / n))).otherwise(0.0)


def sld_entropy(urls: DataFrame) -> DataFrame:
    """Entropy of the second-level label, one row per distinct label."""
    return urls.select("sld").distinct().withColumn("entropy", entropy(c("sld")))


FEATURES_30 = (
    "url_length host_length path_length query_length https dots depth hyphens digits host_digit_ratio "
    "special keywords ip punycode percent at bad_tld sld_entropy long_sld double_slash redirect_query "
    "credential_word confusable confusable_count exact_brand near_brand brand_in_root changed_token "
    "many_tokens com"
).split()


def features_30(urls: DataFrame, column: str = "url") -> DataFrame:
    """Thirty scaled lexical features in [0, 1]; all JVM expressions over one row."""
    text = F.trim(U.nfkc(F.coalesce(c(column), F.lit(""))))
    url = F.when((text == "") | text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    rows = urls.withColumn("_u", url).withColumns({
        "_scheme": F.lower(U.url_part(c("_u"), 1)), "_path": U.url_path(c("_u")), "_query": U.url_part(c("_u"), 4),
        "_host": F.btrim(F.substring_index(F.substring_index(
            F.lower(U.url_part(c("_u"), 2)), "@", -1), ":", 1), F.lit(".")),
    })
    parts = F.filter(F.split("_host", r"\."), lambda p: p != "")
    last_two = F.array_join(F.slice(parts, -2, 2), ".")
    root = F.when(F.size(parts) <= 2, c("_host")).when(
        last_two.isin(C.LEXICAL_TWO_LEVEL), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(last_two)
    rows = rows.withColumn("_labels", parts).withColumn("_root", root).withColumn(
        "_sld", F.coalesce(F.get(F.filter(F.split("_root", r"\."), lambda p: p != ""), F.lit(0)), F.lit("")))
    rows = rows.withColumns({
        "_skel": skeleton(c("_sld")), "_root_skel": skeleton(c("_root")),
        "_words": F.lower(F.concat_ws(" ", "_host", "_path", "_query")),
        "_tokens": F.filter(F.split("_sld", "[^a-z0-9]+"), lambda t: F.length(t) >= 3)})
    rows = rows.withColumns({
        "_words_skel": skeleton(c("_words")), "_token_skels": F.transform("_tokens", skeleton)})
    brands = F.array(*[F.lit(b) for b in C.LEXICAL_BRANDS])
    terms = F.array(*[F.when(c("_words").contains(t) | c("_words_skel").contains(skeleton(F.lit(t))), F.lit(t))
                      for t in C.LEXICAL_TERMS])
    u, host, query, sld = c("_u"), c("_host"), c("_query"), c("_sld")
    number = lambda x: x.cast("double")
    capped = lambda x, top: F.least(number(x), F.lit(float(top))) / float(top)
    any_of = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
    marker = count_class(host, C.CONFUSABLE_MARKER)
    features = [
        capped(F.length(u), 300), capped(F.length(host), 120), capped(F.length("_path"), 220),
        capped(F.length(query), 220), number(c("_scheme") == "https"), capped(count_char(host, "."), 8),
        capped(F.greatest(F.size("_labels") - 2, F.lit(0)), 8), capped(count_char(host, "-"), 8),
        capped(count_class(u, r"(?U)\d"), 30),
        F.least(count_class(host, r"(?U)\d") / F.greatest(F.lit(1), F.length(host)), F.lit(1.0)),
        capped(count_class(u, r"(?U)[^\p{L}\p{N}]"), 45),
        capped(F.size(F.array_compact(terms)), 8),
        number(host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")), number(host.contains("xn--")),
        number(c("_path").contains("%") | query.contains("%")), number(u.contains("@")),
        number(U.tld(host).isin(C.LEXICAL_BAD_TLDS)), capped(entropy(sld), 5), number(F.length(sld) >= 20),
        number(c("_path").contains("//")), number(any_of(F.lower(query), C.REDIRECT_QUERY_WORDS)),
        number(any_of(c("_words"), C.CREDENTIAL_WORDS)), number(marker > 0), capped(marker, 10),
        number(F.arrays_overlap("_token_skels", brands)),
        number((F.length("_skel") >= 4) & F.exists(brands, lambda b: F.levenshtein(c("_skel"), b) <= 1)),
        number(any_of(c("_root_skel"), C.LEXICAL_BRANDS)),
        number(c("_tokens") != c("_token_skels")), number(F.size("_tokens") >= 2),
        number(host.endswith(".com") | host.endswith(".com.my")),
    ]
    return rows.select(*urls.columns, *[f.alias(n) for f, n in zip(features, FEATURES_30, strict=True)])


def numeric_columns_only(rows: DataFrame, label: str) -> DataFrame:
    """Numeric columns of a wide table, label last."""
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != label]
    return rows.select(*names, label)


def assembled(rows: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="skip").transform(rows)


def ngram_pipeline(char_bits: int = 20, word_bits: int = 18) -> Pipeline:
    """Hashed character 2–6-grams and word 1–2-grams, each L2-normalised, joined with the 30 features.

    Expects ``normal_url`` and the columns of :func:`features_30`.
    """
    stages = [RegexTokenizer(inputCol="normal_url", outputCol="chars", pattern="", gaps=True, minTokenLength=1)]
    for n in range(2, 7):
        stages.append(NGram(n=n, inputCol="chars", outputCol=f"c{n}"))
    stages += [
        HashingTF(inputCol="char_grams", outputCol="char_tf", numFeatures=2 ** char_bits),
        Normalizer(inputCol="char_tf", outputCol="char_vec", p=2.0),
        RegexTokenizer(inputCol="normal_url", outputCol="words", pattern="[a-z0-9]{2,}", gaps=False),
        NGram(n=2, inputCol="words", outputCol="w2"),
        HashingTF(inputCol="word_grams", outputCol="word_tf", numFeatures=2 ** word_bits),
        Normalizer(inputCol="word_tf", outputCol="word_vec", p=2.0),
        VectorAssembler(inputCols=["char_vec", "word_vec", *FEATURES_30], outputCol="features"),
    ]
    from pyspark.ml.feature import SQLTransformer

    chars = " , ".join(f"c{n}" for n in range(2, 7))
    stages.insert(6, SQLTransformer(statement=f"SELECT *, concat({chars}) AS char_grams FROM __THIS__"))
    at = next(i for i, s in enumerate(stages) if isinstance(s, HashingTF) and s.getInputCol() == "word_grams")
    stages.insert(at, SQLTransformer(statement="SELECT *, concat(words, w2) AS word_grams FROM __THIS__"))
    return Pipeline(stages=stages)


def ngram_tokens(urls: DataFrame, column: str = "url") -> DataFrame:
    """How many n-grams and words of each URL enter the hashed vector."""
    lexical = features_30(urls, column).withColumn("normal_url", U.normalize_url(c(column)))
    made = ngram_pipeline(10, 10).fit(lexical).transform(lexical)
    return made.select(*urls.columns, F.size("char_grams").alias("char_grams"), F.size("words").alias("words"),
                       F.size("word_grams").alias("word_grams"))


def hashed_ngrams(urls: DataFrame, column: str = "url", char_bits: int = 20, word_bits: int = 18) -> DataFrame:
    """Sparse vectors of :func:`ngram_pipeline`; nothing is fitted, so the model is a pure map."""
    lexical = features_30(urls, column).withColumn("normal_url", U.normalize_url(c(column)))
    model: PipelineModel = ngram_pipeline(char_bits, word_bits).fit(lexical)
    return model.transform(lexical).select(*urls.columns, "features")

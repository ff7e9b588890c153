"""Training-row generation, model fitting and batch prediction."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.operators import extra_trees, sgd
from urlrisk.operators.extra_trees import ExtraTrees
from urlrisk.operators.features import FEATURES_30, assembled

c = F.col

# --- Fixed values: templates of generated training rows (%1$s brand, %2$s term, %3$s TLD).
BRAND_TEMPLATES = (
    "http://%1$s-%2$s-security.%3$s", "https://%1$s-%2$s-account.%3$s",
    "https://secure-%1$s-%2$s.%3$s/login", "https://%1$s.com.%2$s.security.%3$s/account",
)
LURE_TERMS = "login verify secure security account update payment confirm password reset locked support".split()
LURE_TLDS = "com net xyz top click info ru tk work loan".split()
LOOKALIKE_TEMPLATES = (
    "https://www.%1$s.com", "http://%1$s-login-security.com", "https://%1$s-account-verify.click/login",
)
TOKEN_TEMPLATES = (
    "https://%1$s.com", "https://www.%1$s.com/login", "https://secure-%1$s.com/account",
    "http://%1$s-login-security.com", "https://%1$s-account-verify.click/login",
    "https://%1$s.com.verify.security.xyz/account", "https://%2$s.com@%1$s-login-security.com/verify",
)
SHORTENER_TEMPLATES = (
    "https://%2$s/go/%1$s", "https://%2$s/%1$s-login", "https://%2$s/redirect/%1$s/verify",
    "https://%2$s/?to=%1$s-secure",
)
# Generated rows use the first fourteen shorteners only.
TRAINING_SHORTENERS = C.SHORTENERS[:14]
SAFE_PATHS = ("/", "/help", "/settings", "/account")
SAFE_WEIGHT, PHISHING_WEIGHT, REGRESSION_WEIGHT = 8.0, 30.0, 20.0


def obfuscate_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Six written forms of each URL that all normalise to the same one."""
    u = c(column)
    # Only the first separator takes a full-width colon.
    wide = F.concat(F.substring_index(u, "://", 1), F.lit("：//"), F.expr(
        f"substring({column}, locate('://', {column}) + 3)"))
    wide = F.when(u.contains("://"), wide).otherwise(u)
    forms = F.array(u, F.concat(F.lit("."), u), wide, F.concat(F.lit("."), wide),
                    F.concat(F.lit("https://"), u), F.concat(F.lit("https://."), u))
    return urls.select("*", F.posexplode(forms).alias("variant", "variant_url"))


def _filled(templates, *values) -> Column:
    return F.array(*[F.format_string(t, *values) for t in templates])


def labelled_rows(urls: DataFrame, label: int, weight: float) -> DataFrame:
    source = "synthetic_phishing" if label else "synthetic_safe"
    return urls.select("url", F.lit(label).alias("label"), F.lit(source).alias("source"),
                       F.lit(weight).alias("sample_weight"))


def safe_cases(domains: DataFrame) -> DataFrame:
    """Four ordinary pages of every trusted domain."""
    paths = F.array(*[F.lit(p) for p in SAFE_PATHS])
    return labelled_rows(domains.select(F.explode(F.transform(paths, lambda p: F.concat(
        F.lit("https://"), c("domain"), p))).alias("url")), 0, SAFE_WEIGHT)


def brand_cases(brands: DataFrame) -> DataFrame:
    """Every brand with every lure term in four forms; the TLD rotates with term and brand length.

    Terms are an array literal, so rows are generated in place without a join.
    """
    terms = F.array(*[F.lit(t) for t in LURE_TERMS])
    tlds = F.array(*[F.lit(t) for t in LURE_TLDS])
    each = brands.select("brand", F.posexplode(terms).alias("i", "term"))
    each = each.withColumn("tld", F.get(tlds, F.pmod(c("i") + F.length("brand"), F.lit(len(LURE_TLDS)))))
    return labelled_rows(each.select(F.explode(_filled(BRAND_TEMPLATES, "brand", "term", "tld")).alias("url")),
                 1, PHISHING_WEIGHT)


def lookalike_cases(fakes: DataFrame) -> DataFrame:
    """Three phishing forms of every look-alike name (``fake``)."""
    return labelled_rows(fakes.select(F.explode(_filled(LOOKALIKE_TEMPLATES, "fake")).alias("url")), 1, PHISHING_WEIGHT)


def token_cases(tokens: DataFrame) -> DataFrame:
    """Seven phishing forms of every (brand, token), and four on every link shortener."""
    shorteners = F.array(*[F.lit(s) for s in TRAINING_SHORTENERS])
    hosts = tokens.select(F.explode(_filled(TOKEN_TEMPLATES, "token", "brand")).alias("url"))
    links = tokens.select("token", F.explode(shorteners).alias("shortener")).select(
        F.explode(_filled(SHORTENER_TEMPLATES, "token", "shortener")).alias("url"))
    return labelled_rows(hosts.unionByName(links), 1, PHISHING_WEIGHT)


def lure_path_cases(paths: DataFrame) -> DataFrame:
    """Every lure path (``path``) on every shortener, in six written forms."""
    shorteners = F.array(*[F.lit(s) for s in TRAINING_SHORTENERS])
    links = paths.select(F.explode(F.transform(shorteners, lambda s: F.concat(
        F.lit("https://"), s, F.lit("/"), c("path")))).alias("url"))
    return labelled_rows(obfuscate_urls(links).select(c("variant_url").alias("url")), 1, PHISHING_WEIGHT)


def ip_cases(blocks: DataFrame) -> DataFrame:
    """Three forms of every three-octet block (``block``, ``idx``)."""
    at = lambda base: (c("idx") + base).cast("string")
    forms = F.array(
        F.format_string("http://%s.%s/login", "block", at(10)),
        F.format_string("http://%s.%s/verify/account", "block", at(20)),
        F.format_string("http://%s.%s/payment?session=%dabc", "block", at(30), "idx"))
    return labelled_rows(blocks.select(F.explode(forms).alias("url")), 1, PHISHING_WEIGHT)


def augment_cases(domains: DataFrame, brands: DataFrame, tokens: DataFrame, fakes: DataFrame,
                  paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """All generated rows, safe and phishing."""
    return (safe_cases(domains).unionByName(brand_cases(brands)).unionByName(token_cases(tokens))
            .unionByName(lookalike_cases(fakes)).unionByName(lure_path_cases(paths)).unionByName(ip_cases(blocks)))


def _forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", seed=42, cacheNodeIds=True, **params)


def train_tree_ensemble(rows: DataFrame, names: list[str], trees: int = 180, depth: int = 24, key: str = "url") -> ExtraTrees:
    """Class-weighted extremely randomised trees over rows with a unique ``key``."""
    return extra_trees.fit(rows, names, key, trees, depth, least=2, sample=0.75)


def train_random_forest(rows: DataFrame, names: list[str], trees: int = 300, depth: int = 20):
    """A forest over rows that are dealt to all tasks: each row works for every tree, and its bytes would fill few tasks."""
    dealt = assembled(rows, names).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return _forest(numTrees=trees, maxDepth=depth).fit(dealt)


#: Buckets of the hashed n-grams and the lexical features behind them.
CHAR_BITS, WORD_BITS = 20, 18


def hashed_settings(char_bits: int = CHAR_BITS, word_bits: int = WORD_BITS) -> sgd.Settings:
    return sgd.Settings((1 << char_bits) + (1 << word_bits) + len(FEATURES_30))


def train_hashed_logistic(rows: DataFrame, settings: sgd.Settings | None = None, start: sgd.SgdModel | None = None) -> sgd.SgdModel:
    """One round of averaged elastic-net SGD over sparse n-gram vectors, from ``start`` or from nothing."""
    weight = "sample_weight" if "sample_weight" in rows.columns else None
    return sgd.fit([rows], settings or hashed_settings(), start, weight=weight)


def batch_predict(model, rows: DataFrame) -> DataFrame:
    """Probability of class 1, its confidence, and the 0.5 decision; one narrow pass.

    Extra-trees read their feature columns, the other models the vector ``features``.
    """
    if isinstance(model, (ExtraTrees, sgd.SgdModel)):
        p = c("raw_probability")
        return model.votes(rows).withColumns({"confidence": F.greatest(p, 1 - p), "prediction": (p >= 0.5).cast("int")})
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return scored.withColumns({
        "raw_probability": F.get("_p", F.lit(1)), "confidence": F.array_max("_p"),
        "prediction": (F.get("_p", F.lit(1)) >= 0.5).cast("int"),
    }).drop("_p", "probability", "rawPrediction")

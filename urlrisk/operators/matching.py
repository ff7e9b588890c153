"""Host and path matching against the registry.

All host rules run over distinct hosts.  A host is exploded into lookup keys, the
keys meet the registry in one equi-join, candidates are verified, and one
aggregation per host keeps the first match of every rule.  No pair of names is
compared unless the two share a key, and the keys miss no match (see
``functions.similarity``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.functions import similarity as S
from urlrisk.functions import url as U
from urlrisk.functions.text import has_marker, skeleton
from urlrisk.operators.nearest_terms import nearest_terms
from urlrisk.session import materialize
from urlrisk.sources.registry import Registry

NEAR_RATIO = 0.90
PATH_RATIO = 0.88
#: Texts of a task that makes keys of them.
TASK_TEXTS = 2048


def is_shortener(domain: Column) -> Column:
    """Every shortener has two labels, so the last two labels decide."""
    return F.substring_index(domain, ".", -2).isin(C.SHORTENERS)


ALL_KINDS = ("suffix", "hosting", "skeleton", "token", "substring", "typo", "typo3", "label", "label3")
# Enough for the official-domain verdict.
OFFICIAL_KINDS = ("suffix", "hosting", "label", "label3")


def _keys(kind: str, keys: Column, pos: Column | None = None) -> Column:
    at = F.lit(0) if pos is None else pos
    return F.transform(keys, lambda k: F.struct(
        F.lit(kind).alias("kind"), k.alias("key"), at.cast("int").alias("pos")))


def _sld(domain: Column) -> Column:
    return U.sld(U.root_domain(domain))


def _tokens(sld: Column) -> Column:
    return F.filter(F.split(sld, "[^a-z0-9]+"), lambda t: F.length(t) >= 4)


def host_keys(hosts: DataFrame, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Explode every host into the keys of its rules: (domain, kind, key, pos).

    Rows stay narrow; what else a rule needs follows from the host and is computed
    for the few rows that meet the registry.
    """
    c = F.col
    base = hosts.select("domain").withColumns({
        "host_skel": skeleton(c("domain")), "parts": U.labels(c("domain")), "sld": _sld(c("domain"))})
    # Only labels left of the last two can stand in front of an official domain.
    inner = F.filter(
        F.transform(F.slice("parts", 1, F.greatest(F.size("parts") - 2, F.lit(0))),
                    lambda t, i: F.struct(i.alias("pos"), F.length(t).alias("size"), skeleton(t).alias("skel"))),
        lambda s: s["size"] >= 4)
    base = base.withColumns({
        "sld_skel": skeleton(c("sld")), "inner": inner,
        "suffixes": U.suffixes(c("domain")), "skel_suffixes": U.suffixes(c("host_skel"))})
    made = {
        "suffix": _keys("suffix", c("suffixes")),
        "hosting": _keys("hosting", c("suffixes")),
        "skeleton": _keys("skeleton", c("skel_suffixes")),
        "token": F.transform(_tokens(c("sld")), lambda t, i: F.struct(
            F.lit("token").alias("kind"), skeleton(t).alias("key"), i.cast("int").alias("pos"))),
        "substring": _keys("substring", S.grams(c("host_skel"), 4)),
        "typo": _keys("typo", S.short_keys(c("sld_skel"))),
        "typo3": _keys("typo3", S.long_keys(c("sld_skel"))),
        "label": F.flatten(F.transform("inner", lambda s: _keys("label", S.short_keys(s["skel"]), s["pos"]))),
        "label3": F.flatten(F.transform("inner", lambda s: _keys("label3", S.long_keys(s["skel"]), s["pos"]))),
    }
    return base.select("domain", F.inline(F.concat(*[made[k] for k in kinds])))


def host_candidates(hosts: DataFrame, registry: Registry, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Verified (host, registry fact) matches of every rule."""
    c = F.col
    pairs = host_keys(hosts, kinds).join(registry.host_keys, ["kind", "key"])
    fuzzy = c("kind").isin("typo", "typo3", "label", "label3")
    parts = U.labels(c("domain"))
    text = F.when(c("kind") == "token", F.get(_tokens(_sld(c("domain"))), c("pos"))).when(
        c("kind").startswith("label"), F.get(parts, c("pos")))
    pairs = pairs.withColumns({
        "host_root": U.root_domain(c("domain")), "host_labels": F.size(parts), "text": text})
    pairs = pairs.withColumn(
        "skel", F.when(c("kind") == "substring", skeleton(c("domain")))
        .when(c("kind").startswith("typo"), skeleton(_sld(c("domain"))))
        .when(c("kind").startswith("label"), skeleton(c("text"))))
    total = F.length("skel") + F.length("ref")
    # ratio >= 0.9 allows at most 0.1 * total unmatched letters, so at most that many edits.
    reach = F.greatest(F.lit(1), F.floor(total * (1 - NEAR_RATIO) + 1e-9)).cast("int")
    pairs = pairs.filter(
        F.when(c("kind") == "substring", c("skel").contains(c("ref")))
        .when(c("kind").startswith("label"), ~F.array_contains("approved", c("text")))
        .otherwise(True)
    ).withColumn("distance", F.when(fuzzy, F.levenshtein("skel", "ref")))
    pairs = pairs.filter(~fuzzy | (c("distance") <= reach))
    pairs = pairs.withColumn("ratio", S.ratio(
        F.when(fuzzy, c("skel")), F.when(fuzzy, c("ref"))))
    near = (c("distance") == 1) | (c("ratio") >= NEAR_RATIO)
    label = (
        (c("distance") == 0)
        | (has_marker(c("text")) & ((c("distance") <= 1) | (c("ratio") >= NEAR_RATIO)))
        | ((F.length("ref") >= 5) & (c("distance") == 1) & (c("ratio") >= 0.80))
    )
    return pairs.filter(
        F.when(c("kind").startswith("typo"), near & (c("root") != c("host_root")))
        .when(c("kind").startswith("label"), label)
        .otherwise(True)
    )


def _first(condition: Column, **fields: Column) -> Column:
    """First row under a condition, ordered by the fields from left to right."""
    return F.min(F.when(condition, F.struct(*[col.alias(name) for name, col in fields.items()])))


def host_profile(hosts: DataFrame, registry: Registry, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """One row per host that matches any rule; hosts without matches are absent.

    Input rows must be distinct on ``domain``.  Fewer ``kinds`` make fewer keys.
    """
    c = F.col
    found = host_candidates(hosts, registry, kinds)
    typo = c("kind").startswith("typo")
    label = c("kind").startswith("label")
    hits = found.groupBy("domain").agg(
        F.max("host_labels").alias("n"),
        F.collect_set(F.when(c("kind") == "suffix", F.struct(
            "brand_ord", c("ref").alias("official"), "brand", "exact_only", "n_labels"))).alias("suffix_hits"),
        F.max(F.when(c("kind") == "hosting", F.struct(F.length("ref").alias("size"), c("ref").alias("provider"))))
        .alias("hosting_hit"),
        _first(c("kind") == "skeleton", brand_ord=c("brand_ord"), official=c("ref"), brand=c("brand"))
        .alias("skeleton_hit"),
        _first(c("kind") == "token", pos=c("pos"), brand_ord=c("brand_ord"), place=c("place"), brand=c("brand"),
               raw_token=c("text"), term=c("ref"), source=c("root")).alias("token_hit"),
        _first(c("kind") == "substring", brand_ord=c("brand_ord"), brand=c("brand")).alias("substring_hit"),
        _first(typo & (c("distance") == 1), brand_ord=c("brand_ord"), official=c("place"), brand=c("brand"),
               root=c("root")).alias("distance_hit"),
        _first(typo, brand_ord=c("brand_ord"), official=c("place"), brand=c("brand"), root=c("root"),
               distance=c("distance"), ratio=c("ratio")).alias("typo_hit"),
        F.size(F.collect_set(F.when(typo, c("brand_ord")))).alias("typo_brands"),
        F.collect_set(F.when(label, F.struct(
            "pos", c("ref").alias("service_skeleton"), c("text").alias("label"),
            F.get("approved", F.lit(0)).alias("service"), "distance", "ratio"))).alias("label_hits"),
    )
    suffix_hits, first_bad = F.array_sort("suffix_hits"), F.array_min(F.transform("label_hits", lambda h: h["pos"]))
    hits = hits.withColumns({"suffix_hits": suffix_hits, "first_bad": F.coalesce(first_bad, F.lit(1_000_000)),
                             "label_hits": F.array_sort("label_hits")})
    hosted = c("hosting_hit").isNotNull()

    def deceptive(hit):
        return c("first_bad") < c("n") - hit["n_labels"]

    accepted = F.filter("suffix_hits", lambda h: (c("domain") == h["official"]) | (
        ~h["exact_only"] & ~deceptive(h)))
    hits = hits.withColumns({
        "official_hit": F.when(~hosted, F.get(accepted, F.lit(0))),
        "subdomain_hit": F.get(F.filter("suffix_hits", deceptive), F.lit(0)),
    })
    bad_labels = F.filter("label_hits", lambda h: h["pos"] < c("n") - c("subdomain_hit.n_labels"))
    # One entry per label: its first protected skeleton.
    bad_labels = F.filter(bad_labels, lambda h, i: (i == 0) | (
        F.get(bad_labels, i - 1)["pos"] != h["pos"]))
    return hits.select(
        "domain",
        c("official_hit").isNotNull().alias("is_official"),
        c("official_hit.brand").alias("official_brand"),
        c("official_hit.official").alias("official_domain"),
        c("hosting_hit.provider").alias("shared_provider"),
        c("subdomain_hit.brand").alias("subdomain_brand"),
        c("subdomain_hit.official").alias("subdomain_parent"),
        F.when(c("subdomain_hit").isNotNull(), bad_labels).alias("suspicious_labels"),
        "token_hit",
        F.when(c("official_hit").isNull(), c("skeleton_hit")).alias("skeleton_hit"),
        "substring_hit", "distance_hit", "typo_hit", "typo_brands",
    )


def dealt(texts: DataFrame, column: str, most: int = TASK_TEXTS) -> DataFrame:
    """The rows, written and dealt by hash to tasks of about ``most`` rows each.

    By its bytes a table of short texts would be put into one task, however many keys are made of each text.
    """
    held = materialize(texts, "texts")
    return held.repartition(max(1, -(-held.count() // most)), column)


def lure_matches(texts: DataFrame, registry: Registry, column: str = "lure_text") -> DataFrame:
    """First brand-like token of each distinct text (path and query of a short link)."""
    c = F.col
    texts = dealt(texts.select(column), column)
    tokens = F.filter(F.split(skeleton(c(column)), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)

    def keys(kind, made):
        return F.transform(made, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    # Terms of nine letters or more share a trigram with every token in reach, so
    # deletion keys serve short terms only and long tokens make none.
    none, token = F.array().cast("array<string>"), c("token")
    split = texts.select(column, F.posexplode(tokens).alias("pos", "token"))
    exploded = split.select(column, "pos", "token", F.inline(F.concat(
        keys("near", F.when(F.length(token) <= 10, S.deletions(token, 2)).otherwise(none)),
        keys("inside", S.grams(token, 4)),
        keys("gram", F.when(F.length(token) >= 7, S.grams(token, 3)).otherwise(none)))))
    size, term_size = F.length("token"), F.length("term")
    pairs = exploded.join(registry.term_keys, ["kind", "key"]).filter(
        F.abs(size - term_size) <= F.greatest(F.lit(2), F.floor(term_size * 0.35).cast("int")))
    same = (c("token") == c("term")) | ((term_size >= 5) & c("token").contains(c("term")))
    limit = F.when(term_size <= 6, 1).otherwise(2)
    reach = F.greatest(limit, F.floor((size + term_size) * (1 - PATH_RATIO) + 1e-9).cast("int"))
    pairs = pairs.withColumn("same", same).withColumn("distance", F.levenshtein("token", "term"))
    pairs = pairs.filter(c("same") | (c("distance") <= reach)).withColumn("ratio", S.ratio("token", "term"))
    pairs = pairs.filter(c("same") | (c("distance") <= limit) | (c("ratio") >= PATH_RATIO))
    hit = F.min(F.struct(
        "pos", "brand_ord", "place", "brand", "token", "term", "source",
        F.when(c("same"), 0).otherwise(c("distance")).alias("distance"),
        F.when(c("same"), 1.0).otherwise(c("ratio")).alias("similarity")))
    return pairs.groupBy(column).agg(hit.alias("lure_hit"))


def brand_similarity(hosts: DataFrame, registry: Registry, profile: DataFrame) -> DataFrame:
    """Per host: look-alike flag, smallest distance (at most 10) and best ratio ×100 to any brand term.

    Distinct second-level labels are searched in the registry's term index, of
    any size, and joined back to their hosts.
    """
    c = F.col
    slds = hosts.select("domain").withColumn("sld", U.sld(U.root_domain(c("domain")))).withColumn(
        "sld_skel", skeleton(c("sld")))
    found = nearest_terms(slds, registry.term_index, NEAR_RATIO, "sld_skel").withColumnRenamed("label", "sld_skel")
    official = profile.filter("is_official").select("domain", F.lit(True).alias("is_official"))
    best = F.when(c("equal"), 1.0).otherwise(c("ratio"))
    return (
        slds.join(found, "sld_skel").join(official, "domain", "left")
        .select(
            "domain",
            (c("is_official").isNull() & (c("near") | (c("equal") & (c("sld") != c("sld_skel")))))
            .cast("int").alias("lookalike"),
            c("distance").alias("min_distance"),
            F.bround(best * 100, 2).alias("max_similarity"),
        )
    )


def brands_inside(texts: DataFrame, registry: Registry, column: str = "text") -> DataFrame:
    """(text, brand_literals, brand_skeletons) per distinct text that holds a brand.

    A brand is met through the letters it begins with, so a text is compared
    only with brands that begin somewhere in it.
    """
    c = F.col
    keys = registry.brand_keys
    sizes = [r[0] for r in keys.select(F.length("key")).distinct().collect()]    # 1 to BRAND_KEY
    text = dealt(texts.select(c(column).alias("text")).where("text IS NOT NULL").distinct(), "text")
    both = text.select("text", F.inline(F.array(
        F.struct(F.lit("literal").alias("kind"), c("text").alias("inside")),
        F.struct(F.lit("skeleton").alias("kind"), skeleton(c("text")).alias("inside")))))
    grams = F.flatten(F.array(*[S.grams(c("inside"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    met = both.select("*", F.explode(grams).alias("key")).join(keys, ["kind", "key"]).where(c("inside").contains(c("name")))
    return met.groupBy("text").agg(F.count_if(c("kind") == "literal").alias("brand_literals"),
                                   F.count_if(c("kind") == "skeleton").alias("brand_skeletons"))


def keyword_hits(target: Column, folded: Column) -> Column:
    """Suspicious keywords in a lower-case text or in its skeleton, in list order.

    A word in the text is also in the skeleton, unless a letter pair that folds
    into one letter reaches across its edge; only such words need both tests.
    """
    def test(word: str) -> Column:
        in_skeleton = folded.contains(skeleton(F.lit(word)))
        return in_skeleton | target.contains(word) if word[0] in "nv" or word[-1] in "rv" else in_skeleton

    return F.array_compact(F.array(*[F.when(test(w), F.lit(w)) for w in C.KEYWORDS]))


def bad_tld_points(tld: Column) -> Column:
    """Risk points of a TLD, null when it is not on the list."""
    pairs = [F.lit(x) for item in C.BAD_TLD_POINTS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), tld)

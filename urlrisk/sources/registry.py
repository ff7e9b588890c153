"""Registry of official domains and the lookup tables derived from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.functions import similarity as S
from urlrisk.functions import url as U
from urlrisk.functions.text import skeleton, values
from urlrisk.operators.nearest_terms import term_index
from urlrisk.session import materialize
from urlrisk.sources.json_store import MISSING, read_store

#: Letters of a brand that its lookup key has; shorter brands are their own key.
BRAND_KEY = 4
# Built-in brands come first, then the brands of a file in the order given.
_FILE_OFFSET = 1_000_000


def brand_lines(text: str) -> list[tuple[str, list[str]]]:
    """Read ``brand: domain domain`` lines."""
    pairs = (line.split(":", 1) for line in text.strip().splitlines())
    return [(brand.strip(), domains.split()) for brand, domains in pairs]


def entries(spark: SparkSession, text: str, offset: int = 0) -> DataFrame:
    """Registry entries (brand, brand_ord, domain) of a literal text."""
    rows = [
        (brand, offset + position, domain)
        for position, (brand, domains) in enumerate(brand_lines(text))
        for domain in domains
    ]
    return values(spark, {"brand": "string", "brand_ord": "bigint", "domain": "string"}, rows)


def clean_entries(raw: DataFrame) -> DataFrame:
    """Trim and lower-case entries; keep only domains with a dot."""
    return raw.filter(F.col("domain").contains(".")).select(
        F.lower(F.trim("brand")).alias("brand"),
        "brand_ord",
        F.ltrim(F.lower(F.trim("domain")), F.lit(".")).alias("domain"),
    )


def merge_entries(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Set union per brand; a brand keeps the position of its first mention."""
    merged = first
    for other in others:
        merged = merged.unionByName(other)
    distinct = merged.groupBy("brand", "domain").agg(F.min("brand_ord").alias("brand_ord"))
    order = distinct.groupBy("brand").agg(F.min("brand_ord").alias("brand_ord"))
    return distinct.drop("brand_ord").join(order, "brand").select("brand", "brand_ord", "domain")


class Registry:
    """Official domains plus shared hosting, and every table derived from them.

    ``official`` has (brand, brand_ord, domain).  First match everywhere means
    smallest (brand_ord, domain): brands in registry order, domains sorted.
    """

    def __init__(self, official: DataFrame, exact_only: DataFrame, shared: DataFrame):
        self.spark = official.sparkSession
        self.exact_only = exact_only
        self.shared = shared
        self._entries = official

    @cached_property
    def official(self) -> DataFrame:
        exact = self.exact_only.select("domain", F.lit(True).alias("exact_only"))
        root = U.root_domain(F.col("domain"))
        return (
            self._entries.join(exact, "domain", "left")
            .withColumn("exact_only", F.coalesce("exact_only", F.lit(False)))
            .withColumn("n_labels", F.size(U.labels(F.col("domain"))))
            .withColumn("root", root)
            .withColumn("sld_skel", skeleton(U.sld(root)))
        )

    @cached_property
    def brands(self) -> DataFrame:
        return self._entries.select("brand", "brand_ord", skeleton(F.col("brand")).alias("brand_skel")).distinct()

    @cached_property
    def brand_terms(self) -> DataFrame:
        """Distinct (brand, term): skeletons of brand names and of official second-level labels."""
        names = self.brands.select("brand", "brand_ord", F.lit("").alias("place"),
                                   F.col("brand_skel").alias("term"), F.col("brand").alias("source"))
        domains = self.official.select("brand", "brand_ord", F.col("domain").alias("place"),
                                       F.col("sld_skel").alias("term"), F.col("domain").alias("source"))
        return (
            names.unionByName(domains)
            .filter(F.length("term") >= 4)
            .groupBy("brand", "brand_ord", "term")
            .agg(F.min("place").alias("place"), F.max_by("source", "place").alias("source"))
        )

    @cached_property
    def protected_labels(self) -> DataFrame:
        """Skeletons of protected labels with their approved spellings."""
        services = values(self.spark, {"label": "string"}, [(w,) for w in C.PROTECTED_LABELS])
        brands = self._entries.select(F.col("brand").alias("label"))
        parts = self._entries.select(F.explode(U.labels(F.col("domain"))).alias("label"))
        return (
            services.unionByName(brands).unionByName(parts)
            .filter(F.length("label") >= 4)
            .withColumn("skel", skeleton(F.col("label")))
            .filter(F.length("skel") >= 4)
            .groupBy("skel")
            .agg(F.sort_array(F.collect_set("label")).alias("approved"))
        )

    @cached_property
    def host_keys(self) -> DataFrame:
        """One lookup table for all host rules: (kind, key) → registry fact.

        suffix/skeleton/hosting: whole domains; token: brand terms;
        substring: first four letters of a brand; typo and label: deletion
        neighbourhoods of short names and trigrams of long ones.
        """
        none = F.lit(None)

        def rows(source, kind, key, ref, brand=none, brand_ord=none, place=none, root=none,
                 exact_only=none, n_labels=none, approved=none):
            return source.select(
                F.lit(kind).alias("kind"), key.alias("key"), ref.alias("ref"),
                brand.cast("string").alias("brand"), brand_ord.cast("bigint").alias("brand_ord"),
                place.cast("string").alias("place"), root.cast("string").alias("root"),
                exact_only.cast("boolean").alias("exact_only"), n_labels.cast("int").alias("n_labels"),
                approved.cast("array<string>").alias("approved"),
            )

        c = F.col
        owner = {"brand": c("brand"), "brand_ord": c("brand_ord")}
        official, protected = self.official, self.protected_labels

        def split_by_length(source, name):
            size = F.length(name)
            short = source.filter(size <= S.SHORT).withColumn("k", F.explode(S.deletions(c(name))))
            return short, source.filter(size > S.SHORT).withColumn("k", F.explode(S.grams(c(name), 3)))

        short_sld, long_sld = split_by_length(official, "sld_skel")
        short_label, long_label = split_by_length(protected, "skel")
        parts = [
            rows(official, "suffix", c("domain"), c("domain"), place=c("domain"),
                 exact_only=c("exact_only"), n_labels=c("n_labels"), **owner),
            rows(official, "skeleton", skeleton(c("domain")), c("domain"), place=c("domain"), **owner),
            rows(self.shared, "hosting", c("domain"), c("domain")),
            rows(self.brand_terms, "token", c("term"), c("term"), place=c("place"), root=c("source"), **owner),
            rows(self.brands.filter(F.length("brand_skel") >= 4), "substring",
                 F.substring("brand_skel", 1, 4), c("brand_skel"), **owner),
            rows(short_sld, "typo", c("k"), c("sld_skel"),
                 place=c("domain"), root=c("root"), **owner),
            rows(long_sld, "typo3", c("k"), c("sld_skel"),
                 place=c("domain"), root=c("root"), **owner),
            rows(short_label, "label", c("k"), c("skel"), approved=c("approved")),
            rows(long_label, "label3", c("k"), c("skel"), approved=c("approved")),
        ]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return self.sized(table)

    @cached_property
    def term_keys(self) -> DataFrame:
        """Lookup table of brand terms for path and query tokens."""
        c = F.col
        depth1, depth2 = S.deletions(c("term")), S.deletions(c("term"), 2)
        keys = F.when(F.length("term") <= 6, depth1).otherwise(depth2)
        tables = [
            self.brand_terms.filter(F.length("term") <= 8).select(F.lit("near").alias("kind"), F.explode(keys).alias("key"), "*"),
            self.brand_terms.filter(F.length("term") >= 5)
            .select(F.lit("inside").alias("kind"), F.substring("term", 1, 4).alias("key"), "*"),
            self.brand_terms.filter(F.length("term") >= 8)
            .select(F.lit("gram").alias("kind"), F.explode(S.grams(c("term"), 3)).alias("key"), "*"),
        ]
        return self.sized(tables[0].unionByName(tables[1]).unionByName(tables[2]))

    def sized(self, table: DataFrame) -> DataFrame:
        """Write a derived table once per registry; how it is joined, the optimizer decides by its real size."""
        return materialize(table, "registry", keep=True)

    @cached_property
    def term_index(self) -> DataFrame:
        """Blocks of the distinct brand terms for the search of the nearest one."""
        return term_index(self.brand_terms)

    @cached_property
    def brand_keys(self) -> DataFrame:
        """(kind, key, name) of brands as written and as skeletons, by their first letters; one row per brand."""
        names = self.brands.select("brand", F.inline(F.array(
            F.struct(F.lit("literal").alias("kind"), F.col("brand").alias("name")),
            F.struct(F.lit("skeleton").alias("kind"), F.col("brand_skel").alias("name"))))).distinct()
        return self.sized(names.where("name <> ''").select("kind", F.substring("name", 1, BRAND_KEY).alias("key"), "name"))


def _domains(spark: SparkSession, words: list[str]) -> DataFrame:
    return values(spark, {"domain": "string"}, [(w,) for w in words])


_CORE: dict[str, Registry] = {}


def core_registry(spark: SparkSession) -> Registry:
    """The registry shipped with the package: built-in entries under the core list."""
    key = spark.sparkContext.applicationId
    if key not in _CORE:
        built_in = entries(spark, C.BUILT_IN_DOMAINS)
        core = entries(spark, C.CORE_DOMAINS, _FILE_OFFSET)
        _CORE[key] = Registry(materialize(merge_entries(built_in, core), "entries", keep=True), _domains(spark, C.EXACT_ONLY_DOMAINS),
                              _domains(spark, C.SHARED_HOSTING_DOMAINS))
    return _CORE[key]


def registry_from_table(table: DataFrame) -> Registry:
    """Registry of a (brand, brand_ord, domain) table merged under the built-in entries."""
    spark = table.sparkSession
    given = clean_entries(table.withColumn("brand_ord", F.col("brand_ord") + _FILE_OFFSET))
    return Registry(merge_entries(entries(spark, C.BUILT_IN_DOMAINS), given),
                    _domains(spark, C.EXACT_ONLY_DOMAINS), _domains(spark, C.SHARED_HOSTING_DOMAINS))


def load_registry(spark: SparkSession, path: str) -> Registry:
    """Registry of a JSON file.

    ``{"official_domains": {brand: [domain]}, "exact_only_official_domains": [],
    "shared_hosting_domains": []}``.  Built-in brands are always kept.  The file is
    read in splits, so it may be of any size; one that is no object adds nothing.
    """
    found, values, error = read_store(spark, path)
    if error == MISSING:
        raise FileNotFoundError(path)
    given = clean_entries(found.where("section = 'official_domains'").select(
        F.col("key").alias("brand"), (F.col("position") + _FILE_OFFSET).alias("brand_ord"),
        F.explode(F.from_json("record", "array<string>")).alias("domain")))

    def section(name: str, fallback: list[str]) -> DataFrame:
        default = F.array(*[F.lit(w) for w in fallback]).cast("array<string>")
        listed = values.where(F.col("name") == name).agg(F.max(F.from_json("value", "array<string>")).alias("words"))
        return listed.select(F.explode(F.coalesce("words", default)).alias("domain")).select(
            F.ltrim(F.lower(F.trim("domain")), F.lit(".")).alias("domain")
        ).distinct()

    return Registry(
        merge_entries(entries(spark, C.BUILT_IN_DOMAINS), given),
        section("exact_only_official_domains", C.EXACT_ONLY_FALLBACK),
        section("shared_hosting_domains", []),
    )

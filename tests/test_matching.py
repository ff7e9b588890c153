"""The blocked joins find exactly what comparing every pair finds."""

import random

import pytest

from tests.brute import distance, ratio, root, skeleton
from urlrisk import constants as C
from urlrisk.operators.matching import NEAR_RATIO, TASK_TEXTS, brand_similarity, brands_inside, dealt, host_profile, lure_matches
from urlrisk.operators.nearest_terms import TermBlock, nearest_terms, term_index

LETTERS = "abcdeilmnoprstuw01-"


def mutate(rng, word, edits):
    chars = list(word)
    for _ in range(edits):
        at = rng.randrange(len(chars) + 1)
        kind = rng.choice("ids")
        if kind == "i":
            chars.insert(at, rng.choice(LETTERS))
        elif chars and at < len(chars):
            if kind == "d":
                chars.pop(at)
            else:
                chars[at] = rng.choice(LETTERS)
    return "".join(chars).strip("-.") or "x"


@pytest.fixture(scope="module")
def officials(registry):
    return [r.asDict() for r in registry.official.collect()]


@pytest.fixture(scope="module")
def hosts(officials):
    rng = random.Random(11)
    names = set()
    for o in officials:
        sld, _, rest = root(o["domain"]).partition(".")
        for edits in (0, 1, 1, 2, 3):
            names.add(f"{mutate(rng, sld, edits)}.{rng.choice([rest, 'net', 'xyz'])}")
        names.add(f"{mutate(rng, rng.choice(C.PROTECTED_LABELS), rng.choice([0, 1, 1, 2]))}.{o['domain']}")
        names.add(f"{mutate(rng, sld, 1)}-login.top")
    for sld in ("stackoverfloow", "staackoverfoww", "malaysaiairlines", "malaysiairlinnes", "microsoftonlinee",
                "steamcomunitty", "githubusercontennt", "stackexchang3", "cloudfalre", "khanacadmey"):
        names.add(sld + ".com")
    return sorted(n for n in names if ".." not in n and not n.startswith("www."))


@pytest.fixture(scope="module")
def found(spark, registry, hosts):
    table = spark.createDataFrame([(h,) for h in hosts], "domain string")
    return {r.domain: r for r in host_profile(table, registry).collect()}


def test_typo_hits_equal_all_pairs(found, hosts, officials):
    ratio_only = 0
    for host in hosts:
        sld = skeleton(root(host).split(".")[0])
        hits = []
        for o in officials:
            if o["root"] == root(host):
                continue
            d, r = distance(sld, o["sld_skel"]), ratio(sld, o["sld_skel"])
            if d == 1 or r >= 0.9:
                hits.append((o["brand_ord"], o["domain"], d))
                ratio_only += d > 1
        got = found.get(host)
        assert (got.typo_brands if got else 0) == len({h[0] for h in hits}), host
        if hits:
            assert (got.typo_hit.brand_ord, got.typo_hit.official, got.typo_hit.distance) == min(hits), host
        near = [h for h in hits if h[2] == 1]
        assert (got is not None and got.distance_hit is not None) == bool(near), host
        if near:
            assert (got.distance_hit.brand_ord, got.distance_hit.official) == min(near)[:2]
    assert ratio_only > 3, "the fixture must reach the ratio branch"


def test_official_and_subdomain_rules_equal_all_pairs(found, hosts, officials, registry):
    protected = {r.skel: set(r.approved) for r in registry.protected_labels.collect()}
    marker = set("01345789@!|$")

    def deceptive(label):
        if len(label) < 4:
            return False
        skel = skeleton(label)
        for service, approved in protected.items():
            if label in approved:
                continue
            d, r = distance(skel, service), ratio(skel, service)
            if skel == service or (marker & set(label) and (d <= 1 or r >= 0.9)) or (
                    len(service) >= 5 and d == 1 and r >= 0.8):
                return True
        return False

    order = sorted(officials, key=lambda o: (o["brand_ord"], o["domain"]))
    for host in hosts:
        shared = any(host == s or host.endswith("." + s) for s in C.SHARED_HOSTING_DOMAINS)
        official = parent = None
        for o in order:
            under = host.endswith("." + o["domain"])
            bad = under and any(deceptive(x) for x in host[:-len(o["domain"]) - 1].split("."))
            if bad and parent is None:
                parent = o["domain"]
            if official is None and not shared and (host == o["domain"] or (under and not bad and not o["exact_only"])):
                official = o["domain"]
        got = found.get(host)
        assert (got.official_domain if got else None) == official, host
        assert (got.subdomain_parent if got else None) == parent, host
        assert (got is not None and got.shared_provider is not None) == shared


def test_substring_and_token_rules_equal_all_pairs(found, hosts, registry):
    brands = [(r.brand_ord, r.brand, r.brand_skel) for r in registry.brands.collect()]
    terms = {r.term for r in registry.brand_terms.collect()}
    for host in hosts:
        inside = [b[:2] for b in brands if len(b[2]) >= 4 and b[2] in skeleton(host)]
        got = found.get(host)
        assert ((got.substring_hit.brand_ord, got.substring_hit.brand) if got and got.substring_hit else None) == (
            min(inside) if inside else None), host
        sld = root(host).split(".")[0]
        tokens = [t for t in "".join(ch if ch.isalnum() else " " for ch in sld).split() if len(t) >= 4]
        first = next((t for t in tokens if skeleton(t) in terms), None)
        assert (got.token_hit.raw_token if got and got.token_hit else None) == first, host


def test_path_tokens_equal_all_pairs(spark, registry):
    rng = random.Random(3)
    terms = [r.asDict() for r in registry.brand_terms.collect()]
    terms.sort(key=lambda t: (t["brand_ord"], t["place"]))
    texts = set()
    for t in terms:
        for edits in (0, 1, 2, 3):
            texts.add(f"/go/{mutate(rng, t['term'], edits)} q={mutate(rng, rng.choice(terms)['term'], 2)}")
        texts.add(f"/{mutate(rng, t['term'], 1)}{rng.choice(['', 'x', 'pay', 'online'])}")
    got = {r.lure_text: r.lure_hit for r in lure_matches(
        spark.createDataFrame([(t,) for t in texts], "lure_text string"), registry).collect()}
    for text in texts:
        folded = skeleton(text)
        tokens = [t for t in "".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in folded).split()
                  if len(t) >= 4]
        want = None
        for pos, token in enumerate(tokens):
            for t in terms:
                term = t["term"]
                if abs(len(token) - len(term)) > max(2, int(len(term) * 0.35)):
                    continue
                same = token == term or (len(term) >= 5 and term in token)
                if same or distance(token, term) <= (1 if len(term) <= 6 else 2) or ratio(token, term) >= 0.88:
                    want = (token, term, t["brand"])
                    break
            if want:
                break
        hit = got.get(text)
        assert ((hit.token, hit.term, hit.brand) if hit else None) == want, text


def test_similarity_features_equal_all_pairs(spark, registry, hosts, found):
    some = [h for i, h in enumerate(hosts) if i % 7 == 0]
    table = spark.createDataFrame([(h,) for h in some], "domain string")
    terms = sorted(r.term for r in registry.brand_terms.select("term").distinct().collect())
    profile = host_profile(table, registry)
    for r in brand_similarity(table, registry, profile).collect():
        sld = root(r.domain).split(".")[0]
        skel = skeleton(sld)
        distances = [distance(skel, t) for t in terms]
        ratios = [ratio(skel, t) for t in terms]
        official = r.domain in found and found[r.domain].is_official
        look = not official and any(
            (skel == t and sld != t) or (skel != t and (d <= (1 if len(t) <= 6 else 2) or q >= 0.9))
            for t, d, q in zip(terms, distances, ratios))
        assert (r.lookalike, r.min_distance) == (int(look), min(10, *distances)), r.domain
        assert r.max_similarity == pytest.approx(round(max(ratios) * 100, 2))


def test_shuffled_registry_gives_the_same(spark, registry, hosts, found):
    """Where no table is small enough to broadcast, the shuffled joins give equal results."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.createDataFrame([(h,) for h in hosts[:150]], "domain string")
        profile = host_profile(table, registry)
        assert "SortMergeJoin" in profile._jdf.queryExecution().executedPlan().toString()
        rows = {r.domain: r for r in profile.collect()}
        assert rows == {h: found[h] for h in hosts[:150] if h in found}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def random_terms(rng, many, letters="abcdeilnorst0"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(4, 16))) for _ in range(many)})


def plain_nearest(label, terms):
    others = [t for t in terms if t != label]
    measured = [(distance(label, t), ratio(label, t), len(t)) for t in others]
    return (max((q for _, q, _ in measured), default=0.0), min([10, *(d for d, _, _ in measured), *([0] if label in terms else [])]),
            any(d <= (1 if n <= 6 else 2) or q >= NEAR_RATIO for d, q, n in measured), label in terms)


def test_nearest_terms_equal_all_pairs(spark):
    rng = random.Random(5)
    terms = random_terms(rng, 400) + ["x" * 70, "é" * 9, "longer-than-any-other-name-of-this-list"]
    labels = [mutate(rng, rng.choice(terms), rng.randint(0, 4)) for _ in range(120)] + random_terms(rng, 60) + [
        "", "a", "zz", "q" * 64, "q" * 65, "x" * 71, "é" * 8, "日本", terms[0], terms[0], "unlike%%%%%%"]
    index = term_index(spark.createDataFrame([(t,) for t in terms], "term string"))
    table = spark.createDataFrame([(x,) for x in labels] + [(None,)], "label string")
    got = {r.label: (r.ratio, r.distance, r.near, r.equal) for r in nearest_terms(table, index, NEAR_RATIO).collect()}
    assert set(got) == set(labels)
    for label in got:
        want = plain_nearest(label, terms)
        assert got[label][1:] == want[1:] and got[label][0] == pytest.approx(want[0], abs=1e-12), label
    none = nearest_terms(table, index.limit(0), NEAR_RATIO).collect()
    assert {(r.ratio, r.distance, r.near, r.equal) for r in none} == {(0.0, 10, False, False)}
    assert nearest_terms(table.limit(0), index, NEAR_RATIO).count() == 0


def test_long_and_short_subsequences_agree():
    rng = random.Random(6)
    block = TermBlock(tuple("".join(rng.choice("abc") for _ in range(11)) for _ in range(50)))
    for size in (0, 1, 7, 63, 64):
        label = "".join(rng.choice("abcd") for _ in range(size))
        assert block.common(label).tolist() == block._common_of_long(label).tolist()


def test_registry_of_twenty_thousand_domains(spark):
    """The feature job runs and agrees with all pairs where one is checked."""
    from urlrisk.operators.features import features_22
    from urlrisk.sources.registry import registry_from_table

    rng = random.Random(7)
    names = random_terms(rng, 20_500)[:20_000]
    table = spark.createDataFrame([(n, i, f"{n}.com") for i, n in enumerate(names)], "brand string, brand_ord bigint, domain string")
    registry = registry_from_table(table)
    urls = [f"https://{mutate(rng, rng.choice(names), 2)}.net/{rng.choice(names)}/x" for _ in range(6)]
    rows = features_22(spark.createDataFrame([(u,) for u in urls], "url string"), registry).collect()
    terms = {r.term for r in registry.brand_terms.select("term").distinct().collect()}
    assert len(terms) > 19_000
    for r in rows:
        label = skeleton(r.url.split("/")[2].split(".")[0])
        want = plain_nearest(label, terms)
        best = 1.0 if want[3] else want[0]
        assert (r.minimum_brand_distance, r.maximum_brand_similarity) == (want[1], pytest.approx(round(best * 100, 2)))


def test_brands_inside_equal_all_brands(spark, registry):
    brands = [(r.brand, r.brand_skel) for r in registry.brands.select("brand", "brand_skel").distinct().collect()]
    rng = random.Random(8)
    texts = [f"https://{rng.choice(brands)[0]}-{rng.choice(brands)[0]}.com/{mutate(rng, rng.choice(brands)[0], 1)}?{rng.choice(brands)[1]}" for _ in range(60)]
    got = {r.text: (r.brand_literals, r.brand_skeletons)
           for r in brands_inside(spark.createDataFrame([(t,) for t in [*texts, None, "", "zz"]], "text string"), registry).collect()}
    for t in texts:
        assert got.get(t, (0, 0)) == (sum(b in t for b, _ in brands), sum(k in skeleton(t) for _, k in brands))


def test_texts_are_dealt_to_tasks_by_their_number(spark, registry):
    """Short texts of which many keys are made stay in several tasks, whatever few bytes they have."""
    texts = spark.range(3 * TASK_TEXTS).selectExpr("concat('go/paypal-', id) AS lure_text")
    assert dealt(texts, "lure_text").rdd.getNumPartitions() == 3
    assert dealt(texts.limit(0), "lure_text").rdd.getNumPartitions() == 1
    for found in (lure_matches(texts, registry), brands_inside(texts, registry, "lure_text")):
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 3 * TASK_TEXTS

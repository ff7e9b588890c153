"""Check SQL of the registered queries, written for DuckDB.

The SQL is deliberately plain: nested loops over the registry, edit distances and
a recursive sequence-match ratio on every pair, no blocking keys.  It shares only
the fixed values and the fixture views with the Spark side.
"""

from __future__ import annotations

from urlrisk import constants as C
from urlrisk import messages as M
from urlrisk.plans import fixtures as FX


def text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def table(rows, *names) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else text(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


# --- expressions -------------------------------------------------------------

_FROM = "".join(C.CONFUSABLES.values())
_TO = "".join(k * len(v) for k, v in C.CONFUSABLES.items())


def skel(x: str) -> str:
    return f"replace(replace(lower(translate({x}, {text(_FROM)}, {text(_TO)})), 'rn', 'm'), 'vv', 'w')"


def norm(x: str) -> str:
    """The lookahead-free form of the URL repair."""
    x = f"regexp_replace({x}, '\\s+', '', 'g')"
    x = f"regexp_replace({x}, '[,;]+$', '')"
    x = f"regexp_replace({x}, '^[.,;]+(https?[:?]//)', '\\1', 'i')"
    x = f"regexp_replace({x}, '^(https?)\\?//', '\\1://', 'i')"
    x = f"regexp_replace({x}, '^(https?):/+', '\\1://', 'i')"
    x = f"regexp_replace({x}, '^(?:https?://[.,;]*)*(https?://)', '\\1', 'i')"
    return f"(SELECT CASE WHEN v = '' OR regexp_matches(v, '^https?://', 'i') THEN v ELSE 'https://' || v END FROM (SELECT {x} AS v))"


def strip_www(x: str) -> str:
    return f"regexp_replace(trim(trim(lower({x})), '.'), '^www\\.', '')"


def root(x: str, suffixes=C.TWO_LEVEL_SUFFIXES) -> str:
    parts = f"string_split({x}, '.')"
    two, three = f"array_to_string({parts}[-2:], '.')", f"array_to_string({parts}[-3:], '.')"
    return f"CASE WHEN {two} IN {words(suffixes)} THEN {three} ELSE {two} END"


def has_marker(x: str) -> str:
    return f"regexp_matches({x}, '[01345789@!|$]')"


def count(x: str, char: str) -> str:
    return f"(length({x}) - length(replace({x}, '{char}', '')))"


def matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def band(x: str, field: int) -> str:
    b = C.RISK_BANDS
    return (f"CASE WHEN {x} >= 80 THEN {text(b[3][field])} WHEN {x} >= 45 THEN {text(b[2][field])} "
            f"WHEN {x} >= 20 THEN {text(b[1][field])} ELSE {text(b[0][field])} END")


IP = "(\\d{1,3}\\.){3}\\d{1,3}"

# --- registry ----------------------------------------------------------------


def _registry_rows():
    order, rows = {}, set()
    for offset, block in ((0, C.BUILT_IN_DOMAINS), (1_000_000, C.CORE_DOMAINS)):
        for position, line in enumerate(block.strip().splitlines()):
            brand, domains = line.split(":", 1)
            order.setdefault(brand, offset + position)
            rows |= {(brand, d) for d in domains.split()}
    return sorted((order[b], b, d) for b, d in rows)


CORE = {
    "registry": table(_registry_rows(), "brand_ord", "brand", "domain"),
    "exact": table([(d,) for d in C.EXACT_ONLY_DOMAINS], "domain"),
    "sharing": table([(d,) for d in C.SHARED_HOSTING_DOMAINS], "provider"),
    "services": table([(w,) for w in C.PROTECTED_LABELS], "label"),
    "bad_tlds": table(C.BAD_TLD_POINTS.items(), "tld", "points"),
    "keyword_list": table([(i, w) for i, w in enumerate(C.KEYWORDS)], "kpos", "word"),
}

REGISTRY_DERIVED = {
    "official": f"""SELECT brand_ord, brand, domain, domain IN (SELECT domain FROM exact) AS exact_only,
        len(string_split(domain, '.')) AS n_labels, {root('domain')} AS oroot,
        {skel("string_split(" + root('domain') + ", '.')[1]")} AS osld, {skel('domain')} AS oskel FROM registry""",
    "brands": f"SELECT DISTINCT brand_ord, brand, {skel('brand')} AS bskel FROM registry",
    "terms": """SELECT brand_ord, brand, term, min(place) AS place, arg_max(source, place) AS source FROM (
        SELECT brand_ord, brand, '' AS place, bskel AS term, brand AS source FROM brands
        UNION ALL SELECT brand_ord, brand, domain, osld, domain FROM official) WHERE length(term) >= 4
        GROUP BY ALL""",
    "protected": f"""SELECT pskel, list_sort(list(DISTINCT label)) AS approved FROM (
        SELECT label, {skel('label')} AS pskel FROM (SELECT label FROM services UNION ALL SELECT brand FROM registry
        UNION ALL SELECT unnest(string_split(domain, '.')) FROM registry) WHERE length(label) >= 4)
        WHERE length(pskel) >= 4 GROUP BY pskel""",
}
REGISTRY_DERIVED["terms"] = REGISTRY_DERIVED["terms"].replace("GROUP BY ALL", "GROUP BY brand_ord, brand, term")


def url_ctes(source: str) -> dict[str, str]:
    """URLs of a fixture taken apart."""
    return {
        "given": FX.duck_view(source),
        "prep": f"SELECT * EXCLUDE (url), url AS raw, {norm('url')} AS url FROM given",
        "prep2": f"SELECT *, {norm('url')} AS rule_url FROM prep WHERE url <> ''",
        "parts": """SELECT *, lower(regexp_extract(rule_url, '(?i)^(https?)://', 1)) AS scheme,
            regexp_extract(rule_url, '(?i)^https?://([^/?#]*)', 1) AS netloc,
            regexp_replace(regexp_extract(rule_url, '(?i)^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
            regexp_extract(rule_url, '(?i)^https?://[^/?#]*[^?#]*\\?([^#]*)', 1) AS query FROM prep2""",
        "parts2": f"SELECT *, {strip_www('''string_split(string_split(netloc, '@')[-1], ':')[1]''')} AS raw_domain FROM parts",
        "parts3": f"SELECT *, {strip_www('raw_domain')} AS domain FROM parts2",
        "parts4": f"SELECT *, {root('domain')} AS root FROM parts3",
        "urls": f"""SELECT *, string_split(root, '.')[1] AS sld,
            CASE WHEN contains(domain, '.') THEN string_split(domain, '.')[-1] ELSE '' END AS tld,
            list_contains({array(C.SHORTENERS)}, array_to_string(string_split(domain, '.')[-2:], '.')) AS shortener,
            lower(domain || ' ' || path || ' ' || query) AS target FROM parts4""",
        "hosts": f"""SELECT *, {skel('domain')} AS hskel, {skel('sld')} AS sskel, len(string_split(domain, '.')) AS n
            FROM (SELECT DISTINCT domain, root, sld, tld FROM urls)""",
    }


def ratio_ctes(pairs: str) -> dict[str, str]:
    """Sequence-match ratio: longest block, earliest first, then both sides again."""
    def best(alo, ahi, blo, bhi):
        return (f"list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), "
                f"lambda j: {{'k': coalesce(list_max(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), "
                f"lambda k: substring(a, (i + 1)::INT, k::INT) = substring(b, (j + 1)::INT, k::INT))), 0), "
                f"'i': -i, 'j': -j}}))))")

    return {
        "ratio_pairs": pairs,
        "seg": f"""SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi,
                {best('0', 'length(a)', '0', 'length(b)')} AS m FROM ratio_pairs
            UNION ALL
            SELECT a, b, x.alo, x.ahi, x.blo, x.bhi, {best('x.alo', 'x.ahi', 'x.blo', 'x.bhi')} AS m
            FROM (SELECT a, b, unnest([
                    {{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}},
                    {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}}]) AS x FROM seg WHERE m.k > 0) AS s
            WHERE x.ahi > x.alo AND x.bhi > x.blo""",
        "ratios": """SELECT a, b, 2.0::DOUBLE * coalesce(sum(m.k), 0) / (length(a) + length(b)) AS ratio
            FROM seg GROUP BY a, b""",
    }


def bound(a: str, b: str) -> str:
    return f"2.0 * least(length({a}), length({b})) / (length({a}) + length({b}))"


LABEL_CTES = {
    "host_labels": """SELECT domain, n, unnest(range(0, n)) AS pos, unnest(string_split(domain, '.')) AS label FROM hosts""",
    "label_pairs": f"""SELECT DISTINCT label, {skel('label')} AS lskel, pskel, approved[1] AS service,
        levenshtein({skel('label')}, pskel) AS dist, {has_marker('label')} AS marker
        FROM (SELECT DISTINCT label FROM host_labels WHERE length(label) >= 4), protected
        WHERE NOT list_contains(approved, label)""",
}
SLD_CTES = {
    "sld_pairs": """SELECT sskel, osld, levenshtein(sskel, osld) AS dist FROM
        (SELECT DISTINCT sskel FROM hosts), (SELECT DISTINCT osld FROM official)""",
}
TOKEN_CTES = {
    "lures": "SELECT DISTINCT path || ' ' || query AS lure FROM urls WHERE shortener",
}
LURE_TEXTS = {"lures": "SELECT DISTINCT domain || ' ' || path || ' ' || query AS lure FROM urls"}


def token_ctes(lures: dict[str, str]) -> dict[str, str]:
    """Tokens of texts against every brand term."""
    return {
        **lures,
        "token_list": f"""SELECT lure, list_filter(regexp_split_to_array({skel('lure')}, '[^a-z0-9]+'),
            lambda t: length(t) >= 4) AS ts FROM lures""",
        "tokens": "SELECT lure, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM token_list",
        "token_pairs": """SELECT token, t.*, levenshtein(token, term) AS dist,
            token = term OR (length(term) >= 5 AND contains(token, term)) AS same
            FROM (SELECT DISTINCT token FROM tokens), terms AS t
            WHERE abs(length(token) - length(term)) <= greatest(2, floor(length(term) * 0.35))""",
    }


RATIO_PAIRS = f"""
    SELECT lskel AS a, pskel AS b FROM label_pairs WHERE {bound('lskel', 'pskel')} >= 0.8 AND (marker OR dist = 1)
    UNION SELECT sskel, osld FROM sld_pairs WHERE {bound('sskel', 'osld')} >= 0.9 OR dist = 1
    UNION SELECT token, term FROM token_pairs WHERE {bound('token', 'term')} >= 0.88 OR dist <= 2"""

VERDICT_CTES = {
    "bad_labels": """SELECT domain, n, pos, label, min({'p': pskel, 's': service, 'd': dist, 'r': ratio}) AS hit
        FROM host_labels JOIN label_pairs USING (label) LEFT JOIN ratios ON a = lskel AND b = pskel
        WHERE dist = 0 OR (marker AND (dist <= 1 OR ratio >= 0.9)) OR (length(pskel) >= 5 AND dist = 1 AND ratio >= 0.8)
        GROUP BY domain, n, pos, label""",
    "first_bad": "SELECT domain, min(pos) AS bad FROM bad_labels GROUP BY domain",
    "under": """SELECT h.domain, h.n, o.*, coalesce(f.bad, 1000) < h.n - o.n_labels AS deceptive, o.domain AS odomain
        FROM hosts h JOIN official o ON h.domain = o.domain OR ends_with(h.domain, '.' || o.domain)
        LEFT JOIN first_bad f ON f.domain = h.domain""",
    "hosting": """SELECT domain, arg_max(provider, length(provider)) AS provider FROM hosts JOIN sharing
        ON domain = provider OR ends_with(domain, '.' || provider) GROUP BY domain""",
    "official_hit": """SELECT domain, min({'o': brand_ord, 'd': odomain, 'b': brand}) AS hit FROM under
        WHERE (domain = odomain OR (NOT exact_only AND NOT deceptive))
        AND domain NOT IN (SELECT domain FROM hosting) GROUP BY domain""",
    "subdomain_hit": """SELECT domain, min({'o': brand_ord, 'd': odomain, 'b': brand, 'm': n_labels}) AS hit
        FROM under WHERE deceptive GROUP BY domain""",
    "skeleton_hit": """SELECT h.domain, min({'o': brand_ord, 'd': o.domain, 'b': brand}) AS hit FROM hosts h
        JOIN official o ON hskel = oskel OR ends_with(hskel, '.' || oskel)
        WHERE h.domain NOT IN (SELECT domain FROM official_hit) GROUP BY h.domain""",
    "sld_tokens": """SELECT domain, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM (
        SELECT domain, list_filter(regexp_split_to_array(sld, '[^a-z0-9]+'), lambda t: length(t) >= 4) AS ts FROM hosts)""",
    "token_hit": f"""SELECT domain, min({{'p': pos, 'o': brand_ord, 'l': place, 'b': brand, 'raw': token, 't': term,
        's': source}}) AS hit FROM sld_tokens JOIN terms ON {skel('token')} = term GROUP BY domain""",
    "substring_hit": """SELECT domain, min({'o': brand_ord, 'b': brand}) AS hit FROM hosts JOIN brands
        ON length(bskel) >= 4 AND contains(hskel, bskel) GROUP BY domain""",
    "typo_rows": """SELECT h.domain, h.root, o.brand_ord, o.domain AS odomain, o.brand, o.oroot, p.dist, r.ratio
        FROM hosts h JOIN sld_pairs p USING (sskel) JOIN official o USING (osld)
        LEFT JOIN ratios r ON r.a = sskel AND r.b = osld
        WHERE h.root <> o.oroot AND (p.dist = 1 OR r.ratio >= 0.9)""",
    "distance_hit": """SELECT domain, min({'o': brand_ord, 'd': odomain, 'b': brand, 'r': oroot}) AS hit FROM typo_rows
        WHERE dist = 1 GROUP BY domain""",
    "typo_hit": """SELECT domain, min({'o': brand_ord, 'd': odomain, 'b': brand, 'r': oroot, 'dist': dist, 'ratio': ratio})
        AS hit, count(DISTINCT brand_ord) AS brands FROM typo_rows GROUP BY domain""",
    "lure_hit": """SELECT lure, min({'p': pos, 'o': brand_ord, 'l': place, 'b': brand, 'token': token, 't': term,
        's': source, 'd': CASE WHEN same THEN 0 ELSE dist END, 'r': CASE WHEN same THEN 1.0::DOUBLE ELSE ratio END}) AS hit
        FROM tokens JOIN token_pairs p USING (token) LEFT JOIN ratios ON a = token AND b = term
        WHERE same OR dist <= CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END OR ratio >= 0.88 GROUP BY lure""",
}

_KEYWORD_FOUND = (f"list_filter({array(C.KEYWORDS)}, lambda w: contains(target, w) OR contains({skel('target')}, {skel('w')}))")

_NO_REP = """SELECT NULL AS url_id, false AS match, NULL AS match_type, 0 AS score, ''::VARCHAR AS sources,
    false AS context_match, false AS stale, false AS available WHERE false"""


def _reasons(*items) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, _, value in items) + "], lambda x: x IS NOT NULL)"


def _points(*items) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {points} ELSE 0 END" for cond, points, _ in items)


_HYPHENS, _TLD_SKEL = count("domain", "-"), skel("tld")
_CONF_TLD = f"(tld <> {_TLD_SKEL} AND {_TLD_SKEL} IN {words(C.COMMON_TLDS)})"
_STRUCTURE = [
    ("shortener", 45, text(M.STRUCTURE_SHORTENER)),
    ("shortener AND lure IS NOT NULL", 60, f"printf({text(M.STRUCTURE_LURE)}, lure.token)"),
    ("contains(rule_url, '@')", 100, text(M.STRUCTURE_AT)),
    (f"regexp_matches(domain, '{IP}')", 100, text(M.STRUCTURE_IP)),
    ("contains(domain, 'xn--')", 100, text(M.STRUCTURE_PUNYCODE)),
    ("points IS NOT NULL", "points", f"printf({text(M.STRUCTURE_TLD)}, tld)"),
    (_CONF_TLD, 100, f"printf({text(M.STRUCTURE_CONFUSABLE_TLD)}, tld, {_TLD_SKEL})"),
    (f"{_HYPHENS} >= 3", 60, text(M.STRUCTURE_MANY_HYPHENS)),
    (f"{_HYPHENS} BETWEEN 1 AND 2", 25, text(M.STRUCTURE_HYPHENS)),
    ("regexp_matches(sld, '[0-9]')", 30, text(M.STRUCTURE_DIGITS)),
    (f"{count('domain', '.')} >= 4", 50, text(M.STRUCTURE_DEEP)),
    ("contains(path, '%') OR contains(query, '%')", 30, text(M.STRUCTURE_ENCODED)),
]
_SIZE, _SPECIAL = "length(rule_url)", matches("rule_url", "[^a-zA-Z0-9]")
_LENGTH = [
    (f"{_SIZE} > 120", 80, text(M.LENGTH_EXTREME)),
    (f"{_SIZE} BETWEEN 91 AND 120", 50, text(M.LENGTH_SUSPICIOUS)),
    (f"{_SIZE} BETWEEN 71 AND 90", 25, text(M.LENGTH_MODERATE)),
    (f"{_SPECIAL} > 25", 35, text(M.LENGTH_SPECIAL)),
]
_DIGITS = matches("sld", "[0-9]")
_LEXICAL = f"""(CASE WHEN off IS NOT NULL THEN 4 ELSE 12 END
    + CASE WHEN scheme <> 'https' THEN 12 ELSE 0 END
    + CASE WHEN shortener THEN 22 + CASE WHEN lure IS NOT NULL THEN 48 ELSE 0 END ELSE 0 END
    + CASE WHEN regexp_matches(domain, '{IP}') THEN 36 ELSE 0 END
    + CASE WHEN contains(rule_url, '@') THEN 36 ELSE 0 END
    + CASE WHEN points IS NOT NULL THEN least(22.0::DOUBLE, points * 0.25::DOUBLE) ELSE 0 END
    + CASE WHEN {_CONF_TLD} THEN 38 ELSE 0 END
    + least(28, 7 * len(keywords))
    + CASE WHEN off IS NULL THEN CASE WHEN skl IS NOT NULL THEN 45 ELSE 0 END
        + CASE WHEN sbs IS NOT NULL THEN 22 ELSE 0 END + 60 * coalesce(typo_brands, 0) ELSE 0 END
    + CASE WHEN length(sld) > 0 AND {_DIGITS}::DOUBLE / length(sld) >= 0.3 THEN 12 WHEN {_DIGITS} > 0 THEN 6 ELSE 0 END
    + CASE WHEN {_HYPHENS} >= 3 THEN 14 WHEN {_HYPHENS} > 0 THEN 6 ELSE 0 END
    + CASE WHEN {_SIZE} > 120 THEN 16 WHEN {_SIZE} > 80 THEN 10 WHEN {_SIZE} > 55 AND off IS NULL THEN 5 ELSE 0 END)::DOUBLE"""


def _level(x: str, danger: int = 70, warning: int = 30) -> str:
    return f"CASE WHEN {x} >= {danger} THEN 'danger' WHEN {x} >= {warning} THEN 'warning' ELSE 'safe' END"


def _branches(*rows, final) -> tuple[str, str, str]:
    """Score, status and explanation of a first-match chain."""
    return tuple(
        "CASE " + " ".join(f"WHEN {row[0]} THEN {row[i]}" for row in rows) + f" ELSE {final[i - 1]} END"
        for i in (1, 2, 3))


_OFFICIAL = _branches(
    ("off IS NOT NULL", 0, "'safe'", f"printf({text(M.OFFICIAL_SAFE)}, off.d)"),
    ("provider IS NOT NULL", 45, "'warning'", text(M.OFFICIAL_SHARED)),
    ("sub IS NOT NULL", 95, "'danger'", text(M.OFFICIAL_SUBDOMAIN)),
    ("tok IS NOT NULL", 98, "'danger'", text(M.OFFICIAL_TOKEN)),
    ("skl IS NOT NULL", 100, "'danger'", f"printf({text(M.OFFICIAL_SKELETON)}, skl.d)"),
    final=(20, "'warning'", text(M.OFFICIAL_UNKNOWN)))
_REPUTATION = _branches(
    ("off IS NOT NULL", 0, "'safe'", f"printf({text(M.REPUTATION_SUPPRESSED)}, off.d)"),
    ("rep_match", "rep_score", "CASE WHEN rep_score >= 80 THEN 'danger' ELSE 'warning' END",
     f"printf({text(M.REPUTATION_MATCH)}, rep_type, rep_sources)"),
    ("rep_context", 0, "'safe'", text(M.REPUTATION_CONTEXT)),
    ("NOT rep_available", 0, "'warning'", text(M.REPUTATION_UNAVAILABLE)),
    final=(0, "'safe'", text(M.REPUTATION_NONE)))
_BRAND = _branches(
    ("provider IS NOT NULL", 0, "'warning'", text(M.BRAND_SHARED)),
    ("off IS NOT NULL", 0, "'safe'", f"printf({text(M.BRAND_OFFICIAL)}, off.b)"),
    ("sbs IS NOT NULL AND (dst IS NULL OR sbs.o <= dst.o)", 100, "'danger'", f"printf({text(M.BRAND_SUBSTRING)}, sbs.b)"),
    ("dst IS NOT NULL", 95, "'danger'", f"printf({text(M.BRAND_TYPO)}, root, dst.r)"),
    final=(0, "'safe'", text(M.BRAND_NONE)))
_HOMOGRAPH = _branches(
    ("provider IS NOT NULL", 0, "'warning'", text(M.HOMOGRAPH_SHARED)),
    ("off IS NOT NULL", 0, "'safe'", text(M.HOMOGRAPH_OFFICIAL)),
    ("sub IS NOT NULL", 95, "'danger'", text(M.HOMOGRAPH_SUBDOMAIN)),
    ("contains(domain, 'xn--')", 100, "'danger'", text(M.HOMOGRAPH_PUNYCODE)),
    (_CONF_TLD, 100, "'danger'", f"printf({text(M.HOMOGRAPH_TLD)}, tld, {_TLD_SKEL})"),
    ("tok IS NOT NULL", 95, "'danger'", text(M.HOMOGRAPH_TOKEN)),
    ("skl IS NOT NULL", 100, "'danger'", f"printf({text(M.HOMOGRAPH_SKELETON)}, skl.d)"),
    ("typ IS NOT NULL", 90, "'danger'", f"printf({text(M.HOMOGRAPH_TYPO)}, root, typ.r)"),
    final=(0, "'safe'", text(M.HOMOGRAPH_NONE)))

_SHORT = {"officialDomain": "off", "reputationEvidence": "rep", "aiModelProbability": "ai", "brandVerification": "brand",
          "homographAttack": "homo", "urlStructure": "str", "suspiciousKeywords": "kw", "httpsUsage": "https",
          "urlLengthComplexity": "len"}
S = {name: f"s_{short}" for name, short in _SHORT.items()}


def _critical() -> list[tuple[str, str]]:
    return [
        ("s_off >= 90", M.CRITICAL_OFFICIAL), ("s_rep >= 90", M.CRITICAL_REPUTATION),
        ("s_homo >= 90", M.CRITICAL_HOMOGRAPH), ("s_brand >= 90", M.CRITICAL_BRAND),
        ("s_str >= 90", M.CRITICAL_STRUCTURE), ("shortener AND s_brand >= 90", M.CRITICAL_SHORTENER),
        ("s_brand >= 90 AND s_kw >= 40", M.CRITICAL_BRAND_KEYWORD),
        ("s_https >= 60 AND s_kw >= 70", M.CRITICAL_HTTP_KEYWORD), ("contains(rule_url, '@')", M.CRITICAL_AT),
        (f"regexp_matches(domain, '{IP}')", M.CRITICAL_IP)]


def score_ctes(reputation: str = _NO_REP) -> dict[str, str]:
    signals = "[" + ", ".join(f"{{'r': -{S[n]}, 'o': {i}, 'n': {text(n)}}}" for i, n in enumerate(C.INDICATOR_NAMES)) + "]"
    weighted = " + ".join(f"{S[n]} * {w}" for n, w in C.INDICATOR_WEIGHTS.items())
    critical = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {text(m)} END" for t, m in _critical()) + "], lambda x: x IS NOT NULL)"
    combined = ("off IS NULL AND NOT critical AND ((s_ai >= 45 AND s_kw >= 75 AND s_str >= 25) "
                "OR (s_ai >= 50 AND s_kw >= 40 AND s_str >= 60))")
    return {
        "rep_rows": reputation,
        "facts": f"""SELECT u.*, {_KEYWORD_FOUND} AS keywords, oh.hit AS off, provider, sh.hit AS sub, th.hit AS tok,
                kh.hit AS skl, bh.hit AS sbs, dh.hit AS dst, yh.hit AS typ, yh.brands AS typo_brands, lh.hit AS lure,
                points, coalesce(rp.match, false) AS rep_match, rp.match_type AS rep_type, coalesce(rp.score, 0) AS rep_score,
                rp.sources AS rep_sources, coalesce(rp.context_match, false) AS rep_context,
                coalesce(rp.available, false) AS rep_available
            FROM urls u LEFT JOIN official_hit oh USING (domain) LEFT JOIN hosting USING (domain)
            LEFT JOIN subdomain_hit sh USING (domain) LEFT JOIN token_hit th USING (domain)
            LEFT JOIN skeleton_hit kh USING (domain) LEFT JOIN substring_hit bh USING (domain)
            LEFT JOIN distance_hit dh USING (domain) LEFT JOIN typo_hit yh USING (domain)
            LEFT JOIN lure_hit lh ON u.shortener AND lh.lure = u.path || ' ' || u.query
            LEFT JOIN bad_tlds USING (tld) LEFT JOIN rep_rows rp USING (url_id)""",
        "facts2": f"""SELECT *, greatest(0.02::DOUBLE, least(0.95::DOUBLE,
                CASE WHEN off IS NOT NULL THEN least(8.0::DOUBLE, {_LEXICAL}) ELSE {_LEXICAL} END / 100)) AS lexical,
                least(100, {_points(*_STRUCTURE)}) AS str0, {_reasons(*_STRUCTURE)} AS str_list0 FROM facts""",
        "ind": f"""SELECT *, {_OFFICIAL[0]} AS s_off, {_OFFICIAL[1]} AS t_off, {_OFFICIAL[2]} AS e_off,
                {_REPUTATION[0]} AS s_rep, {_REPUTATION[1]} AS t_rep, {_REPUTATION[2]} AS e_rep,
                CASE WHEN off IS NOT NULL THEN least(15, round_even(lexical * 100, 0)::INT)
                     ELSE round_even(lexical * 100, 0)::INT END AS ai0,
                {_BRAND[0]} AS s_brand, {_BRAND[1]} AS t_brand, {_BRAND[2]} AS e_brand,
                {_HOMOGRAPH[0]} AS s_homo, {_HOMOGRAPH[1]} AS t_homo, {_HOMOGRAPH[2]} AS e_homo,
                CASE WHEN off IS NOT NULL AND str0 < 100 THEN 0 ELSE str0 END AS s_str,
                CASE WHEN off IS NOT NULL AND str0 < 100 THEN []::VARCHAR[] ELSE str_list0 END AS str_list,
                CASE WHEN off IS NOT NULL THEN 0 WHEN len(keywords) >= 3 THEN 100 WHEN len(keywords) = 2 THEN 75
                     WHEN len(keywords) = 1 THEN 40 ELSE 0 END AS s_kw,
                CASE WHEN scheme = 'https' THEN 0 ELSE 60 END AS s_https,
                least({_points(*_LENGTH)}, CASE WHEN off IS NOT NULL THEN 10 ELSE 100 END) AS s_len,
                {_reasons(*_LENGTH)} AS len_list FROM facts2""",
        "ind2": f"""SELECT *, (off IS NOT NULL AND s_off = 0 AND s_rep = 0 AND s_brand = 0 AND s_homo = 0 AND s_str = 0
                AND s_kw = 0 AND s_https = 0) AS clean,
                {_level('s_str')} AS t_str, {_level('s_kw')} AS t_kw, {_level('s_len')} AS t_len,
                CASE WHEN s_https = 0 THEN 'safe' ELSE 'warning' END AS t_https,
                CASE WHEN len(str_list) > 0 THEN printf({text(M.STRUCTURE_ISSUES)}, array_to_string(str_list, ', '))
                     ELSE {text(M.STRUCTURE_NONE)} END AS e_str,
                CASE WHEN off IS NOT NULL THEN {text(M.KEYWORDS_OFFICIAL)} WHEN len(keywords) > 0
                     THEN printf({text(M.KEYWORDS_FOUND)}, array_to_string(keywords, ', ')) ELSE {text(M.KEYWORDS_NONE)} END AS e_kw,
                CASE WHEN s_https = 0 THEN {text(M.HTTPS_SAFE)} ELSE {text(M.HTTPS_WARNING)} END AS e_https,
                CASE WHEN len(len_list) > 0 THEN printf({text(M.LENGTH_ISSUES)}, array_to_string(len_list, ', '))
                     ELSE {text(M.LENGTH_NONE)} END AS e_len FROM ind""",
        "ind3": f"""SELECT *, CASE WHEN clean THEN 0 ELSE ai0 END AS s_ai,
                CASE WHEN clean THEN 'safe' ELSE 'warning' END AS t_ai,
                CASE WHEN clean THEN {text(M.AI_CLEAN)} ELSE {text(M.AI_UNAVAILABLE)} END AS e_ai FROM ind2""",
        "sc1": f"""SELECT *, ({weighted})::DOUBLE / 100 AS weighted, round_even(({weighted})::DOUBLE / 100, 0)::INT AS rounded,
                {critical} AS reasons, len({critical}) > 0 AS critical, list_sort({signals})[1:3] AS top FROM ind3""",
        "sc2": """SELECT *, CASE WHEN critical THEN greatest(80, least(100, round_even(-top[1].r * 0.65::DOUBLE
                + -top[2].r * 0.20::DOUBLE + -top[3].r * 0.15::DOUBLE, 0)::INT)) END AS evidence,
                array_to_string(list_transform(top, lambda s: s.n || '=' || (-s.r)), ', ') AS summary FROM sc1""",
        "sc3": f"""SELECT *, CASE WHEN critical THEN greatest(rounded, evidence) ELSE rounded END AS v1 FROM sc2""",
        "sc4": "SELECT *, greatest(v1, s_rep) AS v2 FROM sc3",
        "sc5": f"SELECT *, CASE WHEN {combined} THEN greatest(v2, 45) ELSE v2 END AS v3 FROM sc4",
        "sc6": "SELECT *, CASE WHEN off IS NOT NULL AND NOT critical THEN least(v3, 10) ELSE v3 END AS v4 FROM sc5",
        "sc7": "SELECT *, CASE WHEN provider IS NOT NULL AND NOT critical THEN greatest(v4, 20) ELSE v4 END AS risk FROM sc6",
        "scored": f"""SELECT *, array_to_string(list_filter([
                CASE WHEN v1 <> rounded THEN printf({text(M.OVERRIDE_CRITICAL)}, summary, evidence) END,
                CASE WHEN v2 <> v1 THEN printf({text(M.OVERRIDE_REPUTATION)}, s_rep) END,
                CASE WHEN v3 <> v2 THEN {text(M.OVERRIDE_COMBINED)} END,
                CASE WHEN v4 <> v3 THEN {text(M.OVERRIDE_OFFICIAL)} END,
                CASE WHEN risk <> v4 THEN {text(M.OVERRIDE_SHARED)} END], lambda x: x IS NOT NULL), '; ') AS overrides,
                {band('risk', 1)} AS result, {band('risk', 2)} AS decision, {band('risk', 0)} AS band,
                CASE WHEN risk >= 45 THEN 1 ELSE 0 END AS prediction FROM sc7""",
    }


# Read more than once and dear to repeat.
_MATERIALIZED = {"fed2", "asked2", "store", "by_url", "by_host", "by_root"}


def with_ctes(ctes: dict[str, str], final: str, recursive: bool = True) -> str:
    body = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZED else ''}(\n{sql}\n)" for name, sql in ctes.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{final}"


URLS = url_ctes(FX.ADVERSARIAL)


def hosts_chain(lures=TOKEN_CTES) -> dict[str, str]:
    return {**CORE, **REGISTRY_DERIVED, **URLS, **LABEL_CTES, **SLD_CTES, **token_ctes(lures),
            **ratio_ctes(RATIO_PAIRS), **VERDICT_CTES}


def on_urls(final: str) -> str:
    return with_ctes({**CORE, **URLS}, final, recursive=False)


def on_hosts(final: str) -> str:
    return with_ctes(hosts_chain(), final)


def on_scored(final: str) -> str:
    return with_ctes({**hosts_chain(), **score_ctes()}, final)


# --- reputation ----------------------------------------------------------------

_ABS = "^[^:/?#]+://"


def fingerprint_cols(url: str) -> str:
    host = strip_www(f"string_split(string_split(regexp_extract({url}, '{_ABS}([^/?#]*)', 1), '@')[-1], ':')[1]")
    path = f"regexp_replace(regexp_extract({url}, '{_ABS}[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    query = f"regexp_extract({url}, '{_ABS}[^/?#]*[^?#]*\\?([^#]*)', 1)"
    return (f"{host} AS rhost, lower({host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
            f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END) AS fp")


def reputation_ctes(lookups: str, age_days: int) -> dict[str, str]:
    """``lookups`` selects (url_id, u); the store is ``age_days`` old."""
    stale = age_days > 30
    host_score = ("CASE WHEN rhost <> rroot THEN 98 WHEN list_contains(h.sources, 'urlhaus') OR len(h.sources) >= 2 "
                  "THEN 90 ELSE 35 END")
    if stale:
        host_score = f"least({host_score}, CASE WHEN rhost <> rroot THEN 75 ELSE 30 END)"
    return {
        "feed": FX.duck_view(FX.FEED),
        "fed": f"SELECT lower(trim(source)) AS source, {fingerprint_cols('url')} FROM feed",
        "fed2": f"SELECT *, sha256(fp) AS hash, {root('rhost')} AS rroot FROM fed",
        "store": """SELECT 'url' AS section, hash AS key, list_sort(list(DISTINCT source)) AS sources, 1::BIGINT AS url_count FROM fed2 GROUP BY hash
            UNION ALL SELECT 'host', rhost, list_sort(list(DISTINCT source)), count(DISTINCT hash) FROM fed2 GROUP BY rhost
            UNION ALL SELECT 'root', rroot, list_sort(list(DISTINCT source)), count(DISTINCT hash) FROM fed2 GROUP BY rroot""",
        "asked": f"SELECT url_id, {fingerprint_cols('u')} FROM ({lookups}) AS q",
        "asked2": f"SELECT *, {root('rhost')} AS rroot, sha256(fp) AS hash FROM asked",
        **{f"by_{s}": f"SELECT key, sources, url_count FROM store WHERE section = '{s}'" for s in ("url", "host", "root")},
        "looked": f"""SELECT url_id, u.key IS NOT NULL OR h.key IS NOT NULL AS match,
            CASE WHEN u.key IS NOT NULL THEN 'exact_url' WHEN h.key IS NOT NULL THEN 'host' END AS match_type,
            CASE WHEN u.key IS NOT NULL THEN {85 if stale else 100} WHEN h.key IS NOT NULL THEN {host_score} ELSE 0 END AS score,
            CASE WHEN u.key IS NOT NULL THEN array_to_string(u.sources, ',') WHEN h.key IS NOT NULL THEN array_to_string(h.sources, ',') ELSE '' END AS sources,
            CASE WHEN u.key IS NOT NULL THEN u.url_count WHEN h.key IS NOT NULL THEN h.url_count ELSE 0 END AS url_count,
            CASE WHEN u.key IS NOT NULL THEN 'exact_url' WHEN h.key IS NOT NULL THEN CASE WHEN rhost <> rroot THEN 'dedicated_host'
                WHEN list_contains(h.sources, 'urlhaus') OR len(h.sources) >= 2 THEN 'root_host_multi_source' ELSE 'root_host_single_source' END
                WHEN r.key IS NOT NULL THEN 'root_context_only' END AS evidence_class,
            u.key IS NULL AND h.key IS NULL AND r.key IS NOT NULL AS context_match,
            CASE WHEN u.key IS NULL AND h.key IS NULL AND r.key IS NOT NULL THEN array_to_string(r.sources, ',') ELSE '' END AS context_sources,
            CASE WHEN u.key IS NULL AND h.key IS NULL AND r.key IS NOT NULL THEN r.url_count ELSE 0 END AS context_url_count
            FROM asked2 LEFT JOIN by_url u ON u.key = hash LEFT JOIN by_host h ON h.key = rhost LEFT JOIN by_root r ON r.key = rroot""",
    }


_LOOKUPS = FX.duck_view(FX.CORPUS).replace("SELECT page_id AS url_id, url", "SELECT page_id AS url_id, url AS u")


def on_reputation_scores(final: str) -> str:
    chain = {**CORE, **REGISTRY_DERIVED, **url_ctes(FX.CORPUS), **LABEL_CTES, **SLD_CTES, **token_ctes(TOKEN_CTES),
             **ratio_ctes(RATIO_PAIRS), **VERDICT_CTES, **reputation_ctes(_LOOKUPS, 10),
             **score_ctes("""SELECT url_id, match, match_type, score, replace(sources, ',', ', ') AS sources,
                 context_match, true AS available FROM looked""")}
    return with_ctes(chain, final)


# --- detection log -----------------------------------------------------------

LOG = {"log": FX.duck_view(FX.DETECTIONS)}
ORDER_LOG = {"log": FX.duck_view(FX.DETECTIONS_ORDERS)}
VALID = {"valid": "SELECT * FROM log WHERE riskScore IS NOT NULL AND timestamp IS NOT NULL"}
_HOST = "regexp_replace(string_split(lower(regexp_extract(url, '(?i)^https?://([^/?#\\\\\\s]*)', 1)), '@')[-1], ':\\d*$', '')"
HOSTED = {"hosted": f"SELECT *, {_HOST} AS host FROM valid WHERE regexp_matches({_HOST}, '^[^\\s%<>^|\\[\\]:]+$')"}
TOP_HOSTS = {
    "ranked": """SELECT host, count(*) AS detectionCount, count(*) FILTER (critical_phishing) AS criticalRuleApplications,
        arg_max({'u': url, 's': riskScore, 'c': critical_phishing, 't': timestamp}, {'t': timestamp, 'i': id}) AS latest
        FROM hosted WHERE riskScore >= 80 GROUP BY host""",
}
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_STATS = """count(*) AS totalScans, count(*) FILTER (isPhishing) AS phishingDetected,
    count(*) FILTER (NOT isPhishing) AS safeDetected, floor(avg(riskScore) * 10 + 0.5) / 10 AS avgRiskScore,
    floor(count(*) FILTER (isPhishing)::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS phishingRate"""
BANDS = {"bands": table([(b[0], b[3]) for b in C.RISK_BANDS], "band", "minimum")}


def on_log(final: str, **more) -> str:
    return with_ctes({**LOG, **VALID, **more}, final, recursive=False)


def monthly() -> dict[str, str]:
    return {
        **ORDER_LOG, **VALID,
        "months": f"""SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(
            date_trunc('month', TIMESTAMP '{FX.ORDERS_NOW}') - INTERVAL 11 MONTH,
            date_trunc('month', TIMESTAMP '{FX.ORDERS_NOW}'), INTERVAL 1 MONTH)) AS m)""",
        "monthly": """SELECT month, count(riskScore) AS total, count(*) FILTER (riskScore >= 80) AS highRisk
            FROM months LEFT JOIN valid ON strftime(timestamp, '%Y-%m') = month GROUP BY month""",
    }


_KEYS = {"keys": "SELECT id FROM log WHERE event_type = 'error' AND value > 60"}

# --- evaluation --------------------------------------------------------------


def metrics(source: str) -> dict[str, str]:
    return {
        "cells": f"""SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
            count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM {source}""",
        "rates": """SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r,
            coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS s FROM cells""",
        "measured": """SELECT tn, fp, fn, tp, round_even((tp + tn)::DOUBLE / (tn + fp + fn + tp), 4) AS accuracy,
            round_even((r + s) / 2, 4) AS balanced_accuracy, round_even(p, 4) AS precision, round_even(r, 4) AS recall,
            round_even(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM rates""",
    }


PREDICTIONS = {"predictions": FX.duck_view(FX.PREDICTIONS)}
_EXPECTED = "CASE WHEN kind IN (0, 1, 12, 14, 15, 16, 18, 19) THEN 0 ELSE 1 END"
RULE_CASES = {"cases": f"SELECT *, {_EXPECTED} AS label FROM scored"}
LABELLED = {
    "merged": f"SELECT *, 0 AS priority FROM ({FX.duck_view(FX.LABELLED)}) UNION ALL "
              f"SELECT *, 1 AS priority FROM ({FX.duck_view(FX.RELABELLED)})",
    "kept": """SELECT url, label, arg_max(source, {'p': priority, 'w': sample_weight, 's': source}) AS source,
        arg_max(sample_weight, {'p': priority, 'w': sample_weight, 's': source}) AS sample_weight FROM merged GROUP BY url, label""",
}
SPLIT = {
    **LABELLED,
    "shuffled": """SELECT url, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || url)) AS r,
        count(*) OVER (PARTITION BY label) AS n FROM kept""",
}
ENTRIES = {
    **CORE,
    "pagereg": f"SELECT DISTINCT lower(trim(brand)) AS brand, brand_ord + 1000000 AS brand_ord, ltrim(lower(trim(domain)), '.') AS domain FROM ({FX.duck_view(FX.REGISTRY_ENTRIES)}) WHERE contains(domain, '.')",
    "builtin": table([(b, i, d) for i, (b, ds) in enumerate(
        (line.split(":")[0], line.split(":")[1].split()) for line in C.BUILT_IN_DOMAINS.strip().splitlines()) for d in ds],
        "brand", "brand_ord", "domain"),
    "all_entries": "SELECT * FROM builtin UNION ALL SELECT brand, brand_ord, domain FROM pagereg",
    "registry": """SELECT brand, min(min(brand_ord)) OVER (PARTITION BY brand) AS brand_ord, domain FROM all_entries
        GROUP BY brand, domain""",
}


def on_entries(final: str) -> str:
    ctes = {**{k: v for k, v in ENTRIES.items() if k != "registry"}, "registry": ENTRIES["registry"], **REGISTRY_DERIVED}
    return with_ctes(ctes, final, recursive=False)


# --- features ----------------------------------------------------------------

_U = "feature_url"
_COUNTS = f"""length({_U}) AS url_length, {count(_U, '.')} AS dot_count, {count(_U, '-')} AS hyphen_count,
    {count(_U, '@')} AS at_count, {count(_U, '?')} AS question_count, {count(_U, '=')} AS equals_count,
    {count(_U, '/')} AS slash_count, {matches(_U, '[0-9]')} AS digit_count,
    {matches(_U, '[^a-zA-Z0-9]')} AS special_character_count, regexp_matches({_U}, '{IP}')::INT AS ip_address_flag"""
SIMILARITY = {
    "term_names": "SELECT DISTINCT term FROM terms",
    "sim_pairs": """SELECT sskel, sld, domain, term, levenshtein(sskel, term) AS dist, ratio FROM hosts, term_names
        LEFT JOIN ratios ON a = sskel AND b = term""",
    "sim": """SELECT domain, max(CASE WHEN domain NOT IN (SELECT domain FROM official_hit) AND (
            (sskel = term AND sld <> term) OR (sskel <> term AND (dist <= CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END
            OR ratio >= 0.9))) THEN 1 ELSE 0 END) AS lookalike,
        least(10, min(dist)) AS min_distance, round_even(max(ratio) * 100, 2) AS max_similarity FROM sim_pairs GROUP BY domain""",
}


def on_similarity(final: str) -> str:
    chain = hosts_chain()
    chain["ratio_pairs"] = RATIO_PAIRS + " UNION SELECT sskel, term FROM (SELECT DISTINCT sskel FROM hosts), terms"
    return with_ctes({**chain, **SIMILARITY}, final)


def _sum_of(words_, test: str) -> str:
    return f"len(list_filter({array(words_)}, lambda w: {test}))"


_BRAND_NAMES = "(SELECT list(DISTINCT brand) FROM brands)"
_FEATURES_22 = f"""SELECT url_id, {_COUNTS}, starts_with(lower({_U}), 'https://')::INT AS uses_https,
    length(netloc) AS netloc_length, length(path) AS path_length,
    {_sum_of(C.KEYWORDS, f'contains(lower({_U}), w)')} AS suspicious_keyword_count,
    len(list_filter({_BRAND_NAMES}, lambda w: contains(lower({_U}), w))) AS brand_literal_count,
    len(list_filter({_BRAND_NAMES}, lambda w: contains({skel(f'lower({_U})')}, {skel('w')}))) AS brand_confusable_count,
    (domain IN (SELECT domain FROM official_hit))::INT AS official_domain_flag, lookalike AS domain_lookalike_flag,
    min_distance AS minimum_brand_distance, max_similarity AS maximum_brand_similarity,
    shortener::INT AS shortener_domain_flag,
    (shortener AND (path || ' ' || query) IN (SELECT lure FROM lure_hit))::INT AS shortener_brand_path_flag
    FROM (SELECT *, {norm('rule_url')} AS feature_url FROM urls) JOIN sim USING (domain)"""

_ENTROPY = ("coalesce(-list_sum(list_transform(list_distinct(string_split({0}, '')), lambda ch: "
            "(length({0}) - length(replace({0}, ch, '')))::DOUBLE / length({0}) * "
            "log2((length({0}) - length(replace({0}, ch, '')))::DOUBLE / length({0})))), 0.0)")


def _entropy(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN {_ENTROPY.format(x)} ELSE 0.0 END"


def _features_30() -> str:
    cap = lambda x, top: f"least(({x})::DOUBLE, {top}) / {top}.0::DOUBLE"
    num = lambda x: f"({x})::INT::DOUBLE"
    any_of = lambda t, ws: f"len(list_filter({array(ws)}, lambda w: contains({t}, w))) > 0"
    marker = matches("host", "[01345789@!|$]")
    brands = array(C.LEXICAL_BRANDS)
    cols = {
        "url_length": cap("length(u)", 300), "host_length": cap("length(host)", 120), "path_length": cap("length(path)", 220),
        "query_length": cap("length(query)", 220), "https": num("scheme = 'https'"), "dots": cap(count("host", "."), 8),
        "depth": cap("greatest(len(labels) - 2, 0)", 8), "hyphens": cap(count("host", "-"), 8),
        "digits": cap(matches("u", "[0-9]"), 30),
        "host_digit_ratio": f"least({matches('host', '[0-9]')}::DOUBLE / greatest(1, length(host)), 1.0)",
        "special": cap(matches("u", "[^a-zA-Z0-9]"), 45),
        "keywords": cap(_sum_of(C.LEXICAL_TERMS, f"contains(words, w) OR contains({skel('words')}, {skel('w')})"), 8),
        "ip": num("regexp_matches(host, '^(\\d{1,3}\\.){3}\\d{1,3}$')"), "punycode": num("contains(host, 'xn--')"),
        "percent": num("contains(path, '%') OR contains(query, '%')"), "at": num("contains(u, '@')"),
        "bad_tld": num(f"contains(host, '.') AND string_split(host, '.')[-1] IN {words(C.LEXICAL_BAD_TLDS)}"),
        "sld_entropy": cap(_entropy("sld"), 5), "long_sld": num("length(sld) >= 20"), "double_slash": num("contains(path, '//')"),
        "redirect_query": num(any_of("lower(query)", C.REDIRECT_QUERY_WORDS)),
        "credential_word": num(any_of("words", C.CREDENTIAL_WORDS)), "confusable": num(f"{marker} > 0"),
        "confusable_count": cap(marker, 10), "exact_brand": num(f"list_has_any(tskels, {brands})"),
        "near_brand": num(f"length({skel('sld')}) >= 4 AND len(list_filter({brands}, lambda b: levenshtein({skel('sld')}, b) <= 1)) > 0"),
        "brand_in_root": num(any_of(skel("root"), C.LEXICAL_BRANDS)), "changed_token": num("tokens <> tskels"),
        "many_tokens": num("len(tokens) >= 2"), "com": num("ends_with(host, '.com') OR ends_with(host, '.com.my')"),
    }
    return ("SELECT url_id, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in cols.items()) + f""" FROM (
        SELECT *, list_transform(tokens, lambda t: {skel('t')}) AS tskels FROM (
        SELECT *, list_filter(regexp_split_to_array(sld, '[^a-z0-9]+'), lambda t: length(t) >= 3) AS tokens FROM (
        SELECT *, coalesce(list_filter(string_split(root, '.'), lambda p: p <> '')[1], '') AS sld FROM (
        SELECT *, CASE WHEN len(labels) <= 2 THEN host WHEN array_to_string(labels[-2:], '.') IN {words(C.LEXICAL_TWO_LEVEL)}
            THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS root,
            lower(host || ' ' || path || ' ' || query) AS words FROM (
        SELECT *, list_filter(string_split(host, '.'), lambda p: p <> '') AS labels FROM (
        SELECT url_id, u, lower(regexp_extract(u, '(?i)^(https?)://', 1)) AS scheme,
            trim(string_split(string_split(lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1)), '@')[-1], ':')[1], '.') AS host,
            regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
            regexp_extract(u, '(?i)^https?://[^/?#]*[^?#]*\\?([^#]*)', 1) AS query
        FROM (SELECT url_id, CASE WHEN regexp_matches(trim(url), '^https?://', 'i') THEN trim(url) ELSE 'https://' || trim(url) END AS u
              FROM given)))))))""")


# --- scored text -------------------------------------------------------------


def _explanations() -> str:
    lines = "list_filter([" + ", ".join(
        f"CASE WHEN t_{s} IN ('warning', 'danger') THEN e_{s} END" for s in _SHORT.values()) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lines}) > 0 THEN array_to_string({lines}, ' | ') ELSE {text(M.NO_EXPLANATION)} END"


_RECOMMENDED = "CASE band " + " ".join(f"WHEN {text(k)} THEN {array(v)}" for k, v in M.RECOMMENDATIONS.items()) + " END"


def _indicator(short: str) -> str:
    return f"SELECT url_id, s_{short} AS score, t_{short} AS status, e_{short} AS explanation FROM scored"


def _long(fields: str) -> str:
    return " UNION ALL ".join(
        "SELECT " + fields.format(n=text(n), s=S[n], t=f"t_{_SHORT[n]}", w=w, u="true" if w else "false") + " FROM scored"
        for n, w in C.INDICATOR_WEIGHTS.items())


def _calibrated() -> str:
    p, f = "(url_id % 101 / 100.0::DOUBLE)", "lexical"
    s = f"(({p} * 100 + 1) / 102)"
    return (f"greatest(0.02::DOUBLE, least(0.95::DOUBLE, CASE WHEN {p} <= 0.5 AND {f} >= 0.7 THEN {f} * 0.85::DOUBLE + {s} * 0.15::DOUBLE "
            f"WHEN {p} <= 0.02 OR {p} >= 0.98 THEN {f} * 0.7::DOUBLE + {s} * 0.3::DOUBLE ELSE {f} * 0.4::DOUBLE + {s} * 0.6::DOUBLE END))")


_DISPLAY = ("com.my edu.my gov.my org.my net.my co.uk org.uk ac.uk com.au net.au org.au co.jp ne.jp co.id or.id "
            "com.sg com.br").split()


def _evidence() -> str:
    """Evidence lines from the SQL side's own match columns."""
    def fmt(template, value, condition=None):
        return f"CASE WHEN {condition or value + ' IS NOT NULL'} THEN printf({text(template)}, {value}) END"

    entry = "CASE off_branch WHEN 1 THEN off.d WHEN 4 THEN tok.s WHEN 5 THEN skl.d END"
    shown = root(f"({entry})", _DISPLAY)
    off_brand = "CASE off_branch WHEN 1 THEN off.b WHEN 3 THEN sub.b WHEN 4 THEN tok.b WHEN 5 THEN skl.b END"
    homo_brand = "CASE homo_branch WHEN 3 THEN sub.b WHEN 6 THEN tok.b WHEN 7 THEN skl.b WHEN 8 THEN typ.b END"
    homo_official = "CASE homo_branch WHEN 6 THEN tok.s END"
    brand_brand = "CASE brand_branch WHEN 3 THEN sbs.b WHEN 4 THEN dst.b END"
    points = lambda t, s: f"printf({text(t)}, {s}::BIGINT)"
    sets = {
        "officialDomain": [
            fmt("Protected brand: %s.", off_brand), fmt("User-entered domain: %s.", "domain", "off_branch <> 6"),
            fmt("Official reference root: %s.", shown, f"({entry}) IS NOT NULL"),
            fmt("Official registry reference: %s.", entry, f"({entry}) <> ({shown})"),
            fmt("Protected official parent domain: %s.", "sub.d", "off_branch = 3"),
            fmt("Protected brand token: %s.", "tok.t", "off_branch = 4"),
            fmt("Official-domain registry risk points: %d/100.", "s_off::BIGINT", "off_branch = 6")],
        "reputationEvidence": ["'Offline reputation match count: 0.'"],
        "aiModelProbability": [
            points_percent("Calibrated AI-assisted probability: %.2f%%."), points_percent("Raw model probability: %.2f%%."),
            points_percent("URL lexical-evidence probability: %.2f%%."), points("Adjusted AI risk score: %d/100.", "s_ai")],
        "brandVerification": [
            fmt("Protected brand evidence: %s.", brand_brand),
            fmt("User-entered domain: %s.", "domain", "brand_branch IN (1, 3, 4)"),
            points("Brand-impersonation risk points: %d/100.", "s_brand")],
        "homographAttack": [
            fmt("Protected brand evidence: %s.", homo_brand),
            fmt("User-entered domain: %s.", "domain", "homo_branch IN (1, 3, 5, 6, 7, 8)"),
            fmt("Official reference root: %s.", root(f"({homo_official})", _DISPLAY), f"({homo_official}) IS NOT NULL"),
            fmt("Similarity token: %s.", "tok.t", "homo_branch = 6"),
            points("Homograph and typosquatting risk points: %d/100.", "s_homo")],
        "httpsUsage": [
            fmt("Submitted URL scheme: %s.", "upper(scheme)"), "'TLS certificate validation scope: URL-scheme analysis.'",
            points("HTTPS usage risk points: %d/100.", "s_https")],
        "urlLengthComplexity": [
            f"printf('URL length: %d characters.', {_SIZE})", f"printf('Special-character count: %d.', {_SPECIAL})",
            points("URL length and complexity risk points: %d/100.", "s_len")],
    }
    lists = {n: "list_filter([" + ", ".join(v) + "], lambda x: x IS NOT NULL)" for n, v in sets.items()}
    lists["urlStructure"] = (f"list_concat([{points('URL structure risk points: %d/100.', 's_str')}], "
                             "list_transform(str_list, lambda r: 'Structure evidence: ' || r || '.'))")
    lists["suspiciousKeywords"] = (
        f"[{points('Suspicious keyword risk points: %d/100.', 's_kw')}, CASE WHEN len(keywords) > 0 THEN "
        "'Detected keyword tokens: ' || array_to_string(keywords, ', ') || '.' ELSE 'Detected keyword token count: 0.' END]")
    branch = {
        "off_branch": "CASE WHEN off IS NOT NULL THEN 1 WHEN provider IS NOT NULL THEN 2 WHEN sub IS NOT NULL THEN 3 "
                      "WHEN tok IS NOT NULL THEN 4 WHEN skl IS NOT NULL THEN 5 ELSE 6 END",
        "brand_branch": "CASE WHEN provider IS NOT NULL THEN 1 WHEN off IS NOT NULL THEN 2 WHEN sbs IS NOT NULL AND "
                        "(dst IS NULL OR sbs.o <= dst.o) THEN 3 WHEN dst IS NOT NULL THEN 4 ELSE 5 END",
        "homo_branch": f"CASE WHEN provider IS NOT NULL THEN 1 WHEN off IS NOT NULL THEN 2 WHEN sub IS NOT NULL THEN 3 "
                       f"WHEN contains(domain, 'xn--') THEN 4 WHEN {_CONF_TLD} THEN 5 WHEN tok IS NOT NULL THEN 6 "
                       "WHEN skl IS NOT NULL THEN 7 WHEN typ IS NOT NULL THEN 8 ELSE 9 END",
    }
    source = "(SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in branch.items()) + " FROM scored)"
    rows = " UNION ALL ".join(f"SELECT url_id, {text(n)} AS name, {v} AS ls FROM {source}" for n, v in lists.items())
    return f"SELECT url_id, name, unnest(range(0, len(ls))) AS position, unnest(ls) AS line FROM ({rows})"


def points_percent(template: str) -> str:
    return f"printf({text(template)}, round_even(lexical * 100, 2))"


_GUIDANCE = """SELECT url_id, unnest(range(0, len(g))) AS position, unnest(g) AS text FROM (SELECT url_id, list_filter([
    printf('Final risk score: %d/100.', risk::BIGINT),
    CASE WHEN off IS NOT NULL THEN printf('Verified official-domain registry entry: %s.', off.d)
         WHEN risk < 20 THEN 'Analysis record: Trusted risk band with the displayed indicator evidence.'
         WHEN risk < 45 THEN 'Analysis record: Low Risk band with the displayed indicator evidence.' END,
    CASE WHEN off IS NOT NULL THEN printf('Service access path: %s.', off.d)
         WHEN risk < 45 THEN 'Service access path: confirm the provider domain through an official channel.'
         ELSE 'Service access path: use the verified official domain from the provider''s official channel.' END,
    CASE WHEN off IS NULL AND risk >= 45 AND critical THEN 'Critical-rule evidence: recorded in the detailed calculation section.' END],
    lambda x: x IS NOT NULL) AS g FROM scored)"""

_TEMPLATES = {
    "brand": ["'http://' || brand || '-' || term || '-security.' || tld", "'https://' || brand || '-' || term || '-account.' || tld",
              "'https://secure-' || brand || '-' || term || '.' || tld || '/login'",
              "'https://' || brand || '.com.' || term || '.security.' || tld || '/account'"],
    "token": ["'https://' || token || '.com'", "'https://www.' || token || '.com/login'", "'https://secure-' || token || '.com/account'",
              "'http://' || token || '-login-security.com'", "'https://' || token || '-account-verify.click/login'",
              "'https://' || token || '.com.verify.security.xyz/account'",
              "'https://' || brand || '.com@' || token || '-login-security.com/verify'"],
    "fake": ["'https://www.' || fake || '.com'", "'http://' || fake || '-login-security.com'",
             "'https://' || fake || '-account-verify.click/login'"],
    "link": ["'https://' || s || '/go/' || token", "'https://' || s || '/' || token || '-login'",
             "'https://' || s || '/redirect/' || token || '/verify'", "'https://' || s || '/?to=' || token || '-secure'"],
}


def _augmented() -> str:
    terms = "login verify secure security account update payment confirm password reset locked support".split()
    tlds = "com net xyz top click info ru tk work loan".split()
    short = C.SHORTENERS[:14]
    each = lambda key: ", ".join(_TEMPLATES[key])
    return f"""SELECT unnest(['https://' || domain || '/', 'https://' || domain || '/help', 'https://' || domain || '/settings',
            'https://' || domain || '/account']) AS url, 0 AS label, 'synthetic_safe' AS source, 8.0 AS sample_weight
        FROM (SELECT DISTINCT domain, sld FROM urls)
      UNION ALL SELECT url, 1, 'synthetic_phishing', 30.0 FROM (
        SELECT unnest([{each('brand')}]) AS url FROM (SELECT brand, term, {array(tlds)}[(i + length(brand)) % 10 + 1] AS tld
            FROM (SELECT brand, unnest(range(0, 12)) AS i, unnest({array(terms)}) AS term FROM (SELECT DISTINCT sld AS brand FROM urls)))
        UNION ALL SELECT unnest([{each('token')}]) FROM toks
        UNION ALL SELECT unnest([{each('link')}]) FROM (SELECT token, unnest({array(short)}) AS s FROM toks)
        UNION ALL SELECT unnest([{each('fake')}]) FROM (SELECT DISTINCT {skel('sld')} AS fake FROM urls)
        UNION ALL SELECT unnest([u, '.' || u, replace(u, '://', '：//'), '.' || replace(u, '://', '：//'), 'https://' || u, 'https://.' || u])
            FROM (SELECT 'https://' || s || '/' || sld || '-login' AS u FROM (SELECT sld, unnest({array(short)}) AS s FROM (SELECT DISTINCT sld FROM urls)))
        UNION ALL SELECT unnest(['http://' || b || '.10/login', 'http://' || b || '.20/verify/account', 'http://' || b || '.30/payment?session=0abc'])
            FROM (SELECT DISTINCT array_to_string(string_split(domain, '.')[1:3], '.') AS b FROM urls WHERE regexp_matches(domain, '{IP}')))"""


ORACLES = {
    "load_labelled_urls": FX.duck_view(FX.LABELLED),
    # The file begins with two lists, whose strings are numbered as well, and the name of the section; then come the brands in order.
    "load_domain_registry": on_entries("SELECT brand, brand_ord, domain, exact_only FROM official").replace(
        "brand_ord + 1000000 AS brand_ord", f"dense_rank() OVER (ORDER BY brand) + {1000001 + len(C.EXACT_ONLY_DOMAINS) + len(C.SHARED_HOSTING_DOMAINS)} AS brand_ord", 1),
    "load_reputation_tables": with_ctes(reputation_ctes(_LOOKUPS, 10),
        "SELECT section, key, array_to_string(sources, ',') AS sources, url_count FROM store", False),
    "append_detections": on_log("""SELECT id, url, CASE WHEN event_type = 'click' THEN 100 - riskScore ELSE riskScore END AS riskScore,
        CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS version, strftime(timestamp, '%Y-%m') AS month FROM valid"""),
    "scan_by_key_prefix": on_log("SELECT id, url, riskScore FROM log WHERE starts_with(id, 'detection:anonymous:')"),
    "lookup_by_keys": on_log("SELECT id, url, riskScore FROM log WHERE id IN (SELECT id FROM keys)", **_KEYS),
    "remove_by_keys": on_log("SELECT id, url, riskScore FROM log WHERE id NOT IN (SELECT id FROM keys)", **_KEYS),
    "export_cases": on_log("""SELECT string_split(id, ':')[-1] AS caseId, CASE WHEN userId = 'anonymous' THEN 'Anonymous User'
        ELSE 'Registered User' END AS source, url, riskScore, isPhishing, critical_phishing FROM log
        WHERE id IN (SELECT id FROM keys)""", **_KEYS),
    "export_header": on_log(f"SELECT count(*) AS totalCases, '{FX.NOW}' AS exportDate FROM log WHERE id IN (SELECT id FROM keys)", **_KEYS),
    "write_training_report": with_ctes({**hosts_chain(), **score_ctes(), **RULE_CASES, **metrics("cases")}, f"""
        SELECT printf('accuracy: %.4f', accuracy) AS line FROM measured UNION ALL SELECT printf('balanced_accuracy: %.4f', balanced_accuracy) FROM measured
        UNION ALL SELECT printf('precision: %.4f', precision) FROM measured UNION ALL SELECT printf('recall: %.4f', recall) FROM measured
        UNION ALL SELECT printf('f1: %.4f', f1) FROM measured
        UNION ALL SELECT printf('label %d: %d rows', label, count(*)) FROM cases GROUP BY label
        UNION ALL SELECT printf('source overlay: %d rows', count(*)) FROM cases
        UNION ALL SELECT printf('%s | url_%d | expected=%d predicted=%d probability=%.4f | %s',
            CASE WHEN (risk >= 45) = (label = 1) THEN 'PASS' ELSE 'FAIL' END, url_id, label, (risk >= 45)::INT, risk / 100.0::DOUBLE, url) FROM cases"""),
    "validate_scores": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'n/a' ELSE floor(value)::BIGINT::VARCHAR END AS risk_score,
        event_type <> 'view' AND floor(value) BETWEEN 0 AND 100 AS valid FROM events""",
    "normalize_urls": on_urls("SELECT url_id, raw AS url, url AS normalized_url FROM prep"),
    "obfuscate_urls": with_ctes(url_ctes(FX.CORPUS), "SELECT url_id, unnest(range(0, 6)) AS variant, url AS normalized_url FROM prep", False),
    "split_urls": on_urls("""SELECT url_id, scheme, netloc, path, query, raw_domain, domain,
        contains(netloc, '[') <> contains(netloc, ']') AS parse_error FROM urls"""),
    # One inserted letter at the front of a label: its punycode has three digits.
    "idna_hosts": with_ctes(URLS | {
        "page_hosts": f"SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM ({FX.duck_view(FX.CORPUS)})",
        "split": "SELECT host, string_split(host, '.')[1] AS first, substr(host, length(string_split(host, '.')[1]) + 1) AS rest FROM page_hosts",
        "delta": "SELECT *, 124 * (length(first) + 1) - 1 AS d FROM split",
        "digits": "SELECT *, 1 + d % 35 AS d1, 1 + (d // 35 - 1) % 35 AS d2, (d // 35 - 1) // 35 AS d3 FROM delta"},
        """SELECT 'ü' || host AS raw_domain, 'xn--' || first || '-' || abc[d1 + 1] || abc[d2 + 1] || abc[d3 + 1] || rest AS domain
        FROM digits, (SELECT 'abcdefghijklmnopqrstuvwxyz0123456789' AS abc)""", False),
    "ngram_tokens": on_urls("""SELECT url_id, list_sum(list_transform(range(2, 7), lambda n: greatest(0, length(url) - n + 1)))::BIGINT AS char_grams,
        len(w) AS words, len(w) + greatest(len(w) - 1, 0) AS word_grams FROM (SELECT *, regexp_extract_all(lower(url), '[a-z0-9]{2,}') AS w FROM prep)"""),
    "registrable_domain": on_urls("SELECT DISTINCT domain, root, sld, tld FROM urls"),
    "confusable_skeleton": on_urls(f"SELECT url_id, {skel('domain')} AS domain_skeleton, {skel('path || query')} AS rest_skeleton FROM urls"),
    "confusable_marker_flag": on_urls(f"SELECT label, {has_marker('label')} AS has_marker FROM (SELECT DISTINCT unnest(string_split(domain, '.')) AS label FROM urls)"),
    "url_fingerprint": on_urls(f"""SELECT url_id, fp AS fingerprint, sha256(fp) AS fingerprint_hash, rhost AS rep_host, {root('rhost')} AS rep_root
        FROM (SELECT url_id, {fingerprint_cols('url')} FROM prep2)"""),
    "lexical_counts": on_urls(f"SELECT url_id, {_COUNTS} FROM (SELECT *, url AS feature_url FROM prep)"),
    "features_22": on_similarity(_FEATURES_22),
    "features_5": on_urls(f"""SELECT url_id, length(raw) AS url_length, starts_with(lower(raw), 'https://')::INT AS uses_https,
        {count('raw', '.')} AS dot_count, {count('raw', '-')} AS hyphen_count, {_sum_of(C.SHORT_KEYWORDS, 'contains(lower(raw), w)')} AS keyword_count FROM prep"""),
    "features_30": on_urls(_features_30()),
    "sld_entropy": on_urls(f"SELECT sld, round({_entropy('sld')}, 9) AS entropy FROM (SELECT DISTINCT sld FROM urls)"),
    "numeric_columns_only": """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem""",
    "response_projection": on_scored(f"""SELECT url_id, url, prediction, decision, result, risk AS risk_score, 100 - risk AS safety_score,
        critical AS critical_phishing, array_to_string(reasons, '; ') AS critical_reasons,
        round_even(lexical * 100, 2) AS feature_ai_probability_percent, s_ai AS ai_score, {_explanations()} AS explanations,
        array_to_string({_RECOMMENDED}, ' | ') AS recommendations FROM scored"""),
    "valid_detections": on_log("SELECT id, riskScore FROM valid"),
    "search_detections": on_log("""SELECT id, url, riskScore, userId FROM valid WHERE timestamp >= TIMESTAMP '2024-01-05'
        AND timestamp <= TIMESTAMP '2024-01-20 23:59:59.999' AND riskScore >= 80 AND NOT critical_phishing
        AND contains(lower(url), 'example.') AND (contains(lower(userEmail), 'user1') OR lower(userId) = 'user1')"""),
    "single_http_url_gate": on_urls("""SELECT url_id, len(regexp_extract_all(raw, '(?i)https?://')) = 1 AND NOT regexp_matches(raw, '\\s')
        AND regexp_matches(raw, '^https?://', 'i') AND regexp_matches(raw, '^https?://[^/?#]+', 'i') AS accepted FROM prep"""),
    "reject_empty_urls": on_urls("SELECT url_id, url AS normalized_url FROM prep WHERE NOT contains(raw, '?')"),
    "ip_or_at_url_flag": on_urls(f"SELECT url_id, regexp_matches(domain, '{IP}') AS ip_host, contains(rule_url, '@') AS at_sign FROM urls"),
    "confusable_tld_flag": on_urls(f"SELECT url_id, tld, {_CONF_TLD} AS confusable FROM urls"),
    "verified_official_filter": on_scored("SELECT url_id, off.b AS official_brand, off.d AS official_domain FROM scored WHERE t_off = 'safe'"),
    "match_official_domain": on_hosts("SELECT domain, hit.b AS official_brand, hit.d AS official_domain FROM official_hit"),
    "match_shared_hosting": on_hosts("SELECT domain, provider AS shared_provider FROM hosting"),
    "match_shortener": on_urls("SELECT DISTINCT domain, shortener FROM urls"),
    "lookalike_subdomain": on_hosts("""SELECT domain, s.hit.b AS subdomain_brand, s.hit.d AS subdomain_parent,
        string_agg(label || '~' || b.hit.p || '~' || b.hit.d, ',' ORDER BY pos) AS labels FROM subdomain_hit s JOIN bad_labels b USING (domain)
        WHERE pos < n - s.hit.m GROUP BY domain, s.hit"""),
    "skeleton_domain_match": on_hosts("SELECT domain, hit.b AS brand, hit.d AS official FROM skeleton_hit"),
    "brand_token_in_root": on_hosts("SELECT domain, hit.b AS brand, hit.raw AS raw_token, hit.t AS term, hit.s AS source FROM token_hit"),
    "brand_like_token": with_ctes(hosts_chain(LURE_TEXTS), """SELECT lure AS lure_text, hit.b AS brand, hit.token AS token, hit.t AS term,
        hit.d AS distance, round_even(hit.r, 3) AS similarity FROM lure_hit"""),
    "brand_substring_host": on_hosts("SELECT domain, hit.b AS brand FROM substring_hit"),
    "typo_distance_match": on_hosts("SELECT domain, hit.b AS brand, hit.d AS official, hit.r AS official_root FROM distance_hit"),
    "typo_ratio_match": on_hosts("""SELECT domain, hit.b AS brand, hit.d AS official, hit.dist AS distance, round_even(hit.ratio, 4) AS ratio,
        brands AS typo_brands FROM typo_hit"""),
    "brand_similarity_features": on_similarity("SELECT * FROM sim"),
    "keyword_hits": on_urls(f"SELECT url_id, array_to_string(k, ',') AS keywords, len(k) AS n FROM (SELECT url_id, {_KEYWORD_FOUND} AS k FROM urls)"),
    "tld_risk_lookup": on_urls("SELECT url_id, tld, points FROM urls LEFT JOIN bad_tlds USING (tld)"),
    **{name: with_ctes(reputation_ctes(_LOOKUPS, age), f"""SELECT *, '{generated}' AS generated_at_utc, (SELECT concat_ws(',',
        count(*) FILTER (section = 'url'), count(*) FILTER (section = 'host'), count(*) FILTER (section = 'root')) FROM store) AS counts,
        NULL::VARCHAR AS load_error, '{M.REPUTATION_POLICY}' AS policy FROM looked""", False)
       for name, age, generated in (("reputation_cascade", 10, "2024-01-22T00:00:00"), ("reputation_cascade_stale", 45, "2023-12-18T00:00:00"))},
    "label_predictions": "SELECT doc_id, toxic AS label, (n_chars > 1000)::INT AS prediction FROM labels JOIN documents USING (doc_id)",
    "ind_official_domain": on_scored(_indicator("off")),
    "ind_reputation": on_reputation_scores(_indicator("rep")),
    "ind_ai_probability": on_scored("SELECT url_id, ai0 AS score FROM scored"),
    "ind_brand": on_scored(_indicator("brand")),
    "ind_homograph": on_scored(_indicator("homo")),
    "ind_url_structure": on_scored(_indicator("str")),
    "ind_keywords": on_scored(_indicator("kw")),
    "ind_https": on_scored(_indicator("https")),
    "ind_length": on_scored(_indicator("len")),
    "lexical_probability": on_scored("SELECT url_id, round(lexical, 9) AS probability FROM scored"),
    "calibrate_probability": on_scored(f"SELECT url_id, round({_calibrated()}, 9) AS calibrated FROM scored"),
    "official_clean_correction": on_scored("SELECT url_id, clean AS official_clean, s_ai AS ai_score FROM scored"),
    "weighted_score": on_scored("SELECT url_id, weighted AS weighted_score, rounded AS rounded_score FROM scored"),
    "critical_reasons": on_scored("SELECT url_id, critical, array_to_string(reasons, '; ') AS reasons FROM scored"),
    "critical_top3": on_scored("""SELECT url_id, array_to_string(list_transform(top, lambda s: s.n || '=' || (-s.r)), ',') AS signals,
        evidence AS critical_score FROM scored"""),
    "override_chain": on_scored("SELECT url_id, rounded AS rounded_score, risk AS risk_score, overrides FROM scored"),
    "risk_band": on_scored("SELECT url_id, risk AS risk_score, 100 - risk AS safety_score, result, decision, prediction FROM scored"),
    "explanations": on_scored(f"SELECT url_id, {_explanations()} AS explanations FROM scored"),
    "recommendations": on_scored(f"SELECT url_id, unnest(range(0, len(r))) AS position, unnest(r) AS text FROM (SELECT url_id, {_RECOMMENDED} AS r FROM scored)"),
    "score_audit": on_scored("""SELECT url_id, weighted AS weighted_score_before_overrides, rounded AS rounded_weighted_score, risk AS final_risk_score,
        round_even(rounded - weighted, 2) AS rounding_adjustment_points, risk - rounded AS override_adjustment_points FROM scored"""),
    "scoring_config": with_ctes({**hosts_chain(), **score_ctes(), "long": _long("{n} AS name, {s} AS score"), "config": table(
        [(i, n, label, w, str(w > 0).lower(), "weighted" if w else "rule_override") for i, (n, w, label, _) in enumerate(C.INDICATORS)],
        "ord", "name", "label", "weight_percent", "used", "scoring_mode")},
        """SELECT ord, name, label, weight_percent, used::BOOLEAN AS used_in_final_score, scoring_mode, count(*) AS n, sum(score) AS total_score,
        sum(score) * weight_percent AS weighted_hundredths FROM config JOIN long USING (name)
        GROUP BY ord, name, label, weight_percent, used, scoring_mode"""),
    "indicators_long": on_scored(_long("""url_id, {n} AS name, {s} AS score, 100 - {s} AS safety_score, {t} AS status, {w} AS weight_percent,
        {s} * {w} / 100.0::DOUBLE AS contribution, {u} AS used_in_final_score""")),
    "evidence_statements": on_scored(_evidence()),
    "action_guidance": on_scored(_GUIDANCE),
    "score_urls": on_scored("SELECT url_id, url, domain, " + ", ".join(f"{S[n]} AS {n}" for n in C.INDICATOR_NAMES) +
                            ", weighted AS weighted_score, risk AS risk_score, result, critical FROM scored"),
    "score_urls_with_reputation": on_reputation_scores(
        "SELECT url_id, s_rep AS reputation, weighted AS weighted_score, risk AS risk_score, result, critical FROM scored"),
    "pages_per_band": on_scored("""SELECT band, count(*) AS pages, count(*) FILTER (critical) AS critical, max(risk) AS worst_score,
        arg_max(domain, {'r': risk, 'd': domain}) AS worst_host FROM scored GROUP BY band"""),
    "basic_statistics": on_log(f"SELECT {_STATS} FROM valid"),
    "basic_statistics_per_user": on_log(f"SELECT userId, {_STATS} FROM valid GROUP BY userId"),
    "risk_band_counts": on_log(f"""SELECT bands.band, minimum, count(v.id) AS n FROM bands LEFT JOIN
        (SELECT id, {band('riskScore', 0)} AS band FROM valid) v ON v.band = bands.band GROUP BY bands.band, minimum""", **BANDS),
    "monthly_stats": with_ctes(monthly(), "SELECT * FROM monthly", False),
    "months_ascending": with_ctes(monthly(), "SELECT month[6:7] || '/' || month[1:4] AS label, month, total, highRisk FROM monthly ORDER BY month", False),
    "top_high_risk_hosts": on_log(f"""SELECT host, detectionCount, criticalRuleApplications, latest.u AS latestSubmittedUrl, latest.s AS latestRiskScore,
        latest.c AS latestCriticalRuleApplied, {_TIME.format('latest.t')} AS latestTimestamp FROM ranked
        ORDER BY detectionCount DESC, latest.t DESC, host LIMIT 10""", **HOSTED, **TOP_HOSTS),
    "abused_domain_counts": on_log("""SELECT host AS domain, detectionCount AS count FROM ranked
        ORDER BY detectionCount DESC, latest.t DESC, host LIMIT 10""", **HOSTED, **TOP_HOSTS),
    "top_k_hosts": on_log("""SELECT host, detectionCount FROM ranked ORDER BY detectionCount DESC, latest.t DESC, host LIMIT 3""", **HOSTED, **TOP_HOSTS),
    "global_statistics": on_log(f"""SELECT {_STATS}, {', '.join(f"count(*) FILTER ({band('riskScore', 0)} = '{b[0]}') AS {b[0]}" for b in C.RISK_BANDS)},
        count(*) FILTER (critical_phishing) AS criticalRuleApplications, count(DISTINCT userId) AS uniqueUsers,
        count(*) FILTER (userId = 'anonymous') AS anonymousScans,
        (SELECT string_agg(concat_ws(':', m.month, coalesce(v.total, 0), coalesce(v.high, 0)), ',' ORDER BY m.month) FROM (
            SELECT strftime(unnest(generate_series(date_trunc('month', TIMESTAMP '{FX.NOW}') - INTERVAL 11 MONTH, TIMESTAMP '{FX.NOW}', INTERVAL 1 MONTH)), '%Y-%m') AS month) m
            LEFT JOIN (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (riskScore >= 80) AS high
            FROM valid GROUP BY 1) v ON v.month = m.month) AS months,
        (SELECT coalesce(string_agg(concat_ws(' ', host, detectionCount, criticalRuleApplications, latest.u, latest.s, latest.c,
            strftime(latest.t, '%Y-%m-%d %H:%M:%S')), ',' ORDER BY detectionCount DESC, latest.t DESC, host), '') FROM (
            SELECT * FROM ranked ORDER BY detectionCount DESC, latest.t DESC, host LIMIT 10)) AS hosts
        FROM valid""", **HOSTED, **TOP_HOSTS),
    "daily_risk_trend": on_log("""SELECT strftime(timestamp, '%Y-%m-%d') AS date, floor(avg(riskScore) + 0.5)::BIGINT AS avgRisk FROM valid
        GROUP BY 1 ORDER BY 1 DESC LIMIT 7"""),
    "recent_scan_count": on_log(f"SELECT count(*) AS recentScans FROM valid WHERE timestamp >= TIMESTAMP '{FX.NOW}' - INTERVAL 7 DAY"),
    "indicator_status_counts": with_ctes({**hosts_chain(), **score_ctes(), "long": _long("{n} AS name, {t} AS status")}, """
        SELECT name, count(*) FILTER (status = 'safe') AS safe, count(*) FILTER (status = 'warning') AS warning,
        count(*) FILTER (status = 'danger') AS danger FROM long GROUP BY name"""),
    "band_percentages": on_log(f"""SELECT bands.band, count(v.id) AS n, floor(count(v.id) * 100.0::DOUBLE / (SELECT count(*) FROM valid) * 100 + 0.5) / 100 AS percent
        FROM bands LEFT JOIN (SELECT id, {band('riskScore', 0)} AS band FROM valid) v ON v.band = bands.band GROUP BY bands.band""", **BANDS),
    "label_distribution": with_ctes(LABELLED, "SELECT label, count(*) AS n FROM merged GROUP BY label", False),
    "source_distribution": with_ctes(LABELLED, "SELECT source, count(*) AS n FROM merged GROUP BY source", False),
    "confusion_matrix": with_ctes({**PREDICTIONS, **metrics("predictions")}, "SELECT * FROM cells", False),
    "classification_metrics": with_ctes({**PREDICTIONS, **metrics("predictions")}, "SELECT * FROM measured", False),
    "roc_auc": with_ctes(PREDICTIONS, """SELECT round_even(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE
        / count(*), 4) AS roc_auc FROM (SELECT score FROM predictions WHERE label = 1) p, (SELECT score FROM predictions WHERE label = 0) n""", False),
    "regression_pass_rate": with_ctes({**hosts_chain(), **score_ctes(), **RULE_CASES}, """SELECT count(*) AS cases,
        count(*) FILTER ((risk >= 50) = (label = 1)) AS passed, round_even(avg(((risk >= 50) = (label = 1))::INT), 4) AS pass_rate FROM cases"""),
    "quality_gate": with_ctes({**hosts_chain(), **score_ctes(), **RULE_CASES, **PREDICTIONS, **metrics("predictions")}, """
        SELECT accuracy, pass_rate, accuracy >= 0.9 AND pass_rate >= 0.9 AS accepted FROM measured,
        (SELECT round_even(avg(((risk >= 50) = (label = 1))::INT), 4) AS pass_rate FROM cases)"""),
    "feature_audit": on_similarity("SELECT url_id, position, feature, value, true AS is_share, 1.0 AS importance_total, 100.0 AS percent_total FROM ("
        + " UNION ALL ".join(f"SELECT url_id, {i} AS position, '{n}' AS feature, {n}::DOUBLE AS value FROM f" for i, n in enumerate(C.MODEL_FEATURES))
        + ")").replace("SELECT url_id, position", f", f AS ({_FEATURES_22}) SELECT url_id, position", 1),
    "build_brand_terms": on_entries("SELECT brand, term, source FROM terms"),
    "build_protected_labels": on_entries("SELECT pskel AS skel, array_to_string(approved, ',') AS approved FROM protected"),
    "merge_registry_sets": on_entries("SELECT brand, count(*) AS domains, min(domain) AS first_domain FROM registry GROUP BY brand"),
    "reputation_store_metadata": with_ctes(reputation_ctes(_LOOKUPS, 10), """SELECT count(*) FILTER (section = 'url') AS url_fingerprints,
        count(*) FILTER (section = 'host') AS hosts, count(*) FILTER (section = 'root') AS roots, 10 AS age_days, false AS stale, true AS available FROM store""", False),
    "recent_history": on_log(f"""SELECT userId, id, rank, {_TIME.format('timestamp')} AS timestamp FROM (SELECT *, row_number() OVER
        (PARTITION BY userId ORDER BY timestamp DESC, id) AS rank FROM (SELECT userId, url, timestamp, min(id) AS id FROM valid GROUP BY userId, url, timestamp))
        WHERE rank <= 5"""),
    "first_match": on_hosts("""SELECT domain, coalesce(o.hit.b, s.hit.b, t.hit.b, k.hit.b, b.hit.b, y.hit.b) AS first_brand FROM hosts
        LEFT JOIN official_hit o USING (domain) LEFT JOIN subdomain_hit s USING (domain) LEFT JOIN token_hit t USING (domain)
        LEFT JOIN skeleton_hit k USING (domain) LEFT JOIN substring_hit b USING (domain) LEFT JOIN typo_hit y USING (domain)
        LEFT JOIN hosting g USING (domain) LEFT JOIN first_bad f USING (domain)
        WHERE o.hit IS NOT NULL OR s.hit IS NOT NULL OR t.hit IS NOT NULL OR k.hit IS NOT NULL OR b.hit IS NOT NULL OR y.hit IS NOT NULL
        OR provider IS NOT NULL OR bad IS NOT NULL OR domain IN (SELECT domain FROM under)"""),
    "latest_per_host": on_log(f"""SELECT host, d.id AS id, d.url AS url, d.r AS riskScore, {_TIME.format('d.t')} AS timestamp FROM (
        SELECT host, arg_max({{'id': id, 'url': url, 'r': riskScore, 't': timestamp}}, {{'t': timestamp, 'i': id}}) AS d FROM hosted GROUP BY host)""", **HOSTED),
    "top3_signals": on_scored("SELECT url_id, position, s.n AS name, -s.r AS score FROM (SELECT url_id, unnest(range(0, 3)) AS position, unnest(top) AS s FROM scored)"),
    "detections_newest_first": on_log("SELECT id, riskScore FROM valid WHERE starts_with(id, 'detection:7:')"),
    "union_training_sources": with_ctes(LABELLED, "SELECT * FROM merged", False),
    "dedupe_keep_last": with_ctes(LABELLED, "SELECT * FROM kept", False),
    "augment_cases": with_ctes({**URLS, "toks": f"SELECT DISTINCT sld AS brand, {skel('sld')} AS token FROM urls"}, _augmented(), False),
    "stratified_split": with_ctes(SPLIT, "SELECT url, label, r <= floor(n * 0.2 + 0.5) AS is_test FROM shuffled", False),
    "class_weights": with_ctes(PREDICTIONS, """SELECT doc_id, label, round(2.0::DOUBLE * count(*) OVER () / ((SELECT count(DISTINCT label) FROM predictions)
        * count(*) OVER (PARTITION BY label)), 9) AS weight FROM predictions""", False),
    "evaluate_rules": with_ctes({**hosts_chain(), **score_ctes(), **RULE_CASES, **metrics("cases")}, "SELECT * FROM measured"),
    "stream_score_urls": with_ctes({**CORE, **REGISTRY_DERIVED, **url_ctes(FX.CORPUS), **LABEL_CTES, **SLD_CTES, **token_ctes(TOKEN_CTES),
        **ratio_ctes(RATIO_PAIRS), **VERDICT_CTES, **score_ctes()}, "SELECT url_id, url, risk AS risk_score, result, critical FROM scored"),
    "stream_dedupe": on_log("SELECT id, CASE WHEN event_type = 'click' THEN 100 - riskScore ELSE riskScore END AS riskScore FROM valid"),
    "stream_band_counts": on_log(f"""SELECT {_TIME.format("date_trunc('day', timestamp)")} AS window_start, {band('riskScore', 0)} AS band, count(*) AS n
        FROM valid GROUP BY 1, 2"""),
    "stream_top_hosts": on_log(f"""SELECT host, detectionCount, criticalRuleApplications, {_TIME.format('latest.t')} AS latestTimestamp FROM ranked
        ORDER BY detectionCount DESC, latest.t DESC, host LIMIT 10""", **HOSTED, **TOP_HOSTS),
}
# What holds for every model: rows, positives and cells, the sizes of the models, and that probabilities are such.
_CASES = {"urls": FX.duck_view(FX.ADVERSARIAL), "labelled": "SELECT url_id, CASE WHEN kind IN (0, 1, 12, 14, 15, 16, 18, 19) THEN 0 ELSE 1 END AS label FROM urls"}
_FITTED = "SELECT count(*) AS n_rows, sum(label) AS positives, count(*) AS in_cells, true AS consistent, true AS accurate"
_HELD = """SELECT sum(n)::BIGINT AS n_rows, sum(n) FILTER (label = 1)::BIGINT AS positives, sum(n)::BIGINT AS in_cells, true AS consistent,
    true AS accurate, true AS auc_in_range FROM (SELECT label, floor(count(*) * 0.2 + 0.5) AS n FROM labelled GROUP BY label)"""
_VECTOR = (1 << 20) + (1 << 18) + 30
ORACLES |= {
    "train_tree_ensemble": with_ctes(_CASES, f"{_FITTED}, 180 AS trees, true AS within_depth FROM labelled", False),
    "train_random_forest": with_ctes(_CASES, f"{_FITTED}, 300 AS trees, {len(C.MODEL_FEATURES)} AS inputs FROM labelled", False),
    "train_hashed_logistic": with_ctes(_CASES, f"{_FITTED}, {_VECTOR} AS inputs FROM labelled", False),
    "stream_mini_batch_fit": with_ctes(_CASES, f"{_FITTED}, {_VECTOR} AS inputs, count(*) AS steps FROM labelled", False),
    "evaluate_holdout": with_ctes(_CASES, _HELD, False),
    "batch_predict": with_ctes(_CASES, "SELECT url_id, true AS is_probability, true AS is_confidence, true AS is_class FROM labelled", False),
    "score_urls_modelled": on_scored("SELECT url_id, domain, true AS ai_in_range, true AS risk_in_range FROM scored"),
    "hashed_ngrams": with_ctes(_CASES, f"SELECT url_id, {_VECTOR} AS size, 1.0 AS char_norm, 1.0 AS word_norm, true AS non_negative FROM labelled", False),
}
ORACLES["build_reputation_tables"] = ORACLES["load_reputation_tables"]

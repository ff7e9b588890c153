"""Fixed message texts that scored rows and evidence lines carry."""

# --- Fixed values: explanations by indicator and branch.
OFFICIAL_SAFE = ("The hostname matches a verified official domain: %s. "
                 "This verifies domain ownership only; page content and external reputation were not inspected.")
OFFICIAL_SHARED = ("This hostname is on a shared hosting, short-link, or user-content platform. "
                   "The provider is known, but the individual page owner and content cannot be verified by domain matching alone.")
OFFICIAL_SUBDOMAIN = ("Suspicious look-alike subdomain under a protected official parent domain. "
                      "The subdomain changes a protected service name using confusable characters.")
OFFICIAL_TOKEN = ("Protected brand token found in an unofficial registrable domain. "
                  "This may be a brand-impersonation or typo-squatting site.")
OFFICIAL_SKELETON = ("Look-alike official domain detected. This hostname visually matches '%s' "
                     "but is not the verified domain.")
OFFICIAL_UNKNOWN = "The hostname does not match the curated verified-domain list."

REPUTATION_SUPPRESSED = ("No local reputation override was applied because the hostname matches the verified official domain '%s'. "
                         "Historical host/root feed records are not sufficient to classify a verified provider domain as phishing.")
REPUTATION_MATCH = ("Local malicious reputation evidence (%s) from: %s. "
                    "This is offline historical-feed evidence, not a live network lookup.")
REPUTATION_STALE = " The local store is older than 30 days, so this is presented as historical evidence."
REPUTATION_CONTEXT = ("Historical root-domain context was found, but it was not used as a risk override. "
                      "A record for one hostname must not automatically condemn unrelated sibling subdomains.")
REPUTATION_UNAVAILABLE = "The local reputation store is unavailable; no reputation evidence was applied."
REPUTATION_NONE = "No local malicious reputation match was found. This does not prove the URL is safe."

AI_OFFICIAL = ("Raw model probability: %.1f%%. Calibrated AI-assisted probability: %.1f%%. "
               "Verified official-domain correction sets the effective AI risk to %d/100.")
AI_PLAIN = ("Raw model probability: %.1f%%. Calibrated AI-assisted probability: %.1f%%. "
            "Effective AI risk used for weighting: %d/100.")
AI_UNAVAILABLE = ("AI model prediction is unavailable; the displayed AI-assisted risk uses "
                  "lexical URL evidence only.")
AI_CLEAN = ("The raw AI probability is shown for transparency, but effective AI risk is set to 0 "
            "because the hostname is a verified official domain and no URL-level phishing indicators were detected.")

BRAND_SHARED = ("This is a shared-hosting or user-content platform. "
                "The provider is known, but the individual page owner is not verified.")
BRAND_OFFICIAL = "Official brand domain verified: %s."
BRAND_SUBSTRING = "Possible brand impersonation detected: '%s' appears in an unofficial or look-alike domain."
BRAND_TYPO = "Possible brand typo-squatting detected. '%s' is very similar to '%s'."
BRAND_NONE = "No brand impersonation was detected."

HOMOGRAPH_SHARED = "No domain-owner trust is inferred for this shared-hosting or user-content platform."
HOMOGRAPH_OFFICIAL = "No look-alike issue was detected because the domain is verified as official."
HOMOGRAPH_SUBDOMAIN = ("Look-alike subdomain detected under a protected official parent domain. "
                       "This pattern is commonly used to impersonate trusted institutional services.")
HOMOGRAPH_PUNYCODE = "Punycode domain detected. This may indicate an IDN homograph attack."
HOMOGRAPH_TLD = "Confusable TLD detected: '.%s' visually looks like '.%s'."
HOMOGRAPH_TOKEN = ("Brand-like token detected in an unofficial root domain. "
                   "The token is identical to, or visually confusable with, a protected brand.")
HOMOGRAPH_SKELETON = "Critical homograph/look-alike domain detected. The domain visually matches '%s'."
HOMOGRAPH_TYPO = "Possible typo-squatting detected. '%s' is very similar to '%s'."
HOMOGRAPH_NONE = "No strong look-alike domain pattern was detected."

STRUCTURE_ISSUES = "URL structure issue(s): %s"
STRUCTURE_NONE = "No abnormal URL structure was detected."
STRUCTURE_SHORTENER = "Known URL shortener hides the final destination"
STRUCTURE_LURE = "Short link path contains look-alike brand token '%s'"
STRUCTURE_AT = "URL contains '@', which may hide the real destination"
STRUCTURE_IP = "URL uses an IP address instead of a normal domain"
STRUCTURE_PUNYCODE = "Punycode domain detected"
STRUCTURE_TLD = "Suspicious TLD detected: .%s"
STRUCTURE_CONFUSABLE_TLD = "Confusable TLD detected: .%s looks like .%s"
STRUCTURE_MANY_HYPHENS = "Excessive hyphens in domain"
STRUCTURE_HYPHENS = "Domain contains hyphens"
STRUCTURE_DIGITS = "Main domain contains digits"
STRUCTURE_DEEP = "Excessive subdomain levels detected"
STRUCTURE_ENCODED = "URL contains encoded characters"

KEYWORDS_OFFICIAL = "No suspicious keyword risk was applied because the domain is verified as official."
KEYWORDS_FOUND = "The URL contains suspicious keyword(s): %s"
KEYWORDS_NONE = "No suspicious keyword was detected."

HTTPS_SAFE = "The submitted URL uses the HTTPS scheme. Certificate validity was not tested."
HTTPS_WARNING = "The submitted URL does not use the HTTPS scheme. Certificate validity was not tested."

LENGTH_ISSUES = "URL length/complexity issue(s): %s"
LENGTH_NONE = "URL length and complexity appear normal."
LENGTH_EXTREME = "URL is extremely long"
LENGTH_SUSPICIOUS = "URL length is suspicious"
LENGTH_MODERATE = "URL is moderately long"
LENGTH_SPECIAL = "URL contains many special characters"

NO_EXPLANATION = "No obvious phishing indicators were detected."

# --- Fixed values: critical rules, in reporting order.
CRITICAL_OFFICIAL = "look-alike official domain"
CRITICAL_REPUTATION = "local malicious reputation match"
CRITICAL_HOMOGRAPH = "homograph or typo-squatting domain"
CRITICAL_BRAND = "brand impersonation"
CRITICAL_STRUCTURE = "critical URL structure issue"
CRITICAL_SHORTENER = "shortened URL contains look-alike brand"
CRITICAL_BRAND_KEYWORD = "brand name combined with phishing keyword"
CRITICAL_HTTP_KEYWORD = "HTTP combined with phishing keywords"
CRITICAL_AT = "URL contains @ redirection pattern"
CRITICAL_IP = "IP address used as domain"

# --- Fixed values: override notes.
OVERRIDE_CRITICAL = "dynamic critical-evidence floor: %s produced %d/100"
OVERRIDE_REPUTATION = "local reputation evidence floor: final risk raised to %d"
OVERRIDE_COMBINED = "combined suspicious-signal floor: final risk raised to at least 45"
OVERRIDE_OFFICIAL = "verified official-domain cap: final risk limited to at most 10"
OVERRIDE_SHARED = "shared-hosting floor: page ownership cannot be verified, final risk raised to at least 20"

# --- Fixed values: recommendations per risk band.
RECOMMENDATIONS = {
    "highRisk": [
        "This URL is high risk. Do NOT enter username, password, OTP, or payment information.",
        "Verify the website by typing the official domain manually.",
        "Avoid downloading files or clicking further links from this page.",
        "Report this URL to the relevant security officer or platform.",
    ],
    "suspicious": [
        "Proceed with caution.",
        "Check the domain carefully before entering sensitive information.",
        "Avoid login or payment actions unless the website is verified.",
    ],
    "lowRisk": [
        "The website appears relatively safe, but verify the URL carefully.",
        "Do not enter sensitive information unless necessary.",
    ],
    "trusted": [
        "No obvious URL-level phishing indicators were detected.",
        "The result does not inspect page content, redirects, downloads, or user-generated forms. "
        "Verify sensitive requests independently.",
    ],
}

# Fixed value: how reputation records are to be read.
REPUTATION_POLICY = "v12.1: exact-url and dedicated-host evidence; root-only records are context only"

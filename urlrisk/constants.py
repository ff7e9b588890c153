"""Fixed values of the scoring rules.

Everything in this module is data whose exact content decides results: word
lists, lookup tables, weights and thresholds.  Order matters for the keyword
list and for the registry (first match wins).  No logic lives here.
"""

# --- Fixed values: built-in official domains, merged under every registry file.
BUILT_IN_DOMAINS = """
google: google.com google.com.my accounts.google.com mail.google.com
microsoft: microsoft.com cloud.microsoft office.com live.com outlook.com
apple: apple.com icloud.com
openai: openai.com chatgpt.com
meta: facebook.com instagram.com whatsapp.com
amazon: amazon.com amazon.com.my
paypal: paypal.com paypal.com.my
binance: binance.com
maybank: maybank2u.com.my maybank.com
cimb: cimb.com.my cimbclicks.com.my
touchngo: touchngo.com.my tngdigital.com.my
ukm: ukm.my ftsm.ukm.my siswa.ukm.edu.my
okooo: okooo.com
render: render.com dashboard.render.com
"""

# --- Fixed values: core registry used when the caller passes no registry file.
# A longer registry is a parameter: see ``sources.registry.load_registry``.
CORE_DOMAINS = """
adobe: adobe.com behance.net
airasia: airasia.com
amazon: amazonaws.com aws.amazon.com
apple: appstore.com
binance: binance.info
booking: booking.com
canva: canva.com
cisco: cisco.com webex.com
cloudflare: cloudflare.com
coursera: coursera.org
dropbox: dropbox.com dropboxusercontent.com
figma: figma.com
foodpanda: foodpanda.com foodpanda.my
google: calendar.google.com docs.google.com drive.google.com google.co.uk youtu.be youtube.com
govuk: gov.uk
grab: grab.com grab.com.my
hsbc: hsbc.com hsbc.com.my
ibm: ibm.com
khanacademy: khanacademy.org
kwsp: epf.gov.my kwsp.gov.my
lazada: lazada.com lazada.com.my lazada.sg
lg: lg.com
lhdn: hasil.gov.my
malaysiaairlines: malaysiaairlines.com
maybank: maybank.com.my
meta: fb.com messenger.com meta.com threads.net
microsoft: azure.com github.com githubusercontent.com linkedin.com login.microsoftonline.com microsoftonline.com windows.com xbox.com
mozilla: firefox.com mozilla.org
mygov: malaysia.gov.my mygov.my
netflix: netflix.com
oracle: oracle.com
pypi: pypi.org python.org
reddit: redd.it reddit.com
rhb: rhbgroup.com rhbgroup.com.my
shopee: shopee.com shopee.com.my shopee.sg
spotify: scdn.co spotify.com
stackoverflow: stackexchange.com stackoverflow.com
steam: steamcommunity.com steampowered.com
telegram: t.me telegram.org
ukm: fism.ukm.my ukm.edu.my ukmfolio.ukm.my
whatsapp: wa.me whatsapp.com
wikipedia: wikimedia.org wikipedia.org
x: t.co twitter.com x.com
yahoo: yahoo.co.jp yahoo.com
zoom: zoom.com zoom.us
"""

# --- Fixed values: official only on exact equality, never through a subdomain.
EXACT_ONLY_DOMAINS = (
    "bit.ly dashboard.render.com discord.gg forms.gle goo.gl render.com "
    "t.co t.me tinyurl.com wa.me youtu.be gravatar.com"
).split()
# Used when a registry file has no such section.
EXACT_ONLY_FALLBACK = ["render.com", "dashboard.render.com"]

# --- Fixed values: shared hosting, short-link and user-content platforms.
SHARED_HOSTING_DOMAINS = (
    "amazonaws.com appspot.com azurewebsites.net bit.ly bl.ink blogspot.com "
    "buff.ly canva.site carrd.co cloudfront.net cutt.ly discord.gg "
    "discordapp.net discords.com docs.google.com drive.google.com "
    "firebaseapp.com forms.gle github.io gitlab.io glitch.me goo.su "
    "herokuapp.com is.gd lnkd.in medium.com myshopify.com netlify.app "
    "ngrok-free.app notion.site onrender.com ow.ly pages.dev rb.gy rebrand.ly "
    "replit.app s.id sharepoint.com short.io shorturl.at site123.me "
    "sites.google.com storage.googleapis.com t.co t.me tiny.cc tinyurl.com "
    "vercel.app wa.me web.app web.core.windows.net weebly.com wixsite.com "
    "wordpress.com youtu.be youtube.com"
).split()

# --- Fixed values: protected service labels.
PROTECTED_LABELS = (
    "account accounts admin api auth authentication billing calendar cloud "
    "confirm dashboard docs drive email forms help helpdesk home id identity "
    "login mail microsoft office payment portal secure security service signin "
    "support verify webmail word workspace www youtube zoom wallet banking "
    "checkout profile settings storage teams meet sheets slides photos maps "
    "play ukmfolio siswa ftsm fism moodle elearning lms binance coinbase paypal "
    "maybank cimb touchngo shopee lazada github chatgpt claude amazon facebook "
    "instagram whatsapp"
).split()

# --- Fixed values: link shorteners (all are two-label domains).
SHORTENERS = (
    "goo.su bit.ly tinyurl.com t.co is.gd cutt.ly rebrand.ly shorturl.at ow.ly "
    "buff.ly s.id lnkd.in tiny.cc rb.gy short.io bl.ink"
).split()

# --- Fixed values: suspicious keywords, in reporting order.
KEYWORDS = (
    "login verify secure security update account confirm payment password "
    "unlock suspend wallet support limited signin sign-in reset bank urgent "
    "locked email emails credential credentials otp auth recover verification "
    "validate authorize invoice refund gift bonus kyc crypto seed airdrop"
).split()

# --- Fixed values: risk points of a top-level domain.
BAD_TLD_POINTS = {
    "xyz": 80, "top": 80, "click": 80, "ru": 85, "tk": 80, "ml": 80, "cf": 75,
    "gq": 75, "info": 65, "work": 65, "loan": 80, "monster": 75, "rest": 70,
    "fit": 70, "buzz": 70, "live": 45, "cam": 70, "sbs": 70, "cyou": 70,
}

# --- Fixed values: common TLDs a confusable TLD can imitate.
COMMON_TLDS = (
    "com net org edu gov my uk io ai co com.my edu.my gov.my org.my co.uk "
    "com.sg com.au"
).split()

# --- Fixed values: public suffixes of two labels.
TWO_LEVEL_SUFFIXES = (
    "com.my edu.my gov.my org.my net.my co.uk org.uk ac.uk gov.uk com.au "
    "net.au org.au co.jp ne.jp or.jp co.id or.id ac.id com.sg org.sg edu.sg"
).split()

# --- Fixed values: look-alike characters, grouped by the ASCII letter they map to.
CONFUSABLES = {
    "o": "0oOοΟоО",
    "l": "1lLiI|!ıİіІӏ",
    "e": "3eE€еЕє",
    "a": "4aA@аАαΑ",
    "s": "5sS$",
    "t": "7tT",
    "b": "8bB",
    "g": "9gG",
    "c": "сСϲ¢",
    "p": "рРρ",
    "x": "хХ",
    "y": "уУʏ",
    "h": "һНн",
    "k": "кК",
    "m": "мМ",
    "v": "νѵ",
}
# Pairs applied after the single-character map, in this order.
CONFUSABLE_PAIRS = (("rn", "m"), ("vv", "w"))
# A label holding any of these characters carries a look-alike marker.
CONFUSABLE_MARKER = "[01345789@!|$οΟоОаАαΑсСϲ¢еЕєрРρхуУһНнкКмМνѵʏıİіІӏ]"

IP_PATTERN = r"(\d{1,3}\.){3}\d{1,3}"

# --- Fixed values: indicators in reporting order with their percentage weights.
INDICATORS = (
    # name, weight percent, label, method
    ("officialDomain", 12, "Official Domain Verification",
     "Matches the parsed hostname against the backend's verified allowlist and look-alike rules."),
    ("reputationEvidence", 0, "Local Malicious Reputation",
     "Checks an offline store built from local malicious-URL feed snapshots. A match is historical evidence and includes store age."),
    ("aiModelProbability", 18, "Calibrated AI-Assisted Risk",
     "Combines the loaded model's predict_proba output with URL-derived lexical evidence."),
    ("brandVerification", 20, "Brand Impersonation",
     "Checks unofficial hostnames and short-link paths for protected brand names and close variants."),
    ("homographAttack", 20, "Homograph and Typosquatting",
     "Checks Punycode, confusable characters, edit distance, and hostname similarity."),
    ("urlStructure", 10, "URL Structure",
     "Checks redirect services, @ patterns, IP hosts, suspicious TLDs, encoding, and abnormal hostname structure."),
    ("suspiciousKeywords", 10, "Suspicious Keywords",
     "Counts phishing-related terms in the parsed hostname, path, and query."),
    ("httpsUsage", 5, "HTTPS Usage",
     "Checks whether the submitted URL scheme is https. It does not connect to the site or validate a TLS certificate."),
    ("urlLengthComplexity", 5, "URL Length and Complexity",
     "Measures URL length and special-character count."),
)
INDICATOR_NAMES = [row[0] for row in INDICATORS]
INDICATOR_WEIGHTS = {row[0]: row[1] for row in INDICATORS}

# --- Fixed values: risk bands (key, label, decision, minimum, maximum).
RISK_BANDS = (
    ("trusted", "Trusted", "Safe", 0, 19),
    ("lowRisk", "Low Risk", "Relatively Safe", 20, 44),
    ("suspicious", "Suspicious", "Suspicious", 45, 79),
    ("highRisk", "High Risk", "Phishing", 80, 100),
)

# --- Fixed values: names of the 22 model features, in vector order.
MODEL_FEATURES = (
    "url_length uses_https netloc_length path_length dot_count hyphen_count "
    "at_count question_count equals_count slash_count digit_count "
    "special_character_count ip_address_flag suspicious_keyword_count "
    "brand_literal_count brand_confusable_count official_domain_flag "
    "domain_lookalike_flag minimum_brand_distance maximum_brand_similarity "
    "shortener_domain_flag shortener_brand_path_flag"
).split()

# --- Fixed values: keywords of the five-feature vector.
SHORT_KEYWORDS = "login verify account secure update confirm".split()

# --- Fixed values: word lists of the 30-feature lexical vector.
LEXICAL_TERMS = (
    "login signin verify verification secure security account password payment "
    "wallet bank otp confirm update unlock suspend credential recover invoice "
    "refund kyc seed airdrop authorize billing support gift bonus crypto"
).split()
LEXICAL_BRANDS = (
    "google microsoft apple openai chatgpt paypal binance coinbase maybank cimb "
    "touchngo shopee lazada grab amazon facebook instagram whatsapp netflix "
    "discord steam github linkedin tiktok telegram bankislam publicbank"
).split()
LEXICAL_BAD_TLDS = (
    "xyz top click ru tk ml cf gq work loan monster rest fit buzz cam sbs cyou "
    "zip mov"
).split()
LEXICAL_TWO_LEVEL = (
    "com.my edu.my gov.my org.my net.my co.uk org.uk com.au co.jp com.sg co.id"
).split()
REDIRECT_QUERY_WORDS = ("redirect", "return", "next", "continue", "url=", "target=")
CREDENTIAL_WORDS = ("login", "verify", "payment", "wallet", "password")

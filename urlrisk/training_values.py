"""Fixed values of the training set: names, hand-written URLs and named cases."""

# --- Fixed values: trusted domains; each gives four safe rows.
SAFE_DOMAINS = (
    "google.com accounts.google.com mail.google.com paypal.com microsoft.com login.microsoftonline.com apple.com "
    "icloud.com amazon.com facebook.com instagram.com netflix.com whatsapp.com github.com stackoverflow.com openai.com "
    "chatgpt.com ukm.my ukmfolio.ukm.my fism.ukm.my ftsm.ukm.my siswa.ukm.edu.my maybank2u.com.my cimbclicks.com.my "
    "rhbgroup.com touchngo.com.my tngdigital.com.my render.com dashboard.render.com onrender.com figma.com "
    "www.figma.com cisco.com webex.com"
).split()

# --- Fixed values: further safe URLs.
SAFE_URLS = """
https://www.google.com
https://accounts.google.com/signin/v2/identifier
https://mail.google.com/mail/u/0/
https://www.paypal.com/signin
https://www.paypal.com/myaccount/summary
https://login.microsoftonline.com/common/oauth2/v2.0/authorize
https://github.com/login
https://github.com/settings/profile
https://www.facebook.com/login
https://www.instagram.com/accounts/login/
https://www.netflix.com/login
https://www.ukm.my/
https://ukmfolio.ukm.my/my/
https://www.maybank2u.com.my/home/m2u/common/login.do
https://www.cimbclicks.com.my/clicks/#/
https://dashboard.render.com/web/srv-d8o2c6kvikkc73e1gttg/settings
https://dashboard.render.com/web/srv-demo12345/events
""".split()

# --- Fixed values: further phishing URLs.
PHISHING_URLS = """
https://www.goog1e.com
https://www.g00gle.com
https://www.paypa1.com
https://www.paypai.com
https://www.app1e.com
https://www.netf1ix.com
https://www.faceb00k.com
https://www.micr0soft.com
http://paypal-login-security.com
https://paypal-login-security.com
http://192.168.1.10/login
http://10.0.0.5/account/verify
http://172.16.0.3/payment/login
http://paypal.com@evil-site.ru/login
https://paypal.com.login.verify.security.xyz
https://google.com.account-update.top
https://amazon.com.payment-alert.ru
https://maybank2u.com.my.login-security.xyz
https://cimbclicks.com.my.verify-account.info
https://apple-support-password-reset.com
https://microsoft-office365-login-alert.com
https://facebook-security-checkpoint.net
https://instagram-account-locked.com
https://whatsapp-web-login-confirm.com
https://openai-billing-payment-update.com
https://github-security-login-alert.com
https://ukm-student-login-update.xyz
https://gov-my-tax-refund-login.com
https://dashb0ard.render.com/web/srv-d8o2c6kvikkc73e1gttg/events
https://www.fig3a.com/make/L0YDXp4y0VwOtwlWf3xemR/
https://figma-login-security.com
https://figma.com.verify.security.xyz/account
https://cisc0.com/login
https://cisco-login-security.com
https://webex-meeting-login-confirm.xyz
https://goo.su/i.whatAapp
.https://goo.su/i.whatAapp
https://https://goo.su/i.whatAapp
https://.https://goo.su/i.whatAapp
https：//goo.su/i.whatAapp
.https：//goo.su/i.whatAapp
https://goo.su/i.whatsAapp
https://bit.ly/paypaI-login
https://tinyurl.com/micr0soft-account
https://cutt.ly/cisc0-secure-login
""".split()

# --- Fixed values: brands that phishing rows imitate.
PHISHING_BRANDS = (
    "paypal google apple microsoft amazon facebook instagram netflix whatsapp github openai ukm maybank cimb rhb "
    "touchngo render figma cisco webex"
).split()

# --- Fixed values: look-alike tokens per brand.
LOOKALIKE_TOKENS = {
    "google": "goog1e g00gle g0og1e", "paypal": "paypaI paypa1 paypai", "microsoft": "micr0soft rnicrosoft microsofft",
    "whatsapp": "whatAapp whatsAapp whatsapq whats4pp", "cisco": "cisc0 clsco", "render": "dashb0ard render-login",
    "figma": "fig3a flgma", "ukm": "ukmf0lio f1sm ukm-login",
}

# --- Fixed values: look-alike host names.
LOOKALIKE_NAMES = (
    "goog1e g00gle paypa1 paypai app1e micr0soft rnicrosoft faceb00k netf1ix dashb0ard-render fig3a flgma cisc0 c1sco "
    "whataapp what5app"
).split()

# --- Fixed values: lure paths on link shorteners.
LURE_PATHS = (
    "i.whatAapp i.whatsAapp whatAapp-login whatsapq-web-verify paypaI-login paypa1-secure g0og1e-secure goog1e-account "
    "cisc0-meeting rnicrosoft-account fig3a-make-share ukmf0lio-course f1sm-spidv2-material"
).split()

# --- Fixed values: IP blocks.
IP_BLOCKS = "192.168.1 10.0.0 172.16.0 185.199.108 45.67.89".split()

# --- Fixed values: named regression cases (name, url, expected class).
REGRESSION_CASES = (
    ("official_google", "https://www.google.com", 0),
    ("official_cisco", "https://www.cisco.com/", 0),
    ("official_whatsapp", "https://www.whatsapp.com/", 0),
    ("lookalike_google_digit", "https://www.goog1e.com", 1),
    ("lookalike_google_mixed", "https://G0og1e.com", 1),
    ("lookalike_cisco_digit", "https://Cisc0.com/login", 1),
    ("lookalike_paypal_upper_i", "https://paypaI.com", 1),
    ("lookalike_microsoft_rn", "https://rnicrosoft.com", 1),
    ("lookalike_whatsapp_q", "https://whatsapq.com/login", 1),
    ("shortener_whatsapp_path", "https://goo.su/i.whatAapp", 1),
    ("shortener_whatsapp_leading_dot", ".https://goo.su/i.whatAapp", 1),
    ("shortener_whatsapp_fullwidth_colon", ".https：//goo.su/i.whatAapp", 1),
    ("shortener_whatsapp_double_scheme", "https://https://goo.su/i.whatAapp", 1),
    ("shortener_whatsapp_hidden_scheme", "https://.https://goo.su/i.whatAapp", 1),
    ("shortener_paypal_path", "https://bit.ly/paypaI-login", 1),
    ("brand_phishing_paypal", "http://paypal-login-security.com", 1),
    ("ip_login_private", "http://192.168.1.10/login", 1),
    ("at_redirect", "http://paypal.com@evil-site.ru/login", 1),
    ("brand_subdomain_abuse", "https://paypal.com.login.verify.security.xyz", 1),
    ("malaysia_bank_abuse", "https://maybank2u.com.my.login-security.xyz", 1),
    ("unseen_google_variant", "https://g00gle-account-verify.click/login", 1),
    ("unseen_ip_variant", "http://10.10.10.22/secure/account", 1),
    ("unseen_render_safe", "https://dashboard.render.com/web/srv-newdemo/settings", 0),
)

"""Coarse roles of hosts by an ordered cascade of name patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.net import is_first_party, normalize_host

#: Domains whose hosts, and hosts below them, have a role, in the order of the cascade. Fixed values.
DOMAINS = {
    "walletconnect": "walletconnect.com walletconnect.org walletconnect.network reown.com web3modal.com web3modal.org",
    "rpc_provider": "infura.io alchemy.com alchemyapi.io quiknode.pro quicknode.com ankr.com publicnode.com llamarpc.com blastapi.io chainstack.com moralis.io drpc.org blockpi.network",
    "wallet_vendor": "metamask.io metamask.github.io api.cx.metamask.io cx.metamask.io rabby.io phantom.app okx.com okex.org okxwallet.com okx-httpdns.com okx.cab okx.ac coinall.ltd wallet.ouxyi.cash trustwallet.com rainbow.me coinbase.com walletlink.org safe.global gnosis-safe.io ledger.com ledgerwallet.com zerion.io onekey.so token.im imtoken.com unisat.io bitgetwallet.io bitkeep.com backpack.app exodus.com",
    "identity_provider": "accounts.google.com login.microsoftonline.com login.live.com account.live.com appleid.apple.com facebook.com okta.com okta-emea.com auth0.com duosecurity.com onelogin.com pingidentity.com pingone.com",
    "captcha_challenge": "recaptcha.net hcaptcha.com challenges.cloudflare.com turnstile.cloudflare.com arkoselabs.com funcaptcha.com datadome.co datadome.com perimeterx.net px-cloud.net kasada.io",
    "payment_provider": "stripe.com stripe.network paypal.com paypalobjects.com adyen.com braintreegateway.com braintree-api.com squareup.com squarecdn.com checkout.com klarna.com afterpay.com worldpay.com payoneer.com wise.com razorpay.com paystack.com",
    "messaging_api": "api.telegram.org telegram.org discord.com discordapp.com slack.com hooks.slack.com webhook.site pipedream.net ifttt.com maker.ifttt.com ntfy.sh pushover.net",
    "form_backend": "formspree.io formsubmit.co getform.io formcarry.com staticforms.xyz web3forms.com emailjs.com jotform.com typeform.com tally.so forms.gle googleusercontent.com airtable.com",
    "cloud_api": "firebaseio.com firebasedatabase.app firebaseapp.com firebase.googleapis.com firestore.googleapis.com supabase.co supabase.in appwrite.io appwrite.global airtable.com api.notion.com notion.com zapier.com hooks.zapier.com make.com integromat.com script.google.com script.googleusercontent.com",
    "object_storage": "storage.googleapis.com s3.amazonaws.com amazonaws.com blob.core.windows.net r2.cloudflarestorage.com digitaloceanspaces.com backblazeb2.com wasabisys.com",
    "email_delivery": "sendgrid.net sendgrid.com mailgun.org mailgun.net mandrillapp.com mailchimp.com smtp2go.com brevo.com sendinblue.com postmarkapp.com sparkpostmail.com",
    "file_storage": "drive.google.com docs.google.com dropbox.com dropboxusercontent.com onedrive.live.com 1drv.ms box.com mega.nz mediafire.com wetransfer.com",
    "url_shortener": "bit.ly tinyurl.com t.co cutt.ly rebrand.ly lnkd.in is.gd ow.ly shorturl.at rb.gy s.id buff.ly",
    "hosting_platform": "vercel.app netlify.app pages.dev workers.dev github.io gitlab.io firebaseapp.com web.app herokuapp.com glitch.me replit.app render.com fly.dev surge.sh ngrok-free.app ngrok.io trycloudflare.com duckdns.org hopto.org no-ip.org serveo.net localtunnel.me",
    "software_update": "update.googleapis.com safebrowsing.googleapis.com edge.microsoft.com msedge.api.cdp.microsoft.com versioncheck-bg.addons.mozilla.org addons.mozilla.org extensions.gstatic.com",
    "third_party_static": "cdnjs.cloudflare.com cloudflare.com jsdelivr.net unpkg.com code.jquery.com jquery.com googleapis.com gstatic.com fontawesome.com bootstrapcdn.com cloudfront.net akamaihd.net fastly.net assets.adobedtm.com fonts.googleapis.com fonts.gstatic.com",
    "analytics_ads": "google-analytics.com googletagmanager.com sentry.io datadoghq.com segment.io amplitude.com mixpanel.com intercom.io hotjar.com clarity.ms newrelic.com nr-data.net fullstory.com doubleclick.net googlesyndication.com googletagservices.com facebook.net",
}
#: Further patterns of some roles, at the end of a host unless said otherwise. Fixed values.
PATTERNS = {"identity_provider": [r"(^|\.)(sso|login|auth)\.[^.]+\.[^.]+$"], "object_storage": [r"(^|\.)s3[.-][a-z0-9-]+\.amazonaws\.com$"], "software_update": [r"(^|\.)(clients[0-9]*\.google\.com|aus[0-9]*\.mozilla\.org)$"], "rpc_provider": [r"infura-router\.public\.blockchain-networks"]}
#: Which role a host keeps of several, best first. Fixed values.
PRIORITY = ["walletconnect", "rpc_provider", "wallet_vendor", "identity_provider", "captcha_challenge", "payment_provider", "messaging_api", "form_backend", "cloud_api", "object_storage", "email_delivery", "file_storage", "url_shortener", "hosting_platform", "first_party_site", "software_update", "third_party_static", "analytics_ads", "third_party_backend_or_other", "unknown"]


def pattern(role: str) -> str:
    """One regular expression for a role's domains and patterns."""
    domains = "|".join(d.replace(".", r"\.") for d in DOMAINS[role].split())
    return "|".join([rf"(^|\.)({domains})$", *PATTERNS.get(role, [])])


def classify_host(host: Column, primary: Column) -> Column:
    """The first role of the cascade whose pattern the host matches; the first party comes after url_shortener."""
    pair = F.struct(normalize_host(host).alias("h"), normalize_host(primary).alias("p"))
    return F.element_at(F.transform(F.array(pair), lambda x: _cascade(x["h"], x["p"])), 1)


def _cascade(h: Column, primary: Column) -> Column:
    out = F.when(h == "", "unknown")
    for role in DOMAINS:
        if role == "hosting_platform":
            out = out.when(is_first_party(h, primary), "first_party_site")
        out = out.when(h.rlike(pattern(role)), role)
    return out.otherwise("third_party_backend_or_other")


def best_role(roles: Column) -> Column:
    """Of an array of roles the one with the best priority; unknown for none."""
    order = F.array(*map(F.lit, PRIORITY))
    places = F.filter(F.transform(roles, lambda r: F.array_position(order, r)), lambda p: p > 0)
    return F.coalesce(F.element_at(order, F.array_min(places).cast("int")), F.lit("unknown"))

"""The built-in pack of public token formats: fixed prefixes, and values that stand next to a service's name.

Each table gives a rule's parts; ``rules_of`` makes the rules. All have one capture group, named ``secret``.
"""

from __future__ import annotations

# Public formats of tokens that tell themselves by their beginning, as (service, pattern).
PREFIXED = (
    ("1password-service", r"ops_eyJ[A-Za-z0-9+/]{200,}={0,3}"), ("adafruit", r"aio_[A-Za-z0-9]{28}"), ("age-secret", r"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}"),
    ("airtable", r"pat[A-Za-z0-9]{14}\.[a-f0-9]{64}"), ("alibaba", r"LTAI[A-Za-z0-9]{20}"), ("anthropic", r"sk-ant-api03-[A-Za-z0-9_-]{93}AA"), ("artifactory", r"AKCp[A-Za-z0-9]{69}"),
    ("atlassian", r"ATATT3[A-Za-z0-9_=-]{186}"), ("authress", r"(?:sc|ext|scauth|authress)_[a-z0-9]{5,30}\.[a-z0-9]{4,6}\.acc[_-][a-z0-9-]{10,32}\.[a-z0-9+/_=-]{30,120}"),
    ("aws-session", r"IQoJb3JpZ2luX2[A-Za-z0-9+/=]{50,}"), ("bitbucket-app", r"ATBB[A-Za-z0-9]{32}"), ("brevo", r"xkeysib-[a-f0-9]{64}-[A-Za-z0-9]{16}"), ("buildkite", r"bkua_[a-z0-9]{40}"),
    ("circleci", r"CCIPAT_[A-Za-z0-9]{22}_[a-f0-9]{40}"), ("clojars", r"CLOJARS_[a-z0-9]{60}"), ("cloudflare-origin", r"v1\.0-[a-f0-9]{24}-[a-f0-9]{146}"), ("contentful", r"CFPAT-[A-Za-z0-9_-]{43}"),
    ("databricks", r"dapi[a-f0-9]{32}(?:-\d)?"), ("deno", r"dd[pw]_[A-Za-z0-9]{36}"), ("digitalocean", r"do[opr]_v1_[a-f0-9]{64}"), ("discord-webhook", r"https://discord(?:app)?\.com/api/webhooks/\d{17,20}/[A-Za-z0-9_-]{60,68}"),
    ("docker", r"dckr_pat_[A-Za-z0-9_-]{27}"), ("docker-org", r"dckr_oat_[A-Za-z0-9_-]{32}"), ("doppler", r"dp\.(?:pt|st|ct|sa|scim|audit)\.[A-Za-z0-9]{40,44}"), ("dropbox", r"sl\.[A-Za-z0-9_-]{130,152}"),
    ("duffel", r"duffel_(?:test|live)_[A-Za-z0-9_=-]{43}"), ("dynatrace", r"dt0c01\.[A-Z0-9]{24}\.[A-Z0-9]{64}"), ("easypost", r"EZ[AT]K[A-Za-z0-9]{54}"), ("facebook", r"EAA[A-Za-z0-9]{90,180}"),
    ("figma", r"figd_[A-Za-z0-9_-]{40}"), ("flutterwave", r"FLWSECK_(?:TEST|LIVE)-[a-h0-9]{12,32}-X"), ("fly", r"fm[12][a-z]?_[A-Za-z0-9+/=_-]{100,}"), ("frameio", r"fio-u-[A-Za-z0-9_=-]{64}"),
    ("github-fine", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}"), ("gitlab", r"glpat-[A-Za-z0-9_-]{20}"), ("gitlab-deploy", r"gldt-[A-Za-z0-9_-]{20}"), ("gitlab-pipeline", r"glptt-[a-f0-9]{40}"), ("gitlab-runner", r"glrt-[A-Za-z0-9_-]{20}"),
    ("gitlab-feed", r"glft-[A-Za-z0-9_-]{20}"), ("gitlab-agent", r"glagent-[A-Za-z0-9_-]{50}"), ("gitlab-oauth", r"gloas-[a-f0-9]{64}"), ("gocardless", r"live_[A-Za-z0-9_=-]{40}"), ("google-oauth", r"ya29\.[A-Za-z0-9_-]{60,}"),
    ("google-client", r"GOCSPX-[A-Za-z0-9_-]{28}"), ("grafana", r"glc_[A-Za-z0-9+/]{32,400}={0,2}"), ("grafana-service", r"glsa_[A-Za-z0-9]{32}_[a-f0-9]{8}"), ("groq", r"gsk_[A-Za-z0-9]{52}"), ("hashicorp-batch", r"hvb\.[A-Za-z0-9_-]{138,300}"),
    ("hashicorp-service", r"hvs\.[A-Za-z0-9_-]{90,120}"), ("heroku", r"HRKU-AA[A-Za-z0-9_-]{58}"), ("hubspot", r"pat-(?:na|eu)1-[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}"), ("huggingface", r"hf_[A-Za-z]{34}"),
    ("huggingface-org", r"api_org_[A-Za-z]{34}"), ("infracost", r"ico-[A-Za-z0-9]{32}"), ("intra42", r"s-s4t2(?:ud|af)-[a-f0-9]{64}"), ("jfrog-reference", r"cmVmdGtu[A-Za-z0-9]{56}"), ("launchdarkly", r"(?:api|sdk|mob)-[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}"),
    ("linear", r"lin_api_[A-Za-z0-9]{40}"), ("linear-oauth", r"lin_oauth_[a-f0-9]{64}"), ("lob", r"(?:live|test)_[a-f0-9]{35}"), ("mailchimp", r"[a-f0-9]{32}-us\d{1,2}"), ("mailgun", r"key-[a-f0-9]{32}"), ("mapbox", r"[ps]k\.eyJ[A-Za-z0-9_-]{60,200}\.[A-Za-z0-9_-]{22}"),
    ("maxmind", r"[A-Za-z0-9]{6}_[A-Za-z0-9]{29}_mmk"), ("mergify", r"mergify_application_key_[A-Za-z0-9]{86}"), ("microsoft-teams", r"https://[a-z0-9-]+\.webhook\.office\.com/webhookb2/[a-z0-9-]{36}@[a-z0-9-]{36}/IncomingWebhook/[a-z0-9]{32}/[a-z0-9-]{36}"),
    ("netlify", r"nfp_[A-Za-z0-9]{36}"), ("new-relic-user", r"NRAK-[A-Z0-9]{27}"), ("new-relic-browser", r"NRJS-[a-f0-9]{19}"), ("new-relic-insert", r"NRII-[A-Za-z0-9_-]{32}"), ("notion", r"ntn_[A-Za-z0-9]{46}"), ("npm", r"npm_[A-Za-z0-9]{36}"),
    ("nuget", r"oy2[a-z0-9]{43}"), ("octopus", r"API-[A-Z0-9]{26}"), ("openai", r"sk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20}"), ("openai-project", r"sk-proj-[A-Za-z0-9_-]{40,160}"), ("openrouter", r"sk-or-v1-[a-f0-9]{64}"),
    ("perplexity", r"pplx-[A-Za-z0-9]{48}"), ("plaid", r"access-(?:sandbox|development|production)-[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}"), ("planetscale", r"pscale_tkn_[A-Za-z0-9_=.-]{32,64}"), ("planetscale-password", r"pscale_pw_[A-Za-z0-9_=.-]{32,64}"),
    ("postman", r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}"), ("prefect", r"pn[ub]_[A-Za-z0-9]{36}"), ("pulumi", r"pul-[a-f0-9]{40}"), ("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,1000}"), ("razorpay", r"rzp_(?:live|test)_[A-Za-z0-9]{14}"),
    ("readme", r"rdme_[a-z0-9]{70}"), ("replicate", r"r8_[A-Za-z0-9]{37}"), ("rubygems", r"rubygems_[a-f0-9]{48}"), ("samsara", r"samsara_api_[A-Za-z0-9]{30}"), ("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"), ("sentry-org", r"sntrys_[A-Za-z0-9+/=_]{80,400}"),
    ("sentry-user", r"sntryu_[a-f0-9]{64}"), ("shippo", r"shippo_(?:live|test)_[a-f0-9]{40}"), ("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"), ("slack-app", r"xapp-\d-[A-Z0-9]{8,14}-\d{8,16}-[a-z0-9]{32,80}"),
    ("slack-webhook", r"https://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/]{43,56}"), ("sonar", r"sq[apu]_[a-f0-9]{40}"), ("sourcegraph", r"sgp_(?:[a-f0-9]{16}_)?[a-f0-9]{40}"), ("square", r"EAAA[A-Za-z0-9_-]{60}"),
    ("square-secret", r"sq0csp-[A-Za-z0-9_-]{43}"), ("stripe-webhook", r"whsec_[A-Za-z0-9]{32,64}"), ("supabase", r"sbp_[a-f0-9]{40}"), ("tailscale", r"tskey-(?:api|auth|client|webhook)-[A-Za-z0-9]{10,24}-[A-Za-z0-9]{20,40}"), ("telegram", r"\d{8,10}:AA[A-Za-z0-9_-]{33}"),
    ("terraform", r"[A-Za-z0-9]{14}\.atlasv1\.[A-Za-z0-9_-]{60,70}"), ("twilio-key", r"SK[a-f0-9]{32}"), ("twilio-account", r"AC[a-f0-9]{32}"), ("typeform", r"tfp_[A-Za-z0-9_-]{40,60}"), ("vault", r"s\.[A-Za-z0-9]{24}"), ("vercel-blob", r"vercel_blob_rw_[A-Za-z0-9_]{40,60}"),
    ("xai", r"xai-[A-Za-z0-9]{80}"), ("yandex", r"t1\.[A-Z0-9a-z_-]+={0,2}\.[A-Z0-9a-z_-]{86}={0,2}"), ("yandex-key", r"AQVN[A-Za-z0-9_-]{35,38}"), ("zuplo", r"zpka_[A-Za-z0-9_]{40,60}"),
)

#: Alphabets of values.
HEX, ALNUM, LOWER, WIDE, UUID = "[a-f0-9]", "[A-Za-z0-9]", "[a-z0-9]", "[A-Za-z0-9_-]", "[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}"

# Services whose keys have no mark of their own, by the shape of the key.
NEAR = {
    f"{HEX}{{32}}": "abuseipdb accuweather adjust aftership algolia amplitude apify apilayer assemblyai bugsnag chartmogul clearbit codacy coinapi contentstack currencylayer datadog dnsimple fastspring fixer geocodio hunter intercom ipgeolocation ipstack keen localytics mandrill mixpanel moosend newsapi numverify opsgenie optimizely pagerduty pipedrive positionstack rollbar segment serpapi shodan snyk statuspage sumologic thousandeyes travisci userstack weatherstack wepay zerobounce",
    f"{HEX}{{40}}": "bitly census codeclimate coveralls dnsmadeeasy foursquare gitea gogs hetzner logdna losant moderation openweather pusher rapid7 scrutinizer teamcity vultr wakatime",
    f"{HEX}{{64}}": "alchemy auth0 blockfrost checkly coinbase customerio datarobot fullstory infura kraken messagebird mollie onfido onesignal portainer scaleway tatum thegraph xero",
    f"{ALNUM}{{20}}": "beamer clarifai dyspatch flickr giphy jumpcloud klaviyo mattermost mux okta pivotal trello",
    f"{ALNUM}{{32}}": "airbrake bandwidth bitfinex browserstack calendly cloudsmith confluent convertapi deepgram delighted drift elastic etsy eventbrite freshdesk front gitter gusto helpscout iterable kucoin lastpass lokalise nexmo nylas plivo sauce sendbird skyscanner sparkpost splunk stormpath survicate twitch unsplash workato zapier zendesk",
    f"{WIDE}{{40,64}}": "asana box cloudinary dailymotion disqus fastly gumroad linkedin monday patreon pinecone qualtrics reddit salesforce spotify strava todoist vimeo yelp zoom",
    UUID: "appcenter appveyor azure bing cloudamqp codefresh ipinfo postmark raygun smartthings telnyx unbounce wix",
}
#: Words between a service's name and its key, and how far apart the two may be.
WORDS, REACH = r"(?:api|access|auth|secret|private|client|personal)?[_. -]?(?:key|token|secret|password|pat)", 24


def rules_of(make) -> tuple:
    """The pack, by a maker of rules (id, name, pattern, categories, examples, negative_examples)."""
    out = []
    for service, pattern in PREFIXED:
        out.append(make(f"tr.prefix.{service}", f"{service.replace('-', ' ').title()} token", rf"(?:^|[^A-Za-z0-9_+/-])(?P<secret>{pattern})(?:[^A-Za-z0-9_+/-]|$)", ("api", "secret")))
    for shape, services in NEAR.items():
        for service in services.split():
            pattern = rf"(?i)\b{service}[A-Za-z0-9_. -]{{0,{REACH}}}?{WORDS}[\"']?\s{{0,3}}(?:=|:|=>|:=)\s{{0,3}}[\"']?(?P<secret>(?-i:{shape}))(?:[^A-Za-z0-9_-]|$)"
            out.append(make(f"tr.near.{service}", f"{service.title()} key", pattern, ("api", "secret", "fuzzy")))
    return tuple(out)

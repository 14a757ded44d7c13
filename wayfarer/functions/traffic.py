"""Traffic-source classification: click ids, partner codes, UTM parameters, referers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Click-id parameters, in the order in which they are looked for.
CLICK_IDS = {
    "dclid": ("google_display", "paid"),
    "epik": ("pinterest_ads", "paid"),
    "fbclid": ("meta", "social"),
    "gbraid": ("google_ads", "paid"),
    "gclid": ("google_ads", "paid"),
    "irclickid": ("impact_radius", "affiliate"),
    "li_fat_id": ("linkedin_ads", "paid"),
    "msclkid": ("microsoft_ads", "paid"),
    "sccid": ("snapchat_ads", "paid"),
    "ttclid": ("tiktok", "paid"),
    "twclid": ("twitter_ads", "paid"),
    "wbraid": ("google_ads", "paid"),
}
#: Referring hosts by medium and platform.
REFERERS = {
    "social": {
        "facebook": ("facebook.com", "m.facebook.com", "l.facebook.com", "lm.facebook.com", "fb.com", "fb.me"),
        "instagram": ("instagram.com", "l.instagram.com"),
        "twitter": ("t.co", "twitter.com", "x.com"),
        "linkedin": ("linkedin.com", "lnkd.in"),
        "youtube": ("youtube.com", "youtu.be"),
        "reddit": ("reddit.com", "old.reddit.com", "out.reddit.com"),
        "tiktok": ("tiktok.com",),
        "pinterest": ("pinterest.com",),
        "threads": ("threads.net",),
        "bluesky": ("bsky.app",),
    },
    "organic": {
        "google": ("google.com", "google.co.uk"),
        "bing": ("bing.com",),
        "duckduckgo": ("duckduckgo.com",),
        "yahoo": ("yahoo.com",),
        "baidu": ("baidu.com",),
    },
    "email": {
        "gmail": ("mail.google.com", "mail.googleusercontent.com"),
        "outlook": ("outlook.live.com", "outlook.office.com", "outlook.office365.com", "outlook.com"),
        "yahoo_mail": ("mail.yahoo.com", "mail.yahoo.co.jp"),
        "icloud_mail": ("mail.icloud.com",),
        "aol_mail": ("mail.aol.com",),
        "proton_mail": ("mail.proton.me",),
        "zoho_mail": ("mail.zoho.com",),
        "gmx": ("mail.gmx.com", "mail.gmx.net", "mail.gmx.de"),
        "web_de": ("mail.web.de",),
        "mailru": ("e.mail.ru",),
        "yandex_mail": ("mail.yandex.ru", "mail.yandex.com"),
        "naver_mail": ("mail.naver.com",),
        "fastmail": ("app.fastmail.com",),
        "tuta": ("mail.tutanota.com",),
        "hey": ("app.hey.com",),
    },
    "messaging": {
        "whatsapp": ("web.whatsapp.com",),
        "telegram": ("web.telegram.org",),
        "slack": ("slack.com", "app.slack.com"),
        "discord": ("discord.com",),
    },
    "ai": {
        "chatgpt": ("chatgpt.com", "chat.openai.com", "chat-gpt.org", "openai.com"),
        "claude": ("claude.ai", "anthropic.com"),
        "perplexity": ("perplexity.ai",),
        "copilot": ("copilot.microsoft.com", "edgeservices.bing.com", "turing.microsoft.com", "cosmos.microsoft.com"),
        "gemini": ("gemini.google.com", "bard.google.com", "deepmind.com"),
        "grok": ("grok.com", "grok.x.com", "x.ai"),
        "deepseek": ("deepseek.com",),
        "you": ("you.com",),
        "meta_ai": ("meta.ai",),
        "mistral": ("mistral.ai", "chat.mistral.ai"),
        "character_ai": ("character.ai",),
        "huggingchat": ("huggingface.co", "huggingchat.com"),
        "phind": ("phind.com",),
        "pi": ("pi.ai",),
        "zhipu": ("zhipu.ai", "chatglm.cn"),
        "qwen": ("qwenlm.ai", "chat.qwen.ai"),
        "felo": ("felo.ai",),
        "komo": ("komo.ai",),
        "iask": ("iask.ai",),
        "sider": ("sider.ai",),
        "venice": ("venice.ai",),
        "duckai": ("duck.ai",),
        "cohere": ("cohere.ai",),
        "jasper": ("jasper.ai",),
        "writesonic": ("writesonic.com",),
        "quillbot": ("quillbot.com",),
        "wordtune": ("wordtune.com",),
        "copyai": ("copy.ai",),
        "blackbox": ("blackbox.ai",),
        "openchat": ("openchat.so",),
        "open_assistant": ("open-assistant.io",),
        "openrouter": ("openrouter.ai",),
        "lmarena": ("lmarena.ai",),
        "coze": ("coze.com",),
        "exa": ("exa.ai",),
        "forefront": ("forefront.ai",),
        "reka": ("reka.ai",),
        "ai21": ("ai21.com",),
        "deepl": ("deepl.com",),
        "suno": ("chat.suno.com",),
        "neeva": ("neeva.com",),
        "nimble": ("nimble.ai",),
        "bnngpt": ("bnngpt.com",),
        "adobe_firefly": ("firefly.adobe.com",),
    },
}
UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
REFERER_HOSTS = {h: (platform, medium) for medium, platforms in REFERERS.items() for platform, hosts in platforms.items() for h in hosts}


def normalize_medium(medium: Column) -> Column:
    return F.when(medium.isin("cpc", "ppc", "paid"), "paid").otherwise(medium)


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def captured_click_ids(params: Column, click_ids: dict[str, tuple[str, str]] | None = None) -> Column:
    """The entries of params that are click ids."""
    return F.map_filter(params, lambda k, v: k.isin(*(click_ids or CLICK_IDS)) & v.isNotNull())


def referer_domain(referer: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(referer, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1), r"^www\.", "")


def classify(params: Column, referer: Column, click_ids: dict[str, tuple[str, str]] | None = None, referers: dict[str, tuple[str, str]] | None = None, domain: Column | None = None) -> Column:
    """Struct of a visit's source from its query parameters (a map) and referer (domain: its referer_domain, if that is at hand).

    Field by field, a click id comes before a partner code, that before UTM parameters, those before the referer. Where there
    is any UTM parameter, the missing ones count as given and empty.
    """
    click_ids, referers = click_ids or CLICK_IDS, referers or REFERER_HOSTS
    # The first click id in their order that is given: one look at the map for all of them.
    held = F.filter(F.array(*[F.lit(name) for name in click_ids]), lambda name: params[name].isNotNull())
    kind = F.get(held, F.lit(0))
    platform, medium = (_lookup({name: x[i] for name, x in click_ids.items()})[kind] for i in (0, 1))
    value = params[kind]
    partner = F.coalesce(params["via"], params["ref"])
    any_utm = F.lit(False)
    for name in UTM:
        any_utm = any_utm | F.map_contains_key(params, name)
    assistants = _lookup({h: p for h, (p, m) in REFERER_HOSTS.items() if m == "ai"})
    assistant = assistants[F.regexp_replace(F.lower(params["utm_source"]), r"^www\.", "")]
    utm_platform = F.coalesce(assistant, params["utm_source"])
    utm_medium = F.when(assistant.isNotNull(), "ai").when(F.map_contains_key(params, "utm_medium"), normalize_medium(params["utm_medium"])).otherwise("unknown")
    blank = referer.isNull() | (referer == "")
    domain = referer_domain(referer) if domain is None else domain
    known_platform, known_medium = _lookup({h: x[0] for h, x in referers.items()})[domain], _lookup({h: x[1] for h, x in referers.items()})[domain]
    ref_platform = F.when(blank, "direct").otherwise(F.coalesce(known_platform, F.lit("referral")))
    ref_medium = F.when(blank, "direct").otherwise(F.coalesce(known_medium, F.lit("referral")))
    base_confidence = F.when(~blank & known_platform.isNotNull(), "medium").otherwise("low")
    clicked = kind.isNotNull()
    return F.struct(
        F.when(clicked, platform).when(any_utm, utm_platform).otherwise(ref_platform).alias("platform"),
        F.when(clicked, medium).when(partner.isNotNull(), "referral").when(any_utm, utm_medium).otherwise(ref_medium).alias("medium"),
        params["utm_campaign"].alias("campaign"),
        params["utm_content"].alias("content"),
        params["utm_term"].alias("term"),
        kind.alias("click_id_type"),
        value.alias("click_id_value"),
        partner.alias("partner_code"),
        F.when(~blank, domain).alias("referer_domain"),
        F.when(~blank, referer).alias("referer_url"),
        F.when(clicked, "high").when(any_utm, "medium").otherwise(base_confidence).alias("confidence"),
        captured_click_ids(params, click_ids).alias("captured_click_ids"),
    )

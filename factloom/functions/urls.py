"""URL expressions: canonical form, host and path, geography, site classes. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_brand utm_social utm_social-type gclid dclid gclsrc gbraid wbraid _gl "
    "fbclid fb_action_ids fb_action_types fb_source fb_ref igshid igsh mc_cid mc_eid mkt_tok _t _d _r _t_t ttclid is_from_webapp sender_device "
    "ref ref_src ref_url referrer referer share share_id share_token shareid shared_from source src from feature app ab_channel "
    "embeds_referring_euri embeds_referring_origin embeds_widget_referrer si _branch_referrer _branch_match_id _hsenc _hsmi __hstc __hssc epik trk"
).split()
INDIA_TLDS = ".in .co.in .org.in .gov.in .ac.in .net.in .firm.in .gen.in .ind.in".split()
INDIA_HOSTS = (
    "ndtv.com indianexpress.com hindustantimes.com timesofindia.indiatimes.com economictimes.indiatimes.com thehindu.com thehindubusinessline.com "
    "livemint.com moneycontrol.com business-standard.com businesstoday.in news18.com firstpost.com indiatvnews.com republicworld.com thewire.in scroll.in "
    "thequint.com theprint.in outlookindia.com rediff.com mid-day.com flipkart.com myntra.com nykaa.com ajio.com tatacliq.com jiomart.com croma.com "
    "snapdeal.com paytmmall.com meesho.com firstcry.com lenskart.com shopclues.com limeroad.com purplle.com pepperfry.com urbanic.com boat-lifestyle.com "
    "zepto.in blinkit.com swiggy.com instamart.com dunzo.com bigbasket.com zomato.com hotstar.com jiocinema.com sonyliv.com voot.com altbalaji.com zee5.com "
    "mxplayer.in magicbricks.com 99acres.com naukri.com bookmyshow.com makemytrip.com yatra.com ixigo.com irctc.co.in policybazaar.com paisabazaar.com "
    "bankbazaar.com 1mg.com pharmeasy.in netmeds.com apollopharmacy.in byjus.com unacademy.com vedantu.com cleartrip.com goibibo.com easemytrip.com oyo.com "
    "treebo.in fabhotels.com nobroker.com housing.com squareyards.com commonfloor.com proptiger.com makaan.com nestaway.com justdial.com sulekha.com "
    "urbancompany.com practo.com lybrate.com insider.in shine.com"
).split()
INDIA_SUBREDDITS = (
    "india indiaspeaks askindia indianbusiness indianeconomy indianfood indiansocial indianpets indianmarketing bangalore mumbai delhi chennai hyderabad pune "
    "kolkata ahmedabad kerala tamilnadu karnataka maharashtra punjab westbengal rajasthan telangana indiandev indianfinance indianstreetbets indiandiscussion"
).split()
QUORA_TOKENS = "india indian bharat hindi".split()
SITE_CLASSES = {
    "quick_commerce": "zepto.in blinkit.com swiggy.com instamart.com dunzo.com bigbasket.com zomato.com",
    "ecom_india": "flipkart.com myntra.com nykaa.com ajio.com tatacliq.com jiomart.com croma.com snapdeal.com meesho.com firstcry.com lenskart.com pepperfry.com purplle.com limeroad.com shopclues.com",
    "ecom_global": "amazon.in amazon.com amazon.co.uk etsy.com ebay.com walmart.com target.com bestbuy.com",
    "reviews": "trustpilot.com consumerreports.org bestproducts.com influenster.com makeupalley.com",
    "travel": "makemytrip.com yatra.com ixigo.com cleartrip.com goibibo.com irctc.co.in easemytrip.com booking.com tripadvisor.com trivago.com expedia.com airbnb.com agoda.com oyo.com treebo.in fabhotels.com",
    "real_estate": "magicbricks.com 99acres.com nobroker.com housing.com squareyards.com commonfloor.com proptiger.com makaan.com nestaway.com zillow.com realtor.com",
    "services": "justdial.com sulekha.com urbancompany.com practo.com 1mg.com pharmeasy.in netmeds.com apollopharmacy.in lybrate.com policybazaar.com bankbazaar.com paisabazaar.com naukri.com shine.com monster.com bookmyshow.com insider.in",
}
WEB_EXCLUDED = "reddit.com quora.com youtube.com tiktok.com substack.com trustpilot.com amazon.in amazon.com flipkart.com".split()
# ----------------------------------------------------------------------------------------------

SPLIT = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)


def strip(text: Column) -> Column:
    """A text without blanks of any kind around it."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(strip(url), SPLIT, k)


def host_of(url: Column) -> Column:
    """Lower-case host without userinfo, port and a leading www.; null if the url has none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(bare, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.lower(part(url, 3))


def _encode(v: Column) -> Column:
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(v), v)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without www. and default port; tracking and blank parameters
    dropped, the rest decoded, sorted and encoded again; single slashes, none at the end; no fragment.
    Text without '://' is trimmed; null gives ''. Idempotent."""

    def pieces(u: Column) -> Column:
        get = lambda k: F.regexp_extract(u, SPLIT, k)
        return F.struct(u.alias("u"), F.lower(get(1)).alias("s"), F.lower(get(2)).alias("n"), get(3).alias("p"), get(4).alias("q"))

    def clean(p: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(p["n"], r"^.*@", ""), r":\d*$", ""), r"^www\.", "")
        pairs = F.filter(F.split(p["q"], "&"), lambda x: x.rlike("^[^=]+=.+$"))
        named = F.transform(pairs, lambda x: F.struct(_encode(F.substring_index(x, "=", 1)).alias("k"), _encode(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
        kept = F.array_sort(F.filter(named, lambda x: ~F.lower(x["k"]).isin(*TRACKING)))
        query = F.when(p["q"] == "", "").otherwise(F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&"))
        path = F.regexp_replace(F.when(p["p"] == "", "/").otherwise(p["p"]), "/{2,}", "/")
        return F.struct(p["u"].alias("u"), p["s"].alias("s"), bare.alias("h"), F.regexp_extract(p["n"], r":(\d+)$", 1).alias("port"), path.alias("p"), query.alias("q"))

    def join(r: Column) -> Column:
        keep = (r["port"] != "") & ~((r["s"] == "https") & (r["port"] == "443")) & ~((r["s"] == "http") & (r["port"] == "80"))
        path = F.when(F.length(r["p"]) > 1, F.regexp_replace(r["p"], "/+$", "")).otherwise(r["p"])
        whole = F.concat(r["s"], F.lit("://"), r["h"], F.when(keep, F.concat(F.lit(":"), r["port"])).otherwise(""), path, F.when(r["q"] != "", F.concat(F.lit("?"), r["q"])).otherwise(""))
        return F.when(r["s"] == "", r["u"]).otherwise(whole)

    return F.coalesce(_let(_let(_let(strip(url), pieces), clean), join), F.lit(""))


def geo_scope(url: Column) -> Column:
    """india, row or unknown, from the host, its suffix, and the path of two forums."""
    host, path = host_of(url), path_of(url)
    india = (
        host.rlike(f"(?:{alternatives(INDIA_TLDS)})$") | host.rlike(rf"(?:^|\.)(?:{alternatives(INDIA_HOSTS)})$")
        | (host.contains("reddit.com") & F.regexp_extract(path, r"/r/([a-z0-9_]+)", 1).isin(*INDIA_SUBREDDITS))
        | (host.contains("quora.com") & path.rlike(alternatives(QUORA_TOKENS)))
    )
    return F.when(host.isNull(), "unknown").when(india, "india").otherwise("row")


def site_class(url: Column) -> Column:
    """First class whose host list ends the url's host (no dot is required before the match), else other."""
    host = F.regexp_extract(F.lower(url), r"^https?://([^/]+)/", 1)
    out = None
    for name, hosts in SITE_CLASSES.items():
        hit = host.rlike(f"(?:{alternatives(hosts.split())})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def web_excluded(url: Column) -> Column:
    """Whether a url belongs to another channel than the open web; null and empty urls do."""
    host = F.regexp_replace(F.substring_index(F.regexp_replace(F.lower(url), "^https?://", ""), "/", 1), r"^www\.", "")
    return (F.coalesce(url, F.lit("")) == "") | host.rlike(rf"(?:^|\.)(?:{alternatives(WEB_EXCLUDED)})$")


def canonical_question(url: Column) -> Column:
    """A question page without fragment, /answer/<author> suffix and closing slashes."""
    bare = F.substring_index(url, "#", 1)
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)/answer/[^/?#]+(/?$|/?\?)", "$1"), "/+$", "")


def essay_url(url: Column) -> Column:
    """Canonical url of a newsletter essay (/p/<slug> on its host); null for other pages."""
    ok = url.rlike(r"(?i)^https?://(?:[a-z0-9-]+\.)?substack\.com/") & url.rlike(r"(?i)/p/[^/?#]+")
    return F.when(ok, F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "/+$", ""))


_CLIP = {
    "video": r"(?i)^https?://(?:www\.|m\.)?tiktok\.com/@([A-Za-z0-9._-]+)/video/(\d+)",
    "discover": r"(?i)^https?://(?:www\.)?tiktok\.com/discover/([a-zA-Z0-9][a-zA-Z0-9-]*)",
    "tag": r"(?i)^https?://(?:www\.)?tiktok\.com/tag/([a-zA-Z0-9_-]+)",
}


def clip_parts(url: Column) -> tuple[Column, Column]:
    """(kind, canonical url) of a clip site's video, discover or tag page; nulls for others."""
    a = {k: F.regexp_extract(url, p, 1) for k, p in _CLIP.items()}
    base = "https://www.tiktok.com/"
    kind = F.when(a["video"] != "", "video").when(a["discover"] != "", "discover").when(a["tag"] != "", "tag")
    canon = (
        F.when(a["video"] != "", F.concat(F.lit(base + "@"), a["video"], F.lit("/video/"), F.regexp_extract(url, _CLIP["video"], 2)))
        .when(a["discover"] != "", F.concat(F.lit(base + "discover/"), a["discover"])).when(a["tag"] != "", F.concat(F.lit(base + "tag/"), a["tag"]))
    )
    return kind, canon


def clip_creator(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, _CLIP["video"], 1), F.lit(""))


def clip_tag(url: Column) -> Column:
    """The topic of a discover or tag page as one word in lower case."""
    slug = F.coalesce(*[F.nullif(F.regexp_extract(url, _CLIP[k], 1), F.lit("")) for k in ("discover", "tag")])
    return F.when(F.regexp_extract(url, _CLIP["video"], 1) == "", F.nullif(F.lower(F.regexp_replace(slug, "[-_]", "")), F.lit("")))

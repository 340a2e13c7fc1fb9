"""URL canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_cid",
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "li_fat_id", "mc_cid", "mc_eid",
    "ref", "source", "_ga", "_gl", "yclid", "igshid", "oly_anon_id", "oly_enc_id", "_hsenc", "_hsmi", "mkt_tok",
    "hsa_cam", "hsa_grp", "hsa_mt", "hsa_src", "hsa_ad", "hsa_acc", "hsa_net", "hsa_ver", "hsa_la", "hsa_ol", "hsa_kw", "hsa_tgt",
    "hsa_bal", "hsa_bet", "hsa_bot", "hsa_pst", "hsa_adid", "hsa_cam_id", "hsa_net_id", "hsa_ver_id",
    "pk_campaign", "pk_kwd", "pk_source", "pk_medium",
)
#: Where profiles of people and companies live.
SOCIAL = ("linkedin.com", "twitter.com", "x.com", "instagram.com", "facebook.com", "youtube.com", "pinterest.com")


def normalize_url(u: Column) -> Column:
    """Lower-case scheme and host without www., default port or fragment; single slashes; no trailing slash; parameters
    sorted, without TRACKING. Null or not http(s): null."""
    s = F.trim(u)
    scheme = F.lower(F.regexp_extract(s, r"(?i)^(https?)://", 1))
    rest = F.regexp_replace(F.regexp_replace(s, r"(?i)^https?://", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/{2,}", "/"), r"/$", "")
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def is_tracking(u: Column) -> Column:
    """Whether a parameter only tracks."""
    names = F.transform(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: F.lower(F.split(p, "=")[0]))
    return F.arrays_overlap(names, F.array(*[F.lit(x) for x in TRACKING]))


def canonical_link(html: Column) -> Column:
    """The page's own address: link rel=canonical, else og:url, normalized; null where there is neither."""
    tag = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    link = F.coalesce(
        tag(r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]+)"'), tag(r'(?i)<link[^>]*href="([^"]+)"[^>]*rel="canonical"'),
        tag(r'(?i)<meta[^>]*property="og:url"[^>]*content="([^"]+)"'), tag(r'(?i)<meta[^>]*content="([^"]+)"[^>]*property="og:url"'),
    )
    return normalize_url(link)


def social_handle(u: Column) -> Column:
    """struct(platform, handle) of a profile's address, null for other links: a site's root, or no company, person or school."""
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#]+)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    ok = F.when(host == "linkedin.com", path.rlike("^/(company|in|school)/")).when(host == "youtube.com", path.rlike("/channel/|/c/|/@")).otherwise(path != "")
    return F.when(host.isin(*SOCIAL) & ok & (last != ""), F.struct(host.alias("platform"), last.alias("handle")))

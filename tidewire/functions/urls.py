"""Column functions on URLs and on the keys made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, title_key

# Query parameters that only track the reader; so do all that start with utm_.
TRACKING = (
    "gclid gclsrc dclid fbclid msclkid twclid igshid mc_cid mc_eid ref referer referrer cmpid smid share src source "
    "s_cid ncid trk trkCampaign trkFlavour trkId trkOrg trkPosition vero_id oly_enc_id recruiter recruitment spm scene from"
).split()
# Parameters in which a redirect holds its target.
WRAPPED = "u url link to target dest q".split()


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """One spelling for each page: https, bare lower-case host, clean path, sorted parameters without trackers."""
    u = F.replace(squeeze(url), F.lit(" "), F.lit("%20"))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    scheme = F.when(scheme.isin("http", "https", ""), F.lit("https")).otherwise(scheme)
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    trackers = [t for t in TRACKING if t == t.lower()]

    def own(pair: Column) -> Column:
        key = F.lower(F.regexp_extract(pair, "^([^=]*)", 1))
        return (pair != "") & ~key.isin(trackers) & ~key.startswith("utm_")

    pairs = F.transform(F.filter(F.split(query, "&"), own), lambda p: F.regexp_replace(p, "=$", ""))
    rest = F.array_join(F.array_sort(pairs), "&")
    full = F.concat(scheme, F.lit("://"), host(u), F.when(path == "", F.lit("/")).otherwise(path), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("?"), rest)))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(full)


def unwrap_redirect(url: Column, hosts: list[str]) -> Column:
    """The first web address among a known redirect's parameters, else the URL itself."""
    value = lambda name: F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    decoded = [F.try_url_decode(value(name)) for name in WRAPPED]
    target = F.coalesce(*[F.when(d.rlike("^https?://"), d) for d in decoded])
    return F.when(host(url).isin(hosts) & target.isNotNull(), target).otherwise(url)


def url_hash(url: Column) -> Column:
    return F.sha1(normalize_url(url))


def article_hash(title: Column, url: Column) -> Column:
    return F.sha1(F.concat(title_key(title), F.lit("|"), normalize_url(url)))


def event_key(title: Column) -> Column:
    key = title_key(title)
    return F.sha1(F.substring(F.when(key == "", F.lower(title)).otherwise(key), 1, 180))


def on_domain(url: Column, domains: list[str]) -> Column:
    h = host(url)
    one = [(h == d) | h.endswith("." + d) for d in domains]
    out = F.lit(False)
    for x in one:
        out = out | x
    return out

"""URL expressions. Bad or missing URLs give empty strings, never errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query parameters that carry no meaning start with one of these.
TRACKING = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid", "s_cid", "cmpid", "spm", "_ga")
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


def _text(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit("")))


def authority(url: Column) -> Column:
    """Host and port in lower case."""
    return F.lower(F.regexp_extract(_text(url), _AUTHORITY, 1))


def search_domain(url: Column) -> Column:
    """Domain key of search and fetch: without a leading www., port kept."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def health_domain(url: Column) -> Column:
    """Domain key of the health record: without port, then without a leading www."""
    return F.regexp_replace(F.split_part(authority(url), F.lit(":"), F.lit(1)), r"^www\.", "")


def valid_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(F.lower(F.trim(url)).rlike(r"^https?://[^/?#]+"), F.lit(False))


def canonical_url(url: Column) -> Column:
    """One address per article: lower-case host without www., then m., then amp.; no tracking
    parameters, no trailing slash, no fragment. Text without an authority is returned as it is.
    Parameters keep their spelling; see operators.extract.canonical_urls for full re-encoding."""
    text = _text(url)
    host = authority(url)
    for prefix in (r"^www\.", r"^m\.", r"^amp\."):
        host = F.regexp_replace(host, prefix, "")
    junk = "^(" + "|".join(TRACKING) + ")"
    kept = F.filter(F.split(F.regexp_extract(text, _QUERY, 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(junk))
    kept = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    path = F.regexp_replace(F.regexp_extract(text, _PATH, 1), r"/+$", "")
    scheme = F.lower(F.regexp_extract(text, _SCHEME, 1))
    whole = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(authority(url) == "", F.coalesce(url, F.lit(""))).otherwise(whole)


def unwrapped(link: Column) -> Column:
    """The target in a redirect's url parameter where it starts with http, else the link."""
    target = F.try_url_decode(F.regexp_extract(F.coalesce(link, F.lit("")), r"[?&]url=([^&#]*)", 1))
    return F.when(target.startswith("http"), target).otherwise(F.coalesce(link, F.lit("")))


def video_id(url: Column) -> Column:
    """The id in a video address of an allowed host, or an empty string."""
    text, host = _text(url), authority(url)
    path = F.regexp_extract(text, _PATH, 1)
    short = F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1))
    watch = F.regexp_extract(F.regexp_extract(text, _QUERY, 1), r"(?:^|&)v=([^&]*)", 1)
    player = F.regexp_extract(path, r"^/(?:embed|shorts|live|v)/([^/]*)", 1)
    found = F.when(host.isin("youtu.be", "www.youtu.be"), short).when(path == "/watch", watch).otherwise(player)
    return F.when(host.isin(*VIDEO_HOSTS) & found.rlike(_VIDEO_ID), found).otherwise("")


def resolved(href: Column, page: Column) -> Column:
    """An anchor's address against its page, for absolute, scheme-relative, rooted and plain forms."""
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    slashed = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?"), F.concat(F.regexp_extract(page, r"^([^?#]*)", 1), href)).otherwise(F.concat(slashed, href))

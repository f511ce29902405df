"""Fetching: a ladder of tiers that escalates until a page gives enough prose.

Tiers are callables, so network clients can be plugged in; the offline tier is a join with a table of
pages. URLs are dealt by domain, so one task serves a domain at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import scores, text, urls
from millrace.operators import cache, classify, extract
from millrace.sources import documents

#: A tier takes a url and returns (html, text, reason): html to extract from, or text that is ready. A
#: document's tier adds its kind as a fourth; the lines of such a text stay.
Tier = Callable[[str], tuple]
#: A client takes a url and returns (status, content type, body).
Client = Callable[[str], tuple[int, str, bytes]]
RESULT = "url string, ok boolean, text string, tier string, extractor string, chars int, reason string, html string, content_type string"

# Bytes of a body that are read. Documents are whole or nothing; a page is cut.
MOST_PDF, MOST_DOCUMENT, MOST_PAGE = 25 << 20, 50 << 20, 10_000_000
DOCUMENT_CHARS = 20_000


def opened(body: bytes | None, url: str = "", content_type: str = "", limit: int = DOCUMENT_CHARS) -> tuple[str, str, str, str]:
    """(html, text, reason, kind) of a response's bytes.

    The signature decides, the header and the address only where there is none. A document whose header
    lies is read as the page that it probably is; kind is then empty, as it is for pages.
    """
    body, claimed = body or b"", (content_type or "").lower()
    name = (url or "").lower().partition("?")[0]
    kind = documents.kind_of(body, url, content_type) or ("pdf" if "pdf" in claimed or name.endswith(".pdf") else "")
    if kind:
        if len(body) > (MOST_PDF if kind == "pdf" else MOST_DOCUMENT):
            return "", "", "pdf_too_large" if kind == "pdf" else "document_too_large", kind
        return "", *documents.to_text(body, kind, limit), kind
    html = body[:MOST_PAGE].decode("utf-8", "replace")
    paged = not claimed or "html" in claimed or "xml" in claimed
    if not paged and not (name.endswith(documents.NAMED) and len(html) > classify.USABLE):
        return "", "", f"content_type:{claimed[:30]}", ""
    return html, "", "html_truncated" if len(body) > MOST_PAGE else "", ""


def direct(client: Client, prefix: str = "") -> Tier:
    """A tier over a client: refusals by status, bodies by their bytes."""

    def tier(url: str) -> tuple[str, str, str, str]:
        status, content_type, body = client(url)
        if status != 200:
            head = (body or b"")[: classify.HEAD].decode("utf-8", "replace").lower()
            blocked = status in (403, 429, 503) and any(m in head for m in classify.CHALLENGES)
            return "", "", prefix + ("challenge_needs_a_human" if blocked else f"http_{status}"), ""
        return opened(body, url, content_type)

    return tier


@dataclass(frozen=True)
class Ladder:
    """Tiers in order of cost; ``first`` moves one to the front; ``budget`` seconds bound a page."""

    tiers: tuple[tuple[str, Tier], ...]
    first: str | None = None
    resting: tuple[str, ...] = ()
    budget: float | None = None

    def order(self) -> list[tuple[str, Tier]]:
        own = [x for x in self.tiers if x[0] not in self.resting]
        return sorted(own, key=lambda x: x[0] != self.first)

    def run(self, url: str) -> dict:
        """The first result with enough prose, or the longest thin one, or all reasons."""
        began, best, reasons = time.monotonic(), None, []
        for name, tier in self.order():
            if self.budget is not None and time.monotonic() - began > self.budget:
                reasons.append("page_budget_spent")
                break
            try:
                html, ready, reason, *kind = tier(url)
            except Exception as error:  # a tier is foreign code; its failure is a reason, not the job's
                html, ready, reason, kind = "", "", type(error).__name__, []
            kind = kind[0] if kind else ""
            prose, by = (documents.structured(ready), kind) if kind else (" ".join(ready.split()), "native")
            if kind and prose:
                return self._row(url, prose, name, by, reason, "", kind)
            if not prose and len(html) >= classify.SMALL:
                prose, by = " ".join(extract._density(html)[0].split()), "density"
            if len(prose) >= classify.THIN:
                return self._row(url, prose, name, by, reason if html else "", html)
            if len(prose) >= classify.USEFUL:
                if best is None or len(prose) > best["chars"]:
                    best = self._row(url, prose, name, by, "", html)
            else:
                reasons.append(f"{name}:{reason or 'no_prose'}")
        return best or {"url": url, "ok": False, "text": "", "tier": "", "extractor": "", "chars": 0, "reason": "; ".join(reasons)[:160], "html": "", "content_type": ""}

    @staticmethod
    def _row(url, prose, tier, by, reason, html, kind="html") -> dict:
        return {"url": url, "ok": True, "text": prose, "tier": tier, "extractor": by, "chars": len(prose), "reason": reason, "html": html, "content_type": classify.MIME.get(kind, "text/plain")}


def render_mode(value: bool | str | None) -> str:
    """auto, never or first, from the spellings that callers use."""
    if value is None or value is True or value == "auto":
        return "auto"
    if value is False or value == "never":
        return "never"
    if value in ("first", "always"):
        return "first"
    raise ValueError(f"unknown render mode {value!r}")


def live(requests: DataFrame, ladder: Ladder) -> DataFrame:
    """RESULT rows of the ladder for (url)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([ladder.run(u) for u in frame["url"]], columns=[x.split()[0] for x in RESULT.split(", ")])

    good = requests.filter(urls.valid_url(F.col("url"))).select("url")
    return good.repartition(urls.search_domain(F.col("url"))).mapInPandas(run, RESULT)


def dispatched(files: DataFrame, limit: int = DOCUMENT_CHARS) -> DataFrame:
    """files (url, content binary[, content_type]) with html, prose, why and kind by the bytes."""
    typed = files if "content_type" in files.columns else files.withColumn("content_type", F.lit(""))

    @F.pandas_udf("struct<html:string,prose:string,why:string,kind:string>")
    def run(content: pd.Series, url: pd.Series, claimed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([opened(c, u, t, limit) for c, u, t in zip(content, url, claimed, strict=True)], columns=["html", "prose", "why", "kind"])

    rows = typed.withColumn("__r", run("content", "url", "content_type"))
    missing = F.col("content").isNull()
    return rows.select(*[c for c in files.columns if c not in ("content", "content_type")], F.when(~missing, F.col("__r.html")).alias("html"), "__r.prose", "__r.why", "__r.kind")


def offline(requests: DataFrame, pages: DataFrame, limit: int = 3500, form: str = "text") -> DataFrame:
    """The fetch result of each requested url from a table of pages (url, html), or of raw bodies
    (url, content binary[, content_type]), which are opened by their bytes: documents give their text.

    form: text, html or links. Requests are joined first, so only wanted pages are opened and extracted.
    """
    if form not in ("text", "html", "links"):
        raise ValueError(f"unknown form {form!r}")
    wanted, raw = requests.select("url").distinct(), "content" in pages.columns
    own = ["url", *[c for c in (("content", "content_type") if raw else ("html",)) if c in pages.columns]]
    found = wanted.join(pages.select(*own).dropDuplicates(["url"]), "url", "left")
    found = dispatched(found) if raw else found.withColumns({"prose": F.lit(""), "why": F.lit(""), "kind": F.lit("")})
    valid, document = urls.valid_url(F.col("url")), F.col("kind") != ""
    rows = extract.extract(extract.links(found) if form == "links" else found, limit)
    body = {"text": F.col("text"), "html": text.clip(F.col("html"), limit)}.get(form) if form != "links" else F.substring("links", 1, limit)
    body = F.when(document, text.cut_at_space(F.col("prose"), limit)).otherwise(body)
    refused = F.col("why").startswith("content_type:")
    reason = F.when(~valid, "invalid_url").when(F.col("html").isNull(), "not_in_pages").when(document | refused, F.col("why")).otherwise(F.col("reason"))
    ok = valid & F.when(document, F.col("prose") != "").otherwise(F.col("ok"))
    kind = F.when(document, classify.mime(F.col("kind"))).otherwise("text/html")
    tier = F.when(document, F.col("kind")).otherwise(F.col("tier"))
    return rows.select("url", F.when(ok, body).otherwise("").alias("content"), kind.alias("content_type"), F.when(ok, "ok").otherwise("failed").alias("quality"), F.concat_ws("/", F.lit("pages"), tier).alias("tier"), F.lit(False).alias("cached"), "title", "published", F.substring(reason, 1, 160).alias("failure_reason"))


def fetch(requests: DataFrame, pages: DataFrame, entries: DataFrame | None = None, as_of: Column | None = None, limit: int = 3500, form: str = "text") -> DataFrame:
    """Cached answers where fresh, the offline tier for the rest; one row per url. The cache holds text,
    so the other forms pass it by."""
    if entries is None or form != "text":
        return offline(requests, pages, limit, form)
    keyed = requests.select("url").distinct().select("url", F.lit("extract").alias("kind"), scores.cache_key(F.lit("extract"), F.col("url")).alias("key"))
    seen = cache.lookup(keyed, entries, as_of)
    value = F.from_json("value", "struct<text:string,title:string,published:string>")
    hits = seen.filter("hit").withColumn("v", value).select("url", text.clip(F.col("v.text"), limit).alias("content"), F.lit("text/html").alias("content_type"), F.lit("ok").alias("quality"), F.lit("cache/").alias("tier"), F.lit(True).alias("cached"), F.col("v.title").alias("title"), F.col("v.published").alias("published"), F.lit("").alias("failure_reason"))
    return hits.unionByName(offline(seen.filter(~F.col("hit")), pages, limit))

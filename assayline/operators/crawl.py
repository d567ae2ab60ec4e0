"""Web pages and crawls: links, URLs, trees, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that don't tell pages apart.
TRASH = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "_t", "timestamp", "_")
#: Endings of paths that are no pages.
SKIPPED_ENDINGS = (".pdf", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".woff", ".woff2")


def normalize_url(raw: Column, trash: tuple[str, ...] = TRASH, drop_query: bool = False) -> Column:
    """Lower-case scheme and host, no fragment, default port or trash parameters, sorted parameters, '/' for no path."""
    part = lambda pattern: F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", pattern)
    scheme, authority, path, query = (part(i) for i in (1, 2, 3, 4))
    user, host = F.regexp_extract(authority, "^(.*@)?", 0), F.lower(F.regexp_replace(authority, "^.*@", ""))
    default = F.when(F.lower(scheme) == "http", F.regexp_replace(host, ":80$", "")).when(F.lower(scheme) == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*trash)))
    tail = F.lit("") if drop_query else F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lower(scheme), F.lit("://"), user, default, F.when(path == "", "/").otherwise(path), tail)


def in_scope(url: Column, scheme: str, host: str, subdomains: bool = False) -> Column:
    """Same scheme, same host (or one below it), and no ending that is no page."""
    own = F.lower(F.parse_url(url, F.lit("HOST")))
    same = (own == host) | (own.endswith("." + host) if subdomains else F.lit(False))
    path = F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    skipped = F.lit(False)
    for e in SKIPPED_ENDINGS:
        skipped = skipped | path.endswith(e)
    return F.coalesce((F.parse_url(url, F.lit("PROTOCOL")) == scheme) & same & ~skipped, F.lit(False))


def outlinks(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) → (page_id, link): distinct links without fragments, resolved against the page's address.

    Quotes may be double, single or absent, letters of tag and attribute large; schemes other than http and https give none.
    """
    tags = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*>"), F.lit(0))).alias("tag"))
    forms = (r'(?i)\shref\s*=\s*"([^"#]*)', r"(?i)\shref\s*=\s*'([^'#]*)", r"(?i)\shref\s*=\s*([^\s>\"'#]+)")
    href = F.trim(F.coalesce(*(F.nullif(F.regexp_extract("tag", f, 1), F.lit("")) for f in forms)))
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    link = (
        F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url", "^([a-z]+:)", 1), "href")).when(F.col("href").startswith("/"), F.concat(root, "href"))
        .when(F.col("href").startswith("?"), F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), "href")).otherwise(F.concat(folder, F.regexp_replace("href", r"^(?:\./)+", "")))
    )
    return tags.select("page_id", "url", href.alias("href")).select("page_id", link.alias("link")).where("link is not null").distinct()


def path_tree(urls: DataFrame) -> DataFrame:
    """urls (host, path) → (host, prefix, depth, own, below): every prefix of every path with its own and all pages below."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    cut = urls.select("host", parts.alias("p"))
    each = cut.select("host", "p", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"))
    node = each.select("host", F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/")).alias("prefix"), "depth", (F.col("depth") == F.size("p")).alias("own"))
    return node.groupBy("host", "prefix", "depth").agg(F.count_if("own").alias("own"), F.count(F.lit(1)).alias("below"))


def with_parent(urls: DataFrame) -> DataFrame:
    """urls (url, parent_url) with state: root (no parent), child, or orphan (its parent is not among the urls)."""
    known = urls.select(F.col("url").alias("parent_url")).distinct().withColumn("known", F.lit(True))
    return urls.join(known, "parent_url", "left").withColumn("state", F.when(F.col("parent_url").isNull(), "root").when(F.col("known"), "child").otherwise("orphan")).drop("known")


def strip_text_urls(text: Column) -> Column:
    """[t](url) becomes t; bare URLs and [n] notes go."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\(https?://[^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"https?://\S+", ""), r"\[\d+\]", "")


#: Scripts of captchas; the share of canvas and the number of frames beyond which a page is limited.
CAPTCHAS = ("recaptcha", "hcaptcha", "turnstile")
MOST_CANVAS, MOST_FRAMES = 0.3, 2


def static_signals(html: Column) -> Column:
    """struct of what a page's source tells: captcha, and how many closed shadow roots, sockets, event sources, dialogs
    and frames it opens. canvas_ratio is for those who have seen the page rendered, here null."""
    low = F.lower(F.coalesce(html, F.lit("")))
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    captcha = F.lit(False)
    for name in CAPTCHAS:
        captcha = captcha | low.contains(name)
    return F.struct(
        captcha.alias("captcha"), count(r"mode\s*:\s*['\"]closed|shadowrootmode\s*=\s*['\"]?closed").alias("closed_shadows"), count(r"new\s+websocket\s*\(").alias("sockets"),
        count(r"new\s+eventsource\s*\(").alias("event_sources"), F.lit(None).cast("double").alias("canvas_ratio"), count(r"\b(?:alert|confirm|prompt)\s*\(").alias("dialogs"), count(r"<iframe\b").alias("frames"),
    )


def compat_verdict(signals: Column) -> Column:
    """struct(verdict, reasons) of a page's signals: what rules it out, else limited with all its reasons, else compatible."""
    n = lambda name: F.coalesce(signals[name], F.lit(0))
    counted = [F.when(n(name) > most, F.concat(F.lit(f"{name}: "), n(name).cast("string"))) for name, most in (("sockets", 0), ("event_sources", 0))]
    canvas = F.when(n("canvas_ratio") > MOST_CANVAS, F.lit("canvas_ratio"))
    later = [F.when(n(name) > most, F.concat(F.lit(f"{name}: "), n(name).cast("string"))) for name, most in (("dialogs", 0), ("frames", MOST_FRAMES))]
    limits = F.array_compact(F.array(*counted, canvas, *later))
    captcha, closed = F.coalesce(signals["captcha"], F.lit(False)), n("closed_shadows") > 0
    verdict = F.when(captcha, "incompatible:captcha").when(closed, "incompatible:closed-shadow").when(F.size(limits) > 0, "limited").otherwise("compatible")
    reasons = F.when(captcha, F.array(F.lit("captcha"))).when(closed, F.array(F.concat(F.lit("closed_shadows: "), n("closed_shadows").cast("string")))).otherwise(limits)
    return F.struct(verdict.alias("verdict"), reasons.alias("reasons"))

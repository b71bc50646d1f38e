"""URL functions as column expressions, for absolute URLs with an authority.

Anything else counts as unparsable: it normalizes to itself, has no host and is
no evidence of a redirect. Dot segments, international hosts and characters that
a URL parser would re-encode are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*@)?([^/?#@:\s]+|\[[^\]]*\])(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(#[\s\S]*)?\z"
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|s_cid)\z"
CREDENTIALS = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*@"


FIELDS = ("scheme", "user", "host", "port", "path", "query", "fragment")


def parts(url: Column) -> Column:
    """The fields of a URL as a struct, empty where missing; null where it cannot be parsed."""
    return F.when(url.rlike(PARTS), F.struct(*[F.regexp_extract(url, PARTS, i + 1).alias(name) for i, name in enumerate(FIELDS)]))


def is_url(url: Column) -> Column:
    return url.rlike(PARTS)


def host_of(url: Column) -> Column:
    return F.when(is_url(url), F.lower(F.regexp_extract(url, PARTS, 3)))


def _path(p: Column) -> Column:
    return F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])


def pathname(url: Column) -> Column:
    """The path, at least ``/``; the whole string where it is no URL."""
    return F.when(url.isNotNull(), let(parts(url), lambda p: F.when(p.isNull(), url).otherwise(_path(p))))


def _search(query: Column) -> Column:
    """The query without tracking parameters; as it stands where it has none."""
    tracked = lambda q: F.substring_index(q, "=", 1).rlike(TRACKING)

    def cleaned(pairs: Column) -> Column:
        kept = F.transform(F.filter(pairs, lambda q: (q != "") & ~tracked(q)), lambda q: F.when(F.contains(q, F.lit("=")), q).otherwise(F.concat(q, F.lit("="))))
        rest = let(F.array_join(kept, "&"), lambda k: F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("?"), k)))
        return F.when(F.exists(pairs, tracked), rest).otherwise(query)

    return F.when(F.length(query) < 2, query).otherwise(let(F.split(F.substring(query, 2, 1 << 30), "&"), cleaned))


def _normalized(p: Column) -> Column:
    scheme = F.lower(p["scheme"])
    default = ((scheme == "https") & (p["port"] == "443")) | ((scheme == "http") & (p["port"] == "80"))
    port = F.when((p["port"] == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    authority = F.concat(scheme, F.lit("://"), p["user"], F.lower(p["host"]), port)
    bare = lambda search: (_path(p) == "/") & (search == "") & (p["fragment"] == "")
    return let(_search(p["query"]), lambda search: F.when(bare(search), authority).otherwise(F.concat(authority, _path(p), search, p["fragment"])))


def normalize_url(url: Column) -> Column:
    return F.when(url.isNotNull(), let(parts(url), lambda p: F.when(p.isNull(), url).otherwise(_normalized(p))))


def has_credentials(url: Column) -> Column:
    return url.rlike(CREDENTIALS)


def norm_path(url: Column) -> Column:
    decoded = let(pathname(url), lambda raw: F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    return let(F.regexp_replace(F.lower(decoded), r"/+\z", ""), lambda short: F.when(short == "", F.lit("/")).otherwise(short))


def moved_away(cited: Column, landed: Column) -> Column:
    """Whether a read landed on the site's root or on an ancestor of the cited path."""
    asks = lambda u: F.length(F.regexp_extract(u, PARTS, 6)) > 1
    known = landed.isNotNull() & (landed != "") & is_url(cited) & is_url(landed)

    def above(path: Column) -> Column:
        root = (path["cited"] != "/") | (asks(cited) & ~asks(landed))
        return F.when(path["landed"] == "/", root).otherwise(F.startswith(path["cited"], F.concat(path["landed"], F.lit("/"))))

    paths = F.struct(norm_path(cited).alias("cited"), norm_path(landed).alias("landed"))
    return F.coalesce(F.when(known, let(paths, above)), F.lit(False))


def is_pdf(url: Column, content_type: Column | None = None) -> Column:
    path = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    by_url = path.rlike(r"(?i)\.pdf\z") | path.rlike("(?i)/pdf/")
    return by_url if content_type is None else by_url | F.coalesce(content_type.rlike("(?i)application/pdf"), F.lit(False))

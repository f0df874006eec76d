"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files that are no pages.
SKIPPED_EXTENSIONS = tuple("css doc docx gif ico jpeg jpg js mp3 mp4 pdf png ppt pptx svg ttf woff woff2 xls xlsx zip".split())
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def parts(url: Column) -> dict[str, Column]:
    """scheme (lower case), authority, path, query, as a URL splitter finds them; never fails."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, SCHEME, "")
    return {
        "scheme": F.lower(F.regexp_extract(bare, SCHEME, 1)),
        "authority": F.regexp_extract(rest, r"^//([^/?]*)", 1),
        "path": F.regexp_extract(rest, r"(?s)^(?://[^/?]*)?([^?]*)", 1),
        "query": F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1),
    }


def _host(authority: Column) -> Column:
    """Without user and port, in lower case."""
    after_user = F.regexp_replace(authority, r"(?s)^.*@", "")
    return F.lower(F.when(after_user.startswith("["), F.regexp_extract(after_user, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(after_user, r"(?s):.*$", "")))


def normal_path(path: Column) -> Column:
    """Dot segments resolved, no empty segments, no final slash; ``/`` if nothing is left.

    Exactly two leading slashes stay two, as POSIX has it. The fold over segments is for the
    few paths that need it.
    """
    segments = F.split(path, "/")

    def step(done: Column, seg: Column) -> Column:
        keep = F.array_append(done, seg)
        climb = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        rootless = (F.size(done) == 0) & ~path.startswith("/")
        return F.when(seg.isin("", "."), done).when((seg == "..") & (rootless | (F.get(done, F.size(done) - 1) == "..")), keep).when(seg == "..", climb).otherwise(keep)

    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    root = F.when(path.rlike("^//(?!/)"), F.lit("//")).otherwise(F.lit("/"))
    needs = path.rlike(r"(^|/)\.{1,2}(/|$)|//")
    trimmed = F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "/$", "")
    out = F.when(needs, F.concat(root, folded)).otherwise(trimmed)
    return F.when(out.rlike("^/+$") | (out == ""), F.lit("/")).otherwise(out)


def normalize_url(url: Column) -> Column:
    """The form under which equal pages compare equal: https, lower-case host without one ``www.``, normal path; no query, no fragment.

    Of ports only 443 is dropped. A null URL is null.
    """
    p = parts(url)
    host = F.regexp_replace(_host(p["authority"]), r"^www\.", "")
    port = F.regexp_extract(F.regexp_replace(p["authority"], r"(?s)^.*@", ""), r":(\d+)$", 1)
    scheme = F.when(p["scheme"].isin("", "http", "https"), F.lit("https")).otherwise(p["scheme"])
    netloc = F.concat(host, F.when(port.isin("", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), F.regexp_replace(port, r"^0+(?=\d)", ""))))
    path = F.regexp_replace(p["path"], r";[^/]*$", "")
    return F.when(url.isNotNull(), F.concat(scheme, F.lit("://"), netloc, normal_path(path)))


def slugify(url: Column) -> Column:
    """A file name for a page: host, path and eight digits of the normalised URL's SHA-1."""
    normal = normalize_url(url)
    p = parts(normal)
    host = F.replace(F.regexp_replace(p["authority"], ":443$", ""), F.lit("www."), F.lit(""))
    path = F.translate(F.btrim(p["path"], F.lit("/")), "/", "_")
    path = F.when(path == "", F.lit("index")).otherwise(path)
    return F.concat_ws("__", host, F.substring(path, 1, 100), F.substring(F.sha1(F.encode(normal, "UTF-8")), 1, 8))


def is_crawlable(url: Column, seed_host: Column, path_prefix: Column | None = None) -> Column:
    """Whether a URL is a page of the seed's host below the prefix (if there is one)."""
    p = parts(url)
    bare = lambda h: F.replace(h, F.lit("www."), F.lit(""))
    ok = p["scheme"].isin("http", "https") & (bare(p["authority"]) == bare(seed_host)) & ~F.lower(p["path"]).rlike(rf"\.({'|'.join(SKIPPED_EXTENSIONS)})$")
    if path_prefix is None:
        return ok
    stem = F.regexp_replace(path_prefix, "/+$", "")
    below = (p["path"] == stem) | p["path"].startswith(F.concat(stem, F.lit("/")))
    return ok & (path_prefix.isNull() | (path_prefix == "") | below)


def topic_of(canonical: Column, anchor: str = "students") -> Column:
    """The path segment after the first ``anchor`` that has one after it, else empty."""
    segments = F.filter(F.split(parts(canonical)["path"], "/"), lambda s: s != "")
    at = F.array_position(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), anchor)
    return F.coalesce(F.when(at > 0, F.get(segments, at.cast("int"))), F.lit(""))


def resolve(href: Column, base: Column) -> Column:
    """``href`` as seen from the page ``base``."""
    b = parts(base)
    root = F.concat(b["scheme"], F.lit("://"), b["authority"])
    folder = F.regexp_replace(b["path"], r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, b["path"], href))
        .when((href == "") | href.startswith("#"), F.concat(root, b["path"]))
        .otherwise(F.concat(root, folder, href))
    )

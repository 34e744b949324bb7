"""URL expressions, written as Spark SQL.

Every function takes SQL text, mostly a column name, and gives a Column. Parts
are cut with regular expressions, not ``parse_url``: that one rejects strings
which crawled pages do contain, and it leaves ``;params`` in the path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
PARAMS = r";[^/]*$"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _tidy(url: str) -> str:
    """Drop what browsers drop: leading blanks and controls, tabs, line breaks."""
    return rf"regexp_replace({url}, r'^[\x00-\x20]+|[\t\r\n]', '')"


def _netloc(url: str) -> str:
    return f"regexp_extract({_tidy(url)}, r'{NETLOC}', 1)"


def _path(url: str) -> str:
    return f"regexp_replace(regexp_extract({_tidy(url)}, r'{PATH}', 1), r'{PARAMS}', '')"


def _parts(url: str) -> str:
    """Struct of scheme, netloc, path (without params) and whether params were not empty."""
    full = f"regexp_extract(t, r'{PATH}', 1)"
    return let(
        "t",
        _tidy(url),
        f"named_struct('scheme', lower(regexp_extract(t, r'{SCHEME}', 1)), 'netloc', regexp_extract(t, r'{NETLOC}', 1),"
        f" 'path', regexp_replace({full}, r'{PARAMS}', ''), 'has_params', {full} rlike r';[^/]+$')",
    )


def _drop_slash(path: str) -> str:
    """Empty path becomes ``/``; otherwise exactly one trailing slash goes."""
    return f"if({path} IN ('', '/'), '/', regexp_replace({path}, r'/$', ''))"


def _is_web(p: str) -> str:
    return f"({p}.scheme IN ('http', 'https') AND {p}.netloc <> '')"


def _clean(p: str) -> str:
    return f"concat({p}.scheme, '://', lower({p}.netloc), {_drop_slash(p + '.path')})"


# Walk down split path segments: ".." leaves a folder, "." stays.
_WALK = (
    "aggregate(s, cast(array() AS array<string>), (done, part) -> CASE WHEN part = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))"
    " WHEN part = '.' THEN done ELSE concat(done, array(part)) END)"
)
_CLIMBED = f"concat(array_join({_WALK}, '/'), if(element_at(s, -1) IN ('.', '..'), '/', ''))"


def _rooted(path: str) -> str:
    return let("g", path, "if(startswith(g, '/'), g, concat('/', g))")


def _joined(base: str, path: str) -> str:
    """Path of a link on a page with path ``base``.

    Below the page's folder, empty inner segments vanish; a path from the root
    keeps them. Dots are resolved in both.
    """
    below = f"regexp_replace(concat('/', regexp_replace({base}, r'[^/]*$', ''), {path}), r'/{{2,}}', '/')"
    whole = f"if(startswith({path}, '/'), {path}, {below})"
    climbed = _rooted(let("s", "split(r, '/')", _CLIMBED))
    return let("r", whole, rf"if(r rlike r'(^|/)\.{{1,2}}(/|$)', {climbed}, r)")


def _resolved(b: str, link: str) -> str:
    """Clean absolute URL of a link on page ``b``; NULL if there is none or it is not http(s)."""
    # "http:page" on an http page is a relative reference.
    foreign = f"({link}.scheme <> '' AND {link}.scheme <> {b}.scheme)"
    same_page = f"({link}.path = '' AND NOT {link}.has_params)"
    path = let("j", f"if({same_page}, {b}.path, {_joined(b + '.path', link + '.path')})", _drop_slash("j"))
    return (
        f"CASE WHEN {foreign} THEN if({_is_web(link)}, {_clean(link)}, NULL)"
        f" WHEN NOT ({b}.scheme IN ('http', 'https')) THEN NULL"
        f" WHEN {link}.netloc <> '' THEN concat({b}.scheme, '://', lower({link}.netloc), {_drop_slash(link + '.path')})"
        f" WHEN {b}.netloc <> '' THEN concat({b}.scheme, '://', lower({b}.netloc), {path}) END"
    )


def url_parts(url: str) -> Column:
    """Struct of scheme, netloc, path and has_params."""
    return F.expr(_parts(url))


def normalize_url(url: str) -> Column:
    """Lower scheme and host, no query, fragment or params, one trailing slash less.

    What is no http(s) URL comes back as it is.
    """
    return F.expr(let("p", _parts(url), f"if({_is_web('p')}, {_clean('p')}, {url})"))


def url_host(url: str) -> Column:
    return F.expr(_netloc(url))


def url_path(url: str) -> Column:
    return F.expr(_path(url))


def lower_path(url: str, name: str, body: str) -> Column:
    """``body`` over the lower-case path, called ``name`` there."""
    return F.expr(let(name, f"lower({_path(url)})", body))


def slash_count(url: str) -> Column:
    return F.expr(let("p", _path(url), "length(p) - length(replace(p, '/', ''))"))


def resolve_all(base: str, hrefs: str) -> Column:
    """Clean absolute URL of each link of a page, in order, NULL where there is none."""
    link = f"transform({hrefs}, h -> {_parts('h')})"
    return F.expr(let("b", _parts(base), f"transform({link}, l -> {_resolved('b', 'l')})"))


def resolve_href(base: str, href: str) -> Column:
    return F.element_at(resolve_all(base, f"array({href})"), 1)


def site_key(name: str) -> Column:
    """Surrogate id of a site, the same in every run and on every executor.

    60 bits of a digest: no counter to agree on, no global sort.
    """
    return F.expr(f"cast(conv(substring(md5({name}), 1, 15), 16, 10) AS bigint)")

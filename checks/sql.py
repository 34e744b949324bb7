"""The derived inputs of ``checks.views`` in SQL. Nothing is taken from the library."""

from __future__ import annotations

import re

from checks.views import BEGIN, CRONS, LATER, NOW, PREFIXES, TITLES

NL = "chr(10)"

# Fixed values, written out here once more so that the SQL side stands on its own:
# path patterns in order, base scores, junk titles and sections in order.
CATEGORY_PATTERNS = [
    (r"/docs?(/|$)", "Documentation"),
    (r"/documentation(/|$)", "Documentation"),
    (r"/api(-ref|reference|docs)?(/|$)", "API Reference"),
    (r"/guide", "Guides"),
    (r"/tutorial", "Guides"),
    (r"/getting[_-]?started", "Getting Started"),
    (r"/quick[_-]?start", "Getting Started"),
    (r"/install", "Getting Started"),
    (r"/setup", "Getting Started"),
    (r"/blog(/|$)", "Blog"),
    (r"/news(/|$)", "Blog"),
    (r"/example", "Examples"),
    (r"/demo", "Examples"),
    (r"/sample", "Examples"),
    (r"/faq", "FAQ"),
    (r"/changelog", "Changelog"),
    (r"/release", "Changelog"),
    (r"/about", "About"),
    (r"/team", "About"),
    (r"/contact", "About"),
    (r"/pricing", "About"),
]
BASE_SCORES = {
    "Getting Started": 0.9,
    "Documentation": 0.85,
    "API Reference": 0.8,
    "Guides": 0.75,
    "Examples": 0.7,
    "Core Pages": 0.6,
    "FAQ": 0.5,
    "Changelog": 0.4,
    "About": 0.4,
    "Blog": 0.35,
    "Other": 0.25,
}
JUNK_TITLES = [
    r"^page\s*not\s*found$",
    r"^404\b",
    r"^not\s*found$",
    r"^error\b",
    r"^access\s*denied$",
    r"^reset\s*password",
    r"^log\s*in$",
    r"^sign\s*(in|up)$",
    r"^Talk:",
    r"^.+\s+talk:",
    r"^Template:",
    r"^Category:",
    r"^Module:",
    r"^Draft:",
    r"^Special:",
    r"^User:",
    r"^File:",
    r"^MediaWiki:",
    r"[/:]Archive\s*\d+",
    r"^\d{4}$",
    r"^(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}$",
]
SECTION_ORDER = [
    "Getting Started",
    "Documentation",
    "API Reference",
    "Guides",
    "Examples",
    "Core Pages",
    "FAQ",
    "Changelog",
    "About",
    "Blog",
    "Other",
]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ",".join(quote(v) for v in values) + "]"


def path_of(url: str) -> str:
    return rf"regexp_replace(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def nurl(url: str) -> str:
    path = path_of(url)
    return (
        f"(CASE WHEN regexp_matches({url}, '^(?i:https?)://[^/?#]+') THEN"
        f" lower(regexp_extract({url}, '^([A-Za-z]+://[^/?#]*)', 1)) ||"
        f" CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END ELSE {url} END)"
    )


def host_of(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1)"


def site_id(name: str) -> str:
    return f"(('0x' || md5({name})[1:15])::BIGINT)"


def decoded(text: str) -> str:
    return (
        f"replace(replace(replace(replace({text}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    )


def category(url: str, depth: str = "depth") -> str:
    path = f"lower({path_of(url)})"
    cases = " ".join(f"WHEN regexp_matches({path}, {quote(p)}) THEN {quote(c)}" for p, c in CATEGORY_PATTERNS)
    return f"(CASE {cases} WHEN {depth} <= 1 THEN 'Core Pages' ELSE 'Other' END)"


def relevance(url: str, category: str = "category", depth: str = "depth") -> str:
    path = path_of(url)
    base = " ".join(f"WHEN {quote(c)} THEN {s}" for c, s in BASE_SCORES.items())
    slashes = f"(length({path}) - length(replace({path}, '/', '')))"
    raw = (
        f"(CASE {category} {base} ELSE 0.3 END)::DOUBLE - {depth} * 0.1::DOUBLE"
        f" - greatest(0::DOUBLE, ({slashes} - 3) * 0.05::DOUBLE)"
    )
    return f"greatest(0::DOUBLE, least(1::DOUBLE, round({raw}, 2)))"


def is_junk(title: str) -> str:
    tests = " OR ".join(f"regexp_matches(trim(coalesce({title}, '')), {quote('(?i)' + p)})" for p in JUNK_TITLES)
    return f"(trim(coalesce({title}, '')) = '' OR {tests})"


def md_link(title: str, url: str, description: str) -> str:
    return (
        f"('- [' || {title} || '](' || replace(replace({url}, '(', '%28'), ')', '%29') || ')' ||"
        f" CASE WHEN coalesce({description}, '') = '' THEN '' ELSE ': ' || {description} END)"
    )


def head_of(title: str, description: str) -> str:
    return (
        f"('# ' || {title} || CASE WHEN coalesce({description}, '') = '' THEN ''"
        f" ELSE {NL} || {NL} || '> ' || {description} END || {NL})"
    )


SECTIONS = strings([*SECTION_ORDER, "Optional"])
PREFIX_LIST = strings(PREFIXES)
TITLE_LIST = strings(TITLES)
HEAD = "regexp_extract({u}, '^(https?://[^/]*)', 1)"
REST = "regexp_extract({u}, '^https?://[^/]*(.*)$', 1)"
COMPARED = ["content_hash", "metadata_hash", "headings_hash", "text_hash", "canonical_url"]
DIFFERS = " OR ".join(f"coalesce(p.{c}, '') <> coalesce(c.{c}, '')" for c in COMPARED)

# Later entries may use earlier ones; only what a query needs is put in front of it.
CTES: dict[str, str] = {}
CTES["with_site"] = f"""
SELECT page_id, url AS raw_url, {nurl("url")} AS url, {host_of(nurl("url"))} AS host,
       {site_id(host_of(nurl("url")))} AS site_id, (page_id % 4)::INT AS depth, html FROM pages"""
CTES["page_base"] = """
SELECT * FROM with_site QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1"""
CTES["cut"] = rf"""
SELECT page_id, raw_url, url, host, site_id, depth,
       trim({decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title,
       trim({decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}) AS h1,
       list_filter(list_transform(string_split(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'), '<p>')[2:],
           lambda c: trim({decoded("regexp_replace(regexp_replace(c, '</p>.*$', '', 's'), '<[^>]*>', '', 'g')")})),
           lambda c: c <> '') AS ps,
       list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: lower(regexp_extract(url, '^(https?://[^/]*)', 1))
           || regexp_replace(regexp_replace(regexp_extract({decoded("h")}, '^([^?#]*)', 1), ';[^/]*$', ''), '(.)/$', '\1')) AS hrefs
FROM page_base"""
CTES["facts0"] = r"""
SELECT page_id, raw_url, url, host, site_id, depth, title,
       list_filter(ps, lambda p: length(p) >= 50)[1] AS description, h1 AS headings,
       lower(trim(regexp_replace(array_to_string(list_concat([h1], ps), ' '), '\s+', ' ', 'g'))) AS main_text,
       list_filter(hrefs, lambda h, i: list_position(hrefs, h) = i) AS links, NULL::VARCHAR AS canonical_url
FROM cut"""
CTES["facts1"] = """
SELECT *, sha256(coalesce(title, '') || coalesce(description, '')) AS metadata_hash,
       sha256(headings) AS headings_hash, sha256(main_text) AS text_hash FROM facts0"""
CTES["facts"] = "SELECT *, sha256(metadata_hash || headings_hash || text_hash) AS content_hash FROM facts1"
CTES["page_sites0"] = f"""
SELECT host AS domain, min({HEAD.format(u="url")}) AS url, min(page_id) AS f, length(host) AS n FROM with_site GROUP BY host"""
CTES["page_sites"] = f"""
SELECT {site_id("domain")} AS id, url, domain,
       CASE n % 3 WHEN 1 THEN domain || ' - Docs | More' WHEN 2 THEN domain || ' · Site' END AS title,
       CASE WHEN n % 2 = 0 THEN 'About ' || domain END AS description, n,
       TIMESTAMP '{BEGIN}' + to_hours(f) AS created_at, TIMESTAMP '{BEGIN}' + to_hours(f + 1) AS updated_at
FROM page_sites0"""
CTES["crawled"] = """
SELECT *, raw_url LIKE '%page=2%' AS not_modified, CASE WHEN raw_url LIKE '%page=2%' THEN 304 ELSE 200 END AS http_status,
       CASE depth WHEN 1 THEN 'c' || page_id WHEN 2 THEN '' END AS etag FROM facts"""
CTES["stored0"] = r"""
SELECT * REPLACE (regexp_replace(url, '\.html$', '') AS url) FROM facts
QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '\.html$', '') ORDER BY page_id) = 1"""
CTES["stored1"] = f"""
SELECT *, regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS lang, {category("url")} AS category FROM stored0"""
CTES["stored"] = f"""
SELECT page_id AS id, site_id, url, CASE WHEN lang = 'de' THEN '' END AS canonical_url, title, description, content_hash,
       metadata_hash, CASE WHEN lang <> 'es' THEN headings_hash END AS headings_hash,
       CASE WHEN raw_url LIKE '%utm_source%' THEN sha256('old' || url) ELSE text_hash END AS text_hash,
       CASE WHEN lang = 'fr' THEN [] ELSE links END AS links, 's' || page_id AS etag, 200 AS http_status,
       NOT (raw_url LIKE '%#top' OR page_id % 11 = 0) AS is_active, category, {relevance("url")} AS relevance_score, depth,
       TIMESTAMP '{BEGIN}' + to_hours(page_id) AS created_at, TIMESTAMP '{BEGIN}' + to_hours(page_id + 24) AS updated_at
FROM stored1"""
CTES["reusable"] = """
SELECT site_id, url FROM stored WHERE len(links) > 0 AND coalesce(metadata_hash, '') <> ''
   AND coalesce(headings_hash, '') <> '' AND coalesce(text_hash, '') <> ''"""
CTES["seen"] = """
SELECT c.* FROM crawled c LEFT JOIN reusable r ON r.site_id = c.site_id AND r.url = c.url
WHERE NOT c.not_modified OR r.url IS NOT NULL"""
CTES["diff"] = f"""
SELECT coalesce(p.site_id, c.site_id) AS site_id, coalesce(p.url, c.url) AS url,
       CASE WHEN p.url IS NULL THEN 'added' WHEN c.url IS NULL THEN 'removed' WHEN NOT p.is_active THEN 'reactivated'
            WHEN c.not_modified THEN 'unchanged' WHEN {DIFFERS} THEN 'updated' ELSE 'unchanged' END AS change,
       coalesce(c.not_modified, false) AS not_modified
FROM stored p FULL OUTER JOIN seen c ON p.site_id = c.site_id AND p.url = c.url
WHERE c.url IS NOT NULL OR p.is_active"""
CTES["counts"] = """
SELECT site_id, count(*) FILTER (change IN ('added', 'reactivated')) AS added, count(*) FILTER (change = 'updated') AS updated,
       count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged,
       count(*) FILTER (change IN ('added', 'reactivated', 'updated')) AS changed FROM diff GROUP BY site_id"""


def merged(column: str) -> str:
    return f"CASE WHEN c.url IS NULL OR c.not_modified THEN p.{column} ELSE c.{column} END AS {column}"


CTES["merged0"] = f"""
SELECT CASE WHEN p.id IS NOT NULL THEN p.id ELSE (SELECT max(id) FROM stored) + row_number() OVER (
         PARTITION BY p.id IS NULL ORDER BY coalesce(p.site_id, c.site_id), coalesce(p.url, c.url)) END AS id, coalesce(p.site_id, c.site_id) AS site_id,
       coalesce(p.url, c.url) AS url, {", ".join(merged(c) for c in ["canonical_url", "title", "description", "content_hash", "metadata_hash", "headings_hash", "text_hash", "links"])},
       coalesce(nullif(c.etag, ''), p.etag) AS etag,
       CASE WHEN c.url IS NULL THEN p.http_status ELSE c.http_status END AS http_status, c.url IS NOT NULL AS is_active,
       CASE WHEN p.url IS NULL THEN TIMESTAMP '{LATER}' ELSE p.created_at END AS first_seen_at,
       CASE WHEN c.url IS NOT NULL THEN TIMESTAMP '{LATER}' ELSE p.updated_at END AS last_seen_at,
       CASE WHEN c.url IS NOT NULL OR p.is_active THEN TIMESTAMP '{LATER}' ELSE p.updated_at END AS last_checked_at,
       CASE WHEN c.url IS NOT NULL THEN {category("c.url", "c.depth")} ELSE p.category END AS category,
       p.relevance_score AS old_score, c.url IS NOT NULL AS hit, coalesce(c.depth, p.depth) AS depth
FROM stored p FULL OUTER JOIN seen c ON p.site_id = c.site_id AND p.url = c.url"""
CTES["merged"] = f"""
SELECT * EXCLUDE (old_score, hit), CASE WHEN hit THEN {relevance("url")} ELSE old_score END AS relevance_score FROM merged0"""
CTES["refreshed"] = """
SELECT s.* REPLACE (coalesce(nullif(f.title, ''), s.title) AS title, coalesce(nullif(f.description, ''), s.description) AS description)
FROM page_sites s LEFT JOIN (SELECT * FROM crawled QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY depth, url) = 1) f
  ON f.site_id = s.id"""
CTES["refreshed_seen"] = CTES["refreshed"].replace("FROM crawled", "FROM seen")
CTES["url_variants"] = f"""
SELECT page_id, site_id, depth, {HEAD.format(u="url")} || ({PREFIX_LIST})[(page_id % 23 + 1)::INT] || {REST.format(u="url")} AS url FROM page_base"""
CTES["catalog0"] = f"""
SELECT page_id AS id, site_id, {HEAD.format(u="url")} || ({PREFIX_LIST})[(page_id % 23 + 1)::INT] || {REST.format(u="url")} AS url,
       coalesce(({TITLE_LIST})[(page_id % 25 + 1)::INT], title) AS title, description AS d, host, depth, page_id % 9 <> 0 AS is_active FROM facts"""
CTES["catalog1"] = f"""
SELECT id, site_id, url, title, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'About ' || host WHEN 2 THEN title ELSE d END AS description,
       depth, is_active, {category("url")} AS category FROM catalog0"""
CTES["catalog"] = f"SELECT *, {relevance('url')} AS relevance_score FROM catalog1"
CTES["by_url"] = """
SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY relevance_score DESC, depth, url) = 1"""
CTES["no_junk"] = f"SELECT * FROM by_url WHERE NOT {is_junk('title')}"
CTES["clean"] = """
SELECT * FROM no_junk QUALIFY row_number() OVER (PARTITION BY site_id, lower(trim(title)) ORDER BY relevance_score DESC, depth, url) = 1"""
CTES["numbered"] = """
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY depth, url) AS list_id FROM clean"""

ENTRY = "'{{\"id\":' || {i} || ',\"title\":\"' || {t} || '\",\"description\":\"' || {d} || '\"}}'"


def plan_entry(i: str, t: str, d: str) -> str:
    return ENTRY.format(i=i, t=t, d=d)


MANY = f"array_to_string(list_transform(range(1, 201), lambda i: {plan_entry('i', chr(39) + 'T' + chr(39) + ' || i', chr(39) * 2)}), ',')"
CTES["plan_text"] = f"""
SELECT id AS site_id, n, '{{"site_description":"' || CASE WHEN n % 4 = 0 THEN '' ELSE 'All about ' || domain END ||
  '","sections":[{{"name":"Start","pages":[' || {plan_entry("2", "''", "''")} || ',' || {plan_entry("1", "'One'", "'First page'")} || ',' ||
  {plan_entry("2", "'Again'", "''")} || ',' || {plan_entry("999999", "'No'", "''")} || ']}},{{"name":"None","pages":[]}},{{"name":"Rest","pages":[' ||
  {MANY} || ']}}]' || CASE WHEN n % 11 = 0 THEN '' ELSE ',"optional":[' || {plan_entry("3", "'Opt'", "'Maybe'")} || ']' END || '}}' AS t
FROM page_sites"""
CTES["plans"] = """
SELECT site_id, CASE WHEN n % 5 = 0 THEN left(t, 60) ELSE t END AS json, CASE WHEN n % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
FROM plan_text"""
CTES["good_plans"] = """
SELECT site_id, CASE WHEN json_valid(json) THEN json ELSE '{}' END AS j FROM plans
WHERE finish_reason <> 'length' AND json_valid(json)
  AND json_exists(CASE WHEN json_valid(json) THEN json ELSE '{}' END, '$.site_description')
  AND json_exists(CASE WHEN json_valid(json) THEN json ELSE '{}' END, '$.sections')
  AND json_exists(CASE WHEN json_valid(json) THEN json ELSE '{}' END, '$.optional')"""
ENTRY_TYPE = '{"id":"BIGINT","title":"VARCHAR","description":"VARCHAR"}'
CTES["plan_sections"] = f"""
SELECT site_id, j->>'site_description' AS site_description, list_concat(
   from_json(j->'sections', '[{{"name":"VARCHAR","pages":[{ENTRY_TYPE}]}}]'),
   [{{'name': 'Optional', 'pages': from_json(j->'optional', '[{ENTRY_TYPE}]')}}]) AS s FROM good_plans"""
CTES["entries0"] = """
SELECT site_id, site_description, unnest(s) AS x, generate_subscripts(s, 1)::INT - 1 AS section_pos FROM plan_sections"""
CTES["entries1"] = """
SELECT site_id, site_description, section_pos, x.name AS section, unnest(x.pages) AS e, generate_subscripts(x.pages, 1)::INT - 1 AS entry_pos FROM entries0"""
CTES["entries"] = """
SELECT site_id, site_description, section_pos, section, entry_pos, e.id AS id, e.title AS title, e.description AS description FROM entries1"""
CTES["resolved"] = """
SELECT e.site_id, section_pos, section, entry_pos, n.url, coalesce(nullif(e.title, ''), nullif(n.title, ''), n.url) AS title,
       coalesce(nullif(e.description, ''), n.description) AS description
FROM entries e JOIN numbered n ON n.site_id = e.site_id AND n.list_id = e.id"""
CTES["capped0"] = """
SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY section_pos, entry_pos) = 1"""
CTES["capped"] = """
SELECT * FROM capped0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY section_pos, entry_pos) <= 75"""
CTES["robots"] = f"""
SELECT id AS site_id, domain AS host, CASE CASE n WHEN 25 THEN 9 ELSE n % 3 END
  WHEN 9 THEN (SELECT string_agg('User-agent: bot' || i, {NL} ORDER BY i) FROM range(1, 100001) t(i)) || {NL} || 'User-agent: *' || {NL} ||
       (SELECT string_agg(CASE i % 3 WHEN 0 THEN 'Allow: /' ELSE 'Disallow: /' END || lower(to_hex(i)), {NL} ORDER BY i) FROM range(1, 10001) t(i)) || {NL} ||
       'Allow: /d*e*$' || {NL} || 'Disallow: /*a*b*' || {NL} || 'Sitemap: https://' || domain || '/c.xml'
  WHEN 0 THEN 'User-agent: *' || {NL} || 'Disallow: /x\\E(*[^' || {NL} || 'Disallow: /th' || {NL} || 'Allow: /the$' || {NL} || 'Allow: /tha*n' || {NL} || 'Sitemap: https://' || domain || '/sitemap.xml' || {NL}
  WHEN 1 THEN '# all' || {NL} || 'User-agent: Bot' || {NL} || 'Disallow: /' || {NL} || {NL} || 'User-Agent: other' || {NL} || 'user-agent: *' || {NL} ||
       'Disallow: /*n$ # short' || {NL} || 'Disallow: /de' || {NL} || 'Allow: /de' || {NL} || 'SITEMAP:   https://' || domain || '/a.xml  ' || chr(13) || {NL} ||
       'sitemap:' || {NL} || 'Sitemap: https://' || domain || '/b.xml'
  ELSE '' END AS body FROM page_sites"""
CTES["robot_lines"] = r"""
SELECT host, site_id, unnest(string_split_regex(body, '\r\n|\n|\r')) AS line,
       generate_subscripts(string_split_regex(body, '\r\n|\n|\r'), 1)::INT - 1 AS pos FROM robots"""
CTES["robot_fields"] = r"""
SELECT host, pos, lower(regexp_extract(line, '^\s*([A-Za-z-]+)\s*:', 1)) AS k,
       trim(regexp_replace(regexp_replace(line, '#.*$', ''), '^[^:]*:', '')) AS v FROM robot_lines"""
CTES["robot_runs"] = """
SELECT *, sum(CASE WHEN k = 'user-agent' AND coalesce(before, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS g
FROM (SELECT *, lag(k) OVER (PARTITION BY host ORDER BY pos) AS before FROM robot_fields WHERE k IN ('user-agent', 'allow', 'disallow'))"""
CTES["rules"] = r"""
SELECT host, k = 'allow' AS allow, length(v) AS n, v, v NOT LIKE '%*%' AND v NOT LIKE '%$' AS plain,
       '^' || replace(regexp_escape(regexp_replace(v, '\$$', '')), '\*', '.*') || CASE WHEN v LIKE '%$' THEN '$' ELSE '' END AS re
FROM robot_runs r WHERE k <> 'user-agent' AND v <> ''
  AND EXISTS (SELECT 1 FROM robot_runs a WHERE a.host = r.host AND a.g = r.g AND a.k = 'user-agent' AND a.v = '*')"""
CTES["edges0"] = """
SELECT site_id, page_id, url AS src, unnest(links) AS link, generate_subscripts(links, 1)::INT - 1 AS pos FROM facts"""
CTES["edges"] = f"""
SELECT site_id, page_id, src, pos, CASE (page_id + pos) % 8 WHEN 1 THEN link || '.PDF' WHEN 2 THEN {HEAD.format(u="link")} || '/login' || {REST.format(u="link")}
   WHEN 3 THEN 'https://other.example' || {REST.format(u="link")} WHEN 4 THEN link || '?page=2'
   WHEN 5 THEN {HEAD.format(u="link")} || '/Administration' || {REST.format(u="link")} ELSE link END AS dst FROM edges0"""
CTES["inside"] = rf"""
SELECT e.* REPLACE ({nurl("e.dst")} AS dst) FROM edges e JOIN page_sites s ON s.id = e.site_id
WHERE {host_of(nurl("e.dst"))} = s.domain
  AND NOT regexp_matches(lower({path_of("e.dst")}), '\.(png|jpg|jpeg|gif|svg|ico|webp|pdf|zip|tar|gz|mp4|mp3|wav|css|js|woff|woff2|ttf|eot)$')
  AND NOT regexp_matches(lower({path_of("e.dst")}), '/(login|signin|signup|register|admin)')"""


def blocked(urls: str) -> str:
    """Distinct targets of ``urls`` that robots.txt forbids."""
    return f"""
SELECT url FROM (SELECT u.url, arg_max(r.allow, r.n * 2 + r.allow::INT) AS ok
  FROM (SELECT DISTINCT dst AS url FROM {urls}) u JOIN rules r ON r.host = {host_of("u.url")}
   AND CASE WHEN r.plain THEN starts_with(regexp_extract(u.url, '^[a-z]+://[^/]*(/.*)$', 1), r.v)
            ELSE regexp_matches(regexp_extract(u.url, '^[a-z]+://[^/]*(/.*)$', 1), r.re) END GROUP BY u.url) WHERE NOT ok"""


CTES["blocked_inside"] = blocked("inside")
CTES["crawlable"] = "SELECT * FROM inside WHERE dst NOT IN (SELECT url FROM blocked_inside)"
CTES["tag_links"] = "SELECT site_id, url AS src, unnest(links) AS dst FROM facts"
CTES["tag_graph"] = "SELECT site_id, src, dst FROM tag_links UNION ALL SELECT site_id, dst, src FROM tag_links"
CTES["roots"] = "SELECT site_id, min(url) AS url FROM page_base GROUP BY site_id"
CTES["walk"] = """
SELECT site_id, url, 0 AS depth FROM roots
UNION SELECT w.site_id, g.dst, w.depth + 1 FROM walk w JOIN tag_graph g ON g.site_id = w.site_id AND g.src = w.url WHERE w.depth < 3"""
CTES["bfs"] = "SELECT site_id, url, min(depth) AS depth FROM walk GROUP BY site_id, url"


def child(step: int) -> str:
    return f"'<sitemap><loc>https://maps.example/' || (page_id + {step}) || '.xml</loc><lastmod>x</lastmod></sitemap>'"


CTES["docs"] = f"""
SELECT site_id, page_id, 'https://maps.example/' || page_id || '.xml' AS url,
       CASE page_id % 8 WHEN 0 THEN [page_id + 1, page_id + 2] WHEN 1 THEN [page_id + 2, page_id + 3] WHEN 3 THEN [page_id + 2] END AS children,
       CASE WHEN page_id % 8 NOT IN (0, 1, 3) THEN links END AS locs FROM facts"""
CTES["maps"] = """
SELECT d.site_id, [d.page_id::INT] AS place, 0 AS level, d.page_id FROM docs d
UNION ALL SELECT m.site_id, list_append(m.place, c.i - 1), m.level + 1, c.child FROM maps m
  JOIN (SELECT page_id, unnest(children) AS child, generate_subscripts(children, 1)::INT AS i FROM docs) c ON c.page_id = m.page_id WHERE m.level < 2"""
CTES["listed"] = f"""
SELECT site_id, list_append(place, i - 1) AS place, {nurl("(loc || '/')")} AS url
FROM (SELECT m.site_id, m.place, unnest(d.locs) AS loc, generate_subscripts(d.locs, 1)::INT AS i FROM maps m JOIN docs d ON d.page_id = m.page_id)"""

# History tables.
CTES["jobs"] = """
SELECT o_orderkey AS id, o_custkey AS site_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  (o_orderkey % 200 + o_orderkey % 23)::INT AS pages_found, (o_orderkey % 200)::INT AS pages_crawled, (o_orderkey % 11 + o_orderkey % 6)::INT AS pages_changed,
  (o_orderkey % 11)::INT AS pages_added, (o_orderkey % 6)::INT AS pages_updated, (o_orderkey % 5)::INT AS pages_removed, (o_orderkey % 50)::INT AS pages_unchanged,
  (o_orderkey % 23)::INT AS pages_skipped, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 200 END AS max_pages,
  CASE WHEN o_orderstatus = 'P' THEN 'error ' || o_orderpriority END AS error_message, o_orderdate AS created_at, o_orderdate + to_hours(1) AS updated_at FROM orders"""
CTES["live_jobs"] = f"SELECT * REPLACE (TIMESTAMP '{BEGIN}' + to_minutes(id * 37 % 43200) AS created_at) FROM jobs"
CTES["live_pages0"] = """
SELECT event_id AS id, user_id AS site_id, 'https://s.example/docs/' || event_id AS url, event_type AS title, props AS description,
       (event_id % 4)::INT AS depth, value > 2 AS is_active, ts AS last_checked_at, 'Documentation' AS category FROM events"""
CTES["live_pages"] = f"SELECT *, {relevance('url')} AS relevance_score FROM live_pages0"
CTES["newest_live"] = """
SELECT * FROM live_jobs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) = 1"""
CTES["passed_jobs"] = """
SELECT * FROM live_jobs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) <= 3"""
CTES["sites"] = f"""
SELECT c_custkey AS id, 'https://' || replace(lower(c_name), '#', '-') || '.example.com' AS url, replace(lower(c_name), '#', '-') || '.example.com' AS domain,
  c_name AS title, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS description,
  TIMESTAMP '{BEGIN}' + to_minutes(c_custkey * 7 % 1000) AS created_at, TIMESTAMP '{BEGIN}' + to_minutes(c_custkey * 11 % 5000) AS updated_at FROM customer"""
CTES["files"] = f"""
SELECT doc_id AS id, doc_id % 100 AS site_id, doc_id AS crawl_job_id, '# ' || source || {NL} || {NL} || '> ' || lang || ' site' || {NL} || text AS content,
  sha256(text) AS content_hash, doc_id % 3 = 0 AS is_edited, TIMESTAMP '{BEGIN}' + to_hours(doc_id * 37 % 500) AS created_at FROM documents"""
CTES["job_files"] = """
SELECT f.id, f.crawl_job_id, f.created_at, f.is_edited, o.o_custkey AS site_id FROM files f JOIN orders o ON o.o_orderkey = f.crawl_job_id"""
CTES["newest_job"] = "SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) = 1"
CTES["newest_file"] = "SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) = 1"
CTES["schedules"] = f"""
SELECT s_suppkey AS id, s_suppkey AS site_id, ({strings(CRONS)})[s_nationkey % 4 + 1] AS cron_expression, s_suppkey % 3 <> 0 AS is_active,
  CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '1998-01-01' + to_days((s_suppkey * 13 % 1500)::INT) END AS last_run_at,
  CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '{NOW}' + to_hours(s_suppkey) END AS next_run_at FROM supplier"""
CTES["schedule_requests"] = f"""
SELECT s_suppkey + CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1000000 END AS site_id, ({strings(CRONS)})[(s_nationkey + 1 + again) % 4 + 1] AS cron_expression,
  s_suppkey % 4 <> 0 AS is_active, s_suppkey * 2 + again AS request_id FROM supplier, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR s_suppkey % 3 = 0"""


def fires(ts: str, cron: str) -> str:
    def field(i: int, value: str) -> str:
        f = f"string_split({cron}, ' ')[{i}]"
        step = f"{value} % coalesce(try_cast(nullif(regexp_extract({f}, '^\\*/(\\d+)$', 1), '') AS INT), 1) = 0"
        return f"CASE WHEN {f} LIKE '*%' THEN {step} ELSE {f} = {value}::VARCHAR END"

    return " AND ".join(
        f"({field(i, f'{fn}({ts})')})" for i, fn in enumerate(["minute", "hour", "day", "month", "dayofweek"], 1)
    )


CTES["minutes"] = "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 MINUTE)) AS t"
CTES["cron_kinds"] = f"SELECT unnest({strings(CRONS)}) AS cron"
CTES["fired"] = f"SELECT cron, t FROM cron_kinds CROSS JOIN minutes WHERE {fires('t', 'cron')}"
CTES["upcoming"] = f"SELECT cron, min(t) AS t FROM fired WHERE t >= TIMESTAMP '{NOW}' GROUP BY cron"
CTES["overview"] = """
SELECT s.id AS site_id, s.url, s.domain, s.title, s.description, s.created_at, s.updated_at, j.id AS latest_crawl_job_id, j.status AS latest_crawl_status,
  j.pages_crawled AS latest_crawl_pages_crawled, j.pages_found AS latest_crawl_pages_found, j.pages_changed AS latest_crawl_pages_changed,
  j.updated_at AS latest_crawl_updated_at, j.error_message AS latest_crawl_error_message, f.id IS NOT NULL AS index_generated,
  f.created_at AS index_generated_at, coalesce(f.is_edited, false) AS index_edited, coalesce(m.is_active, false) AS schedule_active,
  m.cron_expression AS schedule_cron_expression, m.next_run_at AS schedule_next_run_at
FROM sites s LEFT JOIN newest_job j ON j.site_id = s.id LEFT JOIN newest_file f ON f.site_id = s.id LEFT JOIN schedules m ON m.site_id = s.id"""

# Event log tables.
CTES["fetch0"] = """
SELECT *, event_type = 'error' OR (user_id % 5 = 0 AND event_type <> 'view') AS timeout FROM events"""
CTES["fetch1"] = """
SELECT *, CASE WHEN NOT timeout AND event_type = 'purchase' AND event_id % 6 = 0 THEN 'ConnectError: ' || props END AS error FROM fetch0"""
CTES["fetch_log"] = """
SELECT event_id, 'h' || user_id AS host, user_id * 100000 + date_diff('day', DATE '1970-01-01', ts::DATE) // 15 AS job_id, ts, timeout, error, event_type = 'view' AND NOT timeout AS accepted, user_id % 2 = 0 AS has_state,
  CASE WHEN timeout OR error IS NOT NULL THEN NULL WHEN event_type = 'signup' THEN 403 WHEN event_type = 'click' THEN ([304, 404, 200, 500])[event_id % 4 + 1] ELSE 200 END AS status,
  CASE WHEN event_type = 'view' THEN 'text/html; charset=utf-8' WHEN event_id % 3 = 1 THEN 'application/pdf ; q=1' WHEN event_id % 3 = 2 THEN 'text/html' END AS content_type,
  CASE WHEN event_id % 7 = 0 THEN '<title>Just A MOMENT...</title>' ELSE props END AS body FROM fetch1"""
CTES["outcomes"] = """
SELECT *, CASE WHEN timeout THEN 'timeout' WHEN error IS NOT NULL THEN 'error' WHEN status = 304 THEN CASE WHEN has_state THEN 'not_modified' ELSE 'no_state' END
    WHEN status = 403 THEN 'blocked' WHEN status <> 200 THEN 'bad_status' WHEN coalesce(content_type, '') NOT LIKE '%text/html%' THEN 'not_html'
    WHEN regexp_matches(body, '(?i)just a moment\\.\\.\\.') THEN 'challenge' ELSE 'ok' END AS outcome FROM fetch_log""".replace("\\\\", "\\")
CTES["reasons"] = """
SELECT *, CASE outcome WHEN 'timeout' THEN 'Timeout' WHEN 'error' THEN error WHEN 'no_state' THEN 'HTTP 304 without cached page state'
    WHEN 'blocked' THEN 'HTTP 403 (access denied)' WHEN 'bad_status' THEN 'HTTP ' || status
    WHEN 'not_html' THEN 'Non-HTML (' || trim(string_split(coalesce(content_type, ''), ';')[1]) || ')' WHEN 'challenge' THEN 'Bot protection (challenge page)' END AS reason FROM outcomes"""
CTES["tally0"] = """
SELECT *, sum(CASE WHEN timeout THEN 0 ELSE 1 END) OVER w AS run, count(*) OVER w AS requests, sum(timeout::INT) OVER w::BIGINT AS timeouts,
  max(CASE WHEN accepted THEN ts END) OVER w AS last_success, min(ts) OVER w AS started
FROM fetch_log WHERE timeout OR error IS NULL WINDOW w AS (PARTITION BY host, job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
CTES["tally"] = """
SELECT *, CASE WHEN timeout THEN count(*) FILTER (timeout) OVER (PARTITION BY host, job_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM tally0"""
CTES["openings"] = """
SELECT event_id, host, job_id, ts, CASE WHEN streak >= 8 THEN 'streak' ELSE 'rate+stall' END AS trigger, requests, timeouts, streak FROM tally
WHERE timeout AND requests >= 12 AND (streak >= 8 OR (timeouts::DOUBLE / requests >= 0.7::DOUBLE
   AND epoch_us(ts) - epoch_us(coalesce(last_success, started)) >= 30000000))"""
CTES["tasks"] = """
SELECT event_id AS id, user_id AS site_id, event_id AS crawl_job_id,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'dead_letter' END AS status,
  (event_id % 3 * 100)::INT AS priority, (event_id % 6)::INT AS attempt_count, 5 AS max_attempts, ts AS available_at,
  CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN ts + to_seconds(floor(value * 60)::INT) END AS leased_until,
  CASE WHEN event_type = 'error' THEN 'w' || (event_id % 10) END AS lease_owner,
  CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'boom ' || props END AS last_error, ts AS created_at FROM events"""
CTES["requests"] = """
SELECT s.id AS request_id, CASE s.id % 6 WHEN 0 THEN s.url WHEN 1 THEN s.url || '//' WHEN 2 THEN 'https://new-' || c_nationkey || '.example.org/'
    WHEN 3 THEN 'ftp://files.example.org' WHEN 4 THEN 'HTTPS://Shop.example/' || c_nationkey ELSE 'no url' END AS url,
  CASE WHEN c_nationkey % 8 <> 7 THEN c_nationkey % 8 END AS max_depth, CASE WHEN c_nationkey <> 3 THEN 40 + c_nationkey * 20 END AS max_pages
FROM sites s JOIN customer c ON c.c_custkey = s.id"""
CTES["judged"] = """
SELECT request_id, url, coalesce(max_depth, 3)::INT AS max_depth, coalesce(max_pages, 200)::INT AS max_pages,
  CASE WHEN NOT regexp_matches(url, '^(?i:https?)://[^/]') THEN 'url' WHEN coalesce(max_depth, 3) NOT BETWEEN 1 AND 5 THEN 'max_depth'
       WHEN coalesce(max_pages, 200) NOT BETWEEN 50 AND 500 THEN 'max_pages' END AS rejection FROM requests"""
CTES["progress"] = """
SELECT user_id AS job_id, event_id, ts, (floor(value) % 3)::INT AS pages_found, (floor(value) % 2)::INT AS pages_crawled,
  0 AS pages_changed, 0 AS pages_added, 0 AS pages_updated, 0 AS pages_removed, 0 AS pages_unchanged,
  CASE WHEN event_type <> 'click' THEN 0 END AS pages_skipped, CASE WHEN event_type = 'signup' THEN 'generating' ELSE 'running' END AS status,
  NULL::VARCHAR AS error_message FROM events
UNION ALL SELECT user_id, user_id + 1000000000, max(ts) + INTERVAL 1 SECOND, 9, 9, 9, 9, 9, 9, 9, 9, CASE WHEN user_id % 2 = 1 THEN 'failed' ELSE 'completed' END,
  CASE WHEN user_id % 2 = 1 THEN 'lost ' || user_id END FROM events GROUP BY user_id"""
CTES["progress_lag"] = """
SELECT *, lag({f: pages_found, c: pages_crawled, s: pages_skipped, t: status}) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before,
  row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM progress"""
CTES["progress_changed"] = """
SELECT * EXCLUDE (before, n) FROM progress_lag
WHERE n = 1 OR pages_found IS DISTINCT FROM before.f OR pages_crawled IS DISTINCT FROM before.c
   OR pages_skipped IS DISTINCT FROM before.s OR status IS DISTINCT FROM before.t"""
CTES["feed"] = "SELECT user_id % 5 AS job_id, ts FROM events"
CTES["feed_lead"] = "SELECT job_id, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS nxt FROM feed"

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def with_ctes(body: str) -> str:
    """Put the views a statement needs in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(_WORD.findall(text)) & CTES.keys():
            if name not in needed:
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    body = body.strip()
    if not parts:
        return body
    glue = f", {body[5:]}" if body.startswith("WITH ") else f" {body}"
    return f"WITH RECURSIVE {', '.join(parts)}{glue}"


def rendered(pages: str, sites: str) -> str:
    """Markdown index per site from scored pages."""
    label = "coalesce(nullif(title, ''), url)"
    return f"""
SELECT site_id, content, sha256(content) AS content_hash FROM (
  SELECT s.id AS site_id, {head_of("coalesce(nullif(any_value(s.title), ''), any_value(s.domain))", "any_value(s.description)")}
     || coalesce(string_agg(x.t, '' ORDER BY x.pos), '') AS content
  FROM {sites} s LEFT JOIN (
    SELECT site_id, pos, {NL} || '## ' || section || {NL} || {NL} || string_agg(link || {NL}, '' ORDER BY relevance_score DESC, depth, url) AS t
    FROM (SELECT *, list_position({SECTIONS}, section) AS pos, {md_link(label, "url", "description")} AS link
          FROM (SELECT *, CASE WHEN relevance_score < 0.3 THEN 'Optional' ELSE category END AS section FROM {pages}
                QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY relevance_score DESC, depth, url) = 1))
    WHERE pos > 0 GROUP BY site_id, pos, section) x ON x.site_id = s.id
  GROUP BY s.id)"""

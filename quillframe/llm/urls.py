"""URL filters with redirect equivalence, in DataFrame functions only.

Rules judge a URL by host and path. Redirect and canonical links make URLs
aliases of one another: connected components over these links spread block
decisions to every alias that no rule decides; a rule that allows a URL itself
always holds against a block that comes by a link.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace, fresh
from quillframe.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULE_TYPE = "array<struct<path:string,verdict:string,name:string>>"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The fitting rule as (path, verdict, name), null if none fits.

    A rule fits its host and all subdomains where the path starts with its
    path; of several the longest wins, of equally long ones an allowing one.
    The rules are looked up by the ends of the host, so the cost of a URL does
    not grow with their number.
    """
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule[0].lower(), []).append(rule)
    if not by_host:
        return F.lit(None).cast(RULE_TYPE[6:-1])
    entries = []
    for name, own in by_host.items():
        some = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(h + p).alias("name")) for h, p, v in own])
        entries += [F.lit(name), some]
    table = F.create_map(*entries)
    most = max(name.count(".") + 1 for name in by_host)
    labels = F.split(host, r"\.")
    # the last labels of the host, one more each time, as far as any rule's host goes
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    found = F.flatten(F.transform(ends, lambda end: F.coalesce(F.try_element_at(table, end), F.array().cast(RULE_TYPE))))
    fitting = F.filter(found, lambda r: path.startswith(r["path"]))
    ranked = F.transform(fitting, lambda r: F.struct(F.length(r["name"]).alias("size"), (r["verdict"] == "allow").alias("allows"), r.alias("rule")))
    return F.array_max(ranked)["rule"]


def page_key(url: Column) -> Column:
    """What makes two spellings of a URL one node: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(_after_scheme(url), "^[^#]*", 0)
    cut = F.regexp_extract(rest, "^[^/?]*", 0)
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(cut, UPPER, LOWER), F.substr(rest, F.length(cut) + 1)))


def link_targets(html: Column) -> Column:
    """The targets of all of a page's canonical links and refresh redirects, as an array."""
    quoted = r"""\s*=\s*["']?\s*([^"'\s>]+)"""
    canonical = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref""" + quoted), F.lit(1))
    refresh = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl""" + quoted), F.lit(1))
    none = F.array().cast("array<string>")
    # most pages have neither word; looking for them first is cheap
    found = F.concat(F.when(html.rlike("(?i)canonical"), canonical).otherwise(none), F.when(html.rlike("(?i)http-equiv"), refresh).otherwise(none))
    return F.transform(found, lambda target: F.replace(target, F.lit("&amp;"), F.lit("&")))


def resolve(base: Column, target: Column) -> Column:
    """A link target as an absolute URL; null if the base has no ``://``."""
    scheme = F.regexp_extract(base, "^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), "^[^/?#]*", 0))
    folder = F.regexp_replace(F.regexp_extract(_after_scheme(base), "^[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return F.when(F.instr(base, "://") == 0, F.lit(None)).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(
        target.startswith("/"), F.concat(root, target)
    ).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(root, folder, target))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)``: absolute URLs joined by the canonical and redirect links of each page, a row for each link."""
    rows = pages.select(F.col(f"`{url_col}`").alias("src"), F.explode(link_targets(F.col(f"`{html_col}`"))).alias("target"))
    rows = rows.select("src", resolve(F.col("src"), F.col("target")).alias("dst"))
    return rows.where("src IS NOT NULL AND dst IS NOT NULL")


def judge(pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None, url_col: str = "url", html_col: str = "html", out: str = "url_filter") -> DataFrame:
    """``pages`` with a struct column ``out`` of (host, path, rule, verdict).

    ``rule`` is the fitting rule's host and path, null if none fits; its verdict
    holds. Other URLs are blocked if a URL that a rule blocks can be reached
    over links in either direction, through any chain and also through URLs
    that are no page of the table, and are allowed otherwise. ``links``
    (src, dst) adds redirects known from elsewhere. A null URL or one without
    ``://`` has an empty host and path, no alias and the verdict allow.
    Repeated rows are judged alike. A column already named ``out`` is replaced.
    """
    ws = Workspace(pages.sparkSession, "urls")
    edges = page_links(pages, url_col, html_col)
    if links is not None:
        edges = edges.union(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    edges = ws.save(edges.select("src", "dst", page_key(F.col("src")).alias("u"), page_key(F.col("dst")).alias("v")).where("u <> v"), "links")
    classes = ws.save(connected_components(edges.select("u", "v"), ws, "aliases"), "classes")
    ends = edges.select(F.col("u").alias("node"), F.col("src").alias("url")).union(edges.select("v", "dst"))
    verdict = match_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    blocking = ends.where(verdict == "block").select("node").distinct()
    blocked = classes.join(blocking, "node").select("component").distinct()
    host, path, page, rule, alias = fresh(pages, "host", "path", "page", "rule", "alias")
    aliases = ws.save(classes.join(blocked, "component").select(F.col("node").alias(alias)), "blocked")
    # the rule is found in a projection of its own, as a column that later ones refer to
    url = F.col(f"`{url_col}`")
    rows = pages.withColumns({host: host_of(url), path: path_of(url), page: page_key(url)})
    rows = rows.withColumn(rule, match_rule(F.col(host), F.col(path), rules))
    rows = rows.join(aliases, F.col(page) == F.col(alias), "left")
    made = F.struct(
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(f"{rule}.name").alias("rule"),
        F.coalesce(f"{rule}.verdict", F.when(F.col(alias).isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
    return rows.withColumn(out, made).select(*[f"`{c}`" for c in pages.columns if c != out], out)


def report(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    return judge(pages.select("page_id", "url", "html"), rules).select("page_id", "url_filter.*")

"""Block and allow rules for urls, with decisions passed along redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import ascii_lower, components, staged

_AFTER_SCHEME = r"^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + _AFTER_SCHEME, 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + _AFTER_SCHEME, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as (size, allows, text, verdict), or null; of equally long ones an allowing one.

    Rules are kept in a map by host that is part of the plan (a list the driver holds), and an url looks up its host and each
    domain above it: work for an url grows with its host's dots, not with the number of rules.
    """
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)

    def listed(own: list[Rule]) -> Column:
        return F.array(
            *(
                F.struct(
                    F.lit(len(r.text)).alias("size"), F.lit(r.verdict == "allow").alias("allows"),
                    F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"),
                )
                for r in own
            )
        )

    if not rules:
        kind = "struct<size:int,allows:boolean,text:string,verdict:string>"
        return F.lit(None).cast(kind)
    known = F.create_map(*(c for name, own in by_host.items() for c in (F.lit(name), listed(own))))
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.flatten(
        F.filter(F.transform(domains, lambda d: F.element_at(known, d)), lambda found: found.isNotNull())
    )
    fitting = F.filter(fitting, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["allows"], r["text"], r["verdict"])))


def _address(url: Column) -> Column:
    """One name for the urls of one page: no scheme, no fragment, host lower-cased; null where there is no host."""
    host = url_host(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (``u``, ``v``) between the url strings of pages and where they redirect to or say they belong.

    Read from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``; a target that begins with ``/`` is taken on the page's
    own host, other targets without ``://`` are left out.
    """
    html, url = F.coalesce(pages[html_col], F.lit("")), pages[url_col]
    canonical = F.regexp_extract(F.regexp_extract(html, _LINK, 0), _HREF, 1)
    redirect = F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _TARGET, 1)
    found = pages.select(url.alias("url"), F.explode(F.array(canonical, redirect)).alias("to")).where("url IS NOT NULL AND to <> ''")
    own = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.when(F.col("to").contains("://"), F.col("to")).when(
        F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")
    ).when(F.col("to").startswith("/") & (own != ""), F.concat(own, "to"))
    return found.select(F.col("url").alias("u"), whole.alias("v")).where("v IS NOT NULL")


def judge(
    pages: DataFrame,
    rules: list[Rule],
    edges: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Verdict on every page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``passed_on``.

    The longest fitting rule decides. Urls that no rule fits take the decision of their component: the urls joined by
    redirect and canonical edges (``edges`` of url strings ``u``, ``v``, besides those that the pages name themselves).
    A component is blocked when a rule blocks one of its urls and none allows one: an explicit allow
    comes before every block that is passed on, and rules on a page itself come before both. Everything else gets ``default``.

    Components come from alternating star rounds, so neither hubs with very many aliases nor long
    redirect chains meet in one task, and only urls that have an edge take part. A null url or one without ``://`` has an
    empty host and path and fits no rule; null html has no links; repeated rows are judged alike; an empty table gives an empty
    table; other columns are not looked at. ``passed_on`` is true where the component decided.
    """
    host, path = url_host(pages[url_col]), url_path(pages[url_col])
    rows = pages.select(
        pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), _address(pages[url_col]).alias("address")
    )
    judged = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    links = link_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.union(edges.select("u", "v"))
    addressed = links.select(
        _address(F.col("u")).alias("u"), _address(F.col("v")).alias("v"), F.col("u").alias("from"), F.col("v").alias("to")
    ).where("u IS NOT NULL AND v IS NOT NULL")
    addressed = staged(addressed, "url-links")
    member = components(addressed, "url-components")
    ends = addressed.select(F.col("u").alias("node"), F.col("from").alias("url")).union(addressed.select("v", "to"))
    decided = ends.select("node", matching_rule(url_host(F.col("url")), url_path(F.col("url")), rules).alias("found"))
    group = (
        member.join(decided.where("found IS NOT NULL").select("node", "found.verdict").distinct(), "node")
        .groupBy("component")
        .agg(F.min("verdict").alias("passed"))  # "allow" is before "block"
    )
    passed = staged(member.join(group, "component").select(F.col("node").alias("address"), "passed"), "url-passed")
    told = judged.join(passed, "address", "left")
    return told.select(
        "page_id", "host", "path", F.col("found.text").alias("rule"),
        F.coalesce("found.verdict", "passed", F.lit(default)).alias("verdict"),
        (F.col("found").isNull() & F.col("passed").isNotNull()).alias("passed_on"),
    )


def kept_pages(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", **options) -> DataFrame:
    """The pages whose verdict is allow, with all their columns; ids name the pages, null ids are kept out of none."""
    blocked = judge(pages, rules, id_col=id_col, **options).where("verdict = 'block'").select(F.col("page_id").alias("__page")).distinct()
    return pages.join(blocked, pages[id_col].eqNullSafe(F.col("__page")), "left_anti")

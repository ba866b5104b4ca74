"""URL filters: block decisions that reach every alias of a blocked address."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import components


class Rule(NamedTuple):
    """A host (with all its subdomains) and the start of a path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query: fixed values.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: Up to here rules are one expression; longer lists are joined by host.
INLINE_RULES = 256


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: what two spellings of one address share. Empty if no address."""
    return F.coalesce(F.concat(host_of(url), F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rule(urls: DataFrame, rules: Iterable[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """Add ``rule`` and ``action``: the longest rule that fits, or nulls.

    Among rules of one length the first by name wins, and a block before an allow of
    the same name.
    """
    rules = sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.action != "block"))
    if len(rules) <= INLINE_RULES:
        tests = [(_fits(r, F.col(host), F.col(path)), r) for r in rules]
        rule = F.coalesce(*[F.when(t, F.lit(r.name)) for t, r in tests], F.lit(None).cast("string"))
        action = F.coalesce(*[F.when(t, F.lit(r.action)) for t, r in tests], F.lit(None).cast("string"))
        return urls.withColumns({"rule": rule, "action": action})
    spark = urls.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.name, r.action, i) for i, r in enumerate(rules)], "r_host string, r_path string, r_name string, r_action string, r_order int")
    places = urls.select(F.col(host).alias("p_host"), F.col(path).alias("p_path")).distinct()
    labels = F.split("p_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        places.withColumn("r_host", F.explode(suffixes))
        .join(table, "r_host")
        .where(F.col("p_path").startswith(F.col("r_path")))
        .groupBy("p_host", "p_path")
        .agg(F.min(F.struct("r_order", "r_name", "r_action")).alias("best"))
    )
    joined = urls.join(best, (F.col(host) == F.col("p_host")) & (F.col(path) == F.col("p_path")), "left")
    return joined.withColumns({"rule": F.col("best.r_name"), "action": F.col("best.r_action")}).drop("p_host", "p_path", "best")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value; ``data-href`` is no ``href``."""
    quoted = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    bare = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(quoted != "", quoted).otherwise(bare)


#: Entities that addresses are written with, ampersands last: fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses that a page's canonical link or refresh redirect makes one.

    ``rel`` may name other relations too; entities in targets are decoded. Targets may be absolute, relative to the scheme (``//host``), to the host (``/x``)
    or to the folder of the page. Pages without an address give none.
    """
    url, html = F.col(url), F.col(html)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    tag = F.col("tag")
    is_canonical = tag.rlike(r"(?i)^<link\b") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    is_refresh = tag.rlike(r"(?i)^<meta\b") & _attribute(tag, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    canonical = F.when(is_canonical, _attribute(tag, "href"))
    refresh = F.when(is_refresh, F.regexp_extract(tag, r"(?is)[\s\"';]url\s*=\s*[\"']?([^\"'>\s;]+)", 1))
    found = (
        pages.select(url.alias("url"), html.alias("html"))
        .where(html.isNotNull() & html.rlike(r"(?i)\bcanonical\b|\brefresh\b"))
        .select("url", F.explode(tags).alias("tag"))
        .select("url", F.trim(_decoded(F.coalesce(canonical, refresh))).alias("target"))
        .where("target != ''")
    )
    target = F.col("target")
    scheme = F.regexp_extract("url", r"^(.*?)://", 1)
    folder = F.regexp_replace(F.col("path"), r"[^/]*$", "")
    full = (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), F.col("host"), target))
        .otherwise(F.concat(scheme, F.lit("://"), F.col("host"), F.when(folder == "", "/").otherwise(folder), target))
    )
    return (
        found.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .select(address_of(F.col("url")).alias("a"), address_of(full).alias("b"))
        .where("a != '' and b != '' and a != b")
    )


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, alias_of, inherited.

    Addresses joined by canonical links, refresh redirects or rows of ``redirects``
    (from_url, to_url) are aliases: connected components over those links. An address
    that a rule blocks blocks all its aliases, whether or not it is itself a page; a
    page that a rule of its own allows stays allowed. Nothing else is blocked.
    ``alias_of`` is the smallest address of the component, null without aliases.

    A null or malformed url has an empty host and path, no alias and no rule but one
    that fits an empty host, and is allowed. Repeated pages are judged each by
    itself; other columns are not read; an empty table gives none.
    """
    rules = list(rules)
    links = alias_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(address_of(F.col("from_url")), address_of(F.col("to_url"))).where("from_url is not null and to_url is not null")).where("a != '' and b != ''")
    classes = components(links)
    # An address is its own page here: the rules need its host and path alone.
    address = F.concat(F.lit("x://"), F.col("node"))
    blocked = (
        with_rule(classes.withColumns({"host": host_of(address), "path": path_of(address)}), rules)
        .groupBy("component")
        .agg(F.max(F.col("action").eqNullSafe("block")).alias("inherited"))
    )
    aliases = classes.join(blocked, "component").select(F.col("node").alias("address"), F.col("component").alias("alias_of"), "inherited")
    url = F.col("url")
    judged = with_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")), rules)
    inherited = F.coalesce("inherited", F.lit(False))
    return judged.join(aliases, "address", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(inherited, "block").otherwise("allow")).alias("verdict"),
        "alias_of",
        inherited.alias("inherited"),
    )

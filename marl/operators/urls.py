"""URL rules: normal form, domain lists, credibility, fetch priority, robots rules and document types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..shared import unused
from .running import running_ranks

PARTS = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?"


@dataclass(frozen=True)
class DomainConfig:
    """dot: a listed domain matches itself and its sub-domains only, not names that merely end like it."""

    credibility: tuple[tuple[str, float], ...] = tuple(lexicon.CREDIBILITY.items())
    blocked: tuple[str, ...] = tuple(lexicon.BLOCKED)
    first: tuple[str, ...] = tuple(lexicon.FIRST_DOMAINS)
    last: tuple[str, ...] = tuple(lexicon.LAST_DOMAINS)
    unknown: float = 0.30
    dot: bool = True


def with_scheme(url: Column | str) -> Column:
    u = text.strip(F.coalesce(text.col(url), F.lit("")))
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def normalize_url(url: Column | str) -> Column:
    """Lower-case scheme and host, a path at least "/", the query, no parameters of the path and no fragment; empty for an empty URL."""
    u = with_scheme(url)
    path = F.regexp_replace(F.regexp_extract(u, PARTS, 3), ";[^/]*$", "")
    whole = F.concat(F.lower(F.regexp_extract(u, PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(u, PARTS, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(u, PARTS, 4))
    return F.when(text.strip(F.coalesce(text.col(url), F.lit(""))) == "", F.lit("")).otherwise(F.regexp_replace(whole, "\\?$", ""))


def host(url: Column | str) -> Column:
    """Host of a URL with scheme, in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(text.col(url), PARTS, 2)), "^www\\.", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(text.col(url), PARTS, 3)


def under(h: Column, domain: str, dot: bool) -> Column:
    return (h == domain) | F.endswith(h, F.lit(f".{domain}")) if dot else F.endswith(h, F.lit(domain))


def any_of(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def is_allowed(url: Column | str, cfg: DomainConfig = DomainConfig(), allowed: tuple[str, ...] | None = None) -> Column:
    h = host(url)
    listed = allowed if allowed is not None else tuple(d for d, _ in cfg.credibility)
    return (h != "") & ~any_of([under(h, d, cfg.dot) for d in cfg.blocked]) & any_of([under(h, d, cfg.dot) for d in listed])


def credibility(url: Column | str, cfg: DomainConfig = DomainConfig()) -> Column:
    """Score of the first listed domain that the host falls under."""
    h = host(url)
    return F.coalesce(*[F.when(under(h, d, cfg.dot), F.lit(float(s))) for d, s in cfg.credibility], F.lit(cfg.unknown))


def priority_class(url: Column | str, cfg: DomainConfig = DomainConfig()) -> Column:
    u = F.lower(text.col(url))
    return F.when(any_of([F.contains(u, F.lit(d)) for d in cfg.first]), 0).when(any_of([F.contains(u, F.lit(d)) for d in cfg.last]), 2).otherwise(1)


def fetch_list(urls: DataFrame, cfg: DomainConfig = DomainConfig(), k: int = 20) -> DataFrame:
    """The first k of (query, pos, url) for each query, by class, then position."""
    ranked = urls.withColumn("class", priority_class("url", cfg))
    order = Window.partitionBy("query").orderBy("class", "pos", "url")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(results: DataFrame, cfg: DomainConfig = DomainConfig()) -> DataFrame:
    """Search results (query, search_pos, pos, url) of all search strings of a query as one list (query, pos, url): normal form, allowed
    domains, each URL where it comes first."""
    found = results.withColumn("url", normalize_url("url")).where(is_allowed("url", cfg))
    first = found.groupBy("query", "url").agg(F.min(F.struct("search_pos", "pos")).alias("at"))
    return first.select("query", (F.row_number().over(Window.partitionBy("query").orderBy("at", "url")) - 1).alias("pos"), "url")


def allowed_by_robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) without those whose lower-case path starts with a prefix that rules (host, prefix) disallow for its host.

    A path is not compared with its host's rules one by one: it is cut to the lengths that these have, few however many rules there are,
    and what is left meets the rules by equality of host and prefix."""
    rules = rules.where("prefix <> '' and host is not null").select("host", F.lower("prefix").alias("prefix")).distinct()
    host_, path_ = unused(pages, "host"), unused(pages, "path")
    own = F.when(path("url") == "", "/").otherwise(F.lower(path("url")))
    named = pages.withColumn(host_, host("url")).withColumn(path_, own)
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    paths = named.select(F.col(host_).alias("host"), F.col(path_).alias("path")).distinct().join(sizes, "host")
    tries = paths.select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.col("path").substr(F.lit(1), F.col("n")))
    blocked = tries.join(rules, ["host", "prefix"], "left_semi").select(F.col("host").alias(host_), F.col("path").alias(path_)).distinct()
    return named.join(blocked, [host_, path_], "left_anti").select(*(f"`{c}`" for c in pages.columns))


def robots_rules(files: DataFrame, host_column: str = "host", body: str = "body") -> DataFrame:
    """(host, prefix): what the sections for all agents of robots files disallow, in lower case."""

    def step(acc: Column, line: Column) -> Column:
        agent = F.startswith(line, F.lit("user-agent"))
        inside = F.when(agent, F.contains(line, F.lit("*"))).otherwise(acc["inside"])
        prefix = text.strip(F.substring(line, len("disallow:") + 1, 1 << 30))
        told = inside & F.startswith(line, F.lit("disallow:")) & (prefix != "")
        return F.struct(inside.alias("inside"), F.when(told, F.concat(acc["found"], F.array(prefix))).otherwise(acc["found"]).alias("found"))

    lines = F.transform(text.lines(F.lower(F.coalesce(F.col(body), F.lit("")))), text.strip)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))
    return files.select(F.col(host_column).alias("host"), F.explode(F.aggregate(lines, start, step, lambda acc: F.array_distinct(acc["found"]))).alias("prefix"))


def fetch_waves(urls: DataFrame, per_host: int = 8, order: str = "pos", each: int = 100_000) -> DataFrame:
    """urls with host and wave: of the URLs of a host at most per_host are fetched in one wave, in order. A host of any size is dealt to tasks."""
    own = urls.withColumn("host", host("url"))
    place = unused(own, "place")
    return running_ranks(own, ["host"], [order, "url"], place, each).withColumn("wave", F.floor((F.col(place) - 1) / per_host).cast("long")).drop(place)


def document_type(content_type: Column | str, url: Column | str) -> Column:
    kind = F.lower(F.coalesce(text.col(content_type), F.lit("")))
    return F.when(F.contains(kind, F.lit("application/pdf")) | F.endswith(F.lower(text.col(url)), F.lit(".pdf")), "pdf").when(F.contains(kind, F.lit("text/html")), "web")

"""URL filters with redirect equivalence.

Explicit rules (verdict, host, path prefix) decide a URL they fit; the longest one wins. URLs that
redirects or canonical links join are aliases: connected components over these edges carry decisions
from the members that a rule fits to those that none fits. A component that has an explicitly
allowed member is allowed, else one with a blocked member is blocked; URLs outside any such
component are allowed. An explicit rule always beats what the aliases say.

Edges come from each page's own HTML (``<link rel=canonical>`` and ``<meta http-equiv=refresh>``)
and from an optional table of redirects. Links are resolved against the page's URL or its ``<base>``,
dot segments and character references included. Fragments don't tell URLs apart.

Rules are a short list in the program; they become one expression, evaluated where the rows are.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and no alias;
null html has no edges; repeated rows are each judged; an empty table gives an empty table; other
input columns aren't read.
"""

from __future__ import annotations

import html
import string
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vocaris.llm.components import connected_components
from vocaris.llm.frames import cut

_BLANK = " \t\n\f\r"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _first_fit(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What two spellings of an alias have in common: the URL without its fragment, host in lower
    case; null without ``://``."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(bare, r"(?s)^(.*?://)", 1))
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*(.*)$", 1)
    return F.when(F.instr(bare, "://") > 0, F.concat(scheme, host_of(bare), rest))


@F.pandas_udf(StringType())
def resolved(page: pd.Series, base: pd.Series, link: pd.Series) -> pd.Series:
    """The links of pages as absolute URLs: character references decoded, relative to the page's
    ``<base href>`` where it has one; null if there is no such URL."""

    def one(page: str | None, base: str | None, link: str | None) -> str | None:
        link = html.unescape(link or "").strip(_BLANK)
        if not page or not link:
            return None
        try:
            return urljoin(urljoin(page, html.unescape(base or "").strip(_BLANK)), link)
        except ValueError:  # a malformed host
            return None

    return pd.Series([one(*x) for x in zip(page, base, link)], dtype=object)


def _href(tag: Column) -> Column:
    found = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'[^']*'|[^\s\"'>]+)", 0)
    return F.regexp_replace(found, r"(?is)^href\s*=\s*[\"']?|[\"']$", "")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between nodes that the pages' own markup declares."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    declared = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b") | t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"))
    base = _href(F.regexp_extract(F.col(html_col), r"(?is)<base\b[^>]*>", 0))
    found = pages.where(F.col(html_col).rlike(r"(?i)canonical|refresh")).select(F.col(url_col).alias("u"), base.alias("base"), F.explode(declared).alias("t"))
    target = F.when(F.col("t").rlike(r"(?is)^<link"), _href(F.col("t"))).otherwise(F.regexp_extract("t", r"(?is)url\s*=\s*'?([^\"'>]+)", 1))
    # links are few beside the pages; cut, so that one stage doesn't hold all these expressions
    links = cut(found.select("u", "base", target.alias("target")))
    absolute = cut(links.select("u", resolved("u", "base", "target").alias("to")))
    return absolute.select(node_of(F.col("u")).alias("a"), node_of(F.col("to")).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule and verdict of every page. redirects: (from_url, to_url)."""
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null and a <> b"))
    edges = cut(cut(edges).distinct())
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), node_of(F.col(url_col)).alias("__node"))
    judged = judged.withColumns({"rule": _first_fit(F.col("host"), F.col("path"), rules, "text"), "__own": _first_fit(F.col("host"), F.col("path"), rules, "verdict")})
    if edges.isEmpty():
        return judged.select(id_col, "host", "path", "rule", F.coalesce("__own", F.lit("allow")).alias("verdict"))
    members = cut(connected_components(edges))
    node = F.col("node")
    said = members.withColumn("v", _first_fit(host_of(node), path_of(node), rules, "verdict")).groupBy("component").agg(F.max((F.col("v") == "allow").cast("int")).alias("y"), F.max((F.col("v") == "block").cast("int")).alias("n"))
    inherited = members.join(said, "component").select("node", F.when(F.col("y") == 1, "allow").when(F.col("n") == 1, "block").alias("__alias"))
    joined = judged.join(inherited, F.col("__node") == F.col("node"), "left")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("__own", "__alias", F.lit("allow")).alias("verdict"))


RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _sql() -> str:
    """For pages whose html declares no aliases."""
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    order = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, value)}'" for r in order) + " END"
    lower = f"translate(regexp_extract(coalesce(url, ''), {parts}, 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH p AS (SELECT page_id, {lower} AS host, regexp_extract(coalesce(url, ''), {parts}, 2) AS path FROM pages)
SELECT page_id, host, path, {case('text')} AS rule, coalesce({case('verdict')}, 'allow') AS verdict FROM p
"""


ORACLE_SQL = _sql()

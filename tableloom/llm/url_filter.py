"""Verdicts on URLs: rules first, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.bloom import MAX_FILTER_BYTES, BlockedBloom
from tableloom.llm.words import LOWER, UPPER
from tableloom.session import materialise


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and without ``://``."""
    host = F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """One spelling for the forms of a page: no scheme, query, fragment, ``www.`` or ``m.``, ``.html`` or last ``/``."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict, or NULL."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every page.

    The longest rule that fits decides. Elsewhere ``block`` if the page's canonical URL is one of ``listed``
    (a column ``canonical``; NULLs and repeats in it do nothing), else ``allow``. URLs that are NULL or have no
    ``://`` have no host and no path, fit no rule and are on no list. Other columns are ignored; repeated rows give
    repeated results; an empty list blocks nothing.

    Plan: a filter of two bytes per listed URL goes to every worker if that is at most ``max_filter_bytes``; pages it
    rules out need no shuffle, the others meet the list in an exact join. A larger list is joined without the filter.
    """
    listed = materialise(listed.select("canonical").filter(F.col("canonical") > "").distinct(), "listed-urls")
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("_canonical", canonical_url(F.col("host"), F.col("path")))
    bloom = BlockedBloom.build(listed, "canonical", max_filter_bytes)
    maybe = F.col("_canonical") > ""
    if bloom:
        maybe &= bloom.possible(pages.sparkSession, F.col("_canonical"))
    parts = parts.withColumn("_maybe", maybe)
    sure = parts.filter(~F.col("_maybe")).withColumn("listed", F.lit(False))
    exact = listed.withColumn("_hit", F.lit(True))
    asked = parts.filter("_maybe").join(exact, F.col("_canonical") == F.col("canonical"), "left")
    asked = asked.withColumn("listed", F.coalesce("_hit", F.lit(False))).drop("canonical", "_hit")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    judged = sure.unionByName(asked).withColumn("_rule", rule)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "listed"
    )

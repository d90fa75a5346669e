"""URL filter: explicit rules, then path templates judged by labelled purity.

Each host has a tree of path segments. Level by level, down to the last segment of the longest
path, segments that few pages share become wildcards; segments left whose pages look alike
(what follows, how many are labelled, how many of these blocked) are merged, the node's largest
branch first, then the largest of those unlike it, until none is left. A path's template is its generalised segments. The urls that rules decide are the
labelled ones; a template is rejected if the smoothed share of blocked urls among its
labelled ones is high enough.

Pages are first counted by host and path. Every grouping has map-side partial aggregates,
a node keeps only branches with enough pages of their own, and joins by node have a unique
right side. Paths whose node has too few pages for any branch are generalised to their end at
once, so that a level has work only for nodes that can still branch.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for urls of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rules(verdict: str, names: list[str]) -> list[Rule]:
    """Rules from strings like ``example.com/en/``."""
    return [Rule(verdict, *(n.split("/", 1)[0], "/" + n.split("/", 1)[1])) for n in names]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.

    Path: from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty.
    """
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _shape(segment: Column) -> Column:
    """The wildcard for a variable segment: numbers apart from other words, with their extension."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return F.concat(F.when(stem.rlike(r"^[0-9]+$"), "<n>").otherwise("<*>"), extension)


def _apart(alike: float) -> Column:
    """Whether a branch's shares differ from those of its ``top``, each by more than ``alike`` and twice its standard error."""

    def differs(count: str, of: str) -> Column:
        x, y = F.col(count) / F.col(of), F.col(f"top.{count}") / F.col(f"top.{of}")
        pooled = (F.col(count) + F.col(f"top.{count}")) / (F.col(of) + F.col(f"top.{of}"))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col(of) + 1 / F.col(f"top.{of}")))
        return F.coalesce((F.abs(x - y) > alike) & (F.abs(x - y) > 2 * error), F.lit(False))

    both = (F.col("labelled") > 0) & (F.col("top.labelled") > 0)
    return differs("ends", "n") | differs("numbers", "n") | differs("labelled", "n") | F.when(both, differs("blocked", "labelled")).otherwise(False)


def _merged(branches: DataFrame, alike: float) -> DataFrame:
    """(host, template, now, name): branches of a node that look alike have one name.

    The node's largest branch takes in all that look like it, then the largest of the rest
    does, and so on. Leaders differ by more than ``alike`` in one of four shares, so how many
    passes it takes has a bound that doesn't depend on the number of pages or branches.
    """
    profile = ("n", "labelled", "blocked", "ends", "numbers")
    left, named = branches.select("host", "template", "s", *profile), None
    while True:
        top = left.groupBy("host", "template").agg(F.max_by(F.struct("s", *profile), F.struct("n", "s")).alias("top"))
        judged = materialize(left.join(top, ["host", "template"]).withColumn("apart", _apart(alike)), "leaders")
        own = judged.where(~F.col("apart")).select("host", "template", F.col("s").alias("now"), F.concat(F.lit("("), F.col("top.s"), F.lit(")")).alias("name"))
        named = own if named is None else named.unionByName(own)
        left = judged.where("apart").select("host", "template", "s", *profile)
        if left.isEmpty():
            return named


def templates(paths: DataFrame, support: int, alike: float) -> DataFrame:
    """(host, path, n, labelled, blocked) with the ``template`` of each path."""
    rows = paths.withColumn("seg", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    rows, done = materialize(rows, "paths"), []
    for level in count():
        here, after = F.get("seg", F.lit(level)), F.get("seg", F.lit(level + 1))
        done.append(rows.where(here.isNull()))
        rows = rows.where(here.isNotNull())
        number = after.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$")
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        follows = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("ends", after.isNull()), ("numbers", F.coalesce(number, F.lit(False))))]
        child = materialize(rows.groupBy("host", "template", here.alias("s")).agg(*sums, *follows), "branches")
        node = child.groupBy("host", "template").agg(F.sum("n").alias("total"))
        if node.where(F.col("total") >= support).isEmpty():  # nor has any node further down
            break
        named = _merged(child.where(F.col("n") >= support), alike)
        joined = rows.withColumn("now", here).join(named, ["host", "template", "now"], "left")
        part = F.concat(F.lit("/"), F.coalesce("name", _shape(F.col("now"))))
        rows = materialize(joined.select("host", "path", "n", "labelled", "blocked", "seg", F.concat("template", part).alias("template")), "paths")
    rest = F.array_join(F.transform(F.slice("seg", level + 1, F.greatest(F.size("seg"), F.lit(1))), lambda s: F.concat(F.lit("/"), _shape(s))), "")
    found = rows.withColumn("template", F.concat("template", rest))
    for d in done:
        found = found.unionByName(d)
    return found.drop("seg")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", support: int = 5, alike: float = 0.1, weight: float = 4.0, reject: float = 0.8) -> DataFrame:
    """Verdict on every url: the longest fitting rule's, else its template's.

    A template is blocked if (blocked + weight / 2) / (labelled + weight) >= ``reject``, over
    the urls with its host and template that rules decide; others are allowed. A segment is
    kept if at least ``support`` pages have it, however many pages and branches its node has.

    Returns id, ``host``, ``path``, ``rule`` (its host and path, or null), ``verdict`` and
    ``template``, a row for each input row. A null url or one without ``://`` has an empty
    host and path and is judged by the (empty) template of the empty host. Of rules with
    equal strings the first counts. Rules are a list of moderate length, held by the driver.
    """
    host, path = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    chosen: Column | None = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        fits = r.fits(F.col("host"), F.col("path"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    none = F.lit(None).cast("struct<name:string,verdict:string>")
    rows = materialize(rows.withColumn("by", none if chosen is None else chosen), "urls")
    labelled, blocked = F.col("by").isNotNull().cast("long"), F.coalesce((F.col("by.verdict") == "block").cast("long"), F.lit(0))
    counted = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked"))
    tree = templates(counted, support, alike)
    tree = materialize(tree, "templates")
    purity = (F.sum("blocked") + weight / 2) / (F.sum("labelled") + weight)
    judged = tree.groupBy("host", "template").agg(F.when(purity >= reject, "block").otherwise("allow").alias("judged"))
    of_path = tree.select("host", "path", "template").join(judged, ["host", "template"])
    out = rows.join(of_path, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("by.name").alias("rule"), F.coalesce("by.verdict", "judged").alias("verdict"), "template")

"""URL filters: explicit rules, and a path-template tree per host for the rest.

The urls that a rule judges are the labelled ones. Level by level, a node of a host's path tree
whose children are many and rare makes them one wildcard. Sibling branches of one shape whose
labels don't differ statistically are merged, from the deepest level to the first. A template is
rejected if its smoothed share of blocked labels is high. One without labels takes that of its merged
siblings, else that of its nearest ancestor in the host with several labelled templates; else it keeps
the prior, which allows.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import written


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules (fixed values).
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: A node's children become a wildcard if they are more than this, with fewer pages each than that.
MAX_CHILDREN, MAX_REPEATS = 16, 20

#: Standard errors within which a branch's blocked share is that of its siblings.
SIMILAR = 1.96

#: Labels that the prior is worth, the prior's blocked share, and the share from which a template is rejected.
PRIOR_WEIGHT, PRIOR, REJECT = 4.0, 0.5, 0.8

#: Labelled templates below an ancestor from which it speaks for templates without labels.
MIN_LABELLED = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A to Z lower-cased, and path; both empty for null and urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _longest(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def _step(state: DataFrame, level: int) -> DataFrame:
    """``state`` (host, path, parts, template, n) with each template one level longer, where there is one more part."""
    part = F.get("parts", F.lit(level))
    children = state.filter(part.isNotNull()).groupBy("host", "template", part.alias("part")).agg(F.sum("n").alias("n"))
    nodes = children.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
    wild = nodes.filter((F.col("kids") > MAX_CHILDREN) & (F.col("n") < MAX_REPEATS * F.col("kids"))).select(
        "host", "template", F.lit(True).alias("wild")
    )
    # A wildcard keeps a file's extension, and an empty part stays what it is.
    shown = F.when(F.col("wild"), F.regexp_replace(part, r"^[^.]+", "*")).otherwise(part)
    grown = F.when(part.isNotNull(), F.concat("template", F.lit("/"), shown)).otherwise(F.col("template"))
    return state.join(wild, ["host", "template"], "left").withColumn("template", grown).drop("wild")


def _generalised(pages: DataFrame) -> DataFrame:
    """(host, path, label, n, template) of every different path of ``pages``; n is its number of pages.

    Only paths under nodes with more than ``MAX_CHILDREN`` paths walk on to the next level: below
    other nodes there can be no wildcard, so what is left of such a path ends its template.
    """
    parts = F.split(F.substring("path", 2, 1 << 30), "/", -1)
    split = F.when(F.startswith("path", F.lit("/")), parts).otherwise(F.array().cast("array<string>"))
    paths = pages.groupBy("host", "path").agg(F.first("label").alias("label"), F.count("*").alias("n"))
    state = written(paths.select("*", split.alias("parts"), F.lit("").alias("template")), "level0")
    done, level = [], 0
    while True:
        left = F.slice("parts", F.lit(level + 1), F.greatest(F.size("parts") - level, F.lit(0)))
        rest = F.when(F.size(left) > 0, F.concat("template", F.lit("/"), F.array_join(left, "/"))).otherwise(F.col("template"))
        crowded = state.filter(F.size("parts") > level).groupBy("host", "template").agg(F.count("*").alias("under")).filter(F.col("under") > MAX_CHILDREN)
        told = state.join(crowded, ["host", "template"], "left")
        told = told.withColumn("walks", F.col("under").isNotNull() & (F.size("parts") > level)).drop("under")
        held = written(told, f"told{level}")
        done.append(held.filter("NOT walks").select("host", "path", "label", "n", rest.alias("template")))
        walking = held.filter("walks").drop("walks")
        if walking.isEmpty():
            break
        state = written(_step(walking, level), f"level{level + 1}")
        level += 1
    every = done[0]
    for some in done[1:]:
        every = every.unionByName(some)
    return written(every, "templates")


def _depth(template: Column) -> Column:
    """Levels of a template."""
    return F.char_length(template) - F.char_length(F.replace(template, F.lit("/")))


def _merged(templates: DataFrame) -> DataFrame:
    """``templates`` (host, template, bad, labels) with ``merged``, its branch after merging from the deepest level to the first.

    Only templates of one host and depth can be siblings, so levels below the deepest such pair are left out.
    """
    state = written(templates.select("*", F.col("template").alias("merged"), _depth(F.col("template")).alias("depth")), "branches")
    several = state.groupBy("host", "depth").agg(F.count("*").alias("n")).filter("n > 1")
    deepest = several.agg(F.max("depth")).first()[0] or 0
    for level in reversed(range(deepest)):
        # A regular expression repeats at most 1000 times, so the parts are cut by place.
        parts = F.split("merged", "/", -1)
        part = F.get(parts, F.lit(level + 1))
        head = F.array_join(F.slice(parts, 1, level + 1), "/")
        tail = F.array_join(F.slice(parts, F.lit(level + 3), F.greatest(F.size(parts) - level - 2, F.lit(0))), "/")
        longer = F.when(F.size(parts) > level + 2, F.concat(F.lit("/"), tail)).otherwise(F.lit(""))
        plain = part.rlike("^[^/*]+")
        shape = F.when(plain, F.concat(head, F.lit("/{}"), F.regexp_extract(part, r"(?s)^[^*]+(.*)$", 1), longer)).otherwise(F.col("merged"))
        branches = state.groupBy("host", "merged", shape.alias("shape")).agg(F.sum("bad").alias("b"), F.sum("labels").alias("n"))
        shapes = branches.groupBy("host", "shape").agg(F.try_divide(F.sum("b"), F.sum("n")).alias("share"))
        met = branches.join(shapes, ["host", "shape"])
        error = F.sqrt(F.try_divide(F.col("share") * (1 - F.col("share")), F.col("n")))
        alike = F.abs(F.try_divide("b", "n") - F.col("share")) <= SIMILAR * error + 1e-9  # null without labels
        joins = alike | ((F.col("n") == 0) & F.col("share").isNotNull())
        moved = met.filter(joins & (F.col("shape") != F.col("merged"))).select("host", "merged", "shape")
        joined = state.join(moved, ["host", "merged"], "left")
        state = written(joined.withColumn("merged", F.coalesce("shape", "merged")).drop("shape"), f"merged{level}")
    return state.drop("depth")


def template_verdicts(paths: DataFrame) -> DataFrame:
    """(host, template, merged, purity, rejected) of every template of ``paths`` with host, template, label and n."""
    bad = F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0))
    labels = F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0))
    state = _merged(paths.groupBy("host", "template").agg(bad.alias("bad"), labels.alias("labels")))
    own = state.groupBy("host", "merged").agg(F.sum("bad").alias("b"), F.sum("labels").alias("n"))
    met = state.join(own, ["host", "merged"])
    # The nearest ancestor, the template itself included, that has several labelled templates below it.
    levels = F.sequence(F.lit(0), _depth(F.col("template")))
    above = F.transform(levels, lambda k: F.struct(k.alias("level"), F.xxhash64(F.call_function("substring_index", F.col("template"), F.lit("/"), k + 1)).alias("node")))
    labelled = state.filter("labels > 0").select("host", "bad", "labels", F.inline(above)).groupBy("host", "level", "node")
    sums = labelled.agg(F.count("*").alias("several"), F.sum("bad").alias("b"), F.sum("labels").alias("n")).filter(F.col("several") >= MIN_LABELLED)
    bare = met.filter("n = 0").select("host", "template", F.inline(above)).join(sums, ["host", "level", "node"])
    nearest = bare.groupBy("host", "template").agg(F.max_by(F.struct("b", "n"), "level").alias("ancestor"))
    taken = F.coalesce("ancestor", F.struct("b", "n"))
    chosen = met.join(nearest, ["host", "template"], "left").select("host", "template", "merged", taken.alias("taken"))
    purity = (F.col("taken.b") + PRIOR * PRIOR_WEIGHT) / (F.col("taken.n") + PRIOR_WEIGHT)
    return chosen.select("host", "merged", "template", purity.alias("purity"), (purity >= REJECT).alias("rejected"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, template and the template's purity.

    The verdict is the longest fitting rule's (of equal length, the later in the alphabet), else
    ``block`` if the page's template is rejected, else ``allow``. Null urls and urls without
    ``://`` have empty host and path, so no rule fits them. Repeated rows are judged alike, further
    columns ignored, an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.select(
        "*",
        _longest(F.col("host"), F.col("path"), rules, lambda r: r.name).alias("rule"),
        _longest(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("label"),
    )
    paths = _generalised(ruled)
    verdicts = template_verdicts(paths).join(paths.select("host", "path", "template"), ["host", "template"])
    judged = ruled.join(written(verdicts, "verdicts"), ["host", "path"], "left")
    other = F.when(F.col("rejected"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label", other).alias("verdict"), "template", "purity")

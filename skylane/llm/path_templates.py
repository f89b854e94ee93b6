"""URL verdicts by a rule list and, where no rule fits, by a tree of path templates per host.

Each path becomes a chain of segments. Segments that look like numbers, dates, hashes or slugs are
wildcards at once; others become one where a node of the tree has many different children for its pages.
Branches of a host (by first segment) with the same main templates are merged unless a test tells them apart:
a chi-square test of how their pages spread over these templates and, where a branch has enough labelled pages,
of how many are blocked. So a branch without labels shares those of branches that look like it. The pages that a
rule decides are the labels: a template is rejected when the share of blocked among its labelled pages, pooled over
merged branches, is high, smoothed by ``PRIOR_PAGES`` pages at the host's share of blocked pages.

The tree is built level by level; every level is one aggregation over (host, template so far, segment)
and a join back that broadcasts the answers of hot nodes only, at most ``HOT_SHARE`` of them. A page leaves the
tree where its path ends, or where all pages of its node go on alike, so however deep paths are, a level holds
only pages that still part from others below it.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless pages like it are blocked; rows with null or repeated ids are answered one by one; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import counted, join_answers
from skylane.session import written

# A node's children become one wildcard when they are at least so many and, on average, have less than so many pages.
MANY_CHILDREN = 12
PAGES_PER_CHILD = 4
# Shares of a branch that belong to its shape; so a shape has at most eight entries.
SHAPE_SHARE = 1 / 8
PRIOR_PAGES = 8
# Labelled pages that a branch needs for its own labels to set it apart.
ENOUGH_LABELS = 8
# Chi-square at one in a thousand, by degrees of freedom from 0 on.
CHI_SQUARE = (0.0, 10.83, 13.82, 16.27, 18.47, 20.52, 22.46, 24.32)
REJECTED_FROM = 0.8
# Segments that vary by their looks: pattern and the wildcard that stands for it.
_LOOKS = (
    (r"^[0-9]+(\.[A-Za-z]{1,5})?$", r"{number}$1"),
    (r"^[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}(\.[A-Za-z]{1,5})?$", r"{hash}$1"),
    (r"^[^/]*[0-9][^/]*-[^/]*$|^[^/]*-[^/]*[0-9][^/]*$|^[^-/]+(?:-[^-/]+){3,}$", "{slug}"),
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    there = F.instr(url, "://") > 0
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.char_length(rest) + 4, F.char_length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def _looks(segment: Column) -> Column:
    out = segment
    for pattern, wildcard in reversed(_LOOKS):
        out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, wildcard.replace("{", r"\{"))).otherwise(out)
    return out


def decided(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """page_id, host, path, and the longest fitting rule's name and verdict, or nulls."""
    host, path = parsed(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, r.name).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))


def templates(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with a column ``template``: the path with its variable segments as wildcards."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    level = rows.select("*", F.transform(segments, _looks).alias("segments"), F.lit("").alias("template"))
    level = level.withColumn("branch", F.coalesce(F.get("segments", F.lit(0)), F.lit("")))
    done, depth = [], 0
    while True:
        rest = F.slice("segments", depth + 1, F.greatest(F.size("segments") - depth, F.lit(0)))
        level = level.withColumn("segment", F.get("segments", F.lit(depth))).withColumn("node", F.concat_ws("\n", "host", "template"))
        level = level.withColumn("rest", F.array_join(rest, "/"))
        children = level.groupBy("node", "segment").agg(F.count(F.lit(1)).alias("pages"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # The first segment of a path tells branches apart and is generalised by merging, not here.
        children = children.groupBy("node").agg(
            F.sum("pages").alias("pages"), F.count("segment").alias("children"), (F.min("low") == F.max("high")).alias("alike")
        )
        if depth == 0:
            variable = F.lit(False)
        else:
            variable = (F.col("children") >= MANY_CHILDREN) & (F.col("pages") < F.col("children") * PAGES_PER_CHILD)
        nodes, _ = counted(children.select("node", "pages", "alike", variable.alias("variable")), "nodes")
        step = (
            F.when(F.col("segment").isNull(), "")
            .when(F.col("alike"), F.concat(F.lit("/"), F.col("rest")))
            .when(F.col("variable"), "/*")
            .otherwise(F.concat(F.lit("/"), F.col("segment")))
        )
        level = join_answers(level, nodes, "node", "pages", total)
        level = level.withColumns({"template": F.concat("template", step), "ended": F.col("alike") | (F.size("segments") <= depth + 1)})
        level = written(level.drop("node", "pages", "alike", "variable", "segment", "rest"), "tree-level")
        done.append(level.filter("ended").drop("ended", "segments"))
        level = level.filter("NOT ended").drop("ended")
        depth += 1
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)


def merged(rows: DataFrame) -> DataFrame:
    """host, branch, group: branches of a host that no test tells apart share a group."""
    tail = F.expr("substring(template, char_length(branch) + 2)")
    counts = rows.groupBy("host", "branch", tail.alias("tail")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked")
    )
    counts = written(counts, "templates")
    whole = counts.groupBy("host", "branch").agg(
        F.sum("pages").alias("all_pages"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
    )
    main = counts.select("host", "branch", "tail", "pages").join(whole.select("host", "branch", "all_pages"), ["host", "branch"])
    main = main.filter(F.col("pages") >= F.col("all_pages") * SHAPE_SHARE)
    # At most 1 / SHAPE_SHARE templates are main ones, so a shape stays small.
    shapes = main.groupBy("host", "branch").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tail", "pages")))).alias("main"), F.sum("pages").alias("main_pages")
    )
    shaped = whole.join(shapes, ["host", "branch"], "left")
    alone = F.concat_ws("\n", F.lit("branch"), "branch")
    shape = F.when(F.col("main").isNull(), alone).otherwise(F.concat_ws("\n", F.lit("shape"), F.map_keys("main")))
    shaped = written(shaped.withColumn("kind", F.sha2(F.concat_ws("\n", "host", shape), 256)), "shaped")
    spread = shaped.select("kind", "labelled", "blocked", "main_pages", F.explode_outer("main").alias("tail", "pages"))
    spread = spread.groupBy("kind", "tail").agg(F.sum("pages").alias("pages")).groupBy("kind").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("tail").isNotNull(), F.struct("tail", "pages")))).alias("pooled"), F.sum("pages").alias("pooled_pages")
    )
    sums = shaped.groupBy("kind").agg(F.count(F.lit(1)).alias("branches"), F.sum("labelled").alias("kind_labelled"), F.sum("blocked").alias("kind_blocked"))
    kinds = written(spread.join(sums, "kind"), "kinds")
    held, branches = counted(shaped, "shaped-branches")
    tested = join_answers(held, kinds, "kind", "branches", branches)

    def off(t: Column) -> Column:
        expected = F.col("main_pages") * F.col("pooled")[t] / F.col("pooled_pages")
        return (F.col("main")[t] - expected) * (F.col("main")[t] - expected) / expected

    spread_off = F.aggregate(F.map_keys("main"), F.lit(0.0), lambda total, t: total + off(t))
    limits = F.array(*[F.lit(v) for v in CHI_SQUARE])
    strange = F.col("main").isNotNull() & (spread_off > F.get(limits, F.size("main") - 1))
    share = F.col("kind_blocked") / F.col("kind_labelled")
    surplus = F.col("blocked") - F.col("labelled") * share
    labels_off = surplus * surplus / F.nullif(F.col("labelled") * share * (1 - share), F.lit(0.0))
    apart = (F.col("labelled") >= ENOUGH_LABELS) & F.coalesce(labels_off > CHI_SQUARE[1], F.lit(False))
    side = F.when(strange, alone).when(apart, F.when(surplus > 0, "more").otherwise("less")).otherwise("with")
    tested = written(tested.select("host", "branch", F.concat_ws("\n", "kind", side).alias("own"), "branches"), "tested")
    names = tested.groupBy("own").agg(F.min("branch").alias("group"), F.count(F.lit(1)).alias("held"))
    return join_answers(tested.drop("branches"), written(names, "group-names"), "own", "held", branches).select("host", "branch", "group")


def judge(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity (the smoothed share of blocked pages)."""
    rows, total = counted(decided(pages, rules), "pages")
    rows = templates(rows, total)
    groups = merged(rows)
    tail = F.expr("substring(template, char_length(branch) + 2)")
    labels = (F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count(F.lit(1)).alias("pages"))
    # From here on one row per (host, template); pages meet them again at the end only.
    leaves = written(rows.groupBy("host", "branch", "template", tail.alias("tail")).agg(*labels), "leaves")
    hosts = leaves.groupBy("host").agg((F.sum("blocked") / (F.sum("pages") + PRIOR_PAGES)).alias("host_share"), F.count(F.lit(1)).alias("leaves"))
    grouped, held = counted(leaves.join(groups, ["host", "branch"]), "grouped")
    pooled = grouped.groupBy("host", "group", "tail").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    purity = (F.col("all_blocked") + F.col("host_share") * PRIOR_PAGES) / (F.col("all_labelled") + PRIOR_PAGES)
    # A host with very many templates is one key among its templates: its share is looked up without a hot task.
    answers = join_answers(grouped, written(hosts, "hosts"), "host", "leaves", held).join(pooled, ["host", "group", "tail"])
    key = F.concat_ws("\n", "host", "template")
    answers = written(answers.select(key.alias("node"), "pages", F.round(purity, 6).alias("purity")), "purities")
    judged = join_answers(rows.withColumn("node", key), answers, "node", "pages", total)
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= REJECTED_FROM, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")

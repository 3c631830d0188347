"""URL filters: a tree of path templates for each host, rejected by smoothed labelled purity.

1. Each URL's path is cut into segments; in a segment, each run of digits and each long run of
   hexadecimal digits becomes a placeholder. URLs are then counted by host and path, so the
   steps below work on paths and not on pages.
2. From the root down, one level of all hosts' trees at a time, statistically similar siblings
   merge: a child whose labelled share of bad pages lies within ``alike`` standard errors of its
   parent's (or without labels) joins its like under ``+``; a child that differs stays by itself.
3. Where a node has more than ``many`` children, of which none holds half of its pages, they are
   variable and become one wildcard ``*``, but for children that differ. As among many some lie
   apart by chance, such a child must also be less likely than one in as many: its labels times
   the divergence of its share from the parent's exceed alike^2 / 2 + ln(children) (Chernoff).
   Beyond ``levels``, a path is named as far down as a branch differs; the rest is one tail ``**``.
4. A template's purity is (bad + weight * prior) / (labelled + weight), with the corpus's share
   of bad labels as prior; it is rejected from ``purest`` on.

Defined cases: a URL that is null, empty or without a host has the host '' and the path given;
pages without a label count as pages only; a null label is none, of several labels of a key
the worst counts; repeated rows are pages of their own, ties in counts change nothing, very
long URLs are read whole; without any labels the prior is 0 and nothing is rejected; no pages
give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed

LEVELS, MANY, ALIKE, WEIGHT, PUREST = 4, 12, 2.0, 4.0, 0.5
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)?([^?#]*)"
HEX, DIGITS = r"[0-9a-f]{12,}", r"[0-9]+"
KEY = r"([0-9]+)[^0-9/]*/?$"


def _labelled(pages: DataFrame, labels: DataFrame, page_id: str, url: str, label_id: str, bad: str, key: str) -> DataFrame:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    path = F.regexp_extract(u, PATH, 1)
    seg = F.regexp_replace(F.regexp_replace(path, HEX, "{h}"), DIGITS, "{n}")
    own = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.lower(F.regexp_extract(u, HOST, 1)).alias("host"), F.filter(F.split(seg, "/"), lambda x: x != "").alias("segs"), F.regexp_extract(path, key, 1).try_cast("bigint").alias("k"))
    marks = labels.select(F.col(label_id).cast("bigint").alias("k"), F.expr(bad).cast("int").alias("bad")).where("k IS NOT NULL AND bad IS NOT NULL").groupBy("k").agg(F.max("bad").alias("bad"))
    return own.join(marks, "k", "left").select("page_id", "host", "segs", "bad")


def _level(tree: DataFrame, level: int, many: int, alike: float) -> DataFrame:
    """The tree with the next level's names added to its nodes; kept is the last level at which a branch differs.

    Children and nodes are counted by aggregates, combined before they are sent, so that a node of many children needs no task of its own.
    """
    here = tree.withColumn("seg", F.when(F.size("segs") > level, F.element_at("segs", level + 1)))
    child = here.where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"))
    parent = child.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pn"), F.max("n").alias("top"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    about = child.join(parent, ["host", "node"])
    over = lambda x, y: x / F.nullif(y, F.lit(0))
    share, own = over(F.col("pb"), F.col("pl")), over(F.col("b"), F.col("l"))
    differs = (F.col("children") > 1) & (F.col("l") > 0) & (F.abs(own - share) > alike * F.sqrt(over(share * (1 - share), F.col("l"))))
    variable = (F.col("children") > many) & (F.col("top") * 2 < F.col("pn"))
    part = lambda x, y: F.when(x > 0, x * F.log(over(x, y))).otherwise(0.0)
    sure = F.col("l") * (part(own, share) + part(1 - own, 1 - share)) > alike * alike / 2 + F.log("children")
    apart = F.coalesce(differs & (~variable | sure), F.lit(False))
    named = about.select("host", "node", "seg", apart.alias("apart"), F.when(apart, F.col("seg")).when(variable, "*").when(F.col("children") == 1, F.col("seg")).otherwise("+").alias("name"))
    node = F.concat("node", F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit("/"), "name")))
    kept = F.when(F.coalesce("apart", F.lit(False)), level + 1).otherwise(F.col("kept"))
    return here.join(named, ["host", "node", "seg"], "left").select("host", "segs", "n", "l", "b", node.alias("node"), kept.alias("kept"))


def _deeper(tree: DataFrame, levels: int, many: int, alike: float) -> DataFrame:
    """The tree of levels, with name and kept of each path as far down as a branch differs.

    Only paths of nodes with both good and bad labels are followed, as no branch of others can differ.
    """
    done, level = [tree.where(F.size("segs") <= levels)], levels
    tree = tree.where(F.size("segs") > levels)
    while True:
        mixed = tree.groupBy("host", "node").agg(((F.sum("b") > 0) & (F.sum("b") < F.sum("l"))).alias("mixed"))
        tree = checkpointed(tree.join(mixed, ["host", "node"]).withColumn("open", F.col("mixed") & (F.size("segs") > level)).drop("mixed"))
        done.append(tree.where("NOT open").drop("open"))
        tree = tree.where("open").drop("open")
        if tree.isEmpty():
            return reduce(DataFrame.unionByName, done)
        names = tree.select("host", "segs", "name")
        deep = _level(tree.drop("name"), level, many, alike).join(names, ["host", "segs"])
        level += 1
        tree = deep.withColumn("name", F.when(F.col("kept") == level, F.col("node")).otherwise(F.col("name")))


def url_templates(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", bad: str = "quality = 0 OR toxic = 1", levels: int = LEVELS, many: int = MANY, alike: float = ALIKE, weight: float = WEIGHT, purest: float = PUREST, key: str = KEY) -> DataFrame:
    """A row for each page: page_id, host, template, n_pages, n_labelled, n_bad, purity, rejected. A page's label has the number as its id that the pattern ``key`` finds in the URL's path, by default the last one."""
    each = _labelled(pages, labels, page_id, url, label_id, bad, key)
    paths = each.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    # pages are read here and once more for the result; each level starts from the one before, kept, and not from the pages
    tree = checkpointed(paths.withColumns({"node": F.lit(""), "kept": F.lit(0)}))
    deepest = tree.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(min(levels, deepest)):
        tree = checkpointed(_level(tree, level, many, alike))
    tree = tree.withColumns({"name": F.col("node"), "kept": F.least(F.size("segs"), F.lit(levels))})
    if deepest > levels:
        tree = _deeper(tree, levels, many, alike)
    tree = tree.select("host", "segs", "n", "l", "b", F.concat("name", F.when(F.size("segs") > F.col("kept"), "/**").otherwise("")).alias("node"))
    total = tree.agg(F.sum("b").alias("tb"), F.sum("l").alias("tl"))
    template = tree.groupBy("host", "node").agg(F.sum("n").alias("n_pages"), F.sum("l").alias("n_labelled"), F.sum("b").alias("n_bad")).crossJoin(total)  # one row
    prior = F.when(F.col("tl") > 0, F.col("tb") / F.col("tl")).otherwise(0.0)
    purity = (F.col("n_bad") + weight * prior) / (F.col("n_labelled") + weight)
    template = template.select("host", "node", "n_pages", "n_labelled", "n_bad", F.round(purity, 9).alias("purity"), ((F.col("n_labelled") > 0) & (purity >= purest)).alias("rejected"))
    where = tree.select("host", "segs", "node").join(template, ["host", "node"])
    return each.select("page_id", "host", "segs").join(where, ["host", "segs"]).select("page_id", "host", F.concat("host", "node").alias("template"), "n_pages", "n_labelled", "n_bad", "purity", "rejected")


def _sql() -> str:
    """The same in DuckDB's SQL, one group of views a level."""
    out = f"""
WITH marks AS (SELECT doc_id AS k, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
own AS (SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
parts AS (SELECT page_id, host, list_filter(string_split(regexp_replace(regexp_replace(path, '{HEX}', '{{h}}', 'g'), '{DIGITS}', '{{n}}', 'g'), '/'), lambda x: x <> '') AS segs, TRY_CAST(regexp_extract(path, '{KEY}', 1) AS BIGINT) AS k FROM own),
each_page AS (SELECT page_id, host, segs, bad FROM parts LEFT JOIN marks USING (k)),
tree0 AS (SELECT host, segs, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0) AS b, '' AS node FROM each_page GROUP BY host, segs)"""
    for k in range(LEVELS):
        out += f""",
child{k} AS (SELECT host, node, segs[{k + 1}] AS seg, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM tree{k} WHERE len(segs) > {k} GROUP BY ALL),
about{k} AS (SELECT *, count(*) OVER w AS children, sum(n) OVER w AS pn, max(n) OVER w AS top, (sum(b) OVER w) * 1.0 / nullif(sum(l) OVER w, 0) AS share FROM child{k} WINDOW w AS (PARTITION BY host, node)),
named{k} AS (SELECT host, node, seg, CASE WHEN children > {MANY} AND top * 2 < pn THEN '*' WHEN children = 1 THEN seg WHEN l > 0 AND abs(b * 1.0 / l - share) > {ALIKE} * sqrt(share * (1 - share) / l) THEN seg ELSE '+' END AS name FROM about{k}),
tree{k + 1} AS (SELECT t.host, t.segs, t.n, t.l, t.b, t.node || coalesce('/' || name, '') AS node FROM tree{k} t LEFT JOIN named{k} m ON t.host = m.host AND t.node = m.node AND t.segs[{k + 1}] = m.seg)"""
    return out + f""",
tree AS (SELECT host, segs, n, l, b, node || CASE WHEN len(segs) > {LEVELS} THEN '/**' ELSE '' END AS node FROM tree{LEVELS}),
total AS (SELECT coalesce(sum(b) * 1.0 / nullif(sum(l), 0), 0) AS prior FROM tree),
template AS (SELECT host, node, CAST(sum(n) AS BIGINT) AS n_pages, CAST(sum(l) AS BIGINT) AS n_labelled, CAST(sum(b) AS BIGINT) AS n_bad, (sum(b) + {WEIGHT} * any_value(prior)) / (sum(l) + {WEIGHT}) AS p FROM tree, total GROUP BY host, node)
SELECT page_id, e.host, e.host || t.node AS template, n_pages, n_labelled, n_bad, round(p, 9) AS purity, n_labelled > 0 AND p >= {PUREST} AS rejected
FROM each_page e JOIN tree t ON e.host = t.host AND e.segs = t.segs JOIN template m ON t.host = m.host AND t.node = m.node
"""


SQL = _sql()

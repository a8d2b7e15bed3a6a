"""URL filters (operator 7): a path-template tree, in DataFrame functions alone.

Listed rules come first. For the rest, every host has a tree of path templates: numbers in a
segment become a wildcard where they vary (page numbers do, a few versions or years don't),
and so does a segment where a place has many different ones. Sibling branches whose labelled rows look alike are merged, and the templates that
are left are rejected by the share of bad labels, smoothed towards their host's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import LOWER, UPPER, ascii_lower, materialize

#: (verdict, host and path): a rule holds for its host and all subdomains, where the
#: url's path starts with the rule's; the longest rule wins.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Segments up to which the oracle's SQL, a chain of queries, can follow a path; judge() follows all of them.
DEPTH = 4
#: A place with so many different segments, one in so many rows at least, is variable; so are
#: numbers at one place of alike paths if there is one in so many rows.
MANY, SPREAD = 12, 4
#: Standard errors within which a branch is like its siblings.
ALIKE = 2.0
#: Pseudo-counts of the smoothing, and the share of bad rows from which a template goes.
WEIGHT, PURITY = 5.0, 0.5


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules want them; both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that wins and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, prefix = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _generalised(paths: DataFrame, deepest: int) -> DataFrame:
    """paths(host, shape, n, ...) with `template`: variable segments are wildcards, level by level."""
    out = paths.withColumn("done", F.array().cast("array<string>"))
    for d in range(deepest):
        own = out.filter(F.size("shape") > d).withColumn("part", F.expr(f"shape[{d}]"))
        places = own.groupBy("host", "done", "part").agg(F.sum("n").alias("n")).groupBy("host", "done").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
        variable = places.filter((F.col("kinds") >= MANY) & (F.col("kinds") * SPREAD >= F.col("all"))).select("host", "done", F.lit(True).alias("variable"))
        step = out.join(variable, ["host", "done"], "left")
        part = F.expr(f"IF(size(shape) > {d}, array(IF(variable IS NULL, shape[{d}], '*')), CAST(array() AS ARRAY<STRING>))")
        out = step.withColumn("done", F.concat("done", part)).drop("variable")
        out = materialize(out, "templates")
    return out.withColumnRenamed("done", "template")


def _shaped(own: DataFrame) -> DataFrame:
    """own(host, path, ...) with `shape`, the path's segments, their numbers as # where those vary on paths that are alike otherwise."""
    parts = "filter(split({}, '/'), s -> s <> '')"
    own = own.withColumn("shape", F.expr(parts.format("regexp_replace(path, '[0-9]+', '#')"))).withColumn("raw", F.expr(parts.format("path")))
    numbers = own.select("host", "shape", F.explode(F.expr("filter(transform(raw, (r, i) -> named_struct('d', i, 'part', r)), x -> x.part RLIKE '[0-9]')")).alias("x")).select("host", "shape", "x.*")
    kinds = numbers.groupBy("host", "shape", "d", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "shape", "d").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    few = kinds.filter(F.col("kinds") * SPREAD < F.col("n")).groupBy("host", "shape").agg(F.collect_set("d").alias("few"))  # of one path
    few = materialize(few.withColumnsRenamed({"host": "f_host", "shape": "f_shape"}), "numbers")
    joined = own.join(few, (F.col("host") == F.col("f_host")) & (F.col("shape") == F.col("f_shape")), "left")
    return joined.withColumn("shape", F.expr("IF(few IS NULL, shape, transform(shape, (s, i) -> IF(array_contains(few, i), raw[i], s)))")).drop("few", "f_host", "f_shape", "raw")


def _merged(templates: DataFrame, deepest: int) -> DataFrame:
    """(host, template, branch): branch is the template after like siblings are merged, leaves first."""
    leaves = _sums(templates, "host", "template").withColumn("branch", F.col("template"))
    for d in range(deepest, 0, -1):
        cut = F.slice("branch", 1, d)
        nodes = _sums(leaves.withColumn("branch", cut).filter(F.size("branch") == d), "host", "branch").withColumn("parent", F.slice("branch", 1, d - 1))
        pooled = nodes.groupBy("host", "parent").agg(F.sum("labelled").alias("p_labelled"), F.sum("bad").alias("p_bad"))
        alike = (
            nodes.join(pooled, ["host", "parent"])
            .filter("p_labelled = 0 OR power(CAST(bad * p_labelled - labelled * p_bad AS DOUBLE), 2) <= %rD * labelled * p_bad * (p_labelled - p_bad)" % (ALIKE * ALIKE))
            .select("host", F.col("branch").alias("old"), F.lit(True).alias("alike"))
        )
        leaves = leaves.withColumn("old", cut).join(alike, ["host", "old"], "left")
        # ~ stands for all siblings that are like their pool.
        leaves = leaves.withColumn("branch", F.expr(f"IF(alike AND size(branch) >= {d}, concat(slice(branch, 1, {d - 1}), array('~'), slice(branch, {d + 1}, size(branch))), branch)")).drop("old", "alike")
        if d > 1:
            leaves = materialize(leaves, "branches")
    return leaves


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: id, host, path, rule, verdict, template, bad_share.

    labelled has columns path_key (the last number in a path, as text) and bad (boolean); it marks
    the pages with that number. Null urls and those without :// have an empty host and path;
    they are a host like others. Without labels every template is allowed. Repeated rows and
    null ids get rows of their own; null keys and labels count for nothing; a key labelled
    twice counts as bad if it ever is; an empty table gives an empty result; extra columns are not read.
    """
    host, path = parse(F.col(url_col))
    rule, verdict = matched(F.col("host"), F.col("path"), RULES if rules is None else rules)
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": verdict})
    own = materialize(_shaped(base).withColumn("key", F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1)), "pages")

    marks = labelled.select(F.col("path_key").alias("key"), "bad").filter("key IS NOT NULL AND key <> '' AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad"))
    keyed = own.filter("key <> ''").groupBy("host", "shape", "key").agg(F.count(F.lit(1)).alias("n")).join(marks, "key")
    found = keyed.groupBy("host", "shape").agg(F.sum("n").alias("labelled"), F.sum(F.expr("IF(bad, n, 0L)")).alias("bad"))
    counts = own.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    shapes = counts.join(found, ["host", "shape"], "left").na.fill(0, ["labelled", "bad"])

    shapes = materialize(shapes, "shapes")
    deepest = shapes.agg(F.max(F.size("shape"))).first()[0] or 0
    templates = _generalised(shapes, deepest)
    branches = materialize(_merged(templates, deepest), "branches")
    totals = branches.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = float(totals[1]) / totals[0] if totals[0] else 0.0
    hosts = branches.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    shares = (
        _sums(branches, "host", "branch")
        .join(hosts, "host")
        .withColumn("prior", F.expr(f"(h_bad + {WEIGHT!r}D * {overall!r}D) / (h_labelled + {WEIGHT!r}D)"))
        .select("host", "branch", F.expr(f"(bad + {WEIGHT!r}D * prior) / (labelled + {WEIGHT!r}D)").alias("bad_share"))
    )
    judged = (
        templates.select("host", "shape", "template").join(branches.select("host", "template", "branch"), ["host", "template"]).join(shares, ["host", "branch"])
        .select(F.col("host").alias("j_host"), F.col("shape").alias("j_shape"), F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"), "bad_share")
    )
    judged = materialize(judged, "judged")
    # One host's template may be a third of all pages: the sort-merge join's large
    # partitions are split at run time, and nothing above needs a key together.
    return own.join(judged, (F.col("host") == F.col("j_host")) & (F.col("shape") == F.col("j_shape"))).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("bad_share") >= PURITY, "block").otherwise("allow")).alias("verdict"), "template", F.round("bad_share", 6).alias("bad_share")
    )


def _oracle() -> str:
    """The same tree for the pages table and labels by the number in a path, level by level."""
    case = lambda pick: "CASE " + " ".join(
        f"WHEN (host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{pick(says, t)}'" for says, t in sorted(RULES, key=lambda r: -len(r[1]))
    ) + " END"
    parts = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u)",
        f"b AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"p0 AS (SELECT *, {case(lambda says, t: t)} AS rule, {case(lambda says, t: says)} AS said, regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS key, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS segs, list_filter(string_split(path, '/'), lambda s: s <> '') AS raw FROM b)",
        "x AS (SELECT host, segs, d, raw[d] AS part, count(*) AS n FROM (SELECT host, segs, raw, unnest(generate_series(1, len(raw))) AS d FROM p0) WHERE regexp_matches(raw[d], '[0-9]') GROUP BY ALL)",
        f"few AS (SELECT host, segs, list(d) AS few FROM (SELECT host, segs, d FROM x GROUP BY host, segs, d HAVING count(*) * {SPREAD} < sum(n)) GROUP BY host, segs)",
        "p AS (SELECT p0.* EXCLUDE (segs, raw), CASE WHEN few IS NULL THEN segs ELSE list_transform(segs, lambda s, i: CASE WHEN list_contains(few, i) THEN raw[i] ELSE s END) END AS shape FROM p0 LEFT JOIN few USING (host, segs))",
        "m AS (SELECT CAST(doc_id AS VARCHAR) AS key, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1)",
        "g0 AS (SELECT host, shape, count(*) AS n, count(m.key) AS labelled, coalesce(sum(m.bad), 0) AS bad, []::VARCHAR[] AS done FROM p LEFT JOIN m ON p.key = m.key AND p.key <> '' GROUP BY host, shape)",
    ]
    for d in range(DEPTH + 1):
        parts.append(f"v{d} AS (SELECT host, done FROM g{d} WHERE len(shape) > {d} GROUP BY host, done HAVING count(DISTINCT shape[{d + 1}]) >= {MANY} AND count(DISTINCT shape[{d + 1}]) * {SPREAD} >= sum(n))")
        parts.append(f"g{d + 1} AS (SELECT g.* EXCLUDE (done), CASE WHEN len(shape) <= {d} THEN g.done WHEN v.host IS NULL THEN list_append(g.done, shape[{d + 1}]) ELSE list_append(g.done, '*') END AS done FROM g{d} g LEFT JOIN v{d} v ON g.host = v.host AND g.done = v.done)")
    parts.append(f"l{DEPTH + 1} AS (SELECT host, done AS template, done AS branch, sum(labelled) AS labelled, sum(bad) AS bad FROM g{DEPTH + 1} GROUP BY host, done)")
    for d in range(DEPTH + 1, 0, -1):
        parts.append(f"n{d} AS (SELECT host, branch[1:{d}] AS node, branch[1:{d - 1}] AS parent, sum(labelled) AS labelled, sum(bad) AS bad FROM l{d} WHERE len(branch) >= {d} GROUP BY 1, 2, 3)")
        parts.append(f"q{d} AS (SELECT host, parent, sum(labelled) AS pl, sum(bad) AS pb FROM n{d} GROUP BY 1, 2)")
        parts.append(f"a{d} AS (SELECT host, node FROM n{d} JOIN q{d} USING (host, parent) WHERE pl = 0 OR pow((bad * pl - labelled * pb)::DOUBLE, 2) <= {ALIKE * ALIKE}::DOUBLE * labelled * pb * (pl - pb))")
        parts.append(f"l{d - 1} AS (SELECT l.host, l.template, l.labelled, l.bad, CASE WHEN a.host IS NOT NULL AND len(branch) >= {d} THEN list_concat(list_append(branch[1:{d - 1}], '~'), branch[{d + 1}:]) ELSE branch END AS branch FROM l{d} l LEFT JOIN a{d} a ON l.host = a.host AND l.branch[1:{d}] = a.node)")
    parts += [
        "o AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0) AS overall FROM l0)",
        f"k AS (SELECT host, (sum(bad) + {WEIGHT}::DOUBLE * any_value(overall)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS prior FROM l0, o GROUP BY host)",
        f"s AS (SELECT host, branch, (sum(bad) + {WEIGHT}::DOUBLE * any_value(prior)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS bad_share FROM l0 JOIN k USING (host) GROUP BY host, branch)",
        f"j AS (SELECT g.host, g.shape, '/' || array_to_string(l0.branch, '/') AS template, bad_share FROM g{DEPTH + 1} g JOIN l0 ON g.host = l0.host AND g.done = l0.template JOIN s ON s.host = l0.host AND s.branch = l0.branch)",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, p.host AS host, path, rule, coalesce(said, CASE WHEN bad_share >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(bad_share, 6) AS bad_share FROM p JOIN j ON p.host = j.host AND p.shape = j.shape"


ORACLE_SQL = _oracle()

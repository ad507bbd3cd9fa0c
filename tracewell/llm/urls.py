"""URL filters: explicit rules, then a path-template tree per host judged by labelled purity.

DataFrame functions only. Urls are first put together by (host, path), with how many pages they have
and how many of those are labelled, and bad. From the host down, one path segment after the other:

- segments that look variable (numbers, numbers with a suffix, long hexadecimal ids) become
  wildcards by form;
- sibling branches are merged into one wildcard branch unless their share of bad labels differs
  from that of the rest of their node by more than chance (a two-proportion z-test), however many
  siblings there are; so one-off segments share a wildcard, and a branch that stands out does not;
- below ``DEPTH`` segments, only nodes that hold both bad and clean labels are taken further, as
  long as there are any; what is left of the others is one tail, ``**``.

A template is rejected if its smoothed share of bad labels reaches ``REJECT``; shares are smoothed
towards the host's, which is smoothed towards that of all labels. The longest rule that fits a url
decides before any template.

Minima of work under skew: counts are combined before each shuffle, and only counts per (host,
path), per child and per node are joined, the last unique on their key, so a hot host splits. There are as many rounds
as segments down to the last node with labels to tell apart.

Cases: a null url, or one without ``://``, has an empty host and path; such pages form one template
of their own; a null page_id has no label; repeated labels of a page count once, as bad if any is;
very long urls are taken whole; branches of equal shares are not apart; of equally long rules the one
with the longer host decides; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import cut, table

#: (verdict, host, path) of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Segments that are looked at in any case.
DEPTH = 6
#: Segments that the SQL follows; the operator goes on as long as there are labels to tell apart.
SQL_DEPTH = 10
#: Standard errors by which a branch differs from its siblings; weight of a prior; share to reject.
DIFFERENT, PRIOR, REJECT = 2.58, 10.0, 0.6
#: Blocked urls that are broadcast at most; beyond that, the share of their pages from which one is hot and still is.
MOST_SENT, HOT = 200_000, 1 / 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])


def by_rule(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of equals, the longer host wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        rule = F.when(_fits(host, path, r), F.lit(r[1] + r[2])).otherwise(rule)
        verdict = F.when(_fits(host, path, r), F.lit(r[0])).otherwise(verdict)
    return rule, verdict


def by_form(segment: Column) -> Column:
    """A segment's form, if it looks variable."""
    return (
        F.when(segment.rlike(r"^\d+$"), F.lit("{n}"))
        .when(segment.rlike(r"^\d+\.\w+$"), F.regexp_replace(segment, r"^\d+", "{n}"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{12,}$"), F.lit("{id}"))
        .otherwise(segment)
    )


def templates(paths: DataFrame) -> DataFrame:
    """``paths (host, path, n, labelled, bad)`` with ``template``, the leaf of each path."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    now = cut(paths.withColumn("segments", segments).withColumns({"template": F.lit(""), "tail": F.lit(False)}), small=True)
    deepest = now.agg(F.max(F.size("segments"))).first()[0] or 0
    done = 0
    for d in range(deepest):
        open_ = (F.size("segments") > d) & ~F.col("tail")
        if d >= DEPTH:
            mixed = now.where(open_).groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")).where("all_bad > 0 and all_bad < all_labelled")
            mixed = cut(mixed.select("host", "template", F.lit(True).alias("mixed")), small=True)
            if mixed.isEmpty():
                break
            # What holds nothing to tell apart goes no further.
            now = now.join(mixed, ["host", "template"], "left").withColumn("tail", F.col("tail") | (open_ & F.col("mixed").isNull())).drop("mixed")
        now = now.withColumn("form", by_form(F.get("segments", F.lit(d))))
        children = now.where(open_).groupBy("host", "template", "form").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        children = cut(children, small=True)
        nodes = children.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        both = children.join(nodes, ["host", "template"])
        others, other_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.greatest(F.col("all_labelled"), F.lit(1))
        error = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("labelled"), F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        gap = F.abs(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) - other_bad / F.greatest(others, F.lit(1)))
        apart = (F.col("labelled") > 0) & (others > 0) & (gap > DIFFERENT * error)
        kept = both.where(apart).select("host", "template", "form", F.lit(True).alias("apart"))
        step = F.when(F.col("apart"), F.col("form")).otherwise("*")
        now = now.join(kept, ["host", "template", "form"], "left").withColumn("template", F.when(open_, F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))).drop("apart", "form")
        now = cut(now, small=True)
        done = d + 1
    deeper = F.col("tail") | (F.size("segments") > done)
    return now.withColumn("template", F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("segments", "tail")


def judge(leaves: DataFrame) -> DataFrame:
    """(host, template, n, labelled, bad, share): templates with their smoothed share of bad labels."""
    total = leaves.agg(F.sum("labelled"), F.sum("bad")).first()
    every = (total[1] or 0) / max(total[0] or 0, 1)
    counts = leaves.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = counts.groupBy("host").agg(((F.sum("bad") + PRIOR * every) / (F.sum("labelled") + PRIOR)).alias("host_share"))
    share = (F.col("bad") + PRIOR * F.col("host_share")) / (F.col("labelled") + PRIOR)
    return counts.join(hosts, "host").select("host", "template", "n", "labelled", "bad", share.alias("share"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; ``labels`` are (page_id, bad)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.where("page_id is not null").groupBy(F.col("page_id").alias("known_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    paths = (
        urls.join(known, F.col("page_id") == F.col("known_id"), "left")
        .groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    leaves = templates(paths)
    rejected = judge(leaves).where(F.col("share") >= REJECT).select("host", "template")
    blocked = cut(leaves.join(rejected, ["host", "template"], "left_semi").select("host", "path", "n", F.lit("block").alias("method")), small=True)
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    total = blocked.agg(F.count("*"), F.sum("n")).first()
    if total[0] <= MOST_SENT:
        marked = urls.join(F.broadcast(blocked.drop("n")), ["host", "path"], "left")
    else:
        # The urls with the most pages, 1/HOT of them at most, go by broadcast: so no task gets all pages of one.
        hot = urls.join(F.broadcast(blocked.where(F.col("n") >= total[1] * HOT).drop("n")), ["host", "path"], "left")
        others = hot.where("method IS NULL").drop("method").join(blocked.where(F.col("n") < total[1] * HOT).drop("n"), ["host", "path"], "left")
        marked = hot.where("method IS NOT NULL").unionByName(others)
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "method", F.lit("allow")).alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the labels of the documents with their ids: bad is junk or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels)


def _sql() -> str:
    """The same in SQL, level by level."""
    at = "instr(coalesce(url, ''), '://')"
    rest = f"CASE WHEN {at} > 0 THEN substr(url, {at} + 3) ELSE '' END"
    parts = [
        f"r AS (SELECT page_id, {rest} AS rest FROM pages)",
        "h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r)",
        f"u AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        "lb AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)",
        "p0 AS (SELECT host, path, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, '' AS template, false AS tail FROM u LEFT JOIN lb USING (page_id) GROUP BY host, path)",
    ]
    for d in range(SQL_DEPTH):
        s = f"seg[{d + 1}]"
        mixed = f"SEMI JOIN (SELECT host, template FROM p{d} WHERE len(seg) > {d} AND NOT tail GROUP BY ALL HAVING sum(bad) > 0 AND sum(bad) < sum(labelled)) USING (host, template)" if d >= DEPTH else ""
        parts += [
            f"q{d} AS (SELECT DISTINCT host, template, true AS goes_on FROM p{d} {mixed} WHERE len(seg) > {d} AND NOT tail)",
            f"f{d} AS MATERIALIZED (SELECT p.* EXCLUDE (tail), tail OR (len(seg) > {d} AND goes_on IS NULL) AS tail, len(seg) > {d} AND goes_on IS NOT NULL AND NOT tail AS more, CASE WHEN regexp_matches({s}, '^\\d+$') THEN '{{n}}' WHEN regexp_matches({s}, '^\\d+\\.\\w+$') THEN regexp_replace({s}, '^\\d+', '{{n}}') WHEN regexp_matches({s}, '^[0-9a-fA-F-]{{12,}}$') THEN '{{id}}' ELSE {s} END AS form FROM p{d} p LEFT JOIN q{d} USING (host, template))",
            f"c{d} AS (SELECT host, template, form, sum(labelled) AS l, sum(bad) AS b FROM f{d} WHERE more GROUP BY ALL)",
            f"n{d} AS (SELECT host, template, sum(l) AS al, sum(b) AS ab FROM c{d} GROUP BY ALL)",
            f"k{d} AS (SELECT host, template, form FROM (SELECT *, ab / CAST(greatest(al, 1) AS DOUBLE) AS share FROM c{d} JOIN n{d} USING (host, template)) WHERE l > 0 AND al - l > 0"
            f" AND abs(b / CAST(greatest(l, 1) AS DOUBLE) - (ab - b) / CAST(greatest(al - l, 1) AS DOUBLE)) > {DIFFERENT} * sqrt(share * (1 - share) * (1 / CAST(greatest(l, 1) AS DOUBLE) + 1 / CAST(greatest(al - l, 1) AS DOUBLE))))",
            f"p{d + 1} AS MATERIALIZED (SELECT host, path, n, labelled, bad, seg, tail, CASE WHEN more THEN f.template || '/' || CASE WHEN k.form IS NOT NULL THEN f.form ELSE '*' END ELSE f.template END AS template FROM f{d} f LEFT JOIN k{d} k USING (host, template, form))",
        ]
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"
    parts += [
        f"lf AS (SELECT host, path, labelled, bad, CASE WHEN tail OR len(seg) > {SQL_DEPTH} THEN template || '/**' ELSE template END AS template FROM p{SQL_DEPTH})",
        "ev AS (SELECT sum(bad) / CAST(greatest(sum(labelled), 1) AS DOUBLE) AS every FROM lf)",
        "ct AS (SELECT host, template, sum(labelled) AS l, sum(bad) AS b FROM lf GROUP BY ALL)",
        f"hs AS (SELECT host, (sum(b) + {PRIOR} * any_value(every)) / (sum(l) + {PRIOR}) AS hs FROM ct, ev GROUP BY host)",
        f"rj AS (SELECT host, template FROM ct JOIN hs USING (host) WHERE (b + {PRIOR} * hs) / (l + {PRIOR}) >= {REJECT})",
        "bl AS (SELECT host, path FROM lf SEMI JOIN rj USING (host, template))",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, u.host, u.path, {pick(lambda r: r[1] + r[2])} AS rule, coalesce({pick(lambda r: r[0])}, CASE WHEN bl.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM (SELECT * FROM u) u LEFT JOIN bl USING (host, path)".replace(
        "(host = ", "(u.host = "
    ).replace("ends_with(host,", "ends_with(u.host,").replace("starts_with(path,", "starts_with(u.path,")


OP8_SQL = _sql()

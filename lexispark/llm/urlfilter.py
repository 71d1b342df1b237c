"""URL filters: rules, and per-host trees of path templates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.common import ascii_lower, discard, stored

#: (action, host, path)
Rule = tuple[str, str, str]
#: Segments that are variable by their form - numbers, dates, hexadecimal and UUID names - with any extension kept.
VARIABLE = r"^(?:[0-9]+|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})(\.[A-Za-z]{1,5})?$"


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") > 0, ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, action) of the longest rule that fits, else null: its host is the
    url's or a parent of it, and its path begins the url's. Length is that of
    the host and the path; of equal lengths a block wins."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2].lstrip("/")), r[0] == "block")):
        h, p = h.lower(), "/" + p.lstrip("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def parse_rules(rules: Sequence[str]) -> list[Rule]:
    """"block com/en/" as (block, com, /en/)."""
    out = []
    for r in rules:
        action, _, where = r.partition(" ")
        host, _, path = where.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {r}")
        out.append((action, host, "/" + path))
    return out


def shape_of(path: Column) -> Column:
    """The segments of a path, those variable by form as ``*``."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, VARIABLE, 1))).otherwise(s))


EXTENSION = r"(\.[A-Za-z]{1,5})$"


#: One host or branch may hold a third of all rows; its rows are dealt over so many tasks.
SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``table`` that has their ``keys``, at most one.

    A stored table of small files is broadcast. Any other is sent once for each
    salt, and rows are dealt by the columns ``spread``, so that rows of a hot
    key are work for many tasks.
    """
    if hasattr(table, "_stored_at") and common.file_bytes(table) <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how).drop("salt")


def alike(child: DataFrame, purity: float, z: float) -> DataFrame:
    """(host, template, kind, s): the siblings that a test on their labels finds alike.

    ``child`` has a row for each child ``s`` of a branch and each kind of path
    below it (how many segments follow, and the extension), with its pages, its
    labels and whether a rule gave some. A rule names its segments, so its
    labels are no sample of their siblings and such a child is never alike
    another. Labelled children of a kind are alike if none differs from the
    others by ``z`` standard errors (those that do are left out) and the rest
    passes a chi-square test of equal shares. A child without labels joins only
    if so many labelled ones are alike that the lower Wilson bound for children
    of one label reaches ``purity``, and if at their rate of labels it is no
    surprise that it has none. How many children there are does not matter.
    """
    keys = ["host", "template", "kind"]
    free = child.filter(~F.col("ruled") & (F.col("s") != ""))
    some = free.filter("labelled > 0")
    all_ = some.groupBy(keys).agg(F.count(F.lit(1)).alias("m"), F.sum("labelled").alias("L"), F.sum("bad").alias("B")).filter("m > 1")
    some = lookup(some, all_, keys, ["s"])
    others, p = F.col("L") - F.col("labelled"), F.col("B") / F.col("L")
    apart = F.abs(F.col("bad") / F.col("labelled") - (F.col("B") - F.col("bad")) / others)
    some = some.filter(apart <= z * F.greatest(F.sqrt(p * (1 - p) * (1 / F.col("labelled") + 1 / others)), F.lit(1e-12))).drop("m", "L", "B")
    sums = some.groupBy(keys).agg(F.count(F.lit(1)).alias("m"), F.sum("labelled").alias("L"), F.sum("bad").alias("B"), F.sum(F.col("bad") * F.col("bad") / F.col("labelled")).alias("squares")).filter("m > 1")
    chi = F.when(p * (1 - p) > 0, (F.col("squares") - F.col("B") * p) / F.when(p * (1 - p) > 0, p * (1 - p))).otherwise(F.lit(0.0))
    sums = sums.filter(chi <= F.col("m") - 1 + z * F.sqrt(2 * (F.col("m") - 1))).select(*keys, "m")
    labelled = lookup(some, sums, keys, ["s"]).select(*keys, "s")
    enough = sums.filter(F.col("m") >= purity * z * z / (1 - purity)).drop("m")
    near = lookup(free, enough, keys, ["s"])
    rate = near.groupBy(keys).agg((F.sum(F.least("labelled", "n")) / F.greatest(F.sum("n"), F.lit(1))).alias("rate"))
    none = lookup(near.filter("labelled = 0"), rate, keys, ["s"]).filter(F.pow(1 - F.col("rate"), F.col("n")) >= 0.025)
    return labelled.unionByName(none.select(*keys, "s"))


def templates(shapes: DataFrame, purity: float, z: float, sampled: bool) -> DataFrame:
    """(host, shape, template): the template of each path shape of a host.

    ``shapes`` has host, shape (segments, those variable by form are ``*``), n
    pages, labelled, bad and ruled, one row for each shape of a host. Segments
    stay as they are unless ``alike`` finds siblings alike, level by level from
    the root; these become ``*`` and their subtrees of a kind one, or ``*word``
    beside a segment variable by form that is not alike. Without ``sampled``
    labels no siblings can be, and the levels need not be walked. A branch that
    holds fewer than two labelled shapes cannot merge further down; it leaves
    the walk with its segments as they are, so deep paths cost no rounds.
    """
    whole = F.concat(F.lit("/"), F.array_join("shape", "/"))
    if not sampled:
        return shapes.select("host", "shape", whole.alias("template"))
    keys = ["host", "template", "kind"]
    tree, level, done = shapes.withColumn("template", F.lit("")), 0, []
    while True:
        here = F.get(F.col("shape"), F.lit(level))
        inside = F.size("shape") > level
        branches = tree.filter(inside).groupBy("host", "template").agg((F.count(F.when(F.col("labelled") > 0, 1)) > 1).alias("open"))
        # One table for each level, so that no level is computed again for the next.
        split = stored(lookup(tree, branches, ["host", "template"], ["shape"], "left"), "tree")
        tree = split.filter(F.col("open") & inside).drop("open")
        done.append(split)
        if tree.isEmpty():
            break
        ext = F.regexp_extract(F.element_at("shape", -1), EXTENSION, 1)
        tree = tree.withColumn("s", here).withColumn("kind", F.concat((F.size("shape") - level).cast("string"), ext))
        # One row for each child of a branch and kind, however many shapes lie below it.
        child = stored(tree.groupBy(*keys, "s").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.max("ruled").alias("ruled")), "children")
        merged = stored(alike(child, purity, z).withColumn("merged", F.lit(True)), "merged")
        form = child.filter(F.col("s").rlike(r"^\*(\.[A-Za-z]{1,5})?$")).join(merged.select(*keys, "s"), [*keys, "s"], "left_anti").select(*keys).distinct()
        beside = form.join(merged.select(*keys).distinct(), keys, "left_semi").withColumn("beside", F.lit(True))
        star = F.concat(F.when(F.col("beside"), "*word").otherwise("*"), F.when(F.size("shape") == level + 1, ext).otherwise(""))
        step = F.concat("template", F.lit("/"), F.when(F.col("merged"), star).otherwise(F.col("s")))
        tree = lookup(lookup(tree, merged, [*keys, "s"], ["shape"], "left"), beside, keys, ["shape"], "left").withColumn("template", step).drop("s", "kind", "merged", "beside")
        level += 1
    closed = []
    for at, split in enumerate(done):
        rest = F.array_join(F.slice("shape", at + 1, F.greatest(F.size("shape") - at, F.lit(0))), "/")
        ended = F.size("shape") <= at
        closed.append(split.filter(ended | ~F.coalesce("open", F.lit(False))).select("host", "shape", F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), rest)).alias("template")))
    out = stored(reduce(DataFrame.unionByName, closed), "templates")
    discard(*done)
    return out


def judged(counts: DataFrame, purity: float, smoothing: float, z: float) -> DataFrame:
    """Verdicts for (host, template, labelled, bad, given, given_bad); the last two count given labels alone.

    Templates of a branch, in the order of their shares of bad labels, are
    merged with the one before as long as the shares do not differ by ``z``
    standard errors; merged templates pool their counts. A class is rejected if
    its smoothed share of bad labels, (bad + smoothing * prior) /
    (labelled + smoothing), reaches ``purity``. The prior is the host's share
    of given labels, itself smoothed by that of all hosts; labels that come
    from rules say nothing about other templates, so they do not enter it.
    Templates without labels are not like any other and stay allowed.

    Templates of one share are never apart, so a branch is walked by its shares,
    each with the labels of its first and last template, not by its templates.
    """
    c = counts.filter("labelled > 0").withColumn("branch", F.regexp_extract("template", r"(?s)^(.*)/[^/]*$", 1)).withColumn("share", F.col("bad") / F.col("labelled"))
    first, last = F.min_by(F.struct("bad", "labelled"), "template"), F.max_by("labelled", "template")
    shares = c.groupBy("host", "branch", "share").agg(first.alias("first"), last.alias("last"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    order = Window.partitionBy("host", "branch").orderBy("share")
    before, n0 = F.lag("share").over(order), F.lag("last").over(order)
    pooled = (F.col("first.bad") + before * n0) / (F.col("first.labelled") + n0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("first.labelled") + 1 / n0))
    shares = shares.withColumn("apart", F.coalesce((F.col("share") - before) > z * F.greatest(error, F.lit(1e-12)), F.lit(False)).cast("int"))
    shares = shares.withColumn("class", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "branch", "class")
    shares = shares.select("host", "branch", "share", F.sum("bad").over(group).alias("b"), F.sum("labelled").over(group).alias("l"))
    hosts = counts.groupBy("host").agg(F.sum("given").alias("hn"), F.sum("given_bad").alias("hb"))
    overall = counts.agg(F.coalesce(F.try_divide(F.sum("given_bad"), F.sum("given")), F.lit(0.5)).alias("overall"))  # one row
    shares = lookup(shares, hosts, ["host"], ["branch", "share"]).crossJoin(F.broadcast(overall))
    prior = (F.col("hb") + smoothing * F.col("overall")) / (F.col("hn") + smoothing)
    shares = shares.select("host", "branch", "share", "l", ((F.col("b") + smoothing * prior) / (F.col("l") + smoothing)).alias("purity"))
    return lookup(c, shares, ["host", "branch", "share"], ["template"]).select("host", "template", F.col("l").alias("labelled"), "purity", (F.col("purity") >= purity).alias("rejected"))


#: Words of a page are runs between blanks; a word is odd if it has no letter or two signs of this kind in a row.
ODD = r"^[^\p{L}]+$|[!*$%&#~^=+|\\@]{2,}"
TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def junk_labels(pages: DataFrame, url_col: str = "url", payload_col: str = "html", share: float = 0.2) -> DataFrame:
    """(url, bad): labels from the pages themselves, for want of others. A page
    is bad if ``share`` or more of the words of its visible text are odd, or if
    it has no word. Null payloads have none. One row for each page."""
    text = F.regexp_replace(F.coalesce(F.col(payload_col), F.lit("")), TAGS, " ")
    w = F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")
    odd = F.size(F.filter(w, lambda x: x.rlike(ODD)))
    return pages.select(F.col(url_col).alias("url"), (odd >= F.greatest(F.size(w) * share, F.lit(0.0))).cast("int").alias("bad"))


def url_filter(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", label_col: str = "bad", purity: float = 0.8, smoothing: float = 4.0, z: float = 1.96) -> DataFrame:
    """Judge every url by rules, and by its host's path templates where no rule fits.

    Labelled urls are those of ``labels`` (``url_col`` and a 0/1 column
    ``label_col``; a null label is none) that no rule fits and, as the rules say
    what is wanted, the urls that rules fit (block is bad). Trees are built from counts of path shapes, not from
    single urls, and a host's shapes are not gathered in one task. Segments are
    merged only as ``alike`` says, so labels of rules stay with the segments
    that the rules name.

    Returns page_id, host, path, rule, verdict, template, purity (null for a
    template without labels). A null url, or one without ``://``, has empty
    host and path and is allowed. Repeated and null ids get a row each; other
    columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u"))
    rows = rows.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rows = rows.withColumn("m", matched(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    known = rows.select("host", "shape", (F.col("m.action") == "block").cast("int").alias("bad"), F.lit(1).alias("page"), F.col("m").isNotNull().alias("ruled"), F.lit(None).cast("int").alias("given"))
    if labels is not None:
        given = labels.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(label_col).cast("int").alias("bad"))
        # A url that a rule fits has the rule's label and no other.
        given = given.filter(matched(F.col("host"), F.col("path"), rules).isNull())
        known = known.unionByName(given.select("host", shape_of(F.col("path")).alias("shape"), "bad", F.lit(0).alias("page"), F.lit(False).alias("ruled"), F.col("bad").alias("given")))
    # bad is null without a label, and count skips nulls.
    by_shape = known.groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.sum("page").alias("n"), F.max("ruled").alias("ruled"), F.count("given").alias("given"), F.coalesce(F.sum("given"), F.lit(0)).alias("given_bad"))
    by_shape = stored(by_shape, "shapes")
    tree = templates(by_shape, purity, z, labels is not None)
    counts = stored(by_shape.join(tree, ["host", "shape"]).groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("labelled", "bad", "given", "given_bad"))), "counts")
    judgements = judged(counts, purity, smoothing, z)
    verdicts = stored(lookup(tree, judgements, ["host", "template"], ["shape"], "left").select("host", "shape", "template", "purity", "rejected"), "verdicts")
    discard(by_shape, counts)
    out = lookup(rows, verdicts, ["host", "shape"], ["page_id", "path"], "left")
    verdict = F.when(F.col("m").isNotNull(), F.col("m.action")).when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")

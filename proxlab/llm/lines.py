"""Line deduplication by site-relative frequency (operator 6), with DataFrame functions only.

A page's lines are cut at line feeds and stripped of blanks, tabs and carriage returns at both ends;
empty lines carry no content and are never counted or dropped.  Per host, the share of a line is the
number of the host's pages that contain it, divided by the number of the host's pages.  A line is
boilerplate where its share exceeds ``ratio`` and at least ``min_pages`` pages of the host contain it.

Plan: one aggregation of (host, line hash) with partial counts, so a line on a third of all pages is
summed before it is shuffled; boilerplate lines are gathered per host (at most mean lines per page /
``ratio`` of them, since the shares of a host's lines sum to its mean lines per page) and meet the pages
in a join by host.  Their number is checked: up to ``BROADCAST_KEYS`` they are broadcast and the texts are
not shuffled; beyond that the join is by host, with skewed hosts split by adaptive execution.

Lines are compared by a pair of hashes (64 and 32 bits) within their host.  A null host is a host of its
own; a null text has no lines and stays null.  Repeated rows are pages of their own, unless ``once`` counts
pages of a host with the same lines as one (else many copies of one text would make its lines boilerplate
and empty every copy).  ``keep_first`` leaves each line on its first bearer, so that no group of near copies
loses its text altogether; bearers without a key come last.  Input columns are kept; ``n_lines``, ``n_dropped``
replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved

RATIO, MIN_PAGES = 0.05, 4
BROADCAST_KEYS = 200_000
BLANKS = " \t\r"


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int, once: bool = False, bearer: Column | None = None) -> DataFrame:
    """[site, drop: array of line keys] of the hosts that have boilerplate; with ``bearer`` also
    ``first``: array of (line key, digest of the lines of the page that bears the line first).
    """
    site = F.coalesce(F.struct(host.cast("string").alias("h")), F.struct(F.lit(None).cast("string").alias("h")))
    lines = page_keys(text)
    flat = pages.select(site.alias("site"), lines.alias("keys"), *([bearer.alias("id")] if bearer is not None else []))
    if once or bearer is not None:
        flat = flat.withColumn("page", page_digest(F.col("keys")))
    named = ["id", "page"] if bearer is not None else []
    first = [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "page")).alias("first")] if named else []
    if once:  # pages with the same lines are one: counted by the digest of their lines, which is what travels
        total = flat.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("all_pages"))
        flat = flat.select("site", F.explode("keys").alias("key"), "page", *named[:1])
        each = flat.groupBy("site", "key", "page").agg(F.min("id").alias("id")) if named else flat.distinct()
    else:
        total = flat.groupBy("site").agg(F.count("*").alias("all_pages"))
        each = flat.select("site", F.explode("keys").alias("key"), *named)
    seen = each.groupBy("site", "key").agg(F.count("*").alias("pages"), *first)
    found = (seen.where(F.col("pages") >= min_pages).join(total, "site")
             .where(F.col("pages") > F.col("all_pages") * F.lit(float(ratio))))
    own = [F.collect_list(F.struct("key.a", "key.b", "first.page")).alias("first")] if named else []
    return found.groupBy("site").agg(F.collect_list("key").alias("drop"), *own)


def page_keys(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.transform(lines_of(text), bare), lambda s: s != ""), line_key))


def page_digest(keys: Column) -> Column:
    """128 bits of a page's lines; pages without a line, or without a text, are one page."""
    return F.struct(F.xxhash64(keys).alias("p"), F.xxhash64(F.lit(1), keys).alias("q"))


def drop_boilerplate(pages: DataFrame, host_col: str | Column = "host", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: bool = True, once: bool = False, keep_first: str | None = None) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text_col``; with ``counts`` also n_lines, n_dropped.

    n_lines counts lines with content, n_dropped those that went.  With ``once`` pages of a host with the same
    lines count as one page.  With ``keep_first`` (a key column) a line stays on the page with the smallest key that
    bears it in its host, and on pages with the same lines as that one.
    """
    prepare(pages)
    host = pages[f"`{host_col}`"] if isinstance(host_col, str) else host_col
    text = pages[f"`{text_col}`"].cast("string")
    drops = saved(boilerplate(pages, host, text, ratio, min_pages, once, pages[f"`{keep_first}`"] if keep_first else None), "boilerplate")
    if (drops.agg(F.sum(F.size("drop") + 4)).first()[0] or 0) <= BROADCAST_KEYS:
        drops = F.broadcast(drops)
    names = ("n_lines", "n_dropped") if counts else ()
    kept = [f.name for f in pages.schema.fields if f.name.lower() not in names]
    row = F.struct(*[pages[f"`{n}`"].alias(f"c{i}") for i, n in enumerate(kept)])
    site = F.struct(host.cast("string").alias("h"))
    at = kept.index(text_col)
    t = F.col(f"row.c{at}").cast("string")
    joined = pages.select(row.alias("row"), site.alias("on_site")).join(drops, F.col("on_site") == F.col("site"), "left")
    has = F.col("drop").isNotNull()
    if keep_first:
        joined = joined.withColumn("page", F.when(has, page_digest(page_keys(t))))
        mine = lambda k: F.array_contains(F.col("first"), F.struct(k["a"].alias("a"), k["b"].alias("b"), F.col("page").alias("page")))
    else:
        mine = lambda k: F.lit(False)
    gone = lambda k: F.array_contains(F.col("drop"), k) & ~mine(k)
    left = F.when(has, F.filter(lines_of(t), lambda s: (bare(s) == "") | ~gone(line_key(bare(s)))))
    content = lambda x: F.size(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda s: bare(s) != "")).cast("long")
    out = joined.select("row", "drop", left.alias("left"))
    cols = [F.col(f"row.c{i}").alias(n) if i != at else F.when(F.col("drop").isNull() | F.col("left").isNull(), t)
            .otherwise(F.array_join("left", "\n")).alias(n) for i, n in enumerate(kept)]
    if counts:
        n = content(lines_of(t))
        cols += [n.alias("n_lines"), F.when(F.col("left").isNull(), F.lit(0).cast("long")).otherwise(n - content(F.col("left"))).alias("n_dropped")]
    return out.select(*cols)

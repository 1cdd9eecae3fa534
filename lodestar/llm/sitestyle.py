"""Main text of web pages by site style trees (operator 11).

The pages of a host are merged into one tree: a branch is a path of elements, with their classes, ids without numbers and, for
elements that have neither and hold others, their ordinals. Pages with equal html count once. The importance of a branch that m
pages of its host have:

* of its presentation: the entropy to base m of the sequences of child elements it has in them (0 if they are all alike, 1 if all differ);
* of its content: the mean over its distinct blocks of text of 1 - log(n) / log(m), n being the pages that have the block (0 if all
  pages have it, 1 if only one has);
* the larger of both; 1 where m is under MIN_PAGES, as too few pages tell nothing;
* at most 0 for parts of a page that its markup names (menus, sidebars, adverts, notices, forms, comments, footers, headers outside the
  article) and all below them; at most OUTSIDE for what stands outside the article on a page that names its article and has text in it;
  1 in articles named by their tag, so that an article that is on many pages stays whole.

A branch with importance under THRESHOLD whose branches are all under it is noise, and goes from every page that has it. Where
nothing would be left of a page, only what its markup names as no article goes.

Counts are aggregated before they are shuffled by host, and of each distinct block of a host one row is left. What the limits alone decide
on a page is decided where it is read; a branch is open there if neither it nor one below it is kept by them and they don't make it noise. Pages
get the keys of their open noise by a join, which Spark splits for a host with a third of all pages; a bitmap of fixed size keeps pages
without any from being shuffled. Nothing of a host is gathered in one place.

Defined cases: null html is empty and gives the empty text; a null url, or one without a host, belongs to the host of empty name;
markup that isn't closed is read as browsers do; line breaks by <br> are white space; repeated rows have equal results; other
columns are kept, whatever their names, but for text and n_chars, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.markup import Page, read_page
from lodestar.llm.shared import bitmap, discard, fresh, in_bitmap, mark_of_id, materialize, text_id_column

MIN_PAGES, THRESHOLD, OUTSIDE = 8, 0.5, 0.4

BRANCH = "struct<branch:bigint,above:array<bigint>,most:double,least:double,open:boolean,style:bigint,blocks:array<bigint>>"
BRANCHES = pa.list_(
    pa.struct([("branch", pa.int64()), ("above", pa.list_(pa.int64())), ("most", pa.float64()), ("least", pa.float64()), ("open", pa.bool_()), ("style", pa.int64()), ("blocks", pa.list_(pa.int64()))])
)


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def bounds(page: Page) -> list[tuple[float, float]]:
    """The most and the least importance of each branch of a page."""
    named, holders = page.names_article(), page.holders()
    most = lambda i, b: 0.0 if b.aside else OUTSIDE if named and not b.article and i not in holders else 1.0
    return [(most(i, b), 1.0 if b.article == 2 and not b.aside else 0.0) for i, b in enumerate(page.branches)]


def _branches(pages: pa.Array) -> pa.Array:
    out = []
    for cell in pages:
        page = read_page(cell.as_py() or "")
        keys, limits, rows = page.keys(), bounds(page), []
        kept = {x for i, (_, least) in enumerate(limits) if least == 1 for x in (i, *page.above(i))}
        for i, b in enumerate(page.branches):
            most, least = limits[i]
            blocks = list({_number(t) for t in b.texts})
            rows.append({"branch": keys[i], "above": [keys[x] for x in page.above(i)], "most": most, "least": least, "open": most == 1 and i not in kept, "style": _number(" ".join(b.children)), "blocks": blocks})
        out.append(rows)
    return pa.array(out, BRANCHES)


def _main_text(pages: pa.Array, noise: pa.Array) -> pa.Array:
    """noise: the open branches of each page that are noise."""
    out = []
    for cell, gone in zip(pages, noise, strict=True):
        page, low = read_page(cell.as_py() or ""), set(gone.as_py() or ())
        keys = page.keys()
        low.update(k for k, (most, _) in zip(keys, bounds(page), strict=True) if most < 1)
        left = [t for b, t in page.blocks if keys[b] not in low and not any(keys[x] in low for x in page.above(b))]
        if not left:
            left = [t for b, t in page.blocks if not page.branches[b].aside]
        out.append("\n\n".join(left))
    return pa.array(out, pa.string())


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, key, branches): the distinct pages of each host and their branches; a written table. key stands for the html."""
    html = F.coalesce("html", F.lit(""))
    branches = F.arrow_udf(_branches, f"array<{BRANCH}>")
    each = pages.select(host_of(F.col("url")).alias("host"), text_id_column(html).alias("key"), branches(html).alias("branches"))
    return materialize(each.groupBy("host", "key").agg(F.first("branches").alias("branches")), "trees")


def importance(trees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, branch, above, pages, presentation, content, importance) of every branch of every host."""
    seen = trees.select("host", F.explode("branches").alias("b")).select("host", "b.*")
    styles = seen.groupBy("host", "branch", "style").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.first("most").alias("most"), F.first("least").alias("least"))
    log = F.log(F.col("n").cast("double"))
    spread = styles.groupBy("host", "branch").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * log).alias("_nlogn"), F.first("above").alias("above"), F.max("most").alias("most"), F.min("least").alias("least"))
    texts = seen.select("host", "branch", F.explode("blocks").alias("block")).groupBy("host", "branch", "block").agg(F.count("*").alias("n"))
    content = texts.groupBy(F.col("host").alias("_host"), F.col("branch").alias("_branch")).agg(F.avg(log).alias("_log"))
    both = spread.join(content, (F.col("host") == F.col("_host")) & (F.col("branch") == F.col("_branch")), "left")
    pages, base = F.col("pages").cast("double"), F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    shown = F.when(F.col("pages") == 1, 1.0).otherwise((F.log(pages) - F.col("_nlogn") / pages) / base)
    said = F.when(F.col("_log").isNull(), 0.0).when(F.col("pages") == 1, 1.0).otherwise(1 - F.col("_log") / base)
    own = F.when(F.col("pages") < min_pages, 1.0).otherwise(F.greatest(shown, said))
    return both.select("host", "branch", "above", "pages", shown.alias("presentation"), said.alias("content"), F.greatest("least", F.least("most", own)).alias("importance"))


def noise(trees: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, branch): branches that are under the threshold with all that is below them; a written table."""
    branches = importance(trees, min_pages)
    each = branches.select("host", F.explode(F.concat("above", F.array("branch"))).alias("branch"), "importance")
    return materialize(each.groupBy("host", "branch").agg(F.max("importance").alias("most")).where(F.col("most") < threshold).select("host", "branch"), "noise")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """pages(url, html, ...) with text, the article of each page, and n_chars, its code points. The threshold is above OUTSIDE and at most 1."""
    if not OUTSIDE < threshold <= 1:
        raise ValueError(f"a threshold from {OUTSIDE} to 1")
    trees = style_trees(pages)
    low = noise(trees, min_pages, threshold)
    had = trees.select("host", "key", F.explode("branches").alias("b")).where("b.open").select("host", "key", "b.branch")
    of_page = materialize(had.join(low, ["host", "branch"]).groupBy("host", "key").agg(F.collect_set("branch").alias("low")), "low")
    discard(trees, low)
    bits = pages.sparkSession.sparkContext.broadcast(bitmap(of_page.select(mark_of_id("key").alias("mark")), "mark"))

    def has_some(marks: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, marks.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    host, key, gone, some = fresh(pages, "host", "key", "low", "some")
    html = F.coalesce("html", F.lit(""))
    marked = pages.withColumn(some, F.arrow_udf(has_some, "boolean")(F.xxhash64(html)))
    clean = marked.where(~F.col(some)).withColumn(gone, F.array().cast("array<bigint>"))
    keyed = marked.where(F.col(some)).withColumns({host: host_of(F.col("url")), key: text_id_column(html)})
    of_page = of_page.select(F.col("host").alias(f"{host}_"), F.col("key").alias(f"{key}_"), F.col("low").alias(gone))
    joined = keyed.join(of_page, (F.col(host) == F.col(f"{host}_")) & (F.col(key) == F.col(f"{key}_")), "left").drop(host, key, f"{host}_", f"{key}_")
    each = clean.unionByName(joined)
    done = each.withColumn("text", F.arrow_udf(_main_text, "string")(F.col("html"), F.col(gone))).withColumn("n_chars", F.length("text").cast("long"))
    return done.drop(gone, some)

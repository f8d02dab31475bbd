"""Main text of web pages by consensus paths.

The pages of a host share a template, though a single page may mislead.  Each page scores its containers and votes for
paths, generalised to tags and first classes without numbers; Spark adds the votes per host, and every page is extracted
again at its host's winning path.  A page without that path, or where it holds less than ``LEAST`` of the text that the
page's own best container holds, is extracted at its own best one.  All containers at the path count, in page order.

What is not the article is known by elements and by words in classes.  Some words are weak: a part of an article with such
a class, a notice or a section on related work, may belong to it.  Of those the host's pages vote as well: from ``KNOWN``
pages on such a path is dropped if its text is the same everywhere or mostly links, else kept.

Defined results: null or empty html gives an empty text; a page without markup is one block; broken markup is repaired as
browsers do; pages of any depth and size take time in proportion to their size; null urls, and those without a host, vote
as one host; repeated pages vote repeatedly; ties go to the path of smallest hash; an empty table gives an empty result;
extra columns are kept by :func:`extract`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import computed, fresh, pin, small
from weft.llm.components import SALTS
from weft.llm.dom import LINKED, blocks, outermost, parse, scores, suspects

#: Share of the page's own best text that the host's path must hold to be believed.
LEAST = 0.2
#: Containers that a page votes for.
VOTES = 3
#: Pages of a host from which on their votes on marked parts count.
KNOWN = 3


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, votes, pages, low, high, text, links): votes for each page's best containers, by their share of the
    page's best score; of its marked parts the pages, least and greatest hash of the text, and lengths."""
    names = ["host", "path", "votes", "pages", "low", "high", "text", "links"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: dict[tuple[str, int], float] = {}
            marked: dict[tuple[str, int], list[int]] = {}
            for host, text in zip(b["host"], b["html"], strict=True):
                root = parse(text or "")
                best = sorted(scores(root), key=lambda x: -x[1])[:VOTES]
                for node, score in best:
                    if best[0][1] > 0:
                        total[host, node.path] = total.get((host, node.path), 0.0) + score / best[0][1]
                for path, (h, n, m) in suspects(root).items():
                    x = marked.setdefault((host, path), [0, h, h, 0, 0])
                    x[:] = x[0] + 1, min(x[1], h), max(x[2], h), x[3] + n, x[4] + m
            rows = [(*k, v, 0, None, None, 0, 0) for k, v in total.items()] + [(*k, 0.0, *v) for k, v in marked.items()]
            yield pd.DataFrame(rows, columns=names).astype({"low": "Int64", "high": "Int64"})

    rows = pages.select(_host(url).alias("host"), F.col(html).alias("html"))
    made = rows.mapInPandas(run, "host string, path long, votes double, pages long, low long, high long, text long, links long")
    sums = [F.sum(c).alias(c) for c in ("votes", "pages", "text", "links")]
    return made.groupBy("host", "path").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))


def winners(voted: DataFrame) -> DataFrame:
    """(host, path, dropped, kept): the container with most votes, rounded so that the order of addition doesn't matter,
    and the marked paths of which enough pages say that they are not, or are, the article."""
    best = F.min(F.when(F.col("votes") > 0, F.struct((-F.round("votes", 6)).alias("least"), "path")))
    alike = (F.col("low") == F.col("high")) | (F.col("links") > LINKED * F.col("text"))
    known = F.col("pages") >= KNOWN
    lists = [F.collect_list(F.when(known & v, F.col("path"))).alias(n) for n, v in (("dropped", alike), ("kept", ~alike))]
    return voted.groupBy("host").agg(best.alias("x"), *lists).select("host", F.col("x.path").alias("path"), "dropped", "kept")


def main_text(html: str | None, path: int | None = None, dropped: list[int] | None = None, kept: list[int] | None = None) -> str:
    root = parse(html or "", set(dropped or ()), set(kept or ()))
    scored = scores(root)
    if not scored:
        return "\n".join(blocks(root))
    own = max(scored, key=lambda x: x[1])[0]
    text = "\n".join(blocks(own))
    same = outermost(root, {id(n) for n, _ in scored if n.path == path})
    shared = "\n".join(t for n in same for t in blocks(n))
    return shared if shared and len(shared) >= LEAST * len(text) else text


def extract(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text") -> DataFrame:
    """``pages`` with ``into`` in place of the html."""
    host, salt, voted, path, dropped, kept = (fresh(n, pages.columns) for n in ("_host", "_salt", "_voted", "_path", "_dropped", "_kept"))
    known = pin(winners(votes(pages, html, url)).toDF(voted, path, dropped, kept))
    paths, rows = small(known), pages.withColumn(host, _host(url))
    on = F.col(host) == F.col(voted)
    if paths is known:  # many hosts: pages go to them, those of a large host dealt over SALTS tasks
        paths = known.withColumn(f"{salt}s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows, on = rows.withColumn(salt, F.pmod(F.xxhash64(html, url), F.lit(SALTS))), on & (F.col(salt) == F.col(f"{salt}s"))
    rows = rows.join(paths, on, "left").drop(host, voted, salt, f"{salt}s")

    def run(htmls: list, *found: list) -> list[list[str]]:
        return [[main_text(*x) for x in zip(htmls, *found, strict=True)]]

    return computed(rows, [html, path, dropped, kept], [T.StructField(into, T.StringType())], [pa.string()], run, (html, path, dropped, kept))


def op6(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

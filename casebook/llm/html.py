"""Main text of web pages: markup first, then nearest-URL page differencing.

A page's text blocks are read in one pass.  Elements that are chrome by name,
role or class (menus, headers, footers, sidebars, notices, adverts, forms,
comments) are left out; a form, or an element that a word of its class or id calls
so, stays if it holds most of the page's text.  On a page with article markup the
blocks inside it are its text, unless they are under a quarter of what is left, as
teaser cards are.  On any other page the remaining lines are compared with the page of
nearest URL path on the same host: both pages' lines are aligned by longest
common subsequence, and lines they share are deleted.

Shared lines inside article markup stay.  Articles quote the same passages and
copy each other, so that differencing them would delete content, while menus
and adverts here differ from page to page and would survive it.

Pages are sorted by (host, path) over all tasks, so a host that holds a third of
all pages spreads over many, and each page is compared with its two neighbours
in this order, the one with the longer common path prefix first, the earlier on
ties.  A task judges the pages whose neighbours it holds and hands on its first
two and last two; these edges, one row per task, meet those of the tasks before
and after in a join.

Defined cases: null or empty html has empty text; a null url is a host of its
own and has no neighbour; equal urls are neighbours in the order of page_id;
a page that shares all its lines with its neighbour is a copy and keeps them; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from casebook.llm.common import stored
from casebook.llm.markup import INSIDE, read_page, shared_lines
from casebook.llm.urls import host_of, path_of

LEAST_INSIDE = 0.25  # share of a page's text from which article markup decides

READ = StructType([
    StructField("marked", BooleanType()), StructField("text", StringType()), StructField("lines", ArrayType(StringType())),
])
RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
RESULT_DDL = "page_id long, url string, text string"
PAGE = ("page_id", "url", "host", "path", "marked", "lines")
PAGE_TYPE = pa.struct(list(zip(PAGE, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())), strict=True)))
PAGE_DDL = "struct<page_id:bigint,url:string,host:string,path:string,marked:boolean,lines:array<string>>"
EDGES = ("first", "second", "inner", "last")  # of a task; second and inner are null if it holds one page
COMPARED = pa.schema([*RESULT, ("part", pa.int32()), *[(name, PAGE_TYPE) for name in EDGES]])
COMPARED_DDL = f"{RESULT_DDL}, part int, " + ", ".join(f"{name} {PAGE_DDL}" for name in EDGES)


@F.arrow_udf(READ)
def _read_udf(html: pa.Array) -> pa.Array:
    marked, texts, lines = [], [], []
    for source in html.to_pylist():
        page = read_page(source or "")
        inside = [text for kind, text in page.blocks if kind == INSIDE]
        decides = bool(inside) and sum(map(len, inside)) >= LEAST_INSIDE * sum(len(text) for _, text in page.blocks)
        marked.append(decides)
        texts.append(" ".join(inside))
        lines.append([text for kind, text in page.blocks if not decides or kind != INSIDE])
    return pa.StructArray.from_arrays(
        [pa.array(marked, pa.bool_()), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.string()))],
        names=["marked", "text", "lines"],
    )


class _Row:
    __slots__ = ("page_id", "url", "host", "path", "marked", "lines")

    def __init__(self, values: tuple):
        self.page_id, self.url, self.host, self.path, self.marked, self.lines = values


def _closeness(a: _Row, b: _Row | None) -> int:
    return len(commonprefix([a.path, b.path])) if b is not None and a.url is not None and a.host == b.host else -1


def _judged(row: _Row, before: _Row | None, after: _Row | None) -> tuple:
    """page_id, url and text of an unmarked page between its neighbours."""
    nearest = max((_closeness(row, before), before), (_closeness(row, after), after), key=lambda c: c[0])
    shared = shared_lines(row.lines, nearest[1].lines) if nearest[0] >= 0 else [False] * len(row.lines)
    kept = row.lines if all(shared) else [t for t, s in zip(row.lines, shared, strict=True) if not s]
    return row.page_id, row.url, " ".join(kept)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages in; the text of each unmarked page out whose neighbours are here, and at last the edges."""
    first: list[tuple] = []  # at most two
    last: list[tuple] = []  # at most three
    for batch in batches:
        out = []
        for values in zip(*(batch.column(n).to_pylist() for n in PAGE), strict=True):
            if len(first) < 2:
                first.append(values)
            last = [*last[-2:], values]
            if len(last) == 3 and not last[1][PAGE.index("marked")]:
                out.append(_judged(*(_Row(last[i]) for i in (1, 0, 2))))
        yield _result(out)
    if first:
        named = [dict(zip(PAGE, v, strict=True)) if v else None for v in (first[0], *first[1:], *[None] * (2 - len(first)), *[None] * (2 - len(last)), *last[-2:])]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], f.type) for f in RESULT][:3] + [pa.array([part], pa.int32())] + [pa.array([v], PAGE_TYPE) for v in named],
            schema=COMPARED)


def _judge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task in, with the last page before it and the first page after it; texts of its unmarked edge pages out."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            before, first, second, inner, last, after = (
                _Row(tuple(row[n][f] for f in PAGE)) if row[n] else None for n in ("before", *EDGES, "after"))
            if not first.marked:
                out.append(_judged(first, before, second or after))
            if inner is not None and not last.marked:
                out.append(_judged(last, inner, after))
        yield _result(out, RESULT)


def _result(rows: list[tuple], schema: pa.Schema | None = None) -> pa.RecordBatch:
    """Texts as a batch; columns of the schema that a text lacks are null."""
    schema = schema or COMPARED
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    columns += [(None,) * len(rows)] * (len(schema) - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def differences(lines: DataFrame) -> DataFrame:
    """page_id, url and text of the unmarked pages, each compared with its nearest neighbour in the order of all pages."""
    keys = ["host", "path", "page_id"]
    ordered = lines.select(*PAGE).repartitionByRange(*keys).sortWithinPartitions(*keys)
    compared = stored(ordered.mapInArrow(_differ, COMPARED_DDL), "html-compared")
    edges = compared.where("part IS NOT NULL").select("part", *EDGES)
    parts = sorted(r["part"] for r in edges.select("part").collect())  # one number per task
    next_of = lines.sparkSession.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int")
    before = next_of.join(edges.select("part", F.col("last").alias("before")), "part").select(F.col("next").alias("part"), "before")
    after = next_of.join(edges.select(F.col("part").alias("next"), F.col("first").alias("after")), "next").select("part", "after")
    met = edges.join(before, "part", "left").join(after, "part", "left").select("before", *EDGES, "after")
    texts = compared.where("part IS NULL").select("page_id", "url", "text")
    return texts.unionByName(met.mapInArrow(_judge_edges, RESULT_DDL))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    url = F.col("url")
    read = stored(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), "url", host_of(url).alias("host"), path_of(url).alias("path"),
            _read_udf.asNondeterministic()(F.col("html")).alias("r"),
        ).select("page_id", "url", "host", "path", "r.*"),
        "html-read",
    )
    others = differences(read)
    texts = read.where("marked").select("page_id", "url", "text").unionByName(others)
    return texts.withColumn("n_chars", F.length("text").cast("long"))

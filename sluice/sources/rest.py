"""Paged REST source (page-number or next-URL paging) as a Python data
source, plus the transports it and the REST sink use.

Page-number paging is fetched in parallel: a bounded range (``max_pages``)
is split over partitions, an open-ended one runs in growing rounds of parallel
ranges until a round meets an empty page.  Next-URL paging is sequential by
nature (each URL comes from the previous page) and runs as one partition.  Each row is one page: (page, url, body).  Records are
then drilled out of the bodies by ``payloads.drill``.

Transports are plain functions (method, url, body, headers).  The default
one speaks http(s) with the standard library; another can be given as a
function or as ``module:function``.
"""

from __future__ import annotations

import base64
import importlib
import itertools
import json
import urllib.parse
import urllib.request
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import materialize, scratch_path
from ..specs import ApiSource

PAGE_SCHEMA = "page long, url string, body string"


def default_transport(method: str, url: str, body: str | None = None, headers: dict | None = None):
    """The response text of a GET, else the HTTP status."""
    data = body.encode() if body is not None else None
    req = urllib.request.Request(url, data=data, method=method, headers=headers or {})
    with urllib.request.urlopen(req, timeout=30) as resp:  # noqa: S310 - user-supplied endpoint
        return resp.read().decode() if method == "GET" else resp.status


def _transport_option(transport) -> str:
    """A transport as a reader option: a name, or the function itself in text form."""
    if callable(transport):
        return "function " + base64.b64encode(cloudpickle.dumps(transport)).decode()
    return transport or ""


def _load_transport(option: str | None):
    if not option:
        return default_transport
    kind, _, text = option.partition(" ")
    if kind == "function":
        return cloudpickle.loads(base64.b64decode(text))
    module, _, name = option.partition(":")
    return getattr(importlib.import_module(module), name)


def page_url(base: str, params: dict) -> str:
    """URL of one page."""
    return f"{base}{'&' if '?' in base else '?'}{urllib.parse.urlencode(params)}" if params else base


def _drill(obj, key: str | None):
    if key:
        for part in key.split("."):
            obj = obj[part]
    return obj


class _PageRange(InputPartition):
    def __init__(self, first: int, last: int | None):
        super().__init__((first, last))
        self.first = first
        self.last = last  # inclusive; None = until an empty page


class RestPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.records_key = options.get("records_key") or None
        self.page_param = options.get("page_param", "page") or None
        self.page_size_param = options.get("page_size_param", "page_size") or None
        self.page_size = int(options.get("page_size", 100))
        self.start_page = int(options.get("start_page", 1))
        self.max_pages = int(options["max_pages"]) if options.get("max_pages") else None
        self.next_url_key = options.get("next_url_key") or None
        self.pages_per_partition = int(options.get("pages_per_partition", 8))
        self.headers = json.loads(options.get("headers") or "{}")
        self.transport = options.get("transport")

    def partitions(self):
        if self.next_url_key or not self.page_param or self.max_pages is None:
            return [_PageRange(self.start_page, None)]
        out = []
        first, end = self.start_page, self.start_page + self.max_pages - 1
        while first <= end:
            last = min(end, first + self.pages_per_partition - 1)
            out.append(_PageRange(first, last))
            first = last + 1
        return out

    def _target(self, page) -> str:
        """URL of a numbered page (None: the bare URL)."""
        if page is None or not self.page_param:
            return page_url(self.url, {})
        size = {self.page_size_param: self.page_size} if self.page_size_param else {}
        return page_url(self.url, {self.page_param: page, **size})

    def _get(self, url: str, first: bool) -> str | None:
        """Body of a page.  A 404 past the first page is the end of paging, like an empty page."""
        try:
            return self.fetch("GET", url, None, self.headers)
        except Exception as exc:
            if getattr(exc, "code", None) == 404 and not first:
                return None
            raise

    def _holds_records(self, body: str | None) -> bool:
        found = _drill(json.loads(body), self.records_key) if body is not None else None
        return isinstance(found, list) and len(found) > 0

    def _numbered(self, part):
        pages = range(part.first, part.last + 1) if part.last is not None else itertools.count(part.first)
        for page in pages if self.page_param else [None]:
            url = self._target(page)
            body = self._get(url, page in (None, self.start_page))
            if not self._holds_records(body):
                if part.last is not None:
                    yield page, url, None  # where paging ends; later ranges are cut off there
                return
            yield -1 if page is None else page, url, body

    def _followed(self, part):
        url, page = self._target(part.first), part.first
        while url:
            body = self._get(url, page >= 0)
            if not self._holds_records(body):
                return
            yield page, url, body
            url, page = json.loads(body).get(self.next_url_key), -1

    def read(self, partition):
        self.fetch = _load_transport(self.transport)
        return (self._followed if self.next_url_key else self._numbered)(partition)


class RestPagesSource(DataSource):
    @classmethod
    def name(cls):
        return "sluice_rest"

    def schema(self):
        return PAGE_SCHEMA

    def reader(self, schema):
        return RestPagesReader(self.options)


def source_options(source: ApiSource, transport, pages_per_partition: int) -> dict[str, str]:
    """The reader options that stand for a source."""
    return {
        "url": source.url,
        "records_key": source.records_key or "",
        "page_param": source.page_param or "",
        "page_size_param": source.page_size_param or "",
        "page_size": str(source.page_size),
        "start_page": str(source.start_page),
        "max_pages": str(source.max_pages or ""),
        "next_url_key": source.next_url_key or "",
        "pages_per_partition": str(pages_per_partition),
        "headers": json.dumps(source.headers or {}),
        "transport": _transport_option(transport),
    }


def _reader(spark: SparkSession, source: ApiSource, transport, pages_per_partition: int):
    spark.dataSource.register(RestPagesSource)
    reader = spark.read.format("sluice_rest")
    for k, v in source_options(source, transport, pages_per_partition).items():
        reader = reader.option(k, v)
    return reader.load()


#: A round of an open-ended source holds at most this many times the pages of the first one.
MOST_ROUND = 64


def next_round(first: int, done: int, max_pages: int | None = None) -> int:
    """Pages of the next round after ``done`` pages: as many as are there already, so that rounds stay few."""
    many = min(max(first, done), MOST_ROUND * first)
    return many if max_pages is None else min(many, max_pages - done)


def land_round(spark: SparkSession, source: ApiSource, transport, start: int, many: int, pages_per_partition: int,
               path: str) -> bool:
    """Writes the pages from ``start`` on; true if paging ends among them.

    A larger round has longer ranges, not more of them: each range past the
    end still asks for one page.
    """
    chunk = replace(source, start_page=start, max_pages=many)
    ranges = max(1, spark.sparkContext.defaultParallelism)
    _reader(spark, chunk, transport, max(pages_per_partition, -(-many // ranges))).write.mode("overwrite").parquet(path)
    return round_ends(spark, path)


def round_ends(spark: SparkSession, path: str) -> bool:
    return bool(spark.read.schema(PAGE_SCHEMA).parquet(path).filter(F.col("body").isNull()).limit(1).count())


def read_rounds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The pages of all rounds up to the first empty one, as one scan: a union's tasks report on every member."""
    return _cut_at_first_empty(spark.read.schema(PAGE_SCHEMA).parquet(*paths))


def _cut_at_first_empty(landed: DataFrame) -> DataFrame:
    first_empty = landed.filter(F.col("body").isNull()).agg(F.min("page")).scalar()
    return landed.filter(F.col("body").isNotNull() & (F.col("page") < F.coalesce(first_empty, F.lit(2**62))))


def read_pages(spark: SparkSession, source: ApiSource, transport=None, pages_per_partition: int = 8) -> DataFrame:
    """One row per fetched page: (page, url, body).

    * next-URL paging: one sequential partition (each URL comes from the
      previous page);
    * page numbers with ``max_pages``: the range is split over partitions
      and fetched in parallel;
    * page numbers without a bound: rounds of parallel ranges, each round
      landed in the checkpoint folder, until a round holds an empty page.
      The first round has ``pages_per_partition`` pages a range, each later
      one as many as all before it together, up to ``MOST_ROUND`` times.

    Pages after the first empty page are dropped, as sequential paging
    would never fetch them.  Landing the pages once means the API is not
    called again by later uses of the frame.
    """
    if source.next_url_key or not source.page_param:
        return materialize(_reader(spark, source, transport, pages_per_partition))
    if source.max_pages is not None:
        return _cut_at_first_empty(materialize(_reader(spark, source, transport, pages_per_partition)))
    first = pages_per_partition * max(1, spark.sparkContext.defaultParallelism)
    folder, rounds, done, ended = scratch_path(spark), [], 0, False
    while not ended:
        many = next_round(first, done)
        rounds.append(f"{folder}/from-{source.start_page + done}")
        ended = land_round(spark, source, transport, source.start_page + done, many, pages_per_partition, rounds[-1])
        done += many
    return read_rounds(spark, rounds)


def read_api(spark: SparkSession, source: ApiSource, transport=None, infer_types: bool = True):
    """Records of a paged REST API as rows (one per record)."""
    from .payloads import drill

    pages = read_pages(spark, source, transport)
    return drill(pages, "body", source.records_key, infer_types=infer_types)

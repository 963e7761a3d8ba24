"""Resumable reading of paged REST sources.

**Next-URL paging** is sequential: the cursor is the URL of the next page.  It
runs in growing rounds of one task each, which follows the cursor and writes
its pages as they come, so no page passes through the driver.  A round is a
folder of its own, complete when its success mark stands, and its last row
holds the cursor: a run that breaks off goes on from there and fetches no page
of a complete round again.

**Page-number paging** runs in growing rounds of parallel page ranges.  Each round is a
folder of its own, complete when its success mark stands; a later run fetches
only the rounds that have none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition

from ..sources.payloads import drill
from ..sources.rest import (
    PAGE_SCHEMA,
    RestPagesReader,
    _load_transport,
    land_round,
    next_round,
    read_rounds,
    round_ends,
    source_options,
)
from ..specs import ApiSource

#: A landed page of a linked source; ``next`` is null where paging ends.
CURSOR_SCHEMA = f"{PAGE_SCHEMA}, next string"


class CursorReader(RestPagesReader):
    """At most ``most`` pages from a URL on, each with the URL of the page after it."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.cursor, self.done, self.most = options["cursor"], int(options["done"]), int(options["most"])

    def partitions(self):
        return [InputPartition(self.done)]

    def read(self, partition):
        self.fetch = _load_transport(self.transport)
        held, url = None, self.cursor
        for page in range(self.done, self.done + self.most):
            body = self._get(url, page == 0)
            if not self._holds_records(body):
                if held:
                    yield *held[:3], None
                return
            if held:
                yield held
            after = json.loads(body).get(self.next_url_key)
            held, url = (page, url, body, after or None), after
            if not url:
                break
        if held:
            yield held


class CursorSource(DataSource):
    @classmethod
    def name(cls):
        return "sluice_rest_cursor"

    def schema(self):
        return CURSOR_SCHEMA

    def reader(self, schema):
        return CursorReader(self.options)


def _last_page(spark: SparkSession, path: str):
    """(page, next) of a round's last page, nulls if it has none."""
    return spark.read.schema(CURSOR_SCHEMA).parquet(path).agg(F.max("page").alias("page"), F.max_by("next", "page").alias("next")).first()


def _follow(spark: SparkSession, source: ApiSource, folder: str, transport, pages_per_batch: int) -> DataFrame:
    spark.dataSource.register(CursorSource)
    options = source_options(source, transport, 1)
    paths, done, cursor = [], 0, RestPagesReader(options)._target(source.start_page)
    while cursor:
        path = f"{folder}/pages/from={done}"
        last = _last_page(spark, path) if _is_complete(spark, path) else None
        if last is None or last["page"] is None:
            asked = {"cursor": cursor, "done": str(done), "most": str(next_round(pages_per_batch, done))}
            spark.read.format("sluice_rest_cursor").options(**options, **asked).load().write.mode("overwrite").parquet(path)
            last = _last_page(spark, path)
        if last["page"] is None:
            break  # the cursor leads to no page yet: a later run asks again
        paths.append(path)
        done, cursor = last["page"] + 1, last["next"]
    return spark.read.schema(PAGE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], PAGE_SCHEMA)


def _is_complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _rounds(spark: SparkSession, source: ApiSource, folder: str, transport, pages_per_partition: int) -> DataFrame:
    first = pages_per_partition * max(1, spark.sparkContext.defaultParallelism)
    paths, done, ended = [], 0, False
    while not ended and (source.max_pages is None or done < source.max_pages):
        start, many = source.start_page + done, next_round(first, done, source.max_pages)
        paths.append(f"{folder}/from-{start}-{many}")
        ended = (round_ends(spark, paths[-1]) if _is_complete(spark, paths[-1])
                 else land_round(spark, source, transport, start, many, pages_per_partition, paths[-1]))
        done += many
    return read_rounds(spark, paths) if paths else spark.createDataFrame([], PAGE_SCHEMA)


def resume_pages(spark: SparkSession, source: ApiSource, folder: str, transport=None, pages_per_batch: int = 16) -> DataFrame:
    """(page, url, body) of every page, landed in ``folder``; a run that broke off is taken up where it stood."""
    if source.next_url_key:
        return _follow(spark, source, folder, transport, pages_per_batch)
    if not source.page_param:
        raise ValueError("a source without paging has nothing to resume")
    return _rounds(spark, source, folder, transport, max(1, pages_per_batch // 2))


def resume_api(spark: SparkSession, source: ApiSource, folder: str, transport=None, infer_types: bool = True) -> DataFrame:
    """The records of the pages of :func:`resume_pages`."""
    return drill(resume_pages(spark, source, folder, transport), "body", source.records_key, infer_types=infer_types)

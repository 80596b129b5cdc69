"""The Atom feed of paper metadata: fetching as a Spark data source, and parsing to rows."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.text import ordered_categories, strip, strip_version

# Which answers are tried again, how often, and the longest wait in seconds.
RETRIED, ATTEMPTS, LONGEST_WAIT = {429, 503}, 5, 120.0
ENTRY = "struct<id:string,title:string,summary:string,published:string,updated:string,author:array<struct<name:string>>,primary_category:struct<_term:string>,category:array<struct<_term:string>>,doi:string,journal_ref:string>"
FEED = f"struct<totalResults:string,startIndex:string,itemsPerPage:string,entry:array<{ENTRY}>>"


def page_url(base: str, category: str, first: str, last: str, start: int = 0, size: int = 500) -> str:
    """A page of one category and range of days (ISO dates), by submission date."""
    days = f"[{first.replace('-', '')}0000 TO {last.replace('-', '')}2359]"
    query = {"search_query": f"cat:{category} AND submittedDate:{days}", "start": start, "max_results": size, "sortBy": "submittedDate", "sortOrder": "ascending"}
    return f"{base}?{urllib.parse.urlencode(query)}"


def wait_before(attempt: int, base: float, retry_after: str = "") -> float:
    """Seconds before another attempt: doubling, or what the server asks for up to a limit."""
    wait = base * 2 ** (attempt - 1)
    return max(wait, min(float(retry_after), LONGEST_WAIT)) if retry_after.isdigit() else wait


def fetch(url: str, gap: float, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes:
    """The body behind ``url``; throttling answers and transport errors are tried again, ``ATTEMPTS`` times in all."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with opener(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or attempt == ATTEMPTS:
                raise
            sleep(wait_before(attempt, gap, error.headers.get("Retry-After", "") if error.headers else ""))
        except (urllib.error.URLError, TimeoutError):
            if attempt == ATTEMPTS:
                raise
            sleep(wait_before(attempt, gap))
    raise AssertionError


class Window(InputPartition):
    def __init__(self, category: str, first: str, last: str):
        self.category, self.first, self.last = category, first, last


class FeedReader(DataSourceReader):
    """One partition per category and window. ``serial`` puts all in one, for a limit per address."""

    def __init__(self, options: dict):
        self.base, self.gap, self.size = options["url"], float(options.get("gap", "3.5")), int(options.get("pageSize", "500"))
        self.quota = int(options.get("quota", "1000000"))
        self.windows = [Window(c, *w.split(":")) for w in options["windows"].split(",") for c in options["categories"].split(",")]
        self.serial = options.get("serial", "true") == "true"
        if not self.serial and self.gap > 0:
            raise ValueError("tasks cannot keep a gap between each other's requests: serial=false needs gap=0, as for a mirror of one's own")

    def partitions(self):
        return [InputPartition(self.windows)] if self.serial else [InputPartition([w]) for w in self.windows]

    def read(self, partition):
        for k, w in enumerate(partition.value):
            start = 0
            while start < self.quota:
                size = min(self.size, self.quota - start)
                if k or start:
                    time.sleep(self.gap)
                body = fetch(page_url(self.base, w.category, w.first, w.last, start, size), self.gap).decode()
                yield w.category, w.first, w.last, start, body
                if body.count("<entry") < size:
                    break
                start += size


class FeedStreamReader(SimpleDataSourceStreamReader):
    """The same pages in the same order, one a micro-batch, fetched on the driver: the gap between requests and the quota of a
    window hold for the whole stream. An offset is a window's place and the entry to go on at, so a stopped stream
    goes on from its checkpoint, and a batch that was planned but not done is fetched again as it was."""

    def __init__(self, options: dict):
        self.feed, self.last = FeedReader(options), None

    def initialOffset(self) -> dict:
        return {"window": 0, "start": 0}

    def _page(self, offset: dict) -> tuple[list[tuple], dict]:
        feed = self.feed
        if offset["window"] >= len(feed.windows):
            return [], offset
        w, start = feed.windows[offset["window"]], offset["start"]
        size = min(feed.size, feed.quota - start)
        if self.last is not None:
            time.sleep(max(0.0, self.last + feed.gap - time.monotonic()))
        body = fetch(page_url(feed.base, w.category, w.first, w.last, start, size), feed.gap).decode()
        self.last = time.monotonic()
        more = body.count("<entry") == size and start + size < feed.quota
        after = {"window": offset["window"], "start": start + size} if more else {"window": offset["window"] + 1, "start": 0}
        return [(w.category, w.first, w.last, start, body)], after

    def read(self, start: dict):
        rows, after = self._page(start)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict):
        while start != end:
            rows, after = self._page(start)
            if not rows:
                return
            yield from rows
            # what the feed has got meanwhile belongs to later batches
            start = end if (after["window"], after["start"]) > (end["window"], end["start"]) else after


class FeedSource(DataSource):
    """``spark.dataSource.register(FeedSource)``, then ``spark.read.format("atom-feed")``, or ``spark.readStream``, with url,
    categories and windows ("2026-01-01:2026-01-07,...")."""

    @classmethod
    def name(cls) -> str:
        return "atom-feed"

    def schema(self) -> str:
        return "category string, win_start string, win_end string, offset int, body string"

    def reader(self, schema):
        return FeedReader(self.options)

    def simpleStreamReader(self, schema):
        return FeedStreamReader(self.options)


def parse(pages: DataFrame, body: str = "body") -> DataFrame:
    """A row per entry of the feeds in column ``body``; a feed that is not XML stops the job.

    Titles lose line feeds, blank authors and empty optional fields go, categories are distinct with the primary
    one first. Other columns of ``pages`` stay.
    """
    rest = [c for c in pages.columns if c != body]
    feed = F.from_xml(F.col(body), FEED, {"ignoreNamespace": "true", "mode": "FAILFAST"})
    e = F.col("e")
    none = lambda c: F.nullif(strip(c), F.lit(""))
    primary = e["primary_category"]["_term"]
    return pages.select(*rest, F.explode(feed["entry"]).alias("e")).select(
        *rest,
        strip_version(F.coalesce(e["id"], F.lit(""))).alias("arxiv_id"),
        strip(F.replace(F.coalesce(e["title"], F.lit("")), F.lit("\n"), F.lit(" "))).alias("title"),
        strip(F.coalesce(e["summary"], F.lit(""))).alias("abstract"),
        e["published"].alias("published"),
        e["updated"].alias("updated"),
        F.filter(F.transform(F.coalesce(e["author"], F.array().cast("array<struct<name:string>>")), lambda a: strip(a["name"])), lambda n: n != "").alias("authors"),
        primary.alias("primary_category"),
        ordered_categories(primary, F.transform(e["category"], lambda c: c["_term"])).alias("categories"),
        none(e["doi"]).alias("doi"),
        none(e["journal_ref"]).alias("journal_ref"),
    )


def feed_meta(pages: DataFrame, body: str = "body") -> DataFrame:
    feed = F.from_xml(F.col(body), FEED, {"ignoreNamespace": "true", "mode": "FAILFAST"})
    return pages.select(*[F.coalesce(feed[x].try_cast("int"), F.lit(0)).alias(y) for x, y in (("totalResults", "total_results"), ("startIndex", "start_index"), ("itemsPerPage", "items_per_page"))])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, one row each, ready for ``parse``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")

"""Pages fetched over the network or from files, with attempts and pauses; what fails is a row, not an exception.

`spark.read.format("cartulary_pages")` reads addresses with urllib (http, https) or pyarrow's file systems (file, hdfs, s3,
gs). Its partitions are lists of addresses, so the lists, not the pages, pass the driver. Pages in any other store that Spark
reaches come by `stored`, which reads files where they are.
"""

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Texts that together stand on a page which a site shows instead of the one asked for.
CHALLENGES = (("enable JavaScript", "Cloudflare"), ("Check for Humans",), ("Sorry, your access has",))
#: Attempts, seconds that one may take, seconds after one that failed.
ATTEMPTS, TIMEOUT, PAUSE = 2, 30.0, 0.8
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; cartulary)", "Accept-Language": "en"}


def page_status(code: Column, html: Column) -> Column:
    """missing (404), blocked (403, or a challenge's texts), failed (another error, or no text), ok."""
    shown = F.lit(False)
    for texts in CHALLENGES:
        one = F.lit(True)
        for text in texts:
            one = one & F.contains(html, F.lit(text))
        shown = shown | one
    failed = code.isNull() | (code >= 400) | html.isNull()
    return F.when(code == 404, "missing").when((code == 403) | F.coalesce(shown, F.lit(False)), "blocked").when(failed, "failed").otherwise("ok")


def challenged(html: str) -> bool:
    return any(all(t in html for t in texts) for texts in CHALLENGES)


def fetch(url: str, timeout: float) -> tuple[int, str | None]:
    """A page's code and text; files that aren't there have the code 404."""
    if url.startswith(("http://", "https://")):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as answer:
                return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as error:
            return error.code, None
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    if system.get_file_info(path).type != fs.FileType.File:
        return 404, None
    with system.open_input_stream(path) as stream:
        return 200, stream.read().decode("utf-8", "replace")


class Addresses(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.size = int(options.get("pages", 16))
        self.attempts, self.timeout, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT)), float(options.get("pause", PAUSE))

    def partitions(self):
        return [Addresses(self.urls[at : at + self.size]) for at in range(0, len(self.urls), self.size)] or [Addresses([])]

    def read(self, partition):
        for url in partition.urls:
            yield self.one(url)

    def one(self, url: str) -> tuple:
        """A page is asked for until it is there, or known to be missing, or the attempts are used up."""
        code, html, error, tries = None, None, None, 0
        while tries < self.attempts:
            tries += 1
            try:
                code, html = fetch(url, self.timeout)
                error = None if code < 400 else f"status {code}"
            except Exception as caught:  # a broken connection, a host that isn't there: data like any other failure
                code, html, error = None, None, f"{type(caught).__name__}: {caught}"
            if code == 404 or (error is None and not challenged(html)):
                break
            if tries < self.attempts:
                time.sleep(self.pause)
        return url, code, html, tries, error


class PageSource(DataSource):
    """Options: urls (a JSON list), pages (addresses a partition), attempts, timeout and pause (seconds)."""

    @classmethod
    def name(cls):
        return "cartulary_pages"

    def schema(self):
        return "url string, code int, html string, attempts int, error string"

    def reader(self, schema):
        return PageReader(self.options)


def fetched(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """(url, code, html, attempts, error, status) of every address; each is asked for where its partition runs, again if
    that is lost. Write the result before using it twice: pages are fetched each time it is read."""
    spark.dataSource.register(PageSource)
    rows = spark.read.format("cartulary_pages").options(urls=json.dumps(urls), **options).load()
    return rows.withColumn("status", page_status(F.col("code"), F.col("html")))


def stored(spark: SparkSession, urls: DataFrame, folder: str, pattern: str = "*") -> DataFrame:
    """(url, code, html) of urls (url, file), file a path below folder, in any store that Spark reaches. Files that aren't
    there have the code 404 and no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    below = F.expr("substring(path, instr(path, '" + root.replace("'", "''") + f"') + {len(root)})")
    held = files.select(below.alias("file"), F.decode("content", "utf-8").alias("html"))
    return urls.join(held, "file", "left").select("url", F.when(F.col("html").isNull(), 404).otherwise(200).alias("code"), "html")

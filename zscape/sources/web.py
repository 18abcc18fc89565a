"""Documents from a web service: a data source, and a collector that resumes where it was stopped.

Both fetch in tasks, never in the driver. All tasks together keep ``delay`` seconds between the starts of
requests: each of ``n`` partitions waits ``n * delay``, so the pace holds however few of them run at once.
A request is tried ``tries`` times with pauses of 2, 4, 8, ... ``unit`` seconds. A 404 is an answer
(no document), not a failure; what is no JSON is a failure, as a broken connection is. A failed request
is a row with its ``error``, so one name never stops the others.
"""

from __future__ import annotations

import gzip
import http.client
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.expr import cik_padded
from ..shared import ensured, scratch, written

# The service, its documents by name, and the error of a name without one.
SERVICE = "https://data.sec.gov"
DOCUMENTS = {"companyfacts": "/api/xbrl/companyfacts/CIK{cik}.json", "submissions": "/submissions/CIK{cik}.json"}
ABSENT = "no_companyfacts_404"
#: Most characters of an error that are kept.
ERROR_CHARS = 300


@dataclass
class Client:
    """``get`` of one partition among ``n``: paced, tried again, and never raising for what a server does."""

    n: int = 1
    delay: float = 0.12
    tries: int = 3
    unit: float = 1.0
    agent: str = "zscape"
    timeout: float = 30.0
    _next: float = 0.0

    def _once(self, url: str) -> str:
        time.sleep(max(0.0, self._next - time.monotonic()))
        self._next = time.monotonic() + self.n * self.delay
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept-Encoding": "gzip"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            body = answer.read()
            body = gzip.decompress(body) if answer.headers.get("Content-Encoding") == "gzip" else body
        text = body.decode("utf-8")
        json.loads(text)
        return text

    def get(self, url: str) -> tuple[int | None, str | None, str | None]:
        """``status, body, error``: 200 with a body, 404 with neither, or an error and the last status, if any."""
        status = error = None
        for attempt in range(1, self.tries + 1):
            try:
                return 200, self._once(url), None
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return 404, None, None
                status, error = e.code, e
            except (OSError, http.client.HTTPException, EOFError, ValueError) as e:  # network, cut or broken body, no JSON, no URL
                status, error = None, e
            if attempt < self.tries:
                time.sleep(self.unit * 2**attempt)
        return status, None, f"{type(error).__name__}: {error}"[:ERROR_CHARS]


@dataclass
class _Share(InputPartition):
    """One row group of the table of requests."""

    path: str
    group: int
    n: int


class WebDocuments(DataSource):
    """``file, url, status, body, error`` for each row of the Parquet table ``requests`` (``file, url``).

    Options are ``requests`` and those of ``Client``: ``delay, tries, unit, agent, timeout``. A partition
    reads one row group of the table, so its writer decides how many requests go on at once.
    """

    @classmethod
    def name(cls) -> str:
        return "web_documents"

    def schema(self) -> str:
        return "file string, url string, status int, body string, error string"

    def reader(self, schema) -> _WebReader:
        return _WebReader(dict(self.options))


class _WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        kinds = {"delay": float, "tries": int, "unit": float, "agent": str, "timeout": float}
        self.requests = options["requests"]
        self.client = {k: kind(options[k]) for k, kind in kinds.items() if k in options}

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.requests)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        groups = [(f, g) for f in files for g in range(pq.read_metadata(f, filesystem=fs).num_row_groups)]
        return [_Share(f, g, len(groups)) for f, g in groups] or [_Share("", 0, 1)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.requests)
        client = Client(partition.n, **self.client)
        with fs.open_input_file(partition.path) as f:
            asked = pq.ParquetFile(f).read_row_group(partition.group, columns=["file", "url"]).to_pylist()
        for r in asked:
            yield (r["file"], r["url"], *client.get(r["url"]))


def documents(requests: DataFrame, parallel: int = 8, **client: object) -> DataFrame:
    """``file, url, status, body, error`` of ``requests(file, url)``, fetched when read, by ``parallel`` tasks at most.

    Rows without a URL are left out, and equal rows are asked once. A plan that reads the result twice
    fetches twice: write it first, or use ``collected``.
    """
    spark = requests.sparkSession
    spark.dataSource.register(WebDocuments)
    path = ensured(spark, scratch(spark, "requests"))
    requests.where("url IS NOT NULL").select("file", "url").distinct().repartition(parallel).write.mode("overwrite").parquet(path)
    return spark.read.format("web_documents").options(requests=path, **client).load()


def filing_requests(universe: DataFrame, what: str = "companyfacts", base: str = SERVICE) -> DataFrame:
    """``ticker, cik, file, url`` of the universe's documents; a row without a CIK has none to ask for."""
    before, after = DOCUMENTS[what].split("{cik}")
    rows = universe.where("trim(cik) != ''").select("ticker", cik_padded(F.col("cik")).alias("cik"))
    return rows.select("ticker", "cik", F.concat(F.lit("CIK"), "cik", F.lit(".json")).alias("file"), F.concat(F.lit(base + before), "cik", F.lit(after)).alias("url"))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of the documents below ``path`` that parse as JSON; a cut or empty one has not landed."""
    raw = spark.read.schema("value string").text(ensured(spark, path), wholetext=True, pathGlobFilter="CIK*.json")
    return raw.select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").isNotNull().alias("whole")).where("whole").select("file")


def collected(requests: DataFrame, path: str, failures: str, parallel: int = 8, force: bool = False, **client: object) -> dict[str, int]:
    """Lands each of ``requests(ticker, cik, file, url)`` as ``path/file``; the numbers of what became of them.

    What has landed and parses is skipped (unless ``force``), and names that share a document ask once. A task
    puts each document in place as soon as it has come, by renaming a whole file, so a run stopped at any moment
    keeps all that came before, and a task that is run again asks only for what its predecessor did not land
    (with ``force`` it asks for its whole share again).
    ``failures`` (``ticker, cik, error``; a CSV folder) is written anew by every run that ends, also without rows.
    """
    spark = requests.sparkSession
    root = ensured(spark, path)
    asked = written(requests.where("url IS NOT NULL").select("ticker", "cik", "file", "url"), "asked")
    each = asked.groupBy("file").agg(F.min("url").alias("url"))
    todo = each if force else each.join(landed(spark, path), "file", "left_anti")

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        one = Client(parallel, **client)
        for b in batches:
            for file, url in zip(b.column("file").to_pylist(), b.column("url").to_pylist()):
                mine = f"{folder}/{file}"
                if not force and _parses(fs, mine):  # by an attempt of this task before
                    status, error = 200, None
                else:
                    status, body, error = one.get(url)
                    if body is not None:
                        part = f"{folder}/_{uuid.uuid4().hex}.tmp"
                        with fs.open_output_stream(part) as out:
                            out.write(body.encode("utf-8"))
                        fs.move(part, mine)
                yield pa.RecordBatch.from_pydict({"file": [file], "status": pa.array([status], pa.int32()), "error": pa.array([error], pa.string())})

    outcome = written(todo.repartition(parallel).mapInArrow(land, "file string, status int, error string"), "outcome")
    bad = outcome.where("status = 404 OR error IS NOT NULL").select("file", F.coalesce("error", F.lit(ABSENT)).alias("error"))
    asked.join(bad, "file").select("ticker", "cik", "error").orderBy("ticker", "cik").write.option("header", True).mode("overwrite").csv(failures)
    n = outcome.agg(F.count("*").alias("asked"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & (F.col("status") == 404)).alias("absent")).first()
    total = each.count()
    return {"total": total, "fetched": n["asked"] - n["failed"] - n["absent"], "skipped": total - n["asked"], "absent": n["absent"], "failed": n["failed"]}


def _parses(fs: pafs.FileSystem, file: str) -> bool:
    if fs.get_file_info(file).type != pafs.FileType.File:
        return False
    try:
        with fs.open_input_stream(file) as f:
            json.loads(f.read())
        return True
    except ValueError:
        return False


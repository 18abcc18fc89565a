"""The web source and the collector, against a server in a thread of this process."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from zscape import jobs
from zscape.sources import readers, web

FAST = {"delay": 0.0, "unit": 0.005, "timeout": 5.0}


class Service:
    """Answers by the last digits of the path; counts requests, and bodies served, by path."""

    def __init__(self):
        self.asked, self.served, self.lock = Counter(), Counter(), threading.Lock()
        self.at = None  # called with the number of bodies served, before each further one; True drops the connection
        self.absent, self.flaky, self.broken, self.garbled = set(), {}, set(), set()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                service.answer(self)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, h):
        n = int(h.path.rsplit("CIK", 1)[1].split(".")[0])
        with self.lock:
            self.asked[n] += 1
            tries, drop = self.asked[n], self.at is not None and self.at(sum(self.served.values()))
        if drop:
            h.close_connection = True
            return
        code = 404 if n in self.absent else 500 if n in self.broken or tries <= self.flaky.get(n, 0) else 200
        body = (b'{"cut": ' if n in self.garbled else json.dumps({"cik": n, "name": "é", "facts": {}}).encode()) if code == 200 else b""
        h.send_response(code)
        h.send_header("Content-Length", str(len(body)))
        h.end_headers()
        if code == 200:
            with self.lock:
                self.served[n] += 1
        h.wfile.write(body)


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def universe(spark, ciks):
    return spark.createDataFrame([(f"T{i}", c) for i, c in enumerate(ciks)], "ticker string, cik string")


def test_source_reads_in_partitions_and_gives_a_row_for_each_request(spark, service):
    service.absent, service.flaky, service.broken, service.garbled = {3}, {4: 2}, {5}, {6}
    requests = web.filing_requests(universe(spark, [*map(str, range(1, 8)), None, " ", "7"]), base=service.base)
    assert requests.count() == 8
    got = web.documents(requests, parallel=3, **FAST)
    assert 1 < got.rdd.getNumPartitions() <= 3
    rows = {r.file: r for r in got.collect()}
    assert len(rows) == 7
    of = lambda n: rows[f"CIK{n:010d}.json"]
    assert json.loads(of(1).body) == {"cik": 1, "name": "é", "facts": {}} and of(1).status == 200
    assert (of(3).status, of(3).body, of(3).error) == (404, None, None) and service.asked[3] == 1
    assert of(4).status == 200 and service.asked[4] == 3
    assert of(5).status == 500 and of(5).body is None and "HTTPError" in of(5).error and service.asked[5] == 3
    assert of(6).body is None and "JSONDecodeError" in of(6).error and service.asked[6] == 3
    assert service.asked[7] == 1  # two names, one document


def test_source_without_requests(spark, service):
    requests = web.filing_requests(universe(spark, [None]), base=service.base)
    assert web.documents(requests, **FAST).collect() == [] and not service.asked


def test_pace_is_that_of_all_partitions():
    waits = []
    client = web.Client(n=4, delay=0.01, tries=3, unit=0.0)
    clock, slept = [100.0], []
    real = web.time
    web.time = type("clock", (), {"monotonic": staticmethod(lambda: clock[0]), "sleep": staticmethod(lambda s: (slept.append(s), clock.__setitem__(0, clock[0] + s)))})
    try:
        waits = [client.get("no url") for _ in range(2)]
    finally:
        web.time = real
    assert all(status is None and error for status, _, error in waits)
    assert [round(s, 6) for s in slept if s > 0] == [0.04] * 5  # six tries, each 4 * 0.01 after the one before


def test_collector_skips_what_has_landed_and_always_leaves_failures(spark, service, tmp_path):
    service.absent, service.broken = {3}, {5}
    names = universe(spark, ["1", "2", "3", "3", "4", "5"])
    at, failures = str(tmp_path / "landing"), str(tmp_path / "failures")
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "CIK0000000001.json").write_text('{"facts": {}}')
    (tmp_path / "landing" / "CIK0000000002.json").write_text('{"facts": ')  # a cut file has not landed
    (tmp_path / "landing" / "CIK0000000004.json").write_text("")
    run = lambda **o: jobs.filings_collected(names, at, failures, base=service.base, **FAST, **o)
    assert run() == {"total": 5, "fetched": 2, "skipped": 1, "absent": 1, "failed": 1}
    assert service.asked[1] == 0
    bad = lambda: {(r.ticker, r.cik, r.error.split(":")[0]) for r in spark.read.option("header", True).schema("ticker string, cik string, error string").csv(failures).collect()}
    assert bad() == {("T2", "0000000003", web.ABSENT), ("T3", "0000000003", web.ABSENT), ("T5", "0000000005", "HTTPError")}
    docs = readers.read_filings(spark, at)
    assert {r.cik for r in docs.where("doc IS NOT NULL").collect()} == {"1", "2", "4"}
    service.absent, service.broken = set(), set()
    assert run() == {"total": 5, "fetched": 2, "skipped": 3, "absent": 0, "failed": 0}
    assert bad() == set()
    assert run(force=True)["fetched"] == 5 and service.served[1] == 1


def test_only_an_outage_is_refused(spark, service, tmp_path):
    service.broken = {1, 2}
    args = (universe(spark, ["1", "2"]), str(tmp_path / "landing"), str(tmp_path / "failures"))
    with pytest.raises(jobs.Refused):
        jobs.filings_collected(*args, base=service.base, **FAST)
    none = jobs.filings_collected(universe(spark, [None]), *args[1:], base=service.base, **FAST)
    assert none == {"total": 0, "fetched": 0, "skipped": 0, "absent": 0, "failed": 0}


def test_a_run_killed_half_way_resumes_without_fetching_twice(spark, service, tmp_path):
    names = universe(spark, [str(n) for n in range(1, 21)])
    at, failures = str(tmp_path / "landing"), str(tmp_path / "failures")
    stopped = threading.Event()

    def kill(served):
        if served >= 9 and not stopped.is_set():
            stopped.set()
            spark.sparkContext.cancelAllJobs()
        return stopped.is_set()

    service.at = kill
    with pytest.raises(Exception, match="cancel"):
        jobs.filings_collected(names, at, failures, base=service.base, parallel=1, **FAST)
    before = None
    while before != (before := service.asked.total()):  # the killed task's worker may take a moment to go
        time.sleep(1)
    kept = {p.name for p in (tmp_path / "landing").glob("CIK*.json")}
    assert len(kept) == 9
    service.at = None
    done = jobs.filings_collected(names, at, failures, base=service.base, parallel=1, **FAST)
    assert (done["fetched"], done["skipped"]) == (11, 9)
    assert set(service.served.values()) == {1} and len(service.served) == 20

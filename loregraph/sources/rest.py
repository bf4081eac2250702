"""Issues from a REST service as a Spark data source: one issue, a search by pages, and a stream by time of update.

How an answer is fetched is an argument of ``register``: any function of an address and headers that gives the bytes of the
answer. It is shipped to the tasks. What fails for a while is tried again, later each time.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SCHEMA = "key string, summary string, description string, status string, issue_type string, assignee string, labels array<string>, created_at string, updated_at string"
# Paths of the service, and the fields that are asked for.
ISSUE, SEARCH, FIELDS = "/rest/api/3/issue/", "/rest/api/3/search", "summary,description,status,issuetype,assignee,labels,created,updated"
#: Answers of these kinds, and lost connections, may succeed later.
PASSING = (408, 425, 429, 500, 502, 503, 504)

Transport = Callable[[str, dict[str, str]], bytes]


def http_get(url: str, headers: dict[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as answer:
        return answer.read()


def issue_row(issue: dict) -> tuple:
    f = issue.get("fields") or {}

    def name(x) -> str | None:
        return (x or {}).get("displayName") or (x or {}).get("name")

    return (
        issue.get("key"), f.get("summary") or "(no summary)", f.get("description"), name(f.get("status")) or "Unknown", name(f.get("issuetype")) or "Unknown",
        name(f.get("assignee")), list(f.get("labels") or []), f.get("created"), f.get("updated"),
    )


def moment(text: str) -> datetime:
    """The time of an update as the service writes it; without a zone it is UTC."""
    t = datetime.fromisoformat(text)
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


class Client:
    """Options: url, user, token, attempts (5), backoff (seconds before the second attempt, doubled each time; 1)."""

    def __init__(self, options: dict, transport: Transport = http_get):
        self.base, self.transport = options["url"].rstrip("/"), transport
        self.attempts, self.backoff = int(options.get("attempts", 5)), float(options.get("backoff", 1))
        self.headers = {"Accept": "application/json"}
        if options.get("user"):
            self.headers["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options.get('token', '')}".encode()).decode()

    def get(self, path: str, **parameters) -> dict:
        url = f"{self.base}{path}" + (f"?{urllib.parse.urlencode(parameters)}" if parameters else "")
        for attempt in range(1, self.attempts + 1):
            try:
                return json.loads(self.transport(url, dict(self.headers)))
            except urllib.error.HTTPError as e:
                if e.code not in PASSING or attempt == self.attempts:
                    raise
            except (OSError, json.JSONDecodeError):
                if attempt == self.attempts:
                    raise
            time.sleep(self.backoff * 2 ** (attempt - 1))
        raise ValueError("attempts has to be 1 or more")

    def issue(self, key: str) -> dict:
        return self.get(ISSUE + urllib.parse.quote(key, safe=""), fields=FIELDS)

    def search(self, jql: str, start: int, size: int) -> dict:
        return self.get(SEARCH, jql=jql, startAt=start, maxResults=size, fields=FIELDS)


class Page(InputPartition):
    def __init__(self, start: int, size: int, jql: str):
        self.start, self.size, self.jql = start, size, jql


class Span(InputPartition):
    """Updates after one time and not after another."""

    def __init__(self, after: datetime, upto: datetime):
        self.after, self.upto = after, upto


class Single(InputPartition):
    def __init__(self, key: str):
        self.key = key


class IssueReader(DataSourceReader):
    """The issue that option ``key`` or a filter on key names, or up to ``maxresults`` issues of ``jql``, a partition for each ``pagesize`` of them."""

    def __init__(self, options: dict, transport: Transport = http_get):
        self.options, self.client, self.key = options, Client(options, transport), options.get("key")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.key in (None, f.value) and not self.options.get("jql"):
                self.key = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.key:
            return [Single(self.key)]
        size, most = int(self.options.get("pagesize", 50)), int(self.options.get("maxresults", 50))
        return [Page(s, min(size, most - s), self.options.get("jql", "")) for s in range(0, most, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Single):
            yield issue_row(self.client.issue(partition.key))
        else:
            yield from map(issue_row, self.client.search(partition.jql, partition.start, partition.size).get("issues", []))


def _minute(t: datetime) -> datetime:
    return t.replace(second=0, microsecond=0)


class IssueStreamReader(DataSourceStreamReader):
    """Issues by the time of their last update; an offset is the time of the last update that was read.

    A batch holds the issues whose last update is after the one offset and not after the other, as far as they have
    not been updated again meanwhile: then they come with a later batch. The span is dealt to up to ``maxpartitions`` (8) tasks.
    The service compares times by the minute, and a page shifts when one of its issues is updated while it is read. So a task goes on
    from the minute of the last issue that it has seen, not from a number of issues, and leaves out what it has seen or what lies outside its span.
    """

    def __init__(self, options: dict, transport: Transport = http_get):
        self.options, self.client = options, Client(options, transport)
        self.size, self.most = int(options.get("pagesize", 50)), int(options.get("maxpartitions", 8))

    def _jql(self, *conditions: str) -> str:
        own = self.options.get("jql", "")
        return " AND ".join([*([f"({own})"] if own else []), *conditions])

    def _updated(self, since: datetime, upto: datetime) -> str:
        last = upto + timedelta(minutes=1)
        return self._jql(f'updated >= "{since:%Y/%m/%d %H:%M}"', f'updated < "{last:%Y/%m/%d %H:%M}"') + " ORDER BY updated ASC, key ASC"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"updated": self.options.get("since", "1970-01-01T00:00:00.000+0000")}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.client.search((self._jql() + " ORDER BY updated DESC").strip(), 0, 1).get("issues", [])
        return {"updated": found[0]["fields"]["updated"]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = moment(start["updated"]), moment(end["updated"])
        if upto <= after:
            return []
        found = self.client.search(self._updated(after, upto), 0, 1)
        total = int(found.get("total", 0))
        if total == 0:
            return []
        first = max(after, moment(found["issues"][0]["fields"]["updated"]) - timedelta(microseconds=1))
        n = max(1, min(self.most, -(-total // self.size), int((upto - first) / timedelta(minutes=1))))
        ends = [first + (upto - first) * k / n for k in range(n)] + [upto]
        return [Span(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, partition: Span) -> Iterator[tuple]:
        since, start, seen = _minute(partition.after), 0, set()
        while True:
            found = self.client.search(self._updated(since, partition.upto), start, self.size).get("issues", [])
            for issue in found:
                if issue["key"] not in seen and partition.after < moment(issue["fields"]["updated"]) <= partition.upto:
                    seen.add(issue["key"])
                    yield issue_row(issue)
            if len(found) < self.size:
                return
            last = _minute(moment(found[-1]["fields"]["updated"]))
            since, start = (last, 0) if last > since else (since, start + max(1, self.size * 3 // 4))

    def commit(self, end: dict) -> None:
        pass


class IssueSource(DataSource):
    """Options: url, user, token, attempts, backoff; key; jql, pagesize, maxresults; since, maxpartitions."""

    transport: Transport = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "issues"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IssueReader:
        return IssueReader(dict(self.options), type(self).transport)

    def streamReader(self, schema) -> IssueStreamReader:  # noqa: N802
        return IssueStreamReader(dict(self.options), type(self).transport)


def register(spark: SparkSession, transport: Transport | None = None) -> None:
    """Make the source known to a session, with a transport of its own where one is given; filters on key are pushed into it."""
    source = IssueSource if transport is None else type("IssueSource", (IssueSource,), {"transport": staticmethod(transport)})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)

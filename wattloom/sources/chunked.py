"""A Python data source for services that answer one time range per request.

``spark.read.format("chunked_json").option("template", url).option("start", ...).option("end", ...)`` plans one input
partition per range, so requests run on the executors. The template has {start} and {end}. A service that wants a token
gets a fixed one (``token``), or one that a worker fetches with its client id and secret from ``token_url``, keeps until
shortly before it expires, and fetches anew if the service turns it down.

A request that fails is tried again with growing pauses. A range that fails for good is a row with its status and no value, so
nothing is missing silently. ``readStream`` serves the ranges that have ended since its last offset.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def date_ranges(start: datetime, end: datetime, days: float) -> Iterator[tuple[datetime, datetime]]:
    """Half-open steps of ``days`` days; the last one ends at ``end``."""
    step = timedelta(days=days)
    while start < end:
        yield start, min(start + step, end)
        start += step


class _Chunk(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


#: Tokens that this worker has: (token, when it is to be renewed) by (address, client).
_TOKENS: dict[tuple[str, str], tuple[str, float]] = {}


class _Requests:
    """Requests with a token and retries. Options: template, timeout, tries, pause, token or token_url with client_id and client_secret."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def _token(self, renew: bool = False) -> str | None:
        o = self.options
        if "token_url" not in o:
            return o.get("token")
        key = (o["token_url"], o.get("client_id", ""))
        if renew or key not in _TOKENS or _TOKENS[key][1] <= time.time():
            name = base64.b64encode(f"{o.get('client_id', '')}:{o.get('client_secret', '')}".encode()).decode()
            body = urllib.parse.urlencode({"grant_type": "client_credentials"}).encode()
            request = urllib.request.Request(o["token_url"], data=body, headers={"Authorization": f"Basic {name}"})
            with urllib.request.urlopen(request, timeout=float(o.get("timeout", 60))) as answer:
                found = json.loads(answer.read())
            _TOKENS[key] = found["access_token"], time.time() + 0.9 * float(found.get("expires_in", 300))
        return _TOKENS[key][0]

    def get(self, start: str, end: str) -> tuple[str, str, str | None, int | None, str | None]:
        o, renew = self.options, False
        url = o["template"].format(start=urllib.parse.quote(start), end=urllib.parse.quote(end))
        tries, status, error = int(o.get("tries", 3)), None, None
        for n in range(tries):
            try:
                token = self._token(renew)
                request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", 60))) as answer:
                    return start, end, answer.read().decode(), answer.status, None
            except urllib.error.HTTPError as e:
                status, error, renew = e.code, str(e), e.code == 401
                if e.code < 500 and e.code not in (401, 408, 429):
                    break  # asking again would not help
            except (urllib.error.URLError, TimeoutError, ConnectionError, KeyError, ValueError) as e:
                status, error = None, str(e) or type(e).__name__
            if n < tries - 1 and not renew:
                time.sleep(float(o.get("pause", 1)) * 2**n)
        return start, end, None, status, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.requests = options, _Requests(options)

    def partitions(self):
        start, end = (datetime.fromisoformat(self.options[k]) for k in ("start", "end"))
        return [_Chunk(a.isoformat(), b.isoformat()) for a, b in date_ranges(start, end, float(self.options.get("days", 150)))]

    def read(self, partition):
        yield self.requests.get(partition.start, partition.end)


class _StreamReader(DataSourceStreamReader):
    """The offset is the time up to which ranges have been asked for; only ranges that have ended are new."""

    def __init__(self, options: dict):
        self.options, self.requests = options, _Requests(options)

    def initialOffset(self):
        return {"until": self.options["start"]}

    def latestOffset(self):
        start, step = datetime.fromisoformat(self.options["start"]), timedelta(days=float(self.options.get("days", 1)))
        end = datetime.fromisoformat(self.options["end"]) if "end" in self.options else datetime.now()
        return {"until": (start + max(0, (end - start) // step) * step).isoformat()}

    def partitions(self, start, end):
        ranges = date_ranges(datetime.fromisoformat(start["until"]), datetime.fromisoformat(end["until"]), float(self.options.get("days", 1)))
        return [_Chunk(a.isoformat(), b.isoformat()) for a, b in ranges]

    def read(self, partition):
        yield self.requests.get(partition.start, partition.end)


class ChunkedJson(DataSource):
    """Rows (chunk_start, chunk_end, value, status, error): the text of each answer, or what went wrong."""

    @classmethod
    def name(cls) -> str:
        return "chunked_json"

    def schema(self) -> str:
        return "chunk_start string, chunk_end string, value string, status int, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

"""REST sources as a Spark data source: pages of JSON records, one task a URL."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tributary.sources.readers import fields_of

_DEFAULTS = {"pagination": {"strategy": "none"}, "auth": {"scheme": "none"}, "max_pages": 1000, "max_records": None, "retries": 3, "timeout_secs": 30, "record_path": None}


class RestFault(RuntimeError):
    pass


def _origin(url: str) -> tuple:
    x = urllib.parse.urlsplit(url)
    return x.scheme, x.hostname, x.port or {"http": 80, "https": 443}.get(x.scheme)


class _SameOrigin(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if _origin(newurl) != _origin(req.full_url):
            raise RestFault(f"redirect to another origin: {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def pointer(doc, path: str):
    """A value by JSON pointer, or null."""
    for part in path.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(doc, list):
            doc = doc[int(part)] if part.isdigit() and int(part) < len(doc) else None
        else:
            doc = doc.get(part) if isinstance(doc, dict) else None
    return doc


def next_link(headers: list[str]) -> str | None:
    """The target of rel=next in Link headers; two different ones are an error."""
    found = set()
    for h in headers:
        for target, params in re.findall(r'<([^>]*)>((?:\s*;\s*[^\s=;,]+\s*(?:=\s*(?:"[^"]*"|[^",;]*))?)*)', h):
            rel = re.search(r';\s*rel\s*=\s*(?:"([^"]*)"|([^\s";,]+))', params, re.I)
            if rel and "next" in (rel[1] or rel[2] or "").lower().split():
                found.add(target)
    if len(found) > 1:
        raise RestFault(f"conflicting next links: {sorted(found)}")
    return found.pop() if found else None


def fetch(url: str, auth: dict, retries: int, timeout: float):
    """(document, Link headers, final URL). Server errors and broken connections are tried again, other errors are not."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"})
    if auth["scheme"] == "bearer":
        request.add_header("Authorization", f"Bearer {auth['token']}")
    elif auth["scheme"] == "header":
        request.add_header(auth["name"], auth["value"])
    opener = urllib.request.build_opener(_SameOrigin())
    for k in range(retries + 1):
        try:
            with opener.open(request, timeout=timeout) as reply:
                return json.loads(reply.read()), reply.headers.get_all("Link") or [], reply.geturl()
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == retries:
                raise RestFault(f"{url}: status {e.code}") from e
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if k == retries:
                raise RestFault(f"{url}: {e}") from e
        time.sleep(min(0.1 * 2**k, 5))


def _with(url: str, **params) -> str:
    x = urllib.parse.urlsplit(url)
    kept = [(k, v) for k, v in urllib.parse.parse_qsl(x.query, keep_blank_values=True) if k not in params]
    return urllib.parse.urlunsplit(x._replace(query=urllib.parse.urlencode([*kept, *params.items()])))


def records(url: str, o: dict) -> Iterator[dict]:
    """All records, page after page, at most max_records of them. More than max_pages pages, or one that comes again, is an error."""
    paging, given = o["pagination"], 0
    way, offset = paging["strategy"], 0
    at: str | None = url
    if way == "offset":
        names = paging.get("offset_param", "offset"), paging.get("limit_param", "limit")
        at = _with(url, **{names[0]: 0, names[1]: paging["limit"]})
    seen = set()
    while at:
        if at in seen:
            raise RestFault(f"{at} continues to itself")
        if len(seen) == o["max_pages"]:
            raise RestFault(f"page_limit_reached: more than {o['max_pages']} pages of {url}")
        seen.add(at)
        doc, links, final = fetch(at, o["auth"], o["retries"], o["timeout_secs"])
        rows = pointer(doc, o["record_path"]) if o["record_path"] else doc
        rows = rows if isinstance(rows, list) else [] if rows is None else [rows]
        for r in rows:
            if o["max_records"] is not None and given == o["max_records"]:
                return
            given += 1
            yield r
        at = None
        if way == "offset" and len(rows) >= paging["limit"]:
            offset += len(rows)
            at = _with(url, **{names[0]: offset, names[1]: paging["limit"]})
        elif way == "cursor_token" and (token := pointer(doc, paging["next_token_pointer"])) is not None:
            at = _with(url, **{paging["cursor_param"]: token})
        elif way == "link_header" and (link := next_link(links)):
            at = urllib.parse.urljoin(final, link)
            if _origin(at) != _origin(url):
                raise RestFault(f"next link to another origin: {at}")


class RestReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self):
        return [InputPartition(u) for u in json.loads(self.options["urls"])]

    def read(self, partition):
        o = _DEFAULTS | json.loads(self.options["request"])
        for r in records(partition.value, o):
            cells = [partition.value if n == "_file" else r.get(n) for n in self.names]
            yield tuple(x if x is None or isinstance(x, str) else json.dumps(x) for x in cells)


class RestSource(DataSource):
    @classmethod
    def name(cls):
        return "rest"

    def reader(self, schema):
        return RestReader(schema, self.options)


def read_rest(spark: SparkSession, urls: list[str], schema: list, **request) -> DataFrame:
    """Cells as text, as other sources give them, with _file the URL. request: pagination, auth, max_pages, max_records (a URL), retries, timeout_secs, record_path (a JSON pointer)."""
    unknown = set(request) - set(_DEFAULTS)
    if unknown:
        raise ValueError(f"no options {sorted(unknown)}")
    spark.dataSource.register(RestSource)
    names = [f.source_name or f.name for f in fields_of(schema)]
    text = ", ".join(f"`{n}` string" for n in [*names, "_file"])
    return spark.read.format("rest").schema(text).option("urls", json.dumps(urls)).option("request", json.dumps(request)).load()

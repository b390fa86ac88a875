"""Paged HTTP sources as a Python data source: one partition per page."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

RETRIED = (429, 500, 502, 503, 504)
#: Fixed limits of the two interfaces: largest page, largest snapshot, and their parameter names.
INTERFACES = {"openfda": (1_000, 25_000, "limit", "skip"), "socrata": (50_000, 250_000, "$limit", "$offset")}


@dataclass
class Page(InputPartition):
    offset: int
    limit: int


def delay(attempt: int, header: str | None, base: float, now: dt.datetime | None = None) -> float:
    """Seconds to wait after a failed attempt: what the server asks for (seconds or a date), else doubling."""
    asked = float("nan")
    try:
        asked = float(header or "nan")
    except ValueError:
        with contextlib.suppress(TypeError, ValueError):
            at = parsedate_to_datetime(header)
            asked = ((at if at.tzinfo else at.replace(tzinfo=dt.UTC)) - (now or dt.datetime.now(dt.UTC))).total_seconds()
    return max(0.0, asked) if math.isfinite(asked) else base * 2 ** (attempt - 1)


def condition(f: Filter) -> str | None:
    """A filter on a text column as a condition of the interface's query language, if it has one."""
    sign = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
    if sign is None or len(f.attribute) != 1 or not isinstance(f.value, str) or f.attribute[0] in ("page", "index", "payload"):
        return None
    return f"{f.attribute[0]} {sign} '{f.value.replace(chr(39), chr(39) * 2)}'"


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.most_page, self.most, self.limit_name, self.offset_name = INTERFACES[options.get("interface", "openfda")]
        self.size, self.total = int(options["pageSize"]), int(options["maxRecords"])
        if not (1 <= self.size <= self.most_page and 1 <= self.total <= self.most):
            raise ValueError("page size or record count out of bounds")
        self.conditions: list[str] = []

    def partitions(self) -> list[Page]:
        """One page a task; with option ``offsets``, only the pages that start there."""
        every = range(0, self.total, self.size)
        wanted = {int(x) for x in self.options["offsets"].split(",")} if "offsets" in self.options else every
        return [Page(at, min(self.size, self.total - at)) for at in every if at in wanted]

    def fetch(self, url: str) -> object:
        attempts, base = int(self.options.get("attempts", 4)), float(self.options.get("backoff", 1.0))
        for attempt in range(1, attempts + 1):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 30))) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as error:
                if error.code not in RETRIED or attempt == attempts:
                    raise
                time.sleep(delay(attempt, error.headers.get("Retry-After"), base))
            except (urllib.error.URLError, TimeoutError):
                if attempt == attempts:
                    raise
                time.sleep(delay(attempt, None, base))
        raise AssertionError

    def read(self, partition: Page):
        query = {self.limit_name: partition.limit, self.offset_name: partition.offset}
        query |= {k[6:]: v for k, v in self.options.items() if k.startswith("param.")}
        if self.conditions:
            query["$where"] = " AND ".join([*(f"({w})" for w in [query.get("$where")] if w), *self.conditions])
        reply = self.fetch(f"{self.options['url']}?{urllib.parse.urlencode(query)}")
        rows = reply if isinstance(reply, list) else reply.get("results")
        if not isinstance(rows, list):
            raise ValueError("the reply holds no list of records")
        columns = self.options.get("columns")
        for i, row in enumerate(rows):
            own = [None if row.get(c.strip()) is None else str(row[c.strip()]) for c in columns.split(",")] if columns else []
            yield f"page-{partition.offset}", i, json.dumps(row, ensure_ascii=False), *own


class FilteringPageReader(PageReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of selected columns become the interface's own condition; the others are left to Spark.

        Only the second interface has conditions.
        """
        for f in filters:
            said = condition(f) if self.options.get("interface") == "socrata" and "columns" in self.options else None
            if said is None:
                yield f
            else:
                self.conditions.append(said)


class PagedRecords(DataSource):
    """spark.read.format("paged_records").options(url=, interface=, pageSize=, maxRecords=).load()

    Option ``columns`` (names with commas) adds fields of the records as text columns; ``pushdown``
    (true) hands conditions on them to the interface.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return ", ".join(["page string, index long, payload string", *(f"{c.strip()} string" for c in self.options.get("columns", "").split(",") if c.strip())])

    def reader(self, schema) -> PageReader:
        return (FilteringPageReader if self.options.get("pushdown") == "true" else PageReader)(self.options)

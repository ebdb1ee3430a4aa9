"""A search server as a Spark data source, over its bulk, search and alias calls.

Writing fills an index of its own in bulk requests; each task reports how many rows it sent. Only when all tasks have ended
and the index holds as many rows does the driver point the alias at it; a missing id, a refused row or a lost count drops the
index, and readers have seen nothing of it. Reading cuts the ids into ranges; each task pages through its range by the last id it
has seen. Filters on fields that the server can compare go with every request.

    spark.dataSource.register(SearchServer)
    df.write.format("search_server").option("url", ...).option("alias", ...).option("id_field", "chunk_id").mode("append").save()
    spark.read.format("search_server").schema(...).option("url", ...).option("alias", ...).option("id_field", "chunk_id").load()
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Rows of a page, rows and bytes of a bulk request, ranges of ids that are read at once, seconds to wait for an answer.
PAGE_ROWS, BULK_ROWS, BULK_BYTES, RANGES, WAIT = 1000, 500, 4 << 20, 8, 60
_RANGES = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


class WriteRefused(RuntimeError):
    """A row without an id, a row that the server refused, or rows that are not there at the end."""


def call(url: str, method: str, path: str, body: Any = None, lines: bool = False) -> dict:
    """One request; ``lines``: the body is text of one JSON document a line."""
    data = None if body is None else (body if lines else json.dumps(body)).encode()
    head = {"Content-Type": "application/x-ndjson" if lines else "application/json"}
    with urllib.request.urlopen(urllib.request.Request(f"{url}/{path}", data, head, method=method), timeout=WAIT) as answer:  # noqa: S310
        return json.loads(answer.read() or b"{}")


@dataclass
class Target:
    """Where the options point."""

    url: str
    alias: str
    id_field: str
    ranges: int
    page: int

    @classmethod
    def of(cls, options: dict) -> Target:
        return cls(options["url"].rstrip("/"), options["alias"], options["id_field"], int(options.get("ranges", RANGES)), int(options.get("page", PAGE_ROWS)))


@dataclass
class IdRange(InputPartition):
    """Ids from ``low`` (or the first) up to, but without, ``high`` (or to the last)."""

    low: Any
    high: Any


class IndexReader(DataSourceReader):
    def __init__(self, target: Target, schema: StructType):
        self.target, self.fields, self.clauses = target, [f.name for f in schema.fields], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of one top-level field go to the server; the others stay with Spark."""
        for f in filters:
            if len(f.attribute) != 1 if hasattr(f, "attribute") else True:
                yield f
                continue
            field = f.attribute[0]
            if isinstance(f, EqualTo) and f.value is not None:
                self.clauses.append({"term": {field: f.value}})
            elif isinstance(f, In):
                self.clauses.append({"terms": {field: [v for v in f.value if v is not None]}})
            elif isinstance(f, IsNotNull):
                self.clauses.append({"exists": {"field": field}})
            elif type(f) in _RANGES and f.value is not None:
                self.clauses.append({"range": {field: {_RANGES[type(f)]: f.value}}})
            else:
                yield f

    def _search(self, clauses: list, size: int, **more: Any) -> list[dict]:
        body = {"size": size, "query": {"bool": {"filter": self.clauses + clauses}}, "sort": [{self.target.id_field: "asc"}], **more}
        return call(self.target.url, "POST", f"{self.target.alias}/_search", body)["hits"]["hits"]

    def partitions(self) -> list[IdRange]:
        """Ranges of ids of about one size, between the places that the server names at equal shares."""
        t = self.target
        shares = [100 * k / t.ranges for k in range(1, t.ranges)]
        found = call(t.url, "POST", f"{t.alias}/_search", {"size": 0, "query": {"bool": {"filter": self.clauses}}, "aggs": {"cuts": {"percentiles": {"field": t.id_field, "percents": shares, "hdr": None}}}}) if shares else {}
        cuts = sorted({v for v in found.get("aggregations", {}).get("cuts", {}).get("values", {}).values() if v is not None})
        return [IdRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, part: IdRange) -> Iterator[tuple]:
        t, limits = self.target, {}
        if part.low is not None:
            limits["gte"] = part.low
        if part.high is not None:
            limits["lt"] = part.high
        inside = [{"range": {t.id_field: limits}}] if limits else []
        after: dict = {}
        while hits := self._search(inside, t.page, **after):
            for hit in hits:
                yield tuple(hit["_source"].get(f) for f in self.fields)
            if len(hits) < t.page:
                return
            after = {"search_after": hits[-1]["sort"]}


@dataclass
class Sent(WriterCommitMessage):
    rows: int


class IndexWriter(DataSourceWriter):
    """Fills an index named after the alias and a mark of this write."""

    def __init__(self, target: Target):
        self.target, self.index = target, f"{target.alias}-{uuid.uuid4().hex[:12]}"
        call(target.url, "PUT", self.index, {})

    def write(self, rows: Iterator[Row]) -> Sent:
        sent, held, size = 0, [], 0
        for row in rows:
            doc = row.asDict(recursive=True)
            key = doc.get(self.target.id_field)
            if key is None:
                raise WriteRefused(f"a row has no {self.target.id_field}")
            text = json.dumps({"index": {"_index": self.index, "_id": str(key)}}) + "\n" + json.dumps(doc, default=str) + "\n"
            held.append(text)
            size += len(text)
            if len(held) >= BULK_ROWS or size >= BULK_BYTES:
                self._bulk(held)
                sent, held, size = sent + len(held), [], 0
        if held:
            self._bulk(held)
        return Sent(sent + len(held))

    def _bulk(self, lines: list[str]) -> None:
        answer = call(self.target.url, "POST", "_bulk", "".join(lines), lines=True)
        if answer.get("errors", True):
            first = next((i["index"].get("error") for i in answer.get("items", []) if i.get("index", {}).get("error")), "no items")
            raise WriteRefused(f"the server refused a row: {first}")

    def commit(self, messages: list[Sent | None]) -> None:
        """A row that a repeated task sent twice is one row by its id, so the index is counted, not the requests."""
        t, sent = self.target, sum(m.rows for m in messages if m)
        try:
            call(t.url, "POST", f"{self.index}/_refresh")
            there = call(t.url, "GET", f"{self.index}/_count")["count"]
            if there != sent:
                raise WriteRefused(f"{sent} rows were sent and {there} are there: ids repeat or rows are lost")
            try:
                before = list(call(t.url, "GET", f"_alias/{t.alias}"))
            except urllib.error.HTTPError as missing:
                if missing.code != 404:
                    raise
                before = []
            # one call, so readers find the old index or the new one
            call(t.url, "POST", "_aliases", {"actions": [*({"remove": {"index": i, "alias": t.alias}} for i in before), {"add": {"index": self.index, "alias": t.alias}}]})
        except Exception:
            self.abort(messages)
            raise

    def abort(self, messages: list[Sent | None]) -> None:
        call(self.target.url, "DELETE", self.index)


class SearchServer(DataSource):
    """Options: url, alias, id_field; for reading also ranges (how many tasks) and page (rows a request). Ids are numbers; a schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "search_server"

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(Target.of(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> IndexWriter:
        return IndexWriter(Target.of(self.options))

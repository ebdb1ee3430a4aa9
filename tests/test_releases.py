"""Releases with fencing, rules on stored rows, and a search server as source and sink."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lorespan.operators import validation as V
from lorespan.sources import releases as R
from lorespan.sources.search_server import SearchServer
from lorespan.sources.tables import write_generation


def checks(spark, ready=True, closed=True):
    return spark.createDataFrame([(ready,)], "ready boolean"), spark.createDataFrame([(closed, "" if closed else "STALE_PROJECTION")], "closed boolean, blockers string")


def statuses(spark, log):
    return {r.generation: r.status for r in R.generations(spark, log).collect()}


def test_publish_and_roll_back(spark, tmp_path):
    log, index = str(tmp_path / "log"), str(tmp_path / "index")
    for g, v in ((1, "old"), (2, "new")):
        write_generation(spark.createDataFrame([(v,)], "v string"), index, g)
        R.transition(spark, log, g, "BUILDING")
    with pytest.raises(R.Refused, match=R.NOT_RELEASABLE):
        R.release(spark, log, "PUBLISH", 1, "p1", "ann", "first", *checks(spark))
    for g in (1, 2):
        R.transition(spark, log, g, "READY")
    with pytest.raises(R.Refused, match=R.NOT_CAUGHT_UP):
        R.release(spark, log, "PUBLISH", 1, "p1", "ann", "first", *checks(spark, ready=False))
    with pytest.raises(R.Refused, match="STALE_PROJECTION"):
        R.release(spark, log, "PUBLISH", 1, "p1", "ann", "first", *checks(spark, closed=False))
    with pytest.raises(R.Refused, match=R.NOT_RELEASABLE):
        R.released(spark, index, log)
    R.release(spark, log, "PUBLISH", 1, "p1", "ann", "first", *checks(spark))
    R.release(spark, log, "PUBLISH", 2, "p2", "bob", "second", *checks(spark))
    assert statuses(spark, log) == {1: "RETIRED", 2: "ACTIVE"}
    assert [r.v for r in R.released(spark, index, log).collect()] == ["new"]
    for wrong in (lambda: R.release(spark, log, "ROLLBACK", 2, "p", "a", "r", *checks(spark)), lambda: R.transition(spark, log, 2, "ACTIVE"), lambda: R.transition(spark, log, 2, "DELETED"), lambda: R.transition(spark, log, 9, "READY")):
        with pytest.raises(R.Refused, match=R.NOT_RELEASABLE):
            wrong()
    R.release(spark, log, "ROLLBACK", 1, "p1", "ann", "worse", *checks(spark))
    assert statuses(spark, log) == {1: "ACTIVE", 2: "RETIRED"}
    assert [r.v for r in R.released(spark, index, log).collect()] == ["old"]
    assert [tuple(r)[1:7] for r in R.publication_events(spark, log).collect()] == [("PUBLISH", None, "p1", None, 1, "ann"), ("PUBLISH", "p1", "p2", 1, 2, "bob"), ("ROLLBACK", "p2", "p1", 2, 1, "ann")]
    R.transition(spark, log, 2, "DELETED")
    assert statuses(spark, log) == {1: "ACTIVE", 2: "DELETED"}
    assert R.generations(spark, log).filter("generation = 2").first().retention_until is None


def test_of_two_publishers_one_is_refused(spark, tmp_path):
    log = str(tmp_path / "log")
    for g in (1, 2):
        R.transition(spark, log, g, "BUILDING")
        R.transition(spark, log, g, "READY")
    both, ended = threading.Barrier(2), []
    ready, closed = checks(spark)

    class Meets:
        """A check that both publishers reach before either goes on."""

        def first(self):
            both.wait(60)
            return closed.first()

    def publish(g):
        try:
            ended.append(R.release(spark, log, "PUBLISH", g, "p", "a", "r", ready, Meets()))
        except R.Refused as refused:
            ended.append(str(refused))

    threads = [threading.Thread(target=publish, args=(g,)) for g in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(map(str, ended)) == ["4", R.CHANGED]
    assert sorted(statuses(spark, log).values()) == ["ACTIVE", "READY"]
    # an entry that is there is never written over, nor left behind half-written
    assert not R._claim(spark, log, 4, {"number": 4})
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")) == [f"{n}.json" for n in range(5)]


def test_transitions_and_immutable_rows(spark):
    log = [("a", 1, "BUILDING"), ("a", 2, "READY"), ("a", 3, "READY"), ("a", 4, "ACTIVE"), ("a", 5, "DELETED"), ("b", 1, "READY"), ("c", 1, "BUILDING"), ("c", 2, None), ("d", 1, "BUILDING"), ("d", 2, "FAILED"), ("d", 3, "DELETED")]
    got = V.illegal_transitions(spark.createDataFrame(log, "entity string, number int, status string"))
    assert sorted(map(tuple, got.collect())) == [("a", 5, "ACTIVE", "DELETED"), ("b", 1, None, "READY"), ("c", 2, "BUILDING", None)]
    schema = "k int, change string, v string"
    before = spark.createDataFrame([(1, "x", "a"), (2, "x", None), (3, "x", "c"), (None, "x", "d"), (5, None, "e")], schema)
    after = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (None, "x", "d"), (5, None, "e"), (6, "y", "new")], schema)
    assert sorted(map(tuple, V.changed_rows(before, after, ["k"]).collect())) == [(2, "CHANGED"), (3, "GONE")]
    manifests = spark.createDataFrame([(1, "READY", 5, 5, 2, 2, 1, 1), (2, "ACTIVE", 5, 4, 3, 2, 2, 1), (3, "BUILDING", 5, 0, 1, 0, 1, 0)], "generation int, status string, expected int, projected int, entities int, mentions int, relations int, evidence int")
    assert {tuple(r) for r in V.incomplete_manifests(manifests).collect()} == {(2, V.INCOMPLETE), (2, V.NO_MENTION), (2, V.NO_EVIDENCE)}


def test_locators(spark):
    units = spark.createDataFrame([(1, 1, 1, "PAGE", 0, "n", "ab😀"), (2, 1, 1, "PAGE", 1, "n", "xy"), (3, 1, 2, "PAGE", 0, "n", "xy"), (4, 1, 1, "BLOCK", 2, "n", "xy")], "unit_id int, doc_id int, revision_id int, kind string, place int, version string, text string")
    rows = [
        (1, 1, 1, "PAGE", 1, 2, 0, 2, "n", None),
        (2, 1, 1, "PAGE", 1, 1, 0, 4, "n", None),
        (3, 1, 1, "PAGE", 1, 1, 0, 5, "n", V.OUT_OF_BOUNDS),
        (4, 1, 1, "PAGE", 1, 1, 2, 2, "n", V.OUT_OF_BOUNDS),
        (5, 1, 1, "PAGE", 2, 1, 0, 1, "n", V.UNITS_APART),
        (6, 1, 1, "PAGE", 1, 3, 0, 1, "n", V.UNITS_APART),
        (7, 1, 1, "PAGE", 1, 4, 0, 1, "n", V.UNITS_APART),
        (8, 1, 1, "BLOCK", 1, 4, 0, 1, "n", None),
        (9, 1, 1, "PAGE", 1, 99, 0, 1, "n", V.UNITS_APART),
        (10, 1, 1, "PAGE", 1, 2, 0, 1, "m", V.UNITS_APART),
        (11, 1, 1, "PAGE", 1, 2, -1, 1, "n", V.OUT_OF_BOUNDS),
        (12, 1, 1, "PAGE", 1, 2, None, 1, "n", V.OUT_OF_BOUNDS),
    ]
    locators = spark.createDataFrame([r[:-1] for r in rows], "locator_id int, doc_id int, revision_id int, kind string, first_unit int, last_unit int, first_offset int, last_offset int, version string")
    assert {r.locator_id: r.fault for r in V.broken_locators(locators, units).collect()} == {r[0]: r[-1] for r in rows if r[-1]}


def test_a_write_with_violations_is_not_published(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.when(F.col("id") != 7, F.col("id")))
    rules = {"v is there": F.col("v").isNotNull(), "id below 90": F.col("id") < 90, "id from 0": F.col("id") >= 0}
    with pytest.raises(V.Violated) as broken:
        V.write_checked(df, str(tmp_path / "out"), rules)
    assert broken.value.counts == {"v is there": 1, "id below 90": 10} and not list(tmp_path.iterdir())
    good = df.filter("id < 90 AND id <> 7")
    assert V.write_checked(good, str(tmp_path / "out"), rules) == 89 == spark.read.parquet(str(tmp_path / "out")).count()
    with pytest.raises(FileExistsError):
        V.write_checked(good, str(tmp_path / "out"), rules)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


class Server(BaseHTTPRequestHandler):
    """Enough of a search server to answer the calls."""

    indexes: dict = {}
    aliases: dict = {}
    asked: list = []

    def log_message(self, *_):
        pass

    def _answer(self, body, code=200):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _body(self):
        return self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()

    def do_PUT(self):
        self._body()
        self.indexes[self.path[1:]] = {}
        self._answer({})

    def do_DELETE(self):
        self.indexes.pop(self.path[1:], None)
        self._answer({})

    def do_GET(self):
        name = self.path[1:]
        if name.endswith("/_count"):
            return self._answer({"count": len(self.indexes[name.split("/")[0]])})
        found = {i: {} for a, i in self.aliases.items() if a == name.split("/")[1]}
        return self._answer(found, 200 if found else 404)

    def do_POST(self):
        body = self._body()
        if self.path == "/_bulk":
            items, lines = [], body.splitlines()
            for head, doc in zip(lines[::2], lines[1::2], strict=True):
                head, doc = json.loads(head)["index"], json.loads(doc)
                bad = doc.get("title") == "refuse me"
                if not bad:
                    self.indexes[head["_index"]][head["_id"]] = doc
                items.append({"index": {"error": "mapping"} if bad else {}})
            return self._answer({"errors": any(i["index"] for i in items), "items": items})
        if self.path == "/_aliases":
            for a in json.loads(body)["actions"]:
                for kind, x in a.items():
                    self.aliases.pop(x["alias"], None) if kind == "remove" else self.aliases.update({x["alias"]: x["index"]})
            return self._answer({})
        if self.path.endswith("/_refresh"):
            return self._answer({})
        ask = json.loads(body)
        self.asked.append(ask)
        rows = [d for d in self.indexes[self.aliases[self.path.split("/")[1]]].values() if all(self._holds(d, c) for c in ask["query"]["bool"]["filter"])]
        if "aggs" in ask:
            ids = sorted(d["chunk_id"] for d in rows)
            return self._answer({"aggregations": {"cuts": {"values": {str(p): ids[int(len(ids) * p / 100)] if ids else None for p in ask["aggs"]["cuts"]["percentiles"]["percents"]}}}})
        rows.sort(key=lambda d: d["chunk_id"])
        rows = [d for d in rows if "search_after" not in ask or d["chunk_id"] > ask["search_after"][0]]
        return self._answer({"hits": {"hits": [{"_source": d, "sort": [d["chunk_id"]]} for d in rows[: ask["size"]]]}})

    @staticmethod
    def _holds(doc, clause):
        ((kind, what),) = clause.items()
        if kind == "exists":
            return doc.get(what["field"]) is not None
        ((field, value),) = what.items()
        v = doc.get(field)
        if kind == "range":
            return v is not None and all({"gt": v > x, "gte": v >= x, "lt": v < x, "lte": v <= x}[k] for k, x in value.items())
        return v in value if kind == "terms" else v == value


@pytest.fixture
def server():
    Server.indexes, Server.aliases, Server.asked = {}, {}, []
    made = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_search_server(spark, server):
    spark.dataSource.register(SearchServer)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"url": server, "alias": "chunks", "id_field": "chunk_id", "ranges": "4", "page": "37"}
    save = lambda df: df.write.format("search_server").options(**options).mode("append").save()
    schema = "chunk_id long, title string, n int"
    rows = [(i * i, f"t{i % 3}", None if i % 5 == 0 else i) for i in range(700)]
    save(spark.createDataFrame(rows, schema).repartition(3))
    read = spark.read.format("search_server").schema(schema).options(**options).load()
    assert sorted(map(tuple, read.collect())) == rows and read.rdd.getNumPartitions() == 4
    Server.asked.clear()
    picked = read.filter("title = 't1' AND chunk_id > 400 AND n IN (22, 25, 28, 31) AND length(title) = 2").select("n").collect()
    assert sorted(r.n for r in picked) == [22, 28, 31]
    asked = [json.dumps(a["query"]) for a in Server.asked]
    assert asked and all('"term": {"title": "t1"}' in a and '"gt": 400' in a and '"terms": {"n"' in a for a in asked)
    first = dict(Server.aliases)
    # a refused row, a missing id and a repeated id leave everything as it was
    for bad in ([(1, "refuse me", 1)], [(None, "x", 1)], [(5, "x", 1), (5, "y", 2)]):
        with pytest.raises(Exception, match="refused a row|has no chunk_id|ids repeat"):
            save(spark.createDataFrame([(10**6 + i, "ok", 1) for i in range(1200)] + bad, schema).repartition(2))
        assert Server.aliases == first and list(Server.indexes) == [first["chunks"]]
    save(spark.createDataFrame([(1, "next", 1)], schema))
    assert [tuple(r) for r in read.collect()] == [(1, "next", 1)] and Server.aliases != first

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corroborate import settings
from corroborate.operators import evidence as E
from corroborate.operators import judging as J
from corroborate.operators import plugins as G
from corroborate.sources import remote


def test_index_is_built_once_per_content(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting(G.HashingEmbedder):
        def embed(self, texts):
            (calls / f"{len(list(calls.iterdir()))}-{len(texts)}").touch()
            return super().embed(texts)

    docs = spark.createDataFrame([(1, "solar power"), (2, "wind power"), (3, "deep sea")], "doc_id long, text string")
    p = Counting(32)
    G.ensure_index(spark, docs, p, str(tmp_path)).collect()
    n = len(list(calls.iterdir()))
    index = G.ensure_index(spark, docs.repartition(3), p, str(tmp_path))
    assert len(list(calls.iterdir())) == n > 0
    q = spark.createDataFrame([(9, "solar power")], "query_id long, text string").select("query_id", G.embedder(spark, G.HashingEmbedder(32))("text").alias("embedding"))
    assert [r.doc_id for r in G.ExactIndex(index).search(q, 2).orderBy("rank").collect()][0] == 1
    other = G.ensure_index(spark, docs.filter("doc_id < 3"), p, str(tmp_path))
    assert other.count() == 2


def test_cell_index_recall_and_that_all_cells_give_the_exact_answer(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    rows = lambda d: {(r.query_id, r.doc_id) for r in d.collect()}
    exact, near = rows(G.ExactIndex(e).search(q, 10)), rows(G.CellIndex(e).search(q, 10))
    assert len(exact & near) >= 0.9 * len(exact)
    few = e.filter("doc_id < 300")
    assert rows(G.CellIndex(few, cells=8, probes=8).search(q, 5)) == rows(G.ExactIndex(few).search(q, 5))
    assert G.CellIndex(few.limit(0)).search(q, 3).count() == 0


def test_paged_rows(spark):
    rows = [{"row": {"id": k, "query": f"q{k}"}} for k in range(25)]

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            a = {k: int(v[0]) for k, v in parse_qs(urlsplit(self.path).query).items() if k != "dataset"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"rows": rows[a["offset"] : a["offset"] + a["length"]]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote.register(spark)
    got = spark.read.format("paged_rows").options(url=f"http://127.0.0.1:{server.server_port}/rows?dataset=x", offset=3, limit=20, page=7).load().orderBy("ord").collect()
    server.shutdown()
    assert [r.ord for r in got] == list(range(3, 23)) and json.loads(got[0].row) == {"id": 3, "query": "q3"}


def test_settings():
    s = settings.load({"CORROBORATE_ROUNDS": "5", "CORROBORATE_RERANK_ENABLED": "true", "OTHER": "x"})
    assert (s.rounds, s.rerank_enabled, s.chunk_size) == (5, True, 700)
    with pytest.raises((ValueError, KeyError)):
        settings.load({"CORROBORATE_RERANK_ENABLED": "maybe"})


def test_payload_claims_and_forbidden_urls(spark):
    c = lambda t: spark.createDataFrame([(t,)], "t string").select(E.claims_of_payload(F.col("t"))).first()[0]
    assert c('{"claim_items": ["a [S1]", " ", "a [S1]"]}') == ["a [S1]"]
    assert c('{"claims": [{"claim": "b", "citations": ["S1", "S2"]}, {"text": "c [S3]", "citations": ["S3"]}]}') == ["b [S1] [S2]", "c [S3]"]
    u = lambda p: spark.range(1).select(J.forbidden_urls(F.lit(p), F.lit("task"))).first()[0]
    assert u("""task {"urls": ["https://a.com/x?q", 'https://b.com/it's/']}""") == ["https://a.com/x", "https://b.com/it's"] and u("other") is None and u("task") is None


def test_pinned_snapshot(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert J.pinned(rows, 3, "k", {"a": 2, "b": 1}).count() == 3
    for count, counts in ((4, {"a": 2, "b": 1}), (3, {"a": 1, "b": 2}), (3, {"a": 2, "b": 1, "c": 0})):
        with pytest.raises(PySparkException):
            J.pinned(rows, count, "k", counts).collect()


def test_spans_are_exported(spark, tmp_path):
    spark.sql("select 'r' run_id, 's' stage, 'error' status, timestamp'2024-01-01' ts, 5.0 duration_ms").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, stage string, status string, ts timestamp, duration_ms double").json(str(tmp_path / "in"))
    got = []
    G.export_spans(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert [(r.code, r.end_ns - r.start_ns) for r in got] == [("ERROR", 5_000_000)]

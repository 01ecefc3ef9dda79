"""Embedders with fallback, and PDF text there and back."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tephra.functions import pdf, vectors
from tephra.operators import embedding


@pytest.fixture
def endpoint():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            answer = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]} if "input" in body else {"embedding": [float(len(body["prompt"]))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_http_protocols(endpoint):
    assert embedding.HttpEmbedder(endpoint, "m").embed(["abc", "d"]) == [[3.0], [1.0]]
    batched = embedding.HttpEmbedder(endpoint, "m", batched=True)
    assert batched.embed(["abc", "d"]) == [[3.0, 1.0], [1.0, 1.0]]
    dead = embedding.HttpEmbedder("http://127.0.0.1:9/", "m", timeout=0.2)
    assert embedding.first_available([dead, batched], None) is batched
    assert embedding.first_available([dead], "other") == "other"


class Failing:
    name = "failing"
    calls = 0

    def embed(self, texts):
        Failing.calls += 1
        raise OSError("gone")


def test_fallback_after_strikes():
    a = embedding.AdaptiveEmbedder(Failing(), embedding.HashEmbedder(8), 3)
    assert {a.embed_named(["x"])[1] for _ in range(9)} == {"hash"} and Failing.calls == 3


def test_embedding_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, t string")
    made = embedding.embed_texts(df, "id", "t", lambda: embedding.AdaptiveEmbedder(embedding.HashEmbedder(40), embedding.HashEmbedder(40)))
    assert embedding.backends(made).first()["texts"] == 2
    both = made.join(df, "id").select(vectors.cosine(F.col("vector"), vectors.hash_embedding(F.col("t"), 40)).alias("c")).collect()
    assert [r["c"] for r in both] == pytest.approx([1.0, 1.0])


def test_pdf_round_trip(spark):
    lines = [f"Line {i} (of) many \\ é" for i in range(130)]
    data = pdf.pages(lines)
    assert pdf.extract_text(data).split("\n") == lines and data.startswith(b"%PDF") and data.count(b"/Type /Page ") == 3
    assert pdf.extract_text(b"%PDF-1.4 nothing") == ""
    df = spark.createDataFrame([(bytearray(data),), (None,)], "c binary")
    assert [r[0] for r in df.select(F.length(pdf.pdf_text(F.col("c")))).collect()] == [len("\n".join(lines)), None]

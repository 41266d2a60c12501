import json
import pickle
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from loomtext.errors import ConfigError, EmptyEmbedding, HttpError, OnnxError
from loomtext.providers import local
from loomtext.providers.base import Provider, embedded
from loomtext.providers.http import Cohere, OpenAI, Voyage
from loomtext.providers.retry import TRANSIENT, Policy, TransportError, asked_delay, run


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def policy(self, **more):
        return Policy(clock=lambda: self.now, sleep=self.sleep, random=lambda: 0.5, **more)

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def answers(*rows):
    it = iter(rows)

    def send():
        r = next(it)
        if isinstance(r, Exception):
            raise r
        return r

    return send


def test_retry():
    c = Clock()
    assert run(answers((503, {}, b""), TransportError("x"), (429, {"retry-after": "7"}, b""), (200, {}, b"ok")), c.policy()) == b"ok"
    assert c.slept == [0.5, 1.0, 7.0]
    for status in (400, 401, 404, 501):
        with pytest.raises(HttpError, match=str(status)):
            run(answers((status, {}, b"no")), Clock().policy())
    assert TRANSIENT == {408, 425, 429, 500, 502, 503, 504}
    c = Clock()
    with pytest.raises(HttpError, match="given up"):
        run(answers(*[(500, {}, b"")] * 50), c.policy())
    assert sum(c.slept) <= 90 and max(c.slept) == 30
    p = Policy()
    assert asked_delay("100", p) == 60 and asked_delay("soon", p) is None and asked_delay(None, p) is None
    c = Clock()
    low, high = Policy(clock=lambda: 0, sleep=c.slept.append, random=lambda: 0.0), Policy(clock=lambda: 0, sleep=c.slept.append, random=lambda: 1.0)
    for p in (low, high):
        run(answers((500, {}, b""), (200, {}, b"")), p)
    assert c.slept == pytest.approx([0.35, 0.65])


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        fails = 1

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            status = 503 if Handler.fails else 200
            Handler.fails = 0
            texts = body.get("input", body.get("texts"))
            made = [[float(len(t)), 1.0] for t in texts]
            data = {"embeddings": made} if "texts" in body else {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(made)))]}
            if texts == ["nothing"]:
                data = {"data": []}
            out = json.dumps(data).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/v1", seen
    httpd.shutdown()


def test_services(server, monkeypatch):
    url, seen = server
    monkeypatch.setenv("TEST_KEY", "hidden")
    quick = Policy(first=0.01)
    for kind, path, doc, query in ((OpenAI, "/v1/embeddings", None, None), (Voyage, "/v1/embeddings", "document", "query"), (Cohere, "/v1/embed", "search_document", "search_query")):
        p = kind(base_url=url, key_variable="TEST_KEY", policy=quick)
        assert p.embed(["a", "bcd"]) == [[1, 1], [3, 1]] and p.embed_query(["xy"]) == [[2, 1]]
        (where, auth, first), (_, _, second) = seen[-2:]
        assert where == path and auth == "Bearer hidden" and first.get("input_type") == doc and second.get("input_type") == query and first["model"] == p.model_id()
        assert "hidden" not in repr(p) and "<redacted>" in repr(p)
    with pytest.raises(EmptyEmbedding):
        OpenAI(base_url=url, key_variable="TEST_KEY").embed(["nothing"])
    with pytest.raises(ConfigError):
        OpenAI(base_url=url, key_variable="NO_SUCH_KEY").embed(["a"])
    with pytest.raises(HttpError):
        OpenAI(base_url="http://127.0.0.1:9", key_variable="TEST_KEY", policy=Policy(first=0.01, total=0.03)).embed(["a"])


def test_defaults():
    assert [p().dimension() for p in (OpenAI, Voyage, Cohere)] == [1536, 512, 1024]
    assert OpenAI("text-embedding-3-large").dimension() == 3072 and OpenAI("x").dimension() == 1536 and Voyage("x").dimension() == 1024 and Cohere("embed-english-light-v3.0").dimension() == 384
    assert local.default_pooling("BAAI/bge-m3") == "cls" and local.default_pooling("who/knows") == "mean"
    assert local.default_prefixes("intfloat/e5-base-v2") == ("query: ", "passage: ")
    assert local.default_prefixes("BAAI/bge-small-en-v1.5")[0].startswith("Represent") and local.default_prefixes("BAAI/bge-m3") == ("", "")


def test_local_states(tmp_path):
    assert local.states_to_vectors(np.array([[3.0, 4.0]]), [[1]], "mean") == [pytest.approx([0.6, 0.8])]
    states = np.array([[[3.0, 4.0], [9.0, 9.0]]])
    assert local.states_to_vectors(states, [[1, 0]], "mean") == [pytest.approx([0.6, 0.8])]
    with pytest.raises(OnnxError):
        local.states_to_vectors(np.zeros(3), [[1]], "mean")
    with pytest.raises(ConfigError):
        local.LocalModel.from_folder("m", str(tmp_path))
    (tmp_path / "model.onnx").write_bytes(b"no model")
    (tmp_path / "tokenizer.json").write_text("{}")
    m = local.LocalModel.from_folder("m", str(tmp_path), pooling="max")
    assert m.model_path.endswith("model.onnx") and pickle.loads(pickle.dumps(m)) == m
    with pytest.raises(OnnxError):
        m.embed(["a"])


def counting():
    """Travels by value, as workers can't import tests."""

    class Counting(Provider):
        def embed(self, texts):
            if "bad" in texts:
                raise HttpError("status 400")
            return [[float(len(t)), float("nan") if t == "nan" else 1.0] for t in texts]

        def embed_query(self, texts):
            return [[0.0, 1.0] for _ in texts]

        def model_id(self):
            return "counting"

        def dimension(self):
            return 2

    return Counting()


def test_a_column_of_texts(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad"), (4, "nan"), (5, "")], "id long, text string").coalesce(1)
    got = {r.id: r for r in embedded(docs, counting()).collect()}
    assert got[1].embedding.vector == [3, 1] and got[1].embedding.model_id == "counting" and got[5].embedding.vector == [0, 1]
    assert got[2].embedding is None and got[2].error is None and got[3].error == "status 400" and "finite" in got[4].error
    assert embedded(docs, counting(), kind="query").first().embedding.vector == [0, 1]
    assert embedded(docs.limit(0), counting()).count() == 0

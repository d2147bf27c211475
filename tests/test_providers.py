import io
import json
from urllib.error import HTTPError, URLError

import pytest

from jurisloom.plans.national import FallbackEncoder
from jurisloom.sources import providers as p


class Server:
    def __init__(self, answers):
        self.answers, self.asked = answers, []

    def __call__(self, request, timeout):
        self.asked.append((request.full_url, json.loads(request.data), dict(request.header_items())))
        answer = next(a for url, a in self.answers if request.full_url.startswith(url))
        if isinstance(answer, Exception):
            raise answer
        return io.BytesIO(json.dumps(answer(self.asked[-1][1]) if callable(answer) else answer).encode())


def http(code):
    return HTTPError("u", code, "x", None, io.BytesIO(b""))


def test_settings():
    assert p.Desk.of({}).endpoints == [p.Endpoint("local", "local-model", "http://127.0.0.1:8080/v1")]
    env = {"JURISLOOM_LLM_PROVIDERS": "remote, deepseek,local", "JURISLOOM_LLM_REMOTE_URL": "http://gpu/v1/", "DEEPSEEK_API_KEY": "k", "JURISLOOM_LLM_MODEL": "m", "JURISLOOM_LLM_LOCAL_MODEL": "own"}
    found = p.Desk.of(env).endpoints
    assert [e.name for e in found] == ["remote", "deepseek", "local"] and found[0].base == "http://gpu/v1" and found[1].secret == "k"
    assert [e.model for e in found] == ["m", "m", "own"]


@pytest.mark.parametrize("name,key", [("openai", "OPENAI_API_KEY"), ("deepseek", "DEEPSEEK_API_KEY"), ("gemini", "GEMINI_API_KEY")])
def test_cloud_services_need_a_key(name, key):
    with pytest.raises(p.ProviderError):
        p.endpoint(name, {})
    assert p.endpoint(name, {key: "secret"}).secret == "secret"
    with pytest.raises(p.ProviderError):
        p.endpoint("other", {})


OK = {"choices": [{"message": {"content": "yes"}}]}
TWO = [p.Endpoint("remote", "m", "http://gpu"), p.Endpoint("local", "m", "http://cpu")]
SAID = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]


@pytest.mark.parametrize("problem", [URLError("off"), TimeoutError(), http(429), http(503)])
def test_unavailable_servers_are_skipped(problem):
    server = Server([("http://gpu", problem), ("http://cpu", OK)])
    assert p.Desk(TWO, p.Line(server)).chat(SAID) == "yes" and len(server.asked) == 2
    with pytest.raises(p.ProviderUnavailable):
        p.Desk(TWO[:1], p.Line(server)).chat(SAID)


def test_calls_are_sent_again_by_the_policy():
    answers, slept = [http(503), URLError("off"), OK], []
    server = Server([("http://gpu", None)])

    def opener(request, timeout):
        server.answers = [("http://gpu", answers.pop(0))]
        return server(request, timeout)

    assert p.Desk(TWO[:1], p.Line(opener, p.Policy((1.0, 2.0, 4.0)), slept.append)).chat(SAID) == "yes"
    assert slept == [1.0, 2.0] and not answers


def test_refusals_are_not_hidden():
    for answer in (http(400), {"choices": []}, []):
        with pytest.raises(p.ProviderError) as e:
            p.Desk(TWO, p.Line(Server([("http://gpu", answer), ("http://cpu", OK)]))).chat(SAID)
        assert not isinstance(e.value, p.ProviderUnavailable)


def test_generated_contents():
    server = Server([("http://g", {"candidates": [{"content": {"parts": [{"text": "oui"}]}}]})])
    e = p.endpoint("gemini", {"GEMINI_API_KEY": "k", "JURISLOOM_LLM_URL": "http://g", "JURISLOOM_LLM_MODEL": "m"})
    assert p.Desk([e], p.Line(server)).chat(SAID) == "oui"
    url, body, headers = server.asked[0]
    assert url == "http://g/models/m:generateContent" and body["systemInstruction"]["parts"][0]["text"] == "s" and headers["X-goog-api-key"] == "k"
    assert [c["role"] for c in body["contents"]] == ["user", "model"]


def test_embeddings():
    shuffled = lambda body: {"data": [{"index": k, "embedding": [float(k), 1.0]} for k in reversed(range(len(body["input"])))]}
    e = p.Endpoint("remote", "m", "http://e", "k")
    server = Server([("http://e", shuffled)])
    encode = p.RemoteEncoder(e, 2, p.Line(server))
    assert encode(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]] and len(server.asked) == 1 and server.asked[0][2]["Authorization"] == "Bearer k"
    for dimension, answer in ((3, shuffled), (2, {"data": []}), (2, {})):
        with pytest.raises(p.ProviderError):
            p.RemoteEncoder(e, dimension, p.Line(Server([("http://e", answer)])))(["a"])
    off = p.RemoteEncoder(e, 2, p.Line(Server([("http://e", URLError("off"))])))
    assert FallbackEncoder([off, encode])(["a"]) == [[0.0, 1.0]]

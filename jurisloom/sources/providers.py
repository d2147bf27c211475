"""Model servers: chat and embeddings over HTTP.

Three parts that know nothing of each other: a :class:`Wire` turns questions into
calls and answers into values, one subclass for each published protocol; a
:class:`Line` sends a call and judges what comes back by a policy that is data; a
:class:`Desk` holds endpoints in order of preference and gives a question to the
first that can take it now.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import closing
from dataclasses import dataclass, field
from typing import Any
from urllib import error, request


class ProviderError(RuntimeError):
    """A server refused, or its answer makes no sense."""


class ProviderUnavailable(ProviderError, ConnectionError):
    """A server can't be used now; another one may."""


@dataclass(frozen=True)
class Call:
    """What is sent: a path under the endpoint's base, a JSON body, and a header that carries the secret."""

    path: str
    body: dict[str, Any]
    secret_header: tuple[str, str] = ("Authorization", "Bearer {}")


class Wire:
    """The widespread protocol of completions and embeddings."""

    def ask(self, model: str, turns: Sequence[Mapping[str, str]], temperature: float) -> Call:
        return Call("/chat/completions", {"model": model, "temperature": temperature, "messages": list(turns)})

    def said(self, answer: Any) -> str:
        return answer["choices"][0]["message"]["content"]

    def embed(self, model: str, texts: Sequence[str]) -> Call:
        return Call("/embeddings", {"model": model, "input": list(texts)})

    def vectors(self, answer: Any) -> list[list[float]]:
        placed = {item.get("index", k): item["embedding"] for k, item in enumerate(answer["data"])}
        return [placed[k] for k in sorted(placed)]


class GenerateContent(Wire):
    """The protocol of generated contents: roles of its own, rules apart from the turns."""

    def ask(self, model: str, turns: Sequence[Mapping[str, str]], temperature: float) -> Call:
        by_kind: dict[bool, list[Mapping[str, str]]] = {True: [], False: []}
        for turn in turns:
            by_kind[turn["role"] == "system"].append(turn)
        part = lambda text: [{"text": text}]
        body: dict[str, Any] = {
            "generationConfig": {"temperature": temperature},
            "contents": [{"parts": part(t["content"]), "role": "model" if t["role"] == "assistant" else "user"} for t in by_kind[False]],
        }
        if by_kind[True]:
            body["systemInstruction"] = {"parts": part("\n".join(t["content"] for t in by_kind[True]))}
        return Call(f"/models/{model}:generateContent", body, ("x-goog-api-key", "{}"))

    def said(self, answer: Any) -> str:
        return answer["candidates"][0]["content"]["parts"][0]["text"]


# Services with their public addresses and default models, the variable of their key, and whether they need one.
SERVICES: dict[str, tuple[type[Wire], str, str, str | None]] = {
    "local": (Wire, "http://127.0.0.1:8080/v1", "local-model", None),
    "remote": (Wire, "http://127.0.0.1:8080/v1", "local-model", None),
    "openai": (Wire, "https://api.openai.com/v1", "gpt-5-mini", "OPENAI_API_KEY"),
    "deepseek": (Wire, "https://api.deepseek.com/v1", "deepseek-chat", "DEEPSEEK_API_KEY"),
    "gemini": (GenerateContent, "https://generativelanguage.googleapis.com/v1beta", "gemini-2.5-flash", "GEMINI_API_KEY"),
}


@dataclass(frozen=True)
class Policy:
    """How often, after which pauses, and on which answers a call is sent again; and when a server counts as unavailable."""

    pauses: tuple[float, ...] = ()
    passing: frozenset[int] = frozenset({408, 425, 429, *range(500, 600)})


@dataclass
class Line:
    """Sends calls.  ``opener`` has the signature of :func:`urllib.request.urlopen`."""

    opener: Callable = request.urlopen
    policy: Policy = field(default_factory=Policy)
    sleep: Callable[[float], None] = time.sleep

    def send(self, url: str, headers: Mapping[str, str], body: dict[str, Any], seconds: float) -> Any:
        for pause in (*self.policy.pauses, None):
            try:
                return self._once(url, headers, body, seconds)
            except ProviderUnavailable:
                if pause is None:
                    raise
                self.sleep(pause)

    def _once(self, url: str, headers: Mapping[str, str], body: dict[str, Any], seconds: float) -> Any:
        call = request.Request(url, method="POST", headers=dict(headers), data=json.dumps(body).encode("utf-8"))
        try:
            with closing(self.opener(call, timeout=seconds)) as answer:
                return json.loads(answer.read())
        except OSError as problem:  # refused answers among them
            code = getattr(problem, "code", None) if isinstance(problem, error.HTTPError) else None
            passing = code is None or code in self.policy.passing
            raise (ProviderUnavailable if passing else ProviderError)(str(problem) if code is None else f"HTTP {code}") from problem


@dataclass(frozen=True)
class Endpoint:
    """One model of one service."""

    name: str
    model: str
    base: str
    secret: str | None = None
    seconds: float = 60.0
    wire: Wire = field(default_factory=Wire, compare=False)

    def put(self, line: Line, call: Call, read: Callable[[Any], Any]) -> Any:
        headers = {"Content-Type": "application/json"}
        if self.secret:
            name, form = call.secret_header
            headers[name] = form.format(self.secret)
        answer = line.send(self.base + call.path, headers, call.body, self.seconds)
        try:
            return read(answer)
        except (LookupError, TypeError, AttributeError) as problem:
            raise ProviderError(f"{self.name}: unexpected answer") from problem


def endpoint(name: str, env: Mapping[str, str], prefix: str = "JURISLOOM_LLM") -> Endpoint:
    """An endpoint by its service's name: ``<prefix>_<NAME>_<SETTING>``, then ``<prefix>_<SETTING>``, then the defaults.

    Settings are URL, MODEL, TIMEOUT and, for services without a key of their
    own, API_KEY.
    """
    key = name.strip().lower()
    try:
        wire, base, model, secret_name = SERVICES[key]
    except KeyError:
        raise ProviderError(f"unknown service {key}") from None

    def setting(what: str, default: str | None) -> str | None:
        tried = (f"{prefix}_{key.upper()}_{what}", f"{prefix}_{what}")
        return next((env[x] for x in tried if env.get(x)), default)

    secret = setting("API_KEY", None) if secret_name is None else env.get(secret_name)
    if secret_name and not secret:
        raise ProviderError(f"{key} needs {secret_name}")
    return Endpoint(key, setting("MODEL", model), setting("URL", base).rstrip("/"), secret, float(setting("TIMEOUT", "60")), wire())


@dataclass
class Desk:
    """Endpoints in order of preference."""

    endpoints: Sequence[Endpoint]
    line: Line = field(default_factory=Line)

    @classmethod
    def of(cls, env: Mapping[str, str], prefix: str = "JURISLOOM_LLM", line: Line | None = None) -> Desk:
        """Those that ``<prefix>_PROVIDERS`` lists, else the one that ``<prefix>_PROVIDER`` names, else the local one."""
        listed = [x for x in (env.get(f"{prefix}_PROVIDERS") or "").split(",") if x.strip()]
        return cls([endpoint(x, env, prefix) for x in listed or (env.get(f"{prefix}_PROVIDER") or "local",)], line or Line())

    def _tried(self, calls: Callable[[Endpoint], tuple[Call, Callable[[Any], Any]]], problems: list[str]) -> Iterator[Any]:
        for e in self.endpoints:
            try:
                yield e.put(self.line, *calls(e))
            except ProviderUnavailable as problem:
                problems.append(f"{e.name}: {problem}")

    def chat(self, turns: Sequence[Mapping[str, str]], temperature: float = 0.0) -> str:
        """The first available endpoint's answer; a refusal ends the search."""
        problems: list[str] = []
        for text in self._tried(lambda e: (e.wire.ask(e.model, turns, temperature), e.wire.said), problems):
            return text
        raise ProviderUnavailable("; ".join(problems))


class RemoteEncoder:
    """An embeddings endpoint as a function from texts to vectors, in the order of the texts.

    ``dimension`` is what the index was made with; every answer is held to it.
    """

    def __init__(self, e: Endpoint, dimension: int, line: Line | None = None) -> None:
        self.endpoint, self.dimension, self.line, self.model = e, dimension, line or Line(), e.model

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found = self.endpoint.put(self.line, self.endpoint.wire.embed(self.model, texts), self.endpoint.wire.vectors)
        sizes = [len(v) for v in found]
        if sizes != [self.dimension] * len(texts):
            raise ProviderError(f"{len(texts)} vectors of {self.dimension} were asked for, {len(sizes)} of {sorted(set(sizes))} came")
        return found

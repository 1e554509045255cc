"""Scorers behind a small protocol: a completion server, a local model, a fixed double, and a client that remembers.

All take what they call (a transport, a tokenizer and a model) as an argument.
A local scorer runs inside ``replay``'s batches on the executors; partitions
take the place of worker threads. A server's answers to a batch are read
together, as columns.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Row

from ..schema import ACTIONS, ContractError
from .identity import LABEL_BIAS, Fingerprint, identity_sha256
from .prompts import LABELS, average_orders, checked_messages, cyclic_messages, cyclic_orders, request_key
from .responses import AUDITED, audits, label_scores, read

MOST_BYTES = 4 << 20


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args, **_how):
        return None


class JsonTransport:
    """JSON over HTTP to one origin: no redirects, no proxies, no credentials in the address, bounded answers."""

    def __init__(self, origin: str, timeout: float = 60.0, most: int = MOST_BYTES):
        parts = urllib.parse.urlsplit(origin)
        if parts.scheme not in ("http", "https") or not parts.hostname or parts.path not in ("", "/") or parts.query or parts.fragment or parts.username or parts.password:
            raise ContractError("a server is named by its origin alone")
        self.origin, self.timeout, self.most = f"{parts.scheme}://{parts.netloc}", timeout, most

    def __call__(self, method: str, path: str, payload: Mapping | None = None) -> Mapping:
        if not path.startswith("/") or path.startswith("//"):
            raise ContractError("a path starts with one slash")
        body = None if payload is None else json.dumps(payload, allow_nan=False).encode()
        request = urllib.request.Request(self.origin + path, body, {"Content-Type": "application/json", "Accept": "application/json"}, method=method)
        opener = urllib.request.build_opener(_NoRedirects, urllib.request.ProxyHandler({}))
        try:
            with opener.open(request, timeout=self.timeout) as answer:
                raw = answer.read(self.most + 1)
        except (urllib.error.URLError, OSError) as error:
            raise ContractError(f"no answer from the server: {error}") from error
        if len(raw) > self.most:
            raise ContractError("the answer is too long")
        try:
            found = json.loads(raw)
        except ValueError as error:
            raise ContractError("the answer is no JSON") from error
        if not isinstance(found, dict):
            raise ContractError("the answer is no JSON object")
        return found


class ServerScorer:
    """Label probabilities from a completion server, under all rotations of the labels, averaged by action."""

    def __init__(self, transport: Callable[..., Mapping], fingerprint: Fingerprint, model_path: str, cache_prompt: bool = False):
        self.call, self.fingerprint, self.model_path, self.cache_prompt = transport, fingerprint, model_path, cache_prompt
        self.semantic_fingerprint = identity_sha256(fingerprint, cache_prompt)
        self.ready = False
        self.counts = {"requests": 0, "scored": 0}

    def preflight(self) -> None:
        """Raises unless the live server is the one of the fingerprint; says everything that differs.

        What is asked of which endpoint, what is read from its answer and what
        that must be stand in one table.
        """
        known = self.fingerprint
        wanted = [
            ("build", "GET", "/props", None, lambda a: a.get("build_info"), known.backend_version),
            ("model file", "GET", "/props", None, lambda a: a.get("model_path"), self.model_path),
            ("file name", "GET", "/props", None, lambda a: re.split(r"[/\\]", str(a.get("model_path")))[-1], known.file_name),
            ("template", "GET", "/props", None, lambda a: hashlib.sha256(str(a.get("chat_template", "")).encode()).hexdigest(), known.template_sha256),
            *(("token of " + label, "POST", "/tokenize", {"content": label, "add_special": False, "parse_special": False, "with_pieces": True}, lambda a, label=label: _one_token(a, label), token)
              for label, token in zip(LABELS, known.token_ids, strict=True)),
        ]
        answers: dict[str, Mapping] = {}
        differing = []
        for what, method, path, payload, told, expected in wanted:
            asked = f"{path} {payload}"
            if asked not in answers:
                answers[asked] = self.call(method, path, payload)
            if told(answers[asked]) != expected:
                differing.append(what)
        if differing:
            raise ContractError(f"the server is another: {', '.join(differing)}")
        self.ready = True

    def payload(self, prompt: str, free: bool = False) -> dict:
        """One token, no randomness; only labels unless ``free``."""
        plain = {"prompt": prompt, "n_predict": 1, "stream": False, "return_tokens": True, "cache_prompt": self.cache_prompt, "seed": 0, "temperature": 1.0, "top_k": 0, "top_p": 1.0, "min_p": 0.0,
                 "typical_p": 1.0, "repeat_penalty": 1.0, "presence_penalty": 0.0, "frequency_penalty": 0.0, "mirostat": 0}
        if free:
            return plain | {"n_probs": AUDITED, "min_keep": 1, "post_sampling_probs": False}
        return plain | {"logit_bias": [[i, LABEL_BIAS] for i in self.fingerprint.token_ids], "n_probs": len(LABELS), "min_keep": len(LABELS), "post_sampling_probs": True}

    def render(self, messages: Sequence[Mapping]) -> str:
        prompt = self.call("POST", "/apply-template", {"messages": list(messages), "add_generation_prompt": True}).get("prompt")
        if not isinstance(prompt, str) or not prompt:
            raise ContractError("the server renders no prompt")
        return prompt

    def score(self, batch: Sequence[Sequence[Mapping]]) -> np.ndarray:
        """One row of action probabilities per list of messages; all are checked before the first request."""
        if not self.ready:
            raise ContractError("preflight comes first")
        answers = []
        for messages in [checked_messages(m) for m in batch]:
            for turn in range(len(cyclic_orders())):
                answers.append(self.call("POST", "/completion", self.payload(self.render(cyclic_messages(messages, turn)))))
                self.counts["requests"] += 1
        rows = [r["scores"] for r in read(answers, self.fingerprint.token_ids, label_scores)] if answers else []
        self.counts["scored"] += len(rows)
        turns = len(cyclic_orders())
        return np.array([average_orders(rows[k: k + turns]) for k in range(0, len(rows), turns)]).reshape(-1, len(ACTIONS))

    def audit(self, batch: Sequence[Sequence[Mapping]]) -> list[Row]:
        """What the server would say freely to each list of messages."""
        if not self.ready:
            raise ContractError("preflight comes first")
        answers = [self.call("POST", "/completion", self.payload(self.render(m), free=True)) for m in [checked_messages(m) for m in batch]]
        return read(answers, self.fingerprint.token_ids, audits) if answers else []


def _one_token(answer: Mapping, label: str) -> int | None:
    """The id of the only token of an answer, given bare or with its text, which must be the label."""
    match answer.get("tokens"):
        case [bool()]:
            return None
        case [int(token)] | [{"id": int(token), "piece": str(_)}] | [{"id": int(token)}] if not isinstance(token, bool):
            one = answer["tokens"][0]
            return token if isinstance(one, int) or one.get("piece", label) == label else None
    return None


class LocalScorer:
    """Label probabilities from a model in this process: the softmax over the labels' logits at the last position.

    ``encode`` turns a prompt into token ids, ``logits`` a list of id lists into
    one row of final-position logits each; any library can stand behind them.
    """

    def __init__(self, encode: Callable[[str], Sequence[int]], logits: Callable[[Sequence[Sequence[int]]], np.ndarray], temperature: float = 1.0, labels: Sequence[str] = LABELS):
        if not temperature > 0:
            raise ContractError("the temperature must be positive")
        self.encode, self.logits, self.temperature = encode, logits, temperature
        found = [list(encode(x)) for x in labels]
        if any(len(x) != 1 for x in found) or len({x[0] for x in found}) != len(labels):
            raise ContractError("every label must be one token of its own")
        self.token_ids = [x[0] for x in found]

    def score(self, prompts: Sequence[str]) -> np.ndarray:
        if not prompts:
            return np.zeros((0, len(self.token_ids)))
        raw = np.asarray(self.logits([list(self.encode(p)) for p in prompts]), dtype=np.float64)[:, self.token_ids] / self.temperature
        if raw.shape[0] != len(prompts) or not np.isfinite(raw).all():
            raise ContractError("the model gave no finite logits for every prompt")
        grown = np.exp(raw - raw.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)


class FixedClient:
    """A double that gives the same answer, or one by number of the call, and keeps what it was asked."""

    def __init__(self, answers: str | Sequence[str]):
        self.answers, self.asked = answers, []

    def __call__(self, messages: Sequence[Mapping], **settings) -> str:
        self.asked.append((list(messages), settings))
        return self.answers if isinstance(self.answers, str) else self.answers[min(len(self.asked), len(self.answers)) - 1]


class RememberingClient:
    """Asks another client once per request; answers are kept by key in ``known``, which append_lines can write."""

    def __init__(self, client: Callable[..., str] | None, known: Mapping[str, str] | None = None):
        self.client, self.known, self.new = client, dict(known or {}), {}
        self.hits = self.misses = 0

    def __call__(self, messages: Sequence[Mapping], **settings) -> str:
        key = request_key(messages, **settings)
        if key in self.known:
            self.hits += 1
            return self.known[key]
        self.misses += 1
        if self.client is None:
            raise ContractError("no answer is kept for the request and nobody can be asked")
        answer = self.client(messages, **settings)
        if not isinstance(answer, str):
            raise ContractError("an answer is text")
        self.known[key] = self.new[key] = answer
        return answer

"""Records, strict answers, identities and scorers, with doubles in place of models and servers."""

import http.server
import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutlab.schema import ACTIONS, ContractError
from rolloutlab.scoring import identity as N
from rolloutlab.scoring import prompts as P
from rolloutlab.scoring import records as R
from rolloutlab.scoring import responses as A
from rolloutlab.scoring import server as S
from rolloutlab.scoring.cache import with_keys

IDS = (11, 7, 42)


def answer(p=(0.5, 0.3, 0.2), **change):
    made = {"truncated": False, "tokens": [11], "content": "A", "completion_probabilities": [{"top_probs": [{"id": i, "prob": x} for i, x in zip(IDS, p)]}]}
    return made | change


def scored(*answers):
    return [list(r["scores"]) for r in A.read(answers, IDS, A.label_scores)]


def test_label_scores(spark):
    legacy = answer()
    legacy["probs"] = legacy.pop("completion_probabilities")
    assert np.allclose(scored(answer(), legacy, answer((1.0, 0.0, 0.0))), [[0.5, 0.3, 0.2], [0.5, 0.3, 0.2], [1, 0, 0]])
    top = answer()["completion_probabilities"][0]["top_probs"]
    steps = lambda *entries: {"completion_probabilities": [{"top_probs": list(entries)}]}
    wrong = [({"truncated": True}, "truncated"), ({"tokens": [5]}, "token"), ({"tokens": [11, 7]}, "token"), ({"tokens": [True]}, "token"), ({"tokens": None}, "token"), ({"content": "B"}, "text"), ({"content": None}, "text"), ({"probs": []}, "probability field"),
             ({"completion_probabilities": []}, "steps"), ({"completion_probabilities": [{"top_probs": top}] * 2}, "steps"), ({"completion_probabilities": [{"top_logprobs": []}]}, "steps"), (steps(*top[:2]), "token ids"),
             (steps(*top, {"id": 11, "prob": 0.0}), "token ids"), (steps({"prob": 1.0}, *top[1:]), "token ids"), (steps({"id": 11, "prob": float("nan")}, *top[1:]), "probability"), (steps({"id": 11}, *top[1:]), "probability"), (steps({"id": 11, "prob": -0.5}, *top[1:]), "probability"),
             (steps(*({"id": i, "prob": 0.5} for i in IDS)), "not the whole mass"), (steps(*({"id": i, "prob": 0.0} for i in IDS)), "not the whole mass")]
    df = spark.createDataFrame([(json.dumps(answer(**bad)), fault) for bad, fault in wrong] + [("{", "not an answer"), (None, "not an answer"), ("{}", "not an answer"), ("[1]", "not an answer")], "r string, fault string")
    for r in df.select("r", "fault", A.label_scores(F.col("r"), IDS).alias("x")).collect():
        assert r.x.fault == r.fault and r.x.scores is None
    with pytest.raises(ContractError, match=r"1 \(text\)"):
        scored(answer(), answer(content="B"))


def free(**change):
    top = [{"id": 3, "token": "x", "logprob": math.log(0.4)}, {"id": 11, "token": "A", "logprob": math.log(0.3)}, {"id": 7, "token": "B", "logprob": math.log(0.2)}, {"id": 42, "token": "C", "logprob": math.log(0.1)}]
    return {"tokens": [3], "content": "x", "completion_probabilities": [{"id": 3, "token": "x", "top_logprobs": top} | change]}


def test_audit(spark):
    chosen = free(id=11, token="A") | {"tokens": [11], "content": "A"}
    found, named = A.read([free(), chosen], IDS, A.audits)
    assert (found.token_id, found.token, found.label, found.ranks) == (3, "x", None, [2, 3, 4]) and found.mass == pytest.approx(0.6) and np.allclose(np.exp(found.logprobs), [0.3, 0.2, 0.1])
    assert named.label == "A"
    top = free()["completion_probabilities"][0]["top_logprobs"]
    wrong = [({"id": 4}, "step"), ({"token": "y"}, "step"), ({"top_logprobs": []}, "length"), ({"top_logprobs": None}, "length"), ({"top_logprobs": top * 20}, "length"), ({"top_logprobs": top[:3]}, "label missing"), ({"top_logprobs": top[::-1]}, "order"),
             ({"top_logprobs": [*top, top[-1]]}, "repeated token"), ({"top_logprobs": [*top[:3], {"id": 42, "token": "D", "logprob": -3.0}]}, "label text"), ({"top_logprobs": [top[0] | {"logprob": 0.5}, *top[1:]]}, "entry"),
             ({"top_logprobs": [*top, {"id": 9, "token": "z", "logprob": float("-inf")}]}, "entry"), ({"top_logprobs": [*top, {"token": "z", "logprob": -9.0}]}, "entry"), ({"top_logprobs": [{"id": i, "token": t, "logprob": -0.1} for i, t in zip(IDS, "ABC")]}, "mass")]
    whole = [(free(**bad), fault) for bad, fault in wrong] + [(free() | {"truncated": True}, "truncated"), (free() | {"tokens": [3, 4]}, "token"), (free() | {"tokens": [-1]}, "token"), (free() | {"content": None}, "token"), (free() | {"completion_probabilities": []}, "step"), ({}, "not an answer")]
    df = spark.createDataFrame([(json.dumps(a), fault) for a, fault in whole], "r string, fault string")
    for r in df.select("fault", A.audits(F.col("r"), IDS).alias("x")).collect():
        assert r.x.fault == r.fault and r.x.mass is None and r.x.ranks is None


def served(**change):
    return N.Fingerprint(**({"backend_version": "b1-abc", "backend_revision": "abc", "model_repository": "r", "model_revision": "1", "file_name": "m.gguf", "file_sha256": "cd" * 32, "quantization": "q4",
                             "template_sha256": "ef" * 32, "token_ids": IDS} | change))


def test_identity():
    plain = N.identity_sha256(served())
    assert plain == N.identity_sha256(served()) and len({plain, N.identity_sha256(served(quantization="q8")), N.identity_sha256(served(), True), N.identity_sha256(served(), workers=2)}) == 4
    for bad in ({"backend_revision": "zz"}, {"file_name": "a/m.gguf"}, {"file_name": "m.bin"}, {"file_sha256": "CD" * 32}, {"token_ids": (1, 1, 2)}, {"token_ids": (1, 2)}, {"token_ids": (True, 2, 3)}, {"quantization": " q4"}):
        with pytest.raises(ContractError):
            served(**bad)
    with pytest.raises(ContractError):
        N.identity(served(), workers=0)


def test_provenance():
    found = N.runtime_provenance()
    N.require_provenance(found)
    for bad in (found | {"python": "0"}, {k: v for k, v in found.items() if k != "machine"}, found | {"more": 1}, found | {"packages": []}):
        with pytest.raises(ContractError):
            N.require_provenance(bad)


def asked(text="State"):
    return [{"role": "system", "content": "Choose."}, {"role": "user", "content": f"{text}\n{P.candidate_block()}"}]


def test_cyclic_messages():
    turned = P.cyclic_messages(asked(), 1)
    assert turned[1]["content"].endswith(P.candidate_block((1, 2, 0))) and asked()[1]["content"].endswith(P.candidate_block())
    for bad in ([], "x", [{"role": "user"}], [{"role": "boss", "content": "x"}], [*asked(), {"role": "assistant", "content": "A"}], [{"role": "user", "content": "none"}],
                [{"role": "user", "content": f"{P.candidate_block()}\n{P.candidate_block()}"}], [{"role": "system", "content": P.candidate_block()}, *asked()]):
        with pytest.raises(ContractError):
            P.checked_messages(bad)
    with pytest.raises(ContractError):
        P.cyclic_messages(asked(), 3)


TEMPLATE = "{{ messages }}"


class Server:
    """Answers as a completion server does; A is likely whatever it stands for, and the last action adds to it."""

    def __init__(self, **change):
        import hashlib

        self.fingerprint = served(template_sha256=hashlib.sha256(TEMPLATE.encode()).hexdigest())
        self.change, self.asked = change, []

    def __call__(self, method, path, payload=None):
        self.asked.append(path)
        if path in self.change:
            return self.change[path]
        if path == "/props":
            return {"build_info": "b1-abc", "model_path": "/models/m.gguf", "chat_template": TEMPLATE}
        if path == "/tokenize":
            return {"tokens": [{"id": dict(zip("ABC", IDS))[payload["content"]], "piece": payload["content"]}]}
        if path == "/apply-template":
            return {"prompt": payload["messages"][-1]["content"]}
        lines = payload["prompt"].split("\n")[-3:]
        p = np.array([0.6 if i == 0 else 0.1 for i in range(3)]) + np.array([0.2 if P.DESCRIPTIONS[2] in line else 0.0 for line in lines])
        return answer(tuple((p / p.sum()).tolist())) if payload["n_probs"] == 3 else free()


def test_server_scorer(spark):
    live = Server()
    scorer = S.ServerScorer(live, live.fingerprint, "/models/m.gguf")
    with pytest.raises(ContractError, match="preflight"):
        scorer.score([asked()])
    scorer.preflight()
    got = scorer.score([asked(), asked("Other")])
    assert got.shape == (2, 3) and got.sum(axis=1) == pytest.approx([1, 1]) and (got[:, 2] > got[:, 0]).all() and got[0, 0] == pytest.approx(got[0, 1])
    assert scorer.counts == {"requests": 6, "scored": 6} and scorer.score([]).shape == (0, 3)
    assert scorer.audit([asked()])[0].mass == pytest.approx(0.6)
    before = len(live.asked)
    with pytest.raises(ContractError):
        scorer.score([asked(), [{"role": "user", "content": "no block"}]])
    assert len(live.asked) == before  # nothing is asked before all is checked


@pytest.mark.parametrize("change", [{"/props": {"build_info": "b2", "model_path": "/models/m.gguf", "chat_template": TEMPLATE}}, {"/props": {"build_info": "b1-abc", "model_path": "/other/m.gguf", "chat_template": TEMPLATE}},
                                    {"/props": {"build_info": "b1-abc", "model_path": "/models/m.gguf", "chat_template": "other"}}, {"/tokenize": {"tokens": [11, 7]}}, {"/tokenize": {"tokens": [{"id": 11, "piece": "Z"}]}}, {"/tokenize": {"tokens": [5]}}, {"/tokenize": {"tokens": [True]}}, {"/tokenize": {}}])
def test_preflight_refuses(change):
    live = Server(**change)
    scorer = S.ServerScorer(live, live.fingerprint, "/models/m.gguf")
    with pytest.raises(ContractError):
        scorer.preflight()
    assert not scorer.ready


def test_preflight_says_all_that_differs():
    live = Server(**{"/props": {"build_info": "b2", "model_path": "C:\\models\\other.gguf", "chat_template": "x"}, "/tokenize": {"tokens": [11]}})
    with pytest.raises(ContractError, match="build, model file, file name, template, token of B, token of C"):
        S.ServerScorer(live, live.fingerprint, "/models/m.gguf").preflight()
    assert live.asked.count("/props") == 1


def test_local_scorer():
    vocabulary = {"A": 0, "B": 1, "C": 2}
    encode = lambda text: [vocabulary.get(text, 3)]
    logits = lambda rows: np.array([[2.0, 1.0, 0.0, 9.0]] * len(rows))
    got = S.LocalScorer(encode, logits, temperature=2.0).score(["p", "q"])
    want = np.exp([1.0, 0.5, 0.0])
    assert np.allclose(got, want / want.sum()) and S.LocalScorer(encode, logits).score([]).shape == (0, 3)
    with pytest.raises(ContractError):
        S.LocalScorer(lambda text: [1, 2], logits)
    with pytest.raises(ContractError):
        S.LocalScorer(lambda text: [3], logits)
    with pytest.raises(ContractError):
        S.LocalScorer(encode, lambda rows: np.full((len(rows), 4), np.nan)).score(["p"])


def test_clients():
    fixed = S.FixedClient(["one", "two"])
    client = S.RememberingClient(fixed)
    assert client(asked(), model_id="m") == client(asked(), model_id="m") == "one" and client(asked("x"), model_id="m") == "two"
    assert (client.hits, client.misses, len(fixed.asked)) == (1, 2, 2)
    with pytest.raises(ContractError):
        S.RememberingClient(None, client.known)(asked("y"), model_id="m")
    assert S.RememberingClient(None, client.known)(asked(), model_id="m") == "one"


def test_transport():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/ok": b'{"a": 1}', "/list": b"[1]", "/text": b"x", "/long": b'{"a": "' + b"y" * 500 + b'"}'}.get(self.path)
            if body is None:
                self.send_response(302)
                self.send_header("Location", "/ok")
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = S.JsonTransport(f"http://127.0.0.1:{server.server_port}", timeout=5, most=100)
    assert call("GET", "/ok") == {"a": 1}
    for path in ("/list", "/text", "/long", "/moved", "//evil"):
        with pytest.raises(ContractError):
            call("GET", path)
    server.shutdown()
    for origin in ("ftp://x", "http://x/path", "http://u:p@x", "http://x?q=1", "x"):
        with pytest.raises(ContractError):
            S.JsonTransport(origin)


def test_records(spark, tmp_path):
    request = R.Request("m", "r1", "v1", fingerprint="ab" * 32)
    base = spark.createDataFrame([(f"k{i}", "p" * 64, [0.2, 0.3, 0.5]) for i in range(3)], "key string, prompt string, p array<double>")
    lines = base.select(R.record_text(request, F.col("key"), F.col("prompt"), F.col("p")).alias("value"))
    lines.unionByName(lines).write.text(str(tmp_path / "good"))
    records = R.read_records(spark, str(tmp_path / "good"))
    keyed = base.select("key", F.col("prompt").alias("prompt_sha256"))
    assert all(r.target == pytest.approx([0.2, 0.3, 0.5]) for r in R.replay_records(keyed, records, request).collect())
    for other in (R.Request("m", "r2", "v1", fingerprint="ab" * 32), R.Request("m", "r1", "v2", fingerprint="ab" * 32), R.Request("m", "r1", "v1"), R.Request("m", "r1", "v1", logit_temperature=2.0, fingerprint="ab" * 32)):
        with pytest.raises(ContractError, match="no matching record"):
            R.replay_records(keyed, records, other)
    with pytest.raises(ContractError, match="no matching record"):
        R.replay_records(keyed.withColumn("prompt_sha256", F.lit("q")), records, request)
    with pytest.raises(ContractError, match="no matching record"):
        R.replay_records(keyed.withColumn("key", F.lit("unknown")), records, request)
    changed = base.withColumn("p", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))).select(R.record_text(request, F.col("key"), F.col("prompt"), F.col("p")).alias("value"))
    lines.unionByName(changed).write.text(str(tmp_path / "conflict"))
    with pytest.raises(ContractError, match="conflicting"):
        R.read_records(spark, str(tmp_path / "conflict"))
    lines.select(F.replace("value", F.lit("0.5"), F.lit("0.9")).alias("value")).write.text(str(tmp_path / "bad"))
    with pytest.raises(ContractError, match="faulty"):
        R.read_records(spark, str(tmp_path / "bad"))
    assert R.request_of({"model_id": "m", "model_revision": "r", "prompt_version": "v", "choice_tokens": ["A", "B", "C"]}).choice_tokens == ("A", "B", "C")
    for bad in ({"model_id": ""}, {"choice_tokens": ["A", "A", "B"]}, {"logit_temperature": 0}, {"fingerprint": "x"}, {"colour": 1}):
        with pytest.raises(ContractError):
            R.request_of({"model_id": "m", "model_revision": "r", "prompt_version": "v"} | bad)


def test_a_missing_note_is_fatal(spark):
    df = spark.createDataFrame([(1, None)], "x int, note string")
    assert with_keys(df, ["x"], "m", "note").count() == 1
    with pytest.raises(Exception, match="needs a note"):
        with_keys(df, ["x"], "m", "note", required=True).collect()


def test_actions_have_descriptions():
    assert len(P.DESCRIPTIONS) == len(ACTIONS) == len(P.LABELS)

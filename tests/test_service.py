"""Requests and commands over a small index."""

import json
import threading
import urllib.request

import pytest

from corpusloom import __main__ as commands
from corpusloom import fixed
from corpusloom.operators import lifecycle
from corpusloom.service import Service, serve
from corpusloom.sources import readers


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('service')}/index"
    rows = [(f"acts/{i}", f"section {i} of the act on tea", "acts") for i in range(6)] + [(f"judgments/{i}", f"the court held number {i} on coffee", "judgments") for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, category string")
    lifecycle.build_index(chunks, path)
    cases = spark.createDataFrame([("tea section 3", ["acts/3"], "acts"), ("coffee 4", ["judgments/4", "judgments/9"], "judgments")], "query string, relevant_ids array<string>, category string")

    def model(system, user, history=()):
        if "fail" in user:
            raise OSError("down")
        return f"So says (S1), after {len(history)} turns."

    return Service(spark, path, chunks, model, cases)


def asked(service, question, path="/chat", **more):
    status, kind, content = service.handle("POST", path, json.dumps({"question": question, **more}).encode())
    return status, json.loads(content) if kind == "application/json" else content


def test_chat(service):
    status, got = asked(service, " tea? ", conversation_history=[{"role": "user", "content": "hi"}, {"role": "assistant", "content": " "}])
    assert status == 200 and got["question"] == "tea?" and got["answer"] == "So says [S1], after 1 turns." and got["validation"]["valid"]
    assert got["evidence"][0]["chunk_id"].startswith("acts/") and got["used_count"] == got["retrieved_count"] == 8
    assert {c["chunk_id"].split("/")[0] for c in got["related_cases"]} == {"judgments"} and got["limitations"][-1] == fixed.ADVICE_LIMITATION
    status, pdf = asked(service, "tea", "/chat/pdf")
    assert status == 200 and pdf.startswith(b"%PDF-1.4")


def test_statuses(service, spark):
    assert asked(service, " ")[0] == asked(service, "x" * 2001)[0] == asked(service, 7)[0] == service.handle("POST", "/chat", b"no json")[0] == 422
    assert asked(service, "tea", conversation_history=[{"role": "system", "content": "x"}])[0] == 422
    assert asked(service, "fail tea")[0] == 503
    assert service.handle("GET", "/nowhere")[0] == 404 and service.handle("GET", "/chat")[0] == 405 and service.handle("GET", "/")[0] == 200
    lost = Service(spark, service.index_path + "x", service.chunks, lambda system, user: "")
    assert asked(lost, "tea")[0] == 500 and lost.handle("GET", "/eval")[0] == 500
    broken = Service(spark, service.index_path, service.chunks.drop("chunk_id"), lambda system, user: "x")
    assert asked(broken, "tea")[0] == 502


def test_evaluation(service):
    status, _, content = service.handle("GET", "/eval?k=1,3")
    got = json.loads(content)
    assert status == 200 and got["k_values"] == [1, 3] and got["categories"]["acts"]["1"]["precision"] == 1 and got["categories"]["judgments"]["3"]["recall"] == 0.5
    assert got["overall_macro"]["3"]["recall"] == 0.75
    assert service.handle("GET", "/eval?k=0")[0] == service.handle("GET", "/eval?k=x")[0] == 400


def test_over_http(service):
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as reply:
            assert reply.status == 200 and json.load(reply)["status"] == "ok"
    finally:
        server.shutdown()


def test_commands(spark, tmp_path, capsys):
    for category, n in (("acts", 7), ("judgments", 6)):
        (tmp_path / "raw" / category).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "raw" / category / f"d{i}.txt").write_text(f"Section {i}\nAbout {category} number {i}.")
    (tmp_path / "raw" / "acts" / "d6.meta.yaml").write_text("category: Judgments\njurisdiction: EU\nparties: [A, B]\n")
    config = {
        "ingest": {"raw_dir": f"file://{tmp_path}/raw", "processed_dir": f"file://{tmp_path}/out", "chunks_file": "chunks", "categories": [{"name": "acts", "preset": "acts", "jurisdiction": "IN"}, {"name": "judgments", "strategy": "sentence"}, {"name": "none"}]},
        "chunking": {"strategy": "pattern"},
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    assert commands.main(["ingest", "--config", str(tmp_path / "config.json")]) == 0
    chunks, path = f"file://{tmp_path}/out/chunks", f"file://{tmp_path}/index"
    assert json.loads(capsys.readouterr().out)["chunks"] == 13
    told = {r["chunk_id"]: r["jurisdiction"] for r in readers.read_chunks(spark, chunks).collect()}
    # What a sidecar says goes before the folder.
    assert told["judgments/d6/0"] == "EU" and "acts/d6/0" not in told and "acts/d3/0" in told
    assert commands.main(["index", "--chunks", chunks, "--path", path, "--resume"]) == 1
    assert commands.main(["index", "--chunks", chunks, "--path", path]) == 0
    assert commands.main(["index", "--chunks", chunks, "--path", path, "--resume"]) == 0
    (tmp_path / "cases.jsonl").write_text(json.dumps({"query": "acts number 3", "relevant_ids": ["acts/d3/0"], "category": "acts"}) + "\n")
    capsys.readouterr()
    assert commands.main(["evaluate", "--path", path, "--cases", f"file://{tmp_path}/cases.jsonl", "--out", f"file://{tmp_path}/report", "--k-values", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["categories"]["acts"]["1"]["precision"] == 1
    assert commands.main(["ingest", "--config", str(tmp_path / "nothing.json")]) == 1

"""Manifests, configurations, cache, backends, a whole run through the command line, and streaming."""

import hashlib
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from docgauge import cli
from docgauge.functions.parse import parse_json
from docgauge.operators import corpus
from docgauge.operators.scoring import FieldSpec
from docgauge.plans import evaluate
from docgauge.plans import queries as plans
from docgauge.sources import backends, config, images, manifest, runs
from docgauge.sources.cache import Cache
from docgauge.streaming.scoring import answer_stream, score_stream

SCHEMA = {"fields": [{"name": "name", "fuzzy_threshold": 0.9}, {"name": "crm", "compare": "digits", "critical": True}]}


@pytest.fixture
def folder(tmp_path):
    rows = [{"id": f"c{i:02d}", "image": "x.jpg", "truth": {"name": f"Person {i}", "crm": None if i % 3 == 0 else f"CRM {i}00"}, "tags": ["a" if i % 2 else "b"]} for i in range(12)]
    (tmp_path / "manifest.jsonl").write_text("# a corpus\n\n" + "\n".join(map(json.dumps, rows)))
    (tmp_path / "schema.json").write_text(json.dumps(SCHEMA))
    (tmp_path / "x.jpg").write_bytes(b"picture")
    for name, noise in (("one", 0.0), ("two", 0.9)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"runner": "mock", "params": {"noise": noise, "seed": "${SEED:-7}"}, "prompt_text": 'Say "Person 1" if unsure'}))
    return tmp_path


def test_manifest(spark, folder):
    cases = manifest.read_cases(spark, str(folder / "manifest.jsonl"))
    assert cases.count() == 12 and corpus.narrow(cases, ["a"], None, 2).select("id").collect()[0][0] == "c01"
    assert corpus.narrow(cases, None, ["a"]).count() == 6
    assert corpus.manifest_problems(manifest.read_lines(spark, str(folder / "manifest.jsonl")), ["name", "crm"]).count() == 0


def test_every_problem_is_told(spark):
    lines = ["{bad", '{"id": "a", "image": "i", "truth": {}}', '{"id": "a", "image": "i", "truth": {}}', '{"image": "", "truth": [1]}', '{"id": "b", "image": "i", "truth": {"zip": 1}}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "lineno long, line string")
    got = {(r["lineno"], r["problem"]) for r in corpus.manifest_problems(df, ["name"]).collect()}
    assert got == {(1, "not a JSON object"), (3, "duplicate id a"), (4, "missing id"), (4, "missing image"), (4, "truth is not an object"), (5, "unknown truth keys: zip")}
    nothing = spark.createDataFrame([(1, "# only a note")], "lineno long, line string")
    assert corpus.manifest_problems(nothing, []).collect()[0]["problem"] == "no cases"


def test_corpus_hash_ignores_order(spark):
    rows = [(f"c{i}", "", json.dumps({"a": i})) for i in range(20)]
    of = lambda r: corpus.corpus_hash(spark.createDataFrame(r, "id string, image_hash string, truth string")).first()[0]
    assert of(rows) == of(rows[::-1]) != of(rows[:-1])


def test_config(folder, monkeypatch):
    c = config.load_config(str(folder / "one.json"))
    assert c.params["seed"] == "7" and c.name == "one"
    monkeypatch.setenv("SEED", "9")
    assert config.load_config(str(folder / "one.json")).params["seed"] == "9"
    assert config.expand(["a${NOT_THERE}b", {"k": "${EMPTY:-x}"}, 1], {"EMPTY": ""}) == ["ab", {"k": "x"}, 1]
    (folder / "p.txt").write_text("Read.")
    (folder / "three.json").write_text(json.dumps({"prompt_file": "p.txt", "something": "else", "host": "a, b,"}))
    three = config.load_config(str(folder / "three.json"))
    assert (three.prompt, three.hosts, three.runner) == ("Read.", ["a", "b"], "ollama")
    (folder / "three.json").write_text(json.dumps({"prompt": "nowhere.txt"}))
    with pytest.raises(FileNotFoundError, match="nowhere"):
        config.load_config(str(folder / "three.json"))
    other = config.Config("other", weights={"a": 2.0}, host="h")
    assert other.hash == config.Config("x").hash != config.Config("x", model="m").hash
    schema = config.Schema([FieldSpec("a", critical=True), FieldSpec("b", weight=0.5)])
    assert config.scoring_policy(schema, config.Config("x", weights={"a": 2.0}, critical_fields=["b"])) == ({"a": 2.0, "b": 0.5}, ["a", "b"])
    assert schema.hash == config.Schema([FieldSpec("a"), FieldSpec("b", "digits")]).hash


@pytest.mark.parametrize(("raw", "k"), [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('Sure: {"k": 3}. Done', 3), ('[{"k": 4}, {}]', 4), ("{broken", None), ("", None), ("[1]", None), (None, None)])
def test_json_recovery(spark, raw, k):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(F.try_variant_get(parse_json(F.col("raw")), "$.k", "int")).first()[0] == k


def test_cache(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    put = lambda *rows: cache.put(spark.createDataFrame(list(rows), "key string, config_hash string, case_id string, payload string, created_at string"))
    put(("k1", "c1", "a", "old", "1"), ("k2", "c2", "a", "x", "1"))
    put(("k1", "c1", "a", "new", "2"))
    assert {r["key"]: r["payload"] for r in cache.rows().collect()} == {"k1": "new", "k2": "x"}
    assert cache.clear("c1") == 1 and cache.stats()["entries"] == 1 and cache.clear() == 1
    (tmp_path / "file").write_text("")
    off = Cache(spark, str(tmp_path / "file" / "below"))
    assert not off.enabled and off.rows().count() == 0


def test_mock_backend_does_not_depend_on_partitions(spark, folder):
    cases = manifest.read_cases(spark, str(folder / "manifest.jsonl")).withColumn("truth_json", F.to_json("truth"))
    schema = config.load_schema(str(folder / "schema.json")).json_schema()
    mock = backends.build("mock", params={"noise": 0.7, "hallucinate": 0.5})
    got = [sorted((r["case_id"], r["data"]) for r in backends.infer(cases, mock, "", schema, n).collect()) for n in (1, 5)]
    assert got[0] == got[1] and len({d for _, d in got[0]}) > 6
    with pytest.raises(ValueError, match="unknown backend"):
        backends.build("nothing")
    body = backends.Http("m", {"temperature": 0}).request(b"x", "p", schema)
    assert body["format"] == schema and body["images"] == ["eA=="] and body["options"] == {"temperature": 0} and body["keep_alive"] == "5m"
    body = backends.Http("m", {"format": "json", "top_p": 0.5, "timeout": 3, "keep_alive": "1m"}).request(b"", "p", schema)
    assert body["format"] == "json" and body["options"] == {"temperature": 0, "top_p": 0.5} and body["keep_alive"] == "1m"
    assert "format" not in backends.Http("m", {"format": "none"}).request(b"", "p", schema)
    assert [backends.made_up(k, {"type": t}) for k, t in (("member_id", "string"), ("crm", ["string", "null"]), ("name", "string"), ("n", "integer"), ("x", "array"), ("b", "boolean"))] == ["99999999", "99999999", "VALOR INVENTADO", 42, ["ITEM INVENTADO"], True]


def test_a_backend_that_raises_gives_error_rows(spark):
    class Broken(backends.Backend):
        def extract(self, *_):
            raise RuntimeError("no")

    got = backends.infer(spark.createDataFrame([("a",)], "id string"), Broken(), "", {}).first()
    assert got["error"] == "RuntimeError: no" and got["data"] is None


def test_images():
    assert images.prepare(b"abc", "none") == b"abc" and "padrao" in images.available()
    with pytest.raises(ValueError, match="unknown"):
        images.prepare(b"", "unknown")
    assert images.describe("unknown") == {"name": "unknown", "unknown": True}
    assert images.describe("maxima") == {"name": "maxima", "max_side": 2560, "format": "PNG", "quality": 88, "grayscale": True, "contrast": 1.3, "sharpness": 1.4, "drop_green": False, "flat_field": False}
    assert images.scaled((100, 50), 1440) == (1440, 720) and images.scaled((4000, 1), 2048) == (2048, 1) and images.scaled((7, 9), 0) == (7, 9)


class Server(http.server.BaseHTTPRequestHandler):
    asked = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, body))
        bad = body.get("prompt") == "fail"
        said = {"details": {"family": "f"}} if self.path == "/api/show" else {"response": "no JSON" if body.get("prompt") == "talk" else '{"name": "x"}', "prompt_eval_count": 3, "eval_count": 2}
        self.answer(500 if bad else 200, "broken" if bad else json.dumps(said))

    def do_GET(self):
        self.answer(200, json.dumps({"models": [{"name": "m", "digest": "0123456789abcdef0123", "size": 5}], "version": "9"}))

    def answer(self, code, text):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *_):
        pass


def test_http_backend():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        backend = backends.Http("m", hosts=[f"http://127.0.0.1:{server.server_port}/"])
        said = backend.extract(backends.Question(b"x", "p", {"type": "object"}))
        assert (said["raw"], said["tokens_in"], said["tokens_out"]) == ('{"name": "x"}', 3, 2) and Server.asked[0][0] == "/api/generate"
        assert backend.extract(backends.Question(prompt="fail"))["error"] == "HTTP 500: broken"
        assert backend.describe() == {"runner": "ollama", "model": "m", "hosts": backend.hosts, "family": "f", "model_digest": "0123456789abcdef", "model_size_bytes": 5, "server_version": "9"}
    finally:
        server.shutdown()
    assert "error" in backends.Http("m", hosts=["http://127.0.0.1:9"], timeout=1).extract(backends.Question())


def test_runs_read_images(spark, folder):
    schema, seen = config.load_schema(str(folder / "schema.json")), folder / "seen"
    seen.mkdir()
    cases = manifest.read_cases(spark, str(folder / "manifest.jsonl"))
    found = images.of_corpus(spark, str(folder), cases)
    hashed = cases.join(images.hashed(found), "image", "left")
    assert {r[0] for r in hashed.select("image_hash").collect()} == {hashlib.sha256(b"picture").hexdigest()[:16]}

    class Looks(backends.Backend):
        def extract(self, asked):
            return {"raw": "words" if asked.case_id == "c01" else json.dumps({"name": asked.image.decode()})}

    said = {r["case_id"]: r for r in evaluate.answers(hashed, schema, config.Config("x"), Looks(), images=found).collect()}
    assert said["c00"]["raw"] == '{"name": "picture"}' and said["c01"]["error"] == "output was not valid JSON" and said["c01"]["predicted"] is None
    other = evaluate.answers(hashed, schema, config.Config("x", preprocess="alta"), Looks(), images=found).first()
    assert "Pillow" in other["error"] or "Error" in other["error"]


def test_recorded_predictions(spark, folder):
    (folder / "said.jsonl").write_text('{"id": "c01", "predicted": {"name": "first"}}\n{"id": "c01", "predicted": {"name": "last"}}\n')
    schema, cases = config.load_schema(str(folder / "schema.json")), manifest.read_cases(spark, str(folder / "manifest.jsonl"))
    c = config.Config("x", "mock", "mock", {"predictions": str(folder / "said.jsonl")})
    said = {r["case_id"]: json.loads(r["raw"]) for r in evaluate.answers(cases, schema, c, backends.build_for(c)).collect()}
    assert said["c01"] == {"name": "last"} and said["c02"] == {"name": "Person 2", "crm": "CRM 200"}


def test_line_numbers_of_a_file_in_pieces(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = manifest.read_lines(spark, str(tmp_path / "m.jsonl"))
        assert lines.rdd.getNumPartitions() > 3 and all(r["line"] == f"line {r['lineno']}" for r in lines.collect()) and lines.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_images_are_told(spark, folder, capsys):
    (folder / "x.jpg").unlink()
    assert cli.main(["validate", "--corpus", str(folder)]) == 3
    assert capsys.readouterr().out.count("image not found: x.jpg") == 12


def test_run_documents(spark, tmp_path):
    run = {"name": "r", "corpus_hash": "h", "field_names": ["a"], "finished_at": "2026-01-02", "cases": [{"case_id": "c", "tags": ["t"], "fields": [{"field": "a", "outcome": "correct", "truth": True, "predicted": "sim", "score": 1.0, "detail": ""}], "latency_ms": 5.0}]}
    (tmp_path / "r.json").write_text(json.dumps(run, indent=1))
    (tmp_path / "bad.json").write_text("{nothing")
    read = runs.read_runs(spark, str(tmp_path / "*.json"))
    fields, cases = runs.facts(read)
    assert [r["name"] for r in runs.list_runs(read).collect()] == ["r"]
    assert fields.first()["outcome"] == "correct" and cases.first()["latency_ms"] == 5.0


def test_command_line(spark, folder, capsys):
    runs_dir, cache = str(folder / "runs"), str(folder / "cache")
    common = ["--runs-dir", runs_dir, "--cache-dir", cache, "--bootstrap", "0"]
    assert cli.main(["validate", "--corpus", str(folder)]) == 0
    assert cli.main(["run", "--corpus", str(folder), "--config", str(folder / "one.json"), *common]) == 0
    assert cli.main(["run", "--corpus", str(folder), "--config", str(folder / "one.json"), *common]) == 3  # it is there already
    assert cli.main(["run", "--corpus", str(folder), "--config", str(folder / "two.json"), "--fail-under", "0.99", *common]) == 2
    capsys.readouterr()
    assert cli.main(["report", "one", "--runs-dir", runs_dir, "--format", "json", "--bootstrap", "0"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["run"]["macro_accuracy"] == 1.0 and len(shown["fields"]) == 2
    assert cli.main(["diff", "one", "two", "--runs-dir", runs_dir, "--bootstrap", "200", "--fail-on-regression"]) == 2
    assert cli.main(["echo", "one", "--config", str(folder / "one.json"), "--runs-dir", runs_dir]) == 0
    document = str(folder / "one.run.json")
    assert cli.main(["run", "--corpus", str(folder), "--config", str(folder / "one.json"), "--document", document, "--overwrite", *common]) == 0
    told = json.loads((folder / "one.run.json").read_text())
    assert len(told["cases"]) == 12 and told["provenance"]["backend"]["runner"] == "mock" and told["cases"][1]["fields"][0]["field"] == "name" and told["cases"][0]["cached"]
    capsys.readouterr()
    assert cli.main(["report", document, "--format", "json", "--bootstrap", "0"]) == 0
    again = json.loads(capsys.readouterr().out)
    assert again["run"]["macro_accuracy"] == 1.0 and again["selective"]["coverage_for"]["0.95"] == 1.0
    assert cli.main(["report", "two", "--runs-dir", runs_dir, "--format", "md", "--bootstrap", "0"]) == 0
    assert "accuracy of 0.99 at least" in capsys.readouterr().out
    assert cli.main(["list", "--runs-dir", runs_dir]) == 0 and capsys.readouterr().out.split() == ["one", "two"]
    assert cli.main(["list", "--runs-dir", runs_dir]) == 0 and cli.main(["cache", "--cache-dir", cache]) == 0
    assert cli.main(["report", "no such run", "--runs-dir", runs_dir]) == 3


def test_streaming_scores_each_answer_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps({"run": "r", "case_id": f"c{i}", "truth": {"a": "x"}, "predicted": {"a": "X" if i else "y"}, "error": ""}))
    for _ in range(2):
        score_stream(answer_stream(spark, str(source), 1), [FieldSpec("a")], str(tmp_path / "out"), str(tmp_path / "check"), True).awaitTermination()
    got = {r["case_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"c0": "wrong", "c1": "correct", "c2": "correct"} and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

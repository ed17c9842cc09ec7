"""Sources and sinks."""

import hashlib
import json
import subprocess
import tomllib
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators.quality import GateError
from millrace.sinks import outputs
from millrace.sources import config, lines, repository


def test_numbered_lines(spark, tmp_path):
    sub = tmp_path / "s1" / "subagents"
    sub.mkdir(parents=True)
    (tmp_path / "s1.jsonl").write_bytes(b"one\r\ntwo\rthree\n\xff\n" + b"z" * 3_000_000)
    (sub / "run-1.jsonl").write_text("{}\n")
    (sub / "run-1.meta.json").write_text('{"agentType": "reviewer",\n "description": "d"}')
    (sub / "run-2.jsonl").mkdir()
    df = lines.read_lines(spark, {"p": str(tmp_path)})
    got = {(r.src.rsplit("/", 1)[1], r.line): (r.json or "")[:5] for r in df.where("error IS NULL").collect()}
    assert got == {("s1.jsonl", 1): "one", ("s1.jsonl", 2): "two", ("s1.jsonl", 3): "three", ("s1.jsonl", 4): "\ufffd", ("s1.jsonl", 5): "zzzzz", ("run-1.jsonl", 1): "{}"}
    assert df.where("error IS NOT NULL").count() == 1
    p = {r.run_id: (r.in_sub_dir, r.parent_session) for r in lines.with_path_columns(df).collect()}
    assert p["run-1"] == (True, "s1") and p["s1"] == (False, None)
    meta = {r.src.rsplit("/", 1)[1]: (r.agent_type, r.state) for r in lines.with_sidecars(df.select("src").distinct(), lines.sidecars(spark, {"p": str(tmp_path)})).collect()}
    assert meta == {"run-1.jsonl": ("reviewer", "read"), "s1.jsonl": (None, "missing"), "run-2.jsonl": (None, "missing")}
    assert lines.read_lines(spark, {"p": str(tmp_path / "none")}).isEmpty()


def test_repository(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t.test", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "a.txt").write_text("first")
    (root / "link").symlink_to("../out")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "b.txt").write_text("second")
    run("add", ".")
    run("commit", "-qm", "two")
    (root / "c.txt").write_text("untracked")
    got = {r.path: (r.kind, bytes(r.data) if r.data is not None else None) for r in repository.read_revision(spark, str(root)).collect()}
    assert got == {"a.txt": ("file", b"first"), "b.txt": ("file", b"second"), "link": ("symlink", None)}
    changed = repository.changed(str(root), "HEAD~1", "HEAD")
    assert changed == ["b.txt"] and repository.read_revision(spark, str(root), "HEAD", changed).count() == 1
    tree = {r.path: (r.kind, r.escapes) for r in repository.read_working_tree(spark, str(root)).collect()}
    assert tree == {"a.txt": ("file", None), "b.txt": ("file", None), "c.txt": ("file", None), "link": ("symlink", True)}
    out = tmp_path / "export"
    assert outputs.export_tree(repository.read_revision(spark, str(root)), str(out)) == 2 and (out / "b.txt").read_text() == "second"
    bad = spark.createDataFrame([("../x", "file", bytearray(b"x"))], "path string, kind string, data binary")
    with pytest.raises(GateError):
        outputs.export_tree(bad, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists() and not (tmp_path / "x").exists()


def test_settings(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text('{"models": {"m-a": {"input": 10, "read": 0.025}}}')
    assert config.read_prefixes(spark, str(f)).first().numbers["read"] == Decimal("0.0250")
    f.write_text('{"models": {"m-a": {"input": -1}}}')
    with pytest.raises(config.InputError):
        config.read_prefixes(spark, str(f))
    f.write_text('{"changes": [{"date": "2021-01-12", "description": "d", "metrics": ["calls"]}]}')
    assert config.read_changes(spark, str(f), {"calls"}).first().scope == "all"
    for bad in ('{"date": "2021-1-12", "description": "d"}', '{"date": "2021-01-12", "description": " "}', '{"date": "2021-01-12", "description": "d", "metrics": ["x"]}', '{"date": "2021-01-12", "description": "d", "scope": "x"}'):
        f.write_text(f'{{"changes": [{bad}]}}')
        with pytest.raises(config.InputError):
            config.read_changes(spark, str(f), {"calls"})
    assert config.resolve_profiles([f"work={tmp_path}"], "/nohome", {}) == {"default": "/nohome/logs", "work": str(tmp_path)}
    assert config.resolve_profiles([f"mine={tmp_path}"], "/nohome", {"MILLRACE_LOGS": str(tmp_path)}) == {"mine": str(tmp_path)}
    with pytest.raises(config.InputError):
        config.resolve_profiles([f"default={tmp_path}"], "/nohome", {})
    f.write_text("# note\nemail-address docs/*  # why\n\n")
    assert config.read_allowlist(str(f)) == [("email-address", "docs/*")]
    f.write_text("nothing docs/*\n")
    with pytest.raises(config.InputError):
        config.read_allowlist(str(f))
    assert config.settings_summary({"a": True, "b": "x y", "c": 1}, {"a", "b"}) == {"values": {"a": True}, "other_keys": ["b", "c"]}
    assert config.parse_date("2024-02-29") == date(2024, 2, 29)


def test_front_matter(spark):
    df = spark.createDataFrame([("---\nname: x\ntools:\n  - a\n  - b\n---\nbody: no\n",), ("no block",)], "t string")
    got = [r[0] for r in df.select(config.front_matter(F.col("t"))).collect()]
    assert got == [{"name": "x", "tools": "a, b"}, {}]


def test_inventory_and_previous_run(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("x" * 9)
    assert [(r.bytes, r.tokens) for r in config.inventory(spark, str(tmp_path)).collect()] == [(9, 2)]
    assert config.previous_run(spark, str(tmp_path)) is None
    (tmp_path / "a" / "manifest.json").write_text('{"data_end": "2021-01-02", "generated_at": "b"}')
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "manifest.json").write_text('{"data_end": "2021-01-01", "generated_at": "c"}')
    assert config.previous_run(spark, str(tmp_path))["data_end"] == "2021-01-02"


def test_rules(tmp_path):
    f = tmp_path / "r.toml"
    rules = {"title": "t", "allowlist": {"paths": ["x"], "regexes": ["y"]}, "rules": [{"id": "1", "allowlists": [{"condition": "AND", "paths": ["p"], "regexes": ["q"]}, {"paths": ["p"]}, {"stopwords": ["w"]}]}, {"id": "2"}]}
    f.write_text(outputs.toml_text(rules))
    assert tomllib.loads(f.read_text()) == rules
    read = config.read_rules(str(f), hashlib.sha256(f.read_bytes()).hexdigest(), 2)
    assert config.without_paths(read) == {"title": "t", "allowlist": {"regexes": ["y"]}, "rules": [{"id": "1", "allowlists": [{"stopwords": ["w"]}]}, {"id": "2"}]}
    for args in (("0" * 64, 2), (hashlib.sha256(f.read_bytes()).hexdigest(), 3)):
        with pytest.raises(config.InputError):
            config.read_rules(str(f), *args)


def test_outputs(spark, tmp_path):
    t = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string").orderBy("n")
    assert outputs.csv_text(t) == "n,s\n1,a|b\n2,\n"
    assert outputs.markdown_table(t) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    assert outputs.canonical_json({"b": Decimal("1.50"), "a": date(2021, 1, 1)}) == '{\n "a": "2021-01-01",\n "b": "1.50"\n}\n'
    facts = {"reconciliation": {}, "rows": 1}
    manifest = outputs.write_outputs(str(tmp_path / "o"), {"t.csv": outputs.csv_text(t)}, facts)
    assert json.loads((tmp_path / "o" / "manifest.json").read_text()) == manifest
    with pytest.raises(GateError):
        outputs.write_outputs(str(tmp_path / "p"), {}, {})
    found = spark.createDataFrame([("error", "a,b", 3, "r", "50%", "reported")], "severity string, path string, line int, rule string, detail string, status string")
    assert found.select(outputs.annotation(F.col("severity"), F.col("path"), F.col("line"), F.col("rule"), F.col("detail"))).first()[0] == "::error file=a%2Cb,line=3,title=r::50%25"
    assert outputs.exit_code(found) == 1 and outputs.exit_code(found.withColumn("status", F.lit("suppressed"))) == 0
    assert outputs.uncovered(spark.createDataFrame([("x",), ("y",)], "rule string"), spark.createDataFrame([("x",)], "rule string")).first().rule == "y"
    assert outputs.report("T", {"S": t}).startswith("# T\n\n## S\n\n| n")


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_bytes(b"".join(b'{"n": %d, "x": "%s"}\n' % (k, b"y" * (k % 400)) for k in range(4000)))
    (tmp_path / "b.jsonl").write_bytes(b"one\r\ntwo\rthree\n\xff\n\nlast")
    (tmp_path / "c.jsonl").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = lines.split_lines(spark, {"p": str(tmp_path)})
        got = sorted((r.src.rsplit("/", 1)[1], r.line, r.json) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = sorted((r.src.rsplit("/", 1)[1], r.line, r.json) for r in lines.read_lines(spark, {"p": str(tmp_path)}).collect())
    assert got == whole and len(got) == 4006


def test_export_again_after_failure(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "file", bytearray(b"x")), ("c", "file", bytearray(b"y" * 100)), ("l", "symlink", None)], "path string, kind string, data binary")
    for address in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        assert outputs.export_tree(df, address) == 2
    assert (tmp_path / "two" / "a" / "b.txt").read_bytes() == b"x" and len(list(tmp_path.iterdir())) == 2


def test_full_report(spark, small):
    from millrace.plans.usage import CHANGES, _weights
    from millrace.sinks import reports
    from millrace.tables import load

    text = reports.full_report(load(spark, small, "calls"), load(spark, small, "call_log"), _weights(spark), spark.createDataFrame(CHANGES, "date string, scope string"), "2021-01-20", 10, rows=3)
    assert text.startswith("# Usage\n") and [x[3:] for x in text.split("\n") if x.startswith("## ")][:3] == ["Totals", "Reconciliation", "Weeks"]
    assert "| SUBTOTAL |" in text or "more rows" in text
    assert text.count("| compactions |") >= 1 and "| cache_rewrite_after_idle" in text
    tables = [x for x in text.split("## ")[1:]]
    assert len(tables) == 19 and all("| --- |" in x for x in tables)


def test_scan_summary(spark):
    from millrace.sinks import reports

    found = spark.createDataFrame([("error", "reported", "us-ssn", "b|c", 3, "****56"), ("warning", "reported", "soft-hyphen", "a", None, "x"), ("error", "skipped", "iban", "z", 1, "****")], "severity string, status string, rule string, path string, line int, detail string")
    text = reports.scan_summary(found, rows=1)
    assert "| error | us-ssn | b\\|c | 3 | ****56 |" in text and "1 more rows" in text and "iban" not in text.split("## Findings")[1]
    assert reports.exit_code(found) == 1 and reports.exit_code(found.where("severity <> 'error'")) == 0 and reports.exit_code(found.where("status = 'skipped'")) == 0


def test_rows_as_text(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, "c|d", "e")], "k int, x string, y string")
    assert [r.line for r in df.select(outputs.csv_line(df.columns).alias("line")).collect()] == ['1,"a,b",', "2,c|d,e"]
    assert [r.line for r in df.select(outputs.markdown_row(df.columns).alias("line")).collect()] == ["| 1 | a,b |  |", "| 2 | c\\|d | e |"]


def test_rules_without_global_paths(tmp_path):
    f = tmp_path / "r.toml"
    f.write_text("[[rules]]\nid = 'a'\n")
    sha = hashlib.sha256(f.read_bytes()).hexdigest()
    assert config.read_rules(str(f), sha, 1, paths=False)["rules"] == [{"id": "a"}]
    with pytest.raises(config.InputError):
        config.read_rules(str(f), sha, 1)

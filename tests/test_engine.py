import json
import os
import time

import pytest

from cairn.engine import Engine
from cairn.plans.policy import ExcludePolicy, ignore_patterns
from cairn.report import Outcome, event, next_command, next_step_reason, share_pct, status_warnings


def _write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    _write(root, {"clients/acme/invoice-2024-03-15_v2.txt": "hello invoice world", "clients/acme/notes.md": "plain notes hello", "clients/beta/plan_final.txt": "other plan", "node_modules/x.js": "skip", "src/main.rs": "fn main", "blob.bin": "x", "empty.txt": ""})
    e = Engine(spark, str(tmp_path_factory.mktemp("db") / "s"))
    assert e.status().outcome == Outcome.UNUSABLE
    got = e.index(str(root), ExcludePolicy.build(prefixes=[]))
    assert got.report["scanned"] == 7 and got.report["indexed"] == 6 and got.report["name:node_modules"] == 1 and got.report["added"] == 6
    return e, root


def test_commands(engine):
    e, root = engine
    assert e.hash().report["n_unhashed"] == 0
    ledger = e.fulltext().report
    assert ledger == {"indexed": 4, "unsupported": 1, "empty": 1}
    found = e.search("hello", fresh_answer=False)
    assert {os.path.basename(r.path) for r in found.rows} == {"invoice-2024-03-15_v2.txt", "notes.md"} and all("hello" in r.snippet for r in found.rows) and found.notice
    assert e.search("nothinglikeit", fresh_answer=False).outcome == Outcome.EMPTY
    assert e.tag('[[tags.rule]]\npath = "clients/**"\ntags = "area:clients"\n').outcome == Outcome.ANSWER
    assert {r.path.rsplit("/", 1)[-1] for r in e.tags(["area:clients", "version:final"]).rows} == {"plan_final.txt"}
    assert [r.value for r in e.tags(["version:"]).rows] == ["final", "v2"]
    explained = e.explain(str(root / "clients/beta/plan_final.txt"))
    assert explained.rows and all(r.stored == r.now for r in explained.rows)
    view = e.browse(["area:clients"]).report["view"]
    assert view.matched == 3 and ("area", "clients") not in {(v.namespace, v.value) for v in view.values}
    lines = e.browse([]).lines("browse")
    assert json.loads(lines[-1])["event"] == "browse_summary"
    assert e.status().report["n_live"] == 6


def test_fresh_answers(engine):
    e, root = engine
    if not e.store.has("postings"):
        e.fulltext()
    late = time.time_ns() + 10**10
    _write(root, {"clients/acme/notes.md": "now something else", "clients/new_report.md": "hello hello again"})
    for name in ("clients/acme/notes.md", "clients/new_report.md"):
        os.utime(root / name, ns=(late, late))
    (root / "clients/acme/invoice-2024-03-15_v2.txt").unlink()
    got = e.search("hello")
    assert [(r.origin, os.path.basename(r.path)) for r in got.rows] == [("live", "new_report.md")] and got.notice is None
    names = {os.path.basename(r.path) for r in e.find("CLIENTS").rows}
    assert names == {"notes.md", "new_report.md", "plan_final.txt"}
    again = e.index(str(root), ExcludePolicy.build())
    assert again.report["deleted"] == 1 and again.report["changed"] == 1 and again.report["added"] == 1
    assert {os.path.basename(r.path) for r in e.find("clients").rows} == names


def test_layers_and_probes(spark, tmp_path):
    root = tmp_path / "r"
    _write(root, {"a/one.txt": "alpha beta", "bb/two.txt": "alpha gamma", "out/three.txt": "alpha", ".gitignore": "out/\n"})
    e = Engine(spark, str(root / "db"))
    got = e.index(str(root), ExcludePolicy.build(ignored=ignore_patterns("out/"), defaults=False))
    assert got.report["gitignore"] == 1 and got.report["indexed"] == 3
    e.fulltext()
    e.tag()
    assert e.browse([]).report["behind"] == 0
    e.hash()
    assert e.browse([], fresh_answer=False).report["behind"] == 0  # a commit is no scan
    again = e.index(str(root), ExcludePolicy.build(ignored=ignore_patterns("out/"), defaults=False))
    assert again.report["store"] > 0 and again.report["unchanged"] == 3 and e.browse([], fresh_answer=False).report["behind"] == 1
    assert e.search_index("alpha").notice and len(e.search_index("alpha").rows) == 2
    late = time.time_ns() + 10**10
    _write(root, {"a/one.txt": "delta"})
    os.utime(root / "a/one.txt", ns=(late, late))
    (root / "bb/two.txt").unlink()
    time.sleep(1.1)  # the change set is kept for a second
    assert "2 files have changed" in e.browse([]).notice and "2 files" in e.tags([]).notice
    assert [r.there for r in e.tags(["ext:txt", "path:bb"], fresh_answer=False).rows] == [False]
    assert e.refresh().report["touched"] == 2
    assert [os.path.basename(r.path) for r in e.search_index("delta").rows] == ["one.txt"] and e.search_index("gamma").outcome == Outcome.EMPTY
    told = e.status(check_journal=True).report["journal"]
    assert told == {"checked": False, "reason": "this system has no change journal"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from cairn.__main__ import main

    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    _write(tmp_path / "r", {"notes/a.txt": "hello", "notes/b.log": "hello log"})
    (tmp_path / "cairn.toml").write_text('[text]\nbinary = ["log"]\n[[tags.rule]]\npath = "notes/**"\ntags = "area:notes"\n')
    monkeypatch.chdir(tmp_path)
    db = ["--db", str(tmp_path / "db")]
    assert main([*db, "index", str(tmp_path / "r"), "--use-gitignore", "--skip-hidden", "--exclude-prefix", "/no/such//dir/"]) == 0
    assert main([*db, "fulltext"]) == 0 and main([*db, "tag", "--no-read-embedded", "--magic-max-size", "100"]) == 0
    assert main([*db, "search", "hello", "--no-fresh", "-n", "5", "--snippet-chars", "40"]) == 0
    assert main([*db, "search", "log", "--no-db"]) == 1
    assert main([*db, "browse", "--axes", "2", "--values", "3", "--label-terms", "1", "--files", "1", "--no-fresh"]) == 0
    assert main([*db, "tags", "area:notes", "--no-fresh"]) == 0 and main([*db, "status", "--check-journal"]) == 0
    assert main([*db, "find", "zzz", "--delta-limit", "5"]) == 1 and main([*db, "tag", "--config", "missing.toml"]) == 2
    events = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert {x["event"] for x in events} >= {"index_summary", "fulltext_summary", "search", "browse_summary", "tags", "status_summary"}


def test_report_helpers():
    assert [share_pct(*x) for x in ((0, 5), (1, 500), (5, 5), (1, 0))] == ["0%", "<1%", "100%", "0%"]
    assert next_command([("a", "b c")], ("d", "e"), {"axes": 2}) == "browse 'a:b c' d:e --axes 2"
    assert next_step_reason(True, 3, 0, None) and next_step_reason(True, 3, 2, ("a", "b")) is None
    assert json.loads(event("x", usn=2**60))["usn"] == str(2**60)
    assert len(status_warnings({"n_live": 0}, 2, "unreadable", "rolled_off")) == 4

"""Plain API, configuration, command line, private files, logging."""

import io
import json
import logging
import os
import pickle
import stat
import sys

import pytest

from maskwright import cli, config
from maskwright.api import Mapping, Sanitizer, Scanner
from maskwright.logs import MaskingFormatter
from maskwright.sources.private import write_private


def test_scanner():
    r = Scanner(locale="us", min_confidence=0.5).scan("é 🙂 a@b.org")
    f = r.findings[0]
    assert (f.entity_type, "é 🙂 a@b.org"[f.start: f.end], r.masked_text) == ("email", "a@b.org", "é 🙂 [EMAIL]")
    assert "a@b" not in repr(r) + repr(f) + repr(Scanner())
    for bad in ({"locale": "xx"}, {"exclude_entities": ["nope"]}, {"min_confidence": -1}):
        with pytest.raises(ValueError):
            Scanner(**bad)
    with pytest.raises(TypeError):
        Scanner(deny_list="one")
    with pytest.raises(TypeError):
        Scanner().scan(b"x")
    with pytest.raises(ValueError):
        Scanner().mask("\ud800")


def test_sanitizer_and_mapping():
    clean, mapping = Sanitizer(min_confidence=0.5).sanitize("né a@b.org, a@b.org", placeholder_style="braces")
    assert clean == "né {EMAIL_1}, {EMAIL_1}" and len(mapping) == 1 and mapping.style == "braces"
    back = Mapping.from_json(mapping.to_json())
    assert back.restore("{ email_1 } {EMAIL_2}") == "a@b.org {EMAIL_2}" and back.restore("{ email_1 }", strict=True) == "{ email_1 }"
    assert "a@b" not in repr(mapping) and mapping.get("{EMAIL_1}")["span_start"] == 4
    with pytest.raises(TypeError):
        pickle.dumps(mapping)
    good = dict(mapping.entries()[0])
    for change in ({"span_end": 99}, {"placeholder": ""}, {"confidence": 2}, {"original": 5}):
        with pytest.raises(ValueError, match="invalid mapping"):
            Mapping.from_json(json.dumps({"entries": [good | change]}))
    with pytest.raises(ValueError):
        Mapping.from_json(json.dumps({"entries": [good, good | {"placeholder": "{ email_1 }"}]}))


def test_config(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / config.NAME).write_text('deny_list = ["x"]\nexclude_entities = ["email"]\n[scanner]\ndeny_list = ["y"]\n')
    assert config.load(start=tmp_path / "a" / "b") == {"allow_list": (), "deny_list": ("x", "y"), "exclude_entities": ("email",)}
    (tmp_path / "bad.toml").write_text('exclude_entities = ["nonsense"]')
    with pytest.raises(ValueError):
        config.load(tmp_path / "bad.toml")


def test_private_files(tmp_path):
    at = tmp_path / "m.json"
    write_private(at, "one")
    assert stat.S_IMODE(os.stat(at).st_mode) == 0o600
    with pytest.raises(FileExistsError):
        write_private(at, "two")
    (tmp_path / "link").symlink_to(at)
    write_private(tmp_path / "link", "three", force=True)
    assert at.read_text() == "one" and not (tmp_path / "link").is_symlink() and sorted(p.name for p in tmp_path.iterdir()) == ["link", "m.json"]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("n,m\n1,a@b.org\n")
    (tmp_path / "d" / "c.json").write_text('{"s":"123-45-6789"}')
    (tmp_path / "d" / "bad.json").write_text("{")
    log = tmp_path / "log.jsonl"
    run = lambda *a: cli.main(["--locale", "us", "--audit-log", str(log), *map(str, a)])
    assert run("scan", tmp_path / "d" / "a.csv") == 1 and "row:1,column:1" in capsys.readouterr().out
    assert run("--quiet", "scan", tmp_path / "d" / "c.json") == 1 and capsys.readouterr().out == '{\n  "s": "[SSN]"\n}'
    assert run("scan", tmp_path / "d" / "bad.json") == 2 and run("--strategy", "encrypt", "scan", tmp_path / "d" / "a.csv") == 2
    assert run("--output-format", "json", "audit", tmp_path / "d") == 1
    report = json.loads(capsys.readouterr().out)
    assert (report["files_scanned"], report["files_skipped"], report["total_findings"], report["severity"]) == (2, 1, 2, "high")
    assert run("pre-commit") == 0 and run("pre-commit", tmp_path / "d" / "a.csv", "--minimum-severity", "high") == 0
    assert run("--output-format", "sarif", "scan", tmp_path / "d" / "a.csv") == 1
    assert "a@b.org" not in log.read_text() and "123-45" not in log.read_text() and len(log.read_text().splitlines()) >= 4
    capsys.readouterr()
    monkeypatch.setattr(sys, "stdin", io.StringIO("x=1 m=a@b.org\nplain\n"))
    assert run("stream") == 1
    out = capsys.readouterr()
    assert out.out == "x=1 m=[EMAIL]\nplain\n" and "lines with findings: 1" in out.err
    (tmp_path / "p.txt").write_text("to a@b.org")
    assert run("sanitize", tmp_path / "p.txt", "--mapping", tmp_path / "m.json") == 0 and capsys.readouterr().out == "to [EMAIL_1]"
    assert run("sanitize", tmp_path / "p.txt", "--mapping", tmp_path / "m.json") == 2 and run("sanitize", tmp_path / "p.txt", "--mapping", tmp_path / "p.txt", "--force") == 2
    (tmp_path / "r.txt").write_text("re [ email_1 ]")
    capsys.readouterr()
    assert run("restore", tmp_path / "r.txt", "--mapping", tmp_path / "m.json") == 0 and capsys.readouterr().out == "re a@b.org"


def test_logging():
    record = logging.makeLogRecord({"name": "app", "levelname": "INFO", "msg": 'from a@b.org\n"q"', "peer": "10.0.0.1"})
    assert MaskingFormatter().format(record) == 'level=INFO target="app" message="from [EMAIL]\\n\\"q\\"" peer="[IP_ADDRESS]"'

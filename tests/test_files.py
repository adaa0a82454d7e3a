"""File sources."""

import json

import pytest

from tierflow.sources import files as S


def test_read_prompts(spark, tmp_path):
    lines = ['{"text": " a b "}', "", '{"broken', '{"prompt": "p", "label": "heavy", "source": "s"}', '{"x": 1}',
             '{"text": "", "instruction": "i"}', '{"text": "   "}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    got = {r.text: (r.label, r.source) for r in S.read_prompts(spark, str(tmp_path)).collect()}
    assert set(got) == {"a b", "p", "i"} and got["p"] == ("heavy", "s") and got["a b"][1] == "custom-jsonl"


def test_samples_fail_fast(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"id": "1", "raw_text": "x", "confidence": "no number"}))
    with pytest.raises(Exception):
        S.read_samples(spark, str(tmp_path)).collect()


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("def one():\n" + "    x = 1\n" * 10 + "def two():\n" + "    y = 1\n" * 10)
    (tmp_path / "src" / "b.md").write_text("# T\n" + "word " * 30)
    (tmp_path / "src" / "c.png").write_text("no")
    (tmp_path / "src" / "bad.txt").write_bytes(b"ok \xff\xfe " + b"z" * 80)
    (tmp_path / "src" / "big.txt").write_text("q" * 3000)
    (tmp_path / "node_modules" / "d.py").write_text("def no(): pass\n" * 20)
    got = S.scan_corpus(spark, str(tmp_path), max_kb=2).collect()
    names = sorted(r.context["file"].rsplit("/", 1)[1] for r in got)
    assert names == ["a.py", "a.py", "b.md", "bad.txt"]


def test_cost_log_day(spark, tmp_path):
    import datetime as dt
    d = spark.createDataFrame([(dt.datetime(2024, 1, d, 3), d) for d in (1, 2, 2)], "ts timestamp_ntz, n int")
    S.write_cost_log(d, str(tmp_path / "log"))
    day = S.read_cost_log(spark, str(tmp_path / "log"), "2024-01-02")
    assert day.count() == 2
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().toString()

import json

from fieldweave.logs import configured


def test_lines_are_json(tmp_path):
    log = configured("test.logs", str(tmp_path / "a/x.jsonl"))
    log.info("hello %s", "you", extra={"stage": "s"})
    assert configured("test.logs") is log and len(log.handlers) == 2
    row = json.loads((tmp_path / "a/x.jsonl").read_text())
    assert (row["message"], row["stage"], row["level"]) == ("hello you", "s", "INFO")

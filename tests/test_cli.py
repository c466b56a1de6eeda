import json

import pytest

from gridmill.__main__ import main


@pytest.fixture
def tree(tmp_path):
    folder = tmp_path / "tree"
    folder.mkdir()
    (folder / "a.txt").write_text("1\n22\n")
    (folder / "nul.txt").write_text("2h 5m\n")
    return folder


def test_lines(spark, tree, capsys):
    assert main(["infer", str(tree / "a.txt")]) == 0 and capsys.readouterr().out == "NonNegInt\n"
    assert main(["check", "Num(1)", str(tree / "a.txt")]) == 1 and capsys.readouterr().out == "22\n"
    assert main(["delta", str(tree / "nul.txt")]) == 0 and "7500" in capsys.readouterr().out


def test_tree(spark, tree, tmp_path, capsys):
    assert main(["manifest", str(tree), "--algorithm", "sha256", "--sort", "BY_FILE"]) == 0
    manifest = tmp_path / "sums"
    manifest.write_text(capsys.readouterr().out)
    assert main(["verify", str(manifest), str(tree)]) == 0
    (tree / "a.txt").write_text("changed")
    assert main(["verify", str(manifest), str(tree)]) == 1 and "SUMMISMATCH" in capsys.readouterr().out
    assert main(["names", str(tree)]) == 1 and "bad Windows name" in capsys.readouterr().out
    assert main(["text", str(tree)]) == 0 and "ASCII,UTF-8" in capsys.readouterr().out


def test_json(tmp_path, capsys):
    (tmp_path / "s.json").write_text(json.dumps({"type": "object"}))
    (tmp_path / "d.json").write_text("[]")
    assert main(["json", str(tmp_path / "s.json"), str(tmp_path / "d.json")]) == 1 and "d.json" in capsys.readouterr().out

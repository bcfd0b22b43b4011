import json

from quillmill import cli


def test_cli(spark, tmp_path, capsys):
    lw = tmp_path / "a.lw"
    lw.write_text("graph TD\nA[One] -->|x| B")
    st = ["--store", str(tmp_path / "st")]
    assert cli.main(["--lw", str(lw), "--check", "--save", "k", *st], spark) == 0
    assert capsys.readouterr().out == "nodes: 2\nedges: 1\n"
    assert cli.main(["--load", "k", "--json", *st], spark) == 0
    assert json.loads(capsys.readouterr().out)["metadata"] == {"nodes": 2, "edges": 1}
    assert cli.main(["--load", "none", *st], spark) == 3
    lw.write_text("graph TD\nA(")
    assert cli.main(["--lw", str(lw)], spark) == 2 and ":2:" in capsys.readouterr().err
    kb = tmp_path / "kb.json"
    kb.write_text(json.dumps({"entities": [{"name": "A", "aliases": ["x"]}, {"name": "B"}], "relations": [{"source": "X", "target": "b", "type": "t"}, {"source": "X", "target": "q"}], "facts": [{"statement": "s", "subject": "A", "predicate": "p", "object": "B"}]}))
    assert cli.main(["--kb", str(kb)], spark) == 0 and capsys.readouterr().out == "nodes: 2\nedges: 2\n"
    assert cli.main(["--graph-json", str(kb)], spark) == 2

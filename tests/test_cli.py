"""The command line, end to end."""

import json

from docquarry.cli import main


def test_index_search_delete(spark, tmp_path, capsys):
    (tmp_path / "c.yml").write_text("schema:\n  shop:\n    alias: s\n    fields:\n      title: {type: text, search: {lexical: {}}, suggest: true}\n      price: {type: int, filter: true}\n")
    (tmp_path / "d.json").write_text('{"_id": 1, "title": "red dress", "price": 3}\n{"_id": 2, "title": "red hat", "price": 5}\n{"_id": 3, "title": "blue hat"}\n')

    def run(*args):
        main(["--config", f"{tmp_path}/c.yml", "--root", f"file://{tmp_path}/idx", *args])
        out = capsys.readouterr().out.strip()
        return json.loads(out.splitlines()[-1]) if out else None

    assert run("list") == ["shop"]
    assert run("index", "file", "--index", "s", "--url", f"{tmp_path}/d.json") == 3
    assert [h["_id"] for h in run("search", "--index", "s", "--request", '{"query": {"match": {"title": "dress"}}}')["hits"]] == ["1"]
    assert run("suggest", "--index", "s", "--request", '{"query": "re", "fields": ["title"]}')[0]["text"] == "red"
    assert run("delete", "--index", "s", "--filters", '{"include": {"range": {"price": {"gt": 4}}}}') == -1
    assert run("delete", "--index", "s", "--ids", "3") == -1
    run("merge", "--index", "s", "--files", "1")
    assert run("stats", "--index", "s")["docs"] == 1
    assert run("replicate", "--index", "s", "--to", f"file://{tmp_path}/copy")[-1] == ["add", "manifest.json"]

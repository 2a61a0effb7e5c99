import json

from tessera import __main__ as cli
from tessera.operators import observe


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Invoice for the Data Platform, to be paid soon")
    (src / "e.json").write_text(json.dumps({"id": "e1", "summary": "Standup", "start": {"dateTime": "2026-07-01T08:30:00Z"}, "end": {"dateTime": "2026-07-01T09:00:00Z"}}))
    cli.main(["silver", "--path", str(src), "--out", str(tmp_path / "s")])
    cli.main(["gold", "--silver", str(tmp_path / "s"), "--out", str(tmp_path / "g")])
    cli.main(["stats", "--gold", str(tmp_path / "g")])
    cli.main(["search", "--gold", str(tmp_path / "g"), "invoice?"])
    cli.main(["similar", "--gold", str(tmp_path / "g"), "invoice platform"])
    cli.main(["validate", "--gold", str(tmp_path / "g")])
    cli.main(["init", "--out", str(tmp_path / "empty")])
    cli.main(["init", "--out", str(tmp_path / "empty")])
    assert spark.read.parquet(str(tmp_path / "empty" / "gold_nodes")).count() == 0
    cli.main(["show", "--silver", str(tmp_path / "s")])
    cli.main(["health", "--gold", str(tmp_path / "g")])
    node = spark.read.parquet(str(tmp_path / "g" / "gold_nodes")).filter("type = 'document'").first().id
    capsys.readouterr()
    cli.main(["detail", "--gold", str(tmp_path / "g"), node])
    assert "a.txt" in capsys.readouterr().out
    cli.main(["stats", "--gold", str(tmp_path / "g")])
    cli.main(["search", "--gold", str(tmp_path / "g"), "invoice?"])
    cli.main(["validate", "--gold", str(tmp_path / "g")])
    said = capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "g" / "store" / "gold_nodes")).count() == spark.read.parquet(str(tmp_path / "g" / "gold_nodes")).count()
    assert "document" in said
    assert "a.txt" in said
    assert "good" in said


def test_observation_and_health(spark):
    df, seen = observe.observed(spark.range(5), "five")
    df.collect()
    assert seen.get == {"rows": 5}
    kept = {}
    made = observe.tracked("t", lambda n, o: kept.update({n: o}))(lambda: spark.range(3))()
    made.collect()
    assert kept["t"].get == {"rows": 3}
    assert {r.what: r.ok for r in observe.health(spark, ["no_such_table"]).collect()} == {"session": True, "no_such_table": False}

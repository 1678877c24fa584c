from scriptorium import cli


def decoded(content, ocr):
    return content.decode()


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/Foxes.pdf").write_text("# Foxes\n\n## Red\n\nRed foxes  run far in the snow.\n\n## Grey\n\nGrey foxes climb trees.\n", encoding="utf-8")
    (tmp_path / "pdf/DMG.pdf").write_text("# Title\n\n## Part\n\nNothing about animals.", encoding="utf-8")
    p = lambda name: f"file://{tmp_path}/{name}"
    # each command reads what the one before has written
    cli.main(["parse", p("pdf"), p("md"), "--converter", "tests.test_cli:decoded"], spark)
    foxes = next(x.stem for x in tmp_path.glob("md/*.md") if x.stem != "DMG")
    assert sorted(x.name for x in tmp_path.glob("md/*")) == sorted(["DMG.md", f"{foxes}.md"])
    cli.main(["clean", p("md"), p("clean")], spark)
    assert "Red foxes" in (tmp_path / f"clean/{foxes}.md").read_text(encoding="utf-8")
    cli.main(["changes", p("clean"), p("md"), p("changes")], spark)
    assert sorted(x.name[-8:] for x in tmp_path.glob("changes/*_pdf-processing_*.json")) == sorted(f"_{x}.json"[-8:] for x in ("DMG", foxes))
    cli.main(["sections", p("clean"), p("sections")], spark)
    cli.main(["chunks", p("sections"), p("chunks")], spark)
    assert spark.read.json(p("chunks")).count() == 3
    cli.main(["sample", p("chunks"), "climb", "-k", "1"], spark)
    cli.main(["index", p("store"), p("chunks")], spark)
    cli.main(["ask", p("store"), "Which foxes climb trees?", "-k", "1"], spark)
    target = spark.read.json(p("chunks")).where("text like '%climb%'").first().chunk_id
    (tmp_path / "set.jsonl").write_text('{"id": "1", "question": "Which foxes climb trees?", "answer": "Grey foxes climb trees.", "references": [{"chunk_id": "' + target + '"}]}\n{"id": "2", "question": "Red?", "answer": "no", "references": []}\n', encoding="utf-8")
    cli.main(["eval", p("store"), p("set.jsonl"), "-k", "1", "--limit", "1", "--log-dir", p("evals")], spark)
    out = capsys.readouterr().out
    assert "Samples: 1\nAverage Recall@1: 1.000" in out and "md/DMG.md" in out
    assert target in out and "Grey foxes climb trees. [1]" in out

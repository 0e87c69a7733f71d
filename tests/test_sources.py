import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.sources import datasets as D
from lakeloom.sources import files as S


def test_text_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc\n".encode())
    assert S.read_text(spark, str(tmp_path / "a.txt")).first()["text"] == "é\nb\nc\n"
    rows = [{"instruction": "ié", "input": "", "output": "o"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.jsonl").write_text("\n" + json.dumps(rows[0]) + "\n\n")
    assert S.read_json(spark, str(tmp_path / "a.json")).collect() == S.read_json(spark, str(tmp_path / "a.jsonl")).collect()
    S.rewrite_unescaped(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert (tmp_path / "b.json").read_text() == json.dumps(rows, indent=2, ensure_ascii=False)
    many = [{"instruction": f"é\n{i}", "input": None, "output": "[]"} for i in range(30)]
    df = spark.createDataFrame(many, S.SAMPLE).repartition(4).sortWithinPartitions("instruction")
    S.write_json_array(df, str(tmp_path / "c.json"))
    text = (tmp_path / "c.json").read_text()
    assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False) and sorted(json.loads(text), key=str) == sorted(many, key=str)
    S.write_json_array(df.limit(0), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == "[]"


def test_json_arrays_by_all_tasks(spark, tmp_path, monkeypatch):
    """No row of an array comes to the driver, and an array that was written here is read in parts, wherever they are cut."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    many = [{"instruction": f'é\n  }},\n  {{"{i}', "input": None if i % 7 == 0 else "]\n", "output": "[\\n  }]," * (i % 5)} for i in range(3000)]
    df = spark.createDataFrame(many, S.SAMPLE).repartition(7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for indent, escaped in ((2, False), (4, True)):
            path = str(tmp_path / f"a{indent}.json")
            S.write_json_array(df, path, indent, escaped)
            text = open(path).read()
            assert text == json.dumps(json.loads(text), indent=indent, ensure_ascii=escaped) and sorted(json.loads(text), key=str) == sorted(many, key=str)
            got = S.read_json(spark, path, S.SAMPLE, indent)
            assert got.rdd.getNumPartitions() > 4 and sorted((r.asDict() for r in got.collect()), key=str) == sorted(many, key=str)
        assert S.read_json(spark, path, S.SAMPLE, 4).schema == S.read_json(spark, path, S.SAMPLE).schema
        for n in (0, 1):
            S.write_json_array(df.limit(n), str(tmp_path / "few.json"))
            assert S.read_json(spark, str(tmp_path / "few.json"), S.SAMPLE, 2).count() == n
        with pytest.raises(Exception):
            (tmp_path / "bad.json").write_text('[\n  {\n    "input": "a"\n  },\n  {\n    "inp\n  }\n]')
            S.read_json(spark, str(tmp_path / "bad.json"), S.SAMPLE, 2).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_registry(spark, tmp_path):
    calls = []
    reg = S.Registry({"x": "place/x.txt"}, lambda place: calls.append(place) or b"data")
    assert reg.get(spark, "x", str(tmp_path)) == reg.get(spark, "x", str(tmp_path))
    assert calls == ["place/x.txt"] and (tmp_path / "x.txt").read_bytes() == b"data"
    with pytest.raises(ValueError):
        reg.get(spark, "y", str(tmp_path))


def test_configs():
    c = D.load_config("name: a\nraw_file: r\nprocessed_dir: p\ntokenizer_type: regex_bpe\nvocab_size: 300\n")
    assert c.train_split == 0.9 and c.min_document_chars == 50
    with pytest.raises(TypeError):
        D.load_config("name: a\nother: 1\n")
    assert D.load_train_config("config:\n  lr: 1\n  n: 2\n", lr=0, n=5) == {"lr": 1, "n": 5}


def test_prepare(spark, tmp_path):
    text = "\n\n".join(f"Paragraph number {i} has some words in it." for i in range(20)) + "\n\nshort"
    (tmp_path / "raw.txt").write_text(text)
    config = D.DatasetConfig("x", str(tmp_path / "raw.txt"), str(tmp_path / "out"), "regex_bpe", 280, 0.9, document_splitter="double_newline", shuffle_documents=True, min_document_chars=10)
    meta = D.prepare(spark, config, str(tmp_path / "tok"))
    assert list(meta)[:4] == ["dataset_name", "raw_file", "processed_dir", "total_characters"] and len(meta) == 21 and meta["num_documents"] == 20
    train, val = D.load_split(spark, config.processed_dir, "train"), D.load_split(spark, config.processed_dir, "val")
    assert train.count() == meta["train_tokens"] == int(meta["total_tokens"] * 0.9) and val.count() == meta["val_tokens"]
    before = (tmp_path / "out/train.bin").stat().st_mtime_ns
    assert D.prepare(spark, config, str(tmp_path / "tok"))["total_tokens"] == meta["total_tokens"] and (tmp_path / "out/train.bin").stat().st_mtime_ns == before
    with pytest.raises(FileNotFoundError):
        D.read_meta(spark, str(tmp_path / "none"))


def test_token_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 7 % 60000).alias("token_id")).repartition(5)
    D.write_tokens(df, str(tmp_path / "t.bin"), "uint16")
    assert np.fromfile(tmp_path / "t.bin", "<u2").tolist() == [i * 7 % 60000 for i in range(1000)]
    assert D.read_tokens(spark, str(tmp_path / "t.bin"), "uint16").where("pos = 3").first()["token_id"] == 21


def test_vocabulary_files(spark, tmp_path):
    vocab = spark.createDataFrame([("é", 0), ("b", 1)], "token string, id long")
    D.save_vocabulary(spark, vocab, str(tmp_path / "v.json"))
    assert sorted(map(tuple, D.load_vocabulary(spark, str(tmp_path / "v.json")).collect())) == [("b", 1), ("é", 0)]
    with pytest.raises(FileNotFoundError):
        D.load_vocabulary(spark, str(tmp_path / "w.json"))
    assert D.loss_series({"train": [1.0, 0.5]}, spark).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from lakeloom import cli

    (tmp_path / "s.json").write_text(json.dumps([{"instruction": "i", "input": "x", "output": "o"}]))
    cli.main(["prompts", str(tmp_path / "s.json"), str(tmp_path / "out")])
    assert "### Input:\nx" in spark.read.json(str(tmp_path / "out")).first()["prompt"]
    (tmp_path / "t.txt").write_text("abc")
    cli.main(["summary", str(tmp_path / "t.txt")])
    assert "0.00 MB" in capsys.readouterr().out


def _reply(url, payload, headers):
    """A provider that needs no network: it answers by what it is asked."""
    text = payload.get("messages", payload.get("input"))[-1]["content"]
    if "scale from 1 to 5" in text:
        text = "Fine. Score: 4"
    elif text.endswith("Answer directly and concisely."):
        text = " an answer "
    elif "Better Answer" in text:
        text = "[Better Answer] best [End]"
    elif "### Instruction" in text:
        text = " response\n"
    else:
        text = '{"instruction": "do é", "input": "with"}'
    if "messages" in payload:
        return [json.dumps({"message": {"content": c}}) + "\n" for c in (text[:3], text[3:])]
    return [json.dumps({"output": [{"content": [{"text": text}]}, {"content": None}]})]


def test_providers():
    from lakeloom.sources.providers import Provider

    seen = []

    def send(url, payload, headers):
        seen.append((url, payload, headers))
        return _reply(url, payload, headers)

    for kind in ("ollama", "openai"):
        ask = Provider(kind, "m", ("http://a", "http://b"), headers={"k": "v"}, send=send)(3)
        assert ask("", "x Answer directly and concisely.") == " an answer "
    assert {u for u, _, _ in seen} == {"http://b"} and seen[0][1]["stream"] is True and "stream" not in seen[1][1]

    def down(url, payload, headers):
        raise OSError("down")

    assert Provider("ollama", "m", ("u",), send=down)(0)("s", "p") == ""
    with pytest.raises(OSError):
        Provider("openai", "m", ("u",), send=down)(0)("s", "p")
    with pytest.raises(ValueError):
        Provider("other", "m", ("u",))


def test_commands_with_a_model(spark, tmp_path, capsys):
    from lakeloom import cli

    more = ["--model", "m", "--url", "http://a", "--url", "http://b"]
    cli.main(["generate", str(tmp_path / "new.json"), "--n", "6", *more], send=_reply)
    rows = json.loads((tmp_path / "new.json").read_text())
    assert len(rows) == 6 and {r["output"] for r in rows} == {"an answer"}
    cli.main(["respond", str(tmp_path / "new.json"), str(tmp_path / "said.json"), *more], send=_reply)
    said = json.loads((tmp_path / "said.json").read_text())
    assert {r["generated_response"] for r in said} == {"response"} and len(said) == 6
    cli.main(["evaluate", str(tmp_path / "said.json"), *more], send=_reply)
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"n": 6, "n_parsed": 6, "mean_score": 4.0}
    cli.main(["reflect", str(tmp_path / "new.json"), str(tmp_path / "better"), "--mode", "response", *more], send=_reply)
    better = spark.read.json(str(tmp_path / "better_response.jsonl"))
    assert {r["output"] for r in better.collect()} == {"best"} and better.count() == 6
    cli.main(["download", "x", "http://host/x.txt", str(tmp_path)], fetch=lambda place: place.encode())
    assert (tmp_path / "x.txt").read_text() == "http://host/x.txt"

"""Command line: datasets, corpora, and instruction data with a model's help.

    python -m lakeloom.cli download name https://host/file.txt folder
    python -m lakeloom.cli prepare config.yaml --tokenizers folder
    python -m lakeloom.cli summary documents.parquet --by lang
    python -m lakeloom.cli prompts samples.json out_folder
    python -m lakeloom.cli generate out.json --n 100 --model m --url http://host:11434/api/chat
    python -m lakeloom.cli respond samples.json out.json --model m --url ...
    python -m lakeloom.cli reflect samples.json out_prefix --mode response --model m --url ...
    python -m lakeloom.cli evaluate responses.json --model m --url ...
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="raw text to token files")
    a.add_argument("config")
    a.add_argument("--tokenizers", default="tokenizers")
    a = sub.add_parser("summary", help="documents, characters and megabytes")
    a.add_argument("path")
    a.add_argument("--by", action="append", default=[])
    a = sub.add_parser("prompts", help="instruction samples to prompts")
    a.add_argument("path")
    a.add_argument("out")
    a = sub.add_parser("download", help="a named file, unless it is there")
    a.add_argument("name")
    a.add_argument("place")
    a.add_argument("folder")
    asked = {"generate": ["out"], "respond": ["path", "out"], "reflect": ["path", "out"], "evaluate": ["path"]}
    about = {"generate": "new instruction samples", "respond": "a model's response to each sample", "reflect": "better samples", "evaluate": "mean score of responses by a judge"}
    for name, places in asked.items():
        a = sub.add_parser(name, help=about[name])
        for x in places:
            a.add_argument(x)
        a.add_argument("--provider", default="ollama", choices=["ollama", "openai"])
        a.add_argument("--model", required=True)
        a.add_argument("--url", action="append", required=True)
        a.add_argument("--temperature", type=float)
        a.add_argument("--seed", type=int, default=0)
        if name == "generate":
            a.add_argument("--n", type=int, default=5)
        if name == "reflect":
            a.add_argument("--mode", default="response", choices=["response", "instruction"])
    return p


def _fetch(place: str) -> bytes:
    import urllib.request

    with urllib.request.urlopen(place) as reply:
        return reply.read()


def _with_model(spark, given, send) -> None:
    """The commands that ask a model."""
    from lakeloom.operators import instruct as I
    from lakeloom.sources import files
    from lakeloom.sources.providers import Provider, send_http

    provider = Provider(given.provider, given.model, tuple(given.url), I.Options(temperature=given.temperature), send=send or send_http)
    n = len(given.url)
    if given.command == "generate":
        files.write_json_array(I.generated_samples(spark, given.n, given.seed, provider, n).select("instruction", "input", "output"), given.out)
        return
    rows = files.read_json(spark, given.path, files.RESPONSE).withColumn("pos", F.monotonically_increasing_id())
    if given.command == "respond":
        files.write_json_array(I.with_responses(rows.drop("generated_response"), "pos", provider, n).drop("pos"), given.out)
    elif given.command == "reflect":
        system, prompt = I.reflection_prompt(given.mode)
        asked = I.call_provider(rows.drop("generated_response").withColumn("system", system).withColumn("prompt", prompt), "pos", provider, endpoints=n)
        I.write_routes(I.reflected(asked.drop("system", "prompt", "pos"), mode=given.mode), given.out, given.mode)
    else:
        asked = I.call_provider(rows.withColumn("system", F.lit("")).withColumn("prompt", I.judge_prompt()), "pos", provider, endpoints=n)
        print(json.dumps(I.mean_score(asked.select(I.parse_score(F.col("raw")).alias("score"))).first().asDict()))


def main(args: list[str] | None = None, fetch=_fetch, send=None) -> None:
    from lakeloom.operators import documents, instruct
    from lakeloom.sources import datasets, files

    given = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "prepare":
        with open(given.config, encoding="utf-8") as f:
            print(json.dumps(datasets.prepare(spark, datasets.load_config(f.read()), given.tokenizers), indent=2))
    elif given.command == "summary":
        docs = spark.read.parquet(given.path) if given.path.rstrip("/").endswith(".parquet") else files.read_text(spark, given.path)
        documents.corpus_summary(docs, *given.by).show(100, truncate=False)
    elif given.command == "download":
        print(files.Registry({given.name: given.place}, fetch).get(spark, given.name, given.folder))
    elif given.command != "prompts":
        _with_model(spark, given, send)
    else:
        rows = files.read_json(spark, given.path)
        files.write_json(rows.withColumn("prompt", instruct.format_input()).where(F.col("instruction").isNotNull()), given.out)


if __name__ == "__main__":
    main()

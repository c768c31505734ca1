"""python -m lexweave.cli generate|explore --config PATH --task TASK --corpus NAME=PATH [--run NAME] [--out PATH] [--most N]"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave.operators import stats
from lexweave.plans import pipeline
from lexweave.sources.io import TASKS, load_configs, load_corpus, save_statistics


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexweave")
    p.add_argument("command", choices=("generate", "explore"))
    p.add_argument("--config", required=True)
    p.add_argument("--task", choices=TASKS, required=True)
    p.add_argument("--corpus", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--key", default="doc_id")
    p.add_argument("--run", default=None)
    p.add_argument("--out", default="dataset")
    p.add_argument("--most", type=int, default=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexweave").getOrCreate()
    configs = load_configs(a.config, a.task, a.most or (10 if a.command == "explore" else None))
    corpora = {name: load_corpus(spark, path) for name, path in (c.split("=", 1) for c in a.corpus)}
    made, counts = pipeline.run(spark, corpora, configs, a.run or uuid.uuid4().hex[:8], a.key)
    if a.command == "generate":
        made.write.mode("overwrite").parquet(a.out)
        for name, table in counts.items():
            save_statistics(table, a.out + "-statistics", name)
    else:
        print(pipeline.show(made))
        stats.mean_by_label(stats.repetition(made.where("text is not null"), F.col("text")), "label", ["rep_2", "rep_3", "rep_4", "diversity"]).show()


if __name__ == "__main__":
    main()

"""Command line: weekly, train, backtest, panel-backtest, verify, health. Exit codes: 0 done, 2 usage, 3 data, 4 a gate failed, 5 a digest differs."""

from __future__ import annotations

import argparse
import sys

from tidemark import config

OK, USAGE, DATA, GATE, DIGEST = 0, 2, 3, 4, 5


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("verb", choices=["weekly", "train", "backtest", "panel-backtest", "verify", "health"])
    p.add_argument("--data-dir")
    p.add_argument("--out-dir")
    p.add_argument("--config")
    p.add_argument("--as-of", type=config.as_of)
    p.add_argument("--every", type=int)
    p.add_argument("--min-train", type=config.weeks)
    p.add_argument("--embargo", type=config.weeks)
    p.add_argument("--digests")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = config.load(args.config, {k: getattr(args, k) for k in ("data_dir", "out_dir", "every", "min_train", "embargo")})
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return USAGE
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if args.verb == "health":
        return OK if spark.range(1).count() == 1 else DATA
    from tidemark.plans import walkforward
    from tidemark.queries import backtest, modelling
    from tidemark.sources import observations

    d, out = settings.data_dir, settings.out_dir
    try:
        if args.verb == "verify":
            digests = spark.read.json(args.digests or f"{out}/digests.json")
            return OK if observations.checked_files(spark, out, digests).where("not ok").isEmpty() else DIGEST
        if args.verb == "weekly":
            rows = modelling.weekly_output(spark, d)
            rows = rows.where(F.col("as_of_date") == str(args.as_of)) if args.as_of else rows
            observations.write_records(rows.withColumn("as_of", F.col("as_of_date")), f"{out}/weekly")
        elif args.verb == "train":
            walkforward.quantile_fits(modelling.pairs(spark, d)).write.mode("overwrite").parquet(f"{out}/fits")
        elif args.verb == "panel-backtest":
            walkforward.panel_fit(modelling.pairs(spark, d)).write.mode("overwrite").parquet(f"{out}/panel")
        else:
            walkforward.run(modelling.pairs(spark, d), settings.embargo, settings.min_train, settings.every).write.mode("overwrite").parquet(f"{out}/backtest")
            gates = backtest.acceptance_gates(spark, d)
            gates.coalesce(1).write.mode("overwrite").json(f"{out}/gates")
            return OK if gates.where("not passed").isEmpty() else GATE
    except AnalysisException as e:
        print(e, file=sys.stderr)
        return DATA
    return OK


if __name__ == "__main__":
    sys.exit(main())

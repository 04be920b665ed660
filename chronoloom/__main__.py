"""The jobs as commands: `python -m chronoloom train|baselines|forecast --root DIR --as-of TIME [--countries BE,DE|all] [--types load,...|all]`.

DIR holds the domain's tables as Parquet; what the jobs write lies under DIR/out: models, evaluations, forecasts, the log of runs, and reports as CSV.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import functions as F

from .operators import features, jobs, prediction
from .session import session
from .sources import series, sinks
from .sources.store import ModelStore

log = logging.getLogger("chronoloom")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="chronoloom", description=__doc__.splitlines()[0])
    p.add_argument("command", choices=["train", "baselines", "forecast"])
    p.add_argument("--root", required=True)
    p.add_argument("--as-of", required=True, help="a time; nothing later is read, and nothing asks the clock")
    p.add_argument("--countries", default="all")
    p.add_argument("--types", default="all")
    p.add_argument("--horizons", default="", help="days ahead; each type's own if not given")
    p.add_argument("--algorithm", default="xgboost")
    p.add_argument("--rounds", type=int, default=200)
    p.add_argument("--least-rows", type=int, default=1500)
    p.add_argument("--validation-rows", type=int, default=720)
    p.add_argument("--promote", action="store_true", help="models with a skill over --min-skill go into production")
    p.add_argument("--min-skill", type=float, default=0.0)
    p.add_argument("--limit", type=float, default=jobs.LIMIT, help="seconds that a runner has")
    p.add_argument("--master")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = session(a.master)
    countries = jobs.chosen(a.countries, tuple(features.COUNTRIES.split()), upper=True)
    types = jobs.chosen(a.types, jobs.TYPES if a.command == "forecast" else jobs.TRAINED)
    work = jobs.work_list(spark, countries, types, [int(h) for h in a.horizons.split(",") if h.strip()] or None)
    history = series.history(spark, a.root, types, countries)
    out = f"{a.root.rstrip('/')}/out"
    tables, store = sinks.tables(spark, out), ModelStore(spark, f"{out}/models")
    version = a.as_of.replace("-", "").replace(":", "").replace(" ", "_")
    if a.command == "train":
        report, models, names = jobs.train_all(history, work, a.as_of, a.algorithm, {"rounds": a.rounds}, least_rows=a.least_rows, validation_rows=a.validation_rows)
        store.save(models.withColumn("names", F.array(*map(F.lit, names))), version, a.as_of)
        sinks.to_csv(report, f"{out}/reports/train-{version}")
        done = report.where("status = 'completed'")
        scores = done.select(*jobs.SERIES, F.lit(version).alias("model_version"), F.to_date(F.lit(a.as_of)).cast("string").alias("evaluation_date"), "mae", F.col("skill").alias("skill_vs_persistence"), F.lit(False).alias("is_baseline"), F.lit("candidate").alias("model_location")).where("mae is not null")
        sinks.save_evaluation(tables["model_evaluations"], scores)
        if a.promote:
            store.promote(scores.where(F.col("skill_vs_persistence") > a.min_skill))
        log.info("%d of %d series trained", done.count(), report.count())
        return 0
    if a.command == "baselines":
        scores = jobs.baselines_all(history, work, a.as_of)
        rows = scores.select(*jobs.SERIES, F.col("baseline").alias("model_version"), F.to_date(F.lit(a.as_of)).cast("string").alias("evaluation_date"), "mae", "rmse", "mape", "smape", F.col("n").cast("int").alias("test_samples"), F.lit(True).alias("is_baseline"))
        sinks.save_evaluation(tables["model_evaluations"], rows.where("mae is not null"))
        sinks.to_csv(scores, f"{out}/reports/baselines-{version}")
        log.info("%d scores", scores.count())
        return 0
    runners = {"persistence": jobs.persistence}
    if not store.exists().isEmpty():
        kept = store.load()
        names = kept.first().names  # the job trains all series on the same columns

        def stored(past, hours):
            return prediction.predicted(past.withColumn("y", F.col("y").cast("double")), kept.drop("version", "location", "names"), names, hours, jobs.SERIES, a.as_of, load=F.col("forecast_type") == "load").join(kept.select(*jobs.SERIES), jobs.SERIES, "left_semi")

        runners["production"] = stored
    results = jobs.run_all(history, work, lambda rows: sinks.save_forecasts(tables["forecasts"], rows), a.as_of, runners, a.limit, version)
    runs = spark.createDataFrame([(name, status, message) for name, status, message in results], "run_type string, status string, error_message string")
    tables["forecast_runs"].write(tables["forecast_runs"].read().unionByName(runs.withColumns({"run_timestamp": F.lit(a.as_of).cast("timestamp"), "types_requested": F.lit(",".join(types)), "countries_requested": F.lit(",".join(countries))}), allowMissingColumns=True))
    for name, status, message in results:
        log.info("%s: %s%s", name, status, f" ({message})" if message else "")
    return 0 if any(status == "completed" for _, status, _ in results) else 1


if __name__ == "__main__":
    sys.exit(main())

"""ask, noul, choice, score and fit over DataFrames, and a command line on top of them."""
from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.config import Config, tier
from calibra.operators import calibrate, fits, suites
from calibra.operators import decide as D

_REQUEST = "request_id long, images array<string>, question string, type string, keys array<string>, descriptions array<string>"


class Decider:
    """Questions about rows of images, answered by a scorer (statement rows in, z out)."""

    def __init__(self, spark: SparkSession, scorer: Callable[[DataFrame], DataFrame] = D.hash_scorer, config: Config | None = None):
        self.spark, self.scorer, self.config, self.temperature = spark, scorer, config or Config(), 1.0
        self.sets: DataFrame | None = None

    def ask(self, requests: DataFrame) -> DataFrame:
        """Answers to valid requests; a request with errors is an exception that names its first error."""
        checked = D.problems(requests)
        bad = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("validation_error: "), F.get("errors", F.lit(0))["message"]))).otherwise(F.col("request_id"))
        return D.answers(self.scorer(D.fan_out(checked.withColumn("request_id", bad).drop("errors"))), self.temperature)

    def _one(self, image: str, question: str, kind: str, keys: list[str], descriptions: list[str | None]):
        row = self.spark.createDataFrame([(0, [image], question, kind, keys, descriptions)], _REQUEST)
        return self.ask(row).first()

    def noul(self, image: str, statement: str) -> float:
        return self._one(image, statement, "noul", [], [])["p"][1]

    def choice(self, image: str, question: str, options: dict[str, str | None]):
        return self._one(image, question, "choice", list(options), list(options.values()))

    def score(self, image: str, question: str, levels: list[str]):
        return self._one(image, question, "score", levels, [None] * len(levels))

    def fit(self, labelled: DataFrame) -> Decider:
        """labelled: z array<double>, y int. A decider whose answers use the fitted temperature."""
        found = fits.fit_temperature(labelled.withColumn("unit", F.lit("all")), "unit", "z", "y").first()
        new = Decider(self.spark, self.scorer, self.config)
        new.temperature = found["temperature"]
        return new


    def calibrate(self, rows: DataFrame) -> Decider:
        """rows: prediction rows (see operators/calibrate.py). A decider that holds the fits by question type and by suite."""
        new = Decider(self.spark, self.scorer, self.config)
        new.sets = calibrate.fit_sets(rows)
        return new

    def calibrated(self, rows: DataFrame, prefer_suite: bool = False) -> DataFrame:
        """rows with p under the fit of their own configuration; one without a fit is an error."""
        if self.sets is None:
            raise ValueError("calibration_mismatch: nothing is fitted")
        found = calibrate.apply_sets(rows, self.sets, prefer_suite)
        bad = F.concat(F.lit("calibration_mismatch: no fit for "), F.concat_ws("/", "key", "type"))
        return found.withColumn("p", F.when(F.col("fit_scope").isNull(), F.raise_error(bad)).otherwise(F.col("p")))


def hosted(config: Config, backend: str) -> str:
    """A hosted back end's name, if the settings allow sending pictures out."""
    if not config.allow_hosted:
        raise PermissionError(f"{backend} is hosted: set allow_hosted to send pictures to it")
    return backend


_ROWS = "key string, suite string, type string, split string, item_id string, z array<double>, label_index int"


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="calibra")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor").add_argument("--ram-gb", type=float, default=16)
    ask = commands.add_parser("decide")
    ask.add_argument("requests", help="JSON lines of requests")
    fit = commands.add_parser("fit")
    fit.add_argument("predictions", help="JSON lines of prediction rows")
    commands.add_parser("suites")
    one = commands.add_parser("ask", help="one yes/no question or choice about one picture")
    one.add_argument("image")
    one.add_argument("question")
    one.add_argument("--option", action="append", default=[], help="key=description or key; none asks yes or no")
    rate = commands.add_parser("score", help="one rating of one picture")
    rate.add_argument("image")
    rate.add_argument("--rubric", help='a JSON file with "instructions" and "criteria", lowest first')
    rate.add_argument("--instructions")
    rate.add_argument("--criteria", nargs="+")
    run = commands.add_parser("eval")
    run.add_argument("sf_dir")
    run.add_argument("queries", nargs="*")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        print(json.dumps({"tier": tier(args.ram_gb)}), file=out)
        return 0
    if args.command == "suites":
        for group, names in sorted(suites.GROUPS.items()):
            print(json.dumps({"group": group, "suites": names}), file=out)
        return 0
    if args.command == "score" and args.rubric:
        with open(args.rubric, encoding="utf-8") as f:
            read = json.load(f)
        args.instructions, args.criteria = read.get("instructions"), read.get("criteria")
    if args.command == "score" and not (args.instructions and args.criteria):
        print("give --rubric with instructions and criteria, or --instructions and --criteria", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args.command in ("ask", "score"):
        decider = Decider(spark)
        if args.command == "score":
            row = decider.score(args.image, args.instructions, args.criteria)
        elif args.option:
            row = decider.choice(args.image, args.question, {k: d or None for k, _, d in (o.partition("=") for o in args.option)})
        else:
            row = decider._one(args.image, args.question, "noul", [], [])
        print(json.dumps(row.asDict()), file=out)
        return 0
    if args.command == "fit":
        rows = spark.read.schema(_ROWS).json(args.predictions)
        for r in calibrate.quality(rows, calibrate.fit_sets(rows)).toLocalIterator():
            print(json.dumps(r.asDict()), file=out)
        return 0
    if args.command == "decide":
        rows = spark.read.schema(_REQUEST).json(args.requests)
        for r in Decider(spark).ask(rows).toLocalIterator():
            print(json.dumps(r.asDict()), file=out)
        return 0
    from calibra.plans import catalog

    for name in args.queries or ["metric_bundle", "ece_equal_mass", "go_no_go"]:
        print(f"## {name}", file=out)
        print(markdown(catalog.QUERIES[name](spark, args.sf_dir)), file=out)
    return 0


def markdown(df: DataFrame, most: int = 50) -> str:
    """The first rows of an aggregate as a table."""
    rows = [df.columns, ["---"] * len(df.columns), *(["" if v is None else str(v) for v in r] for r in df.take(most))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


if __name__ == "__main__":
    sys.exit(main())

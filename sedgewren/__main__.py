"""Commands over parquet folders: python -m sedgewren COMMAND --in PATH --out PATH ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import disclosure
from .functions import text as T
from .operators import audit, cohort, early, labels, metrics, models, preprocess, splits, users
from .plans import all_queries
from .schemas import TARGETS, require_columns
from .session import build_session
from .sources import corpora, files

Command = Callable[[SparkSession, argparse.Namespace], DataFrame]
COMMANDS: dict[str, Command] = {}


def command(name: str) -> Callable[[Command], Command]:
    def put(function: Command) -> Command:
        COMMANDS[name] = function
        return function

    return put


def corpus(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    return files.read_corpus(spark, options.source)


@command("preprocess")
def preprocess_(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return preprocess.preprocess(corpus(spark, o), near=o.near)


@command("label-weak")
def label_weak(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    priors = config.priors_frame(spark, config.load_communities(o.communities))
    return labels.weak_labels(corpus(spark, o), priors, "clean_text", "subreddit")


@command("label-disclosure")
def label_disclosure(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return disclosure.disclosure_labels(corpus(spark, o), "clean_text")


@command("label-aggregate")
def label_aggregate(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return labels.aggregate_labels(corpus(spark, o), o.target)


@command("disclosure-summary")
def disclosure_summary(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    frame = corpus(spark, o)
    return audit.disclosure_summary(frame, "subreddit", {t: f"disclosure_{t}" for t in TARGETS if f"disclosure_{t}" in frame.columns})


@command("audit")
def audit_(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return audit.corpus_stats(corpus(spark, o), "clean_text", "subreddit", "author_hash", "created_utc")


@command("features")
def features(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    wide = corpus(spark, o).withColumn("_w", T.tokens(F.col("clean_text")))
    return wide.withColumns(T.feature_columns(F.col("clean_text"), F.col("_w"))).drop("_w")


@command("split")
def split(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    frame = corpus(spark, o)
    return splits.group_split(frame, "author_hash") if o.by_author else splits.stratified_split(frame, "id", f"label_{o.target}")


@command("train")
def train(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Fits on rows of split train and scores all; the model is saved beside the scores."""
    frame = require_columns(corpus(spark, o), "split", f"label_{o.target}").withColumn("y", T.binarise(F.col(f"label_{o.target}")))
    fitted = models.build_model(o.model, text="clean_text").fit(frame.where("split = 'train'"))
    fitted.save(f"{o.out}-model")
    return fitted.score(frame).select("id", "subreddit", "author_hash", "created_utc", "split", "y", F.col("score").alias(f"score_{o.target}"), F.col("pred").alias(f"pred_{o.target}"))


@command("evaluate")
def evaluate(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    frame = corpus(spark, o).withColumnRenamed(f"score_{o.target}", "score").where("split = 'test'")
    best = metrics.best_threshold(frame).first()["threshold"]
    whole = metrics.basic_metrics(frame, threshold=best).withColumn("threshold", F.lit(best))
    return whole.join(metrics.auroc(frame)).join(metrics.auprc(frame)).join(metrics.calibration_error(frame))  # one row each


@command("evaluate-groups")
def evaluate_groups(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return metrics.confusion_by(corpus(spark, o).withColumn("pred", F.col(f"pred_{o.target}")), "subreddit")


@command("build-testset")
def build_testset(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return cohort.test_users(corpus(spark, o), "author_hash", "subreddit", {t: f"disclosure_{t}" for t in TARGETS})


@command("evaluate-users")
def evaluate_users(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    per = users.aggregate_scores(corpus(spark, o), "author_hash", f"score_{o.target}", f"user_{o.target}", o.how).withColumnRenamed("label", "y")
    return metrics.basic_metrics(per, threshold=metrics.best_threshold(per).first()["threshold"])


@command("evaluate-early")
def evaluate_early(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return early.report(early.decisions(corpus(spark, o), "author_hash", f"score_{o.target}", f"user_{o.target}", "created_utc", "id", o.threshold, o.streak))


@command("load-trec")
def load_trec(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return corpora.unique_sentences(corpora.trec_sentences(spark, o.source))


@command("load-submissions")
def load_submissions(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return corpora.nested_submissions(spark, o.source)


@command("query")
def query(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """A registered query over a folder of test tables."""
    return all_queries.queries()[o.name](spark, o.source)


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sedgewren", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--in", dest="source", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--target", default="anxiety", choices=TARGETS)
    parser.add_argument("--communities", help="YAML of communities and priors")
    parser.add_argument("--model", default="tfidf")
    parser.add_argument("--name", help="a registered query")
    parser.add_argument("--how", default="mean", choices=("mean", "max", "topk_mean"))
    parser.add_argument("--threshold", type=float, default=0.5)
    parser.add_argument("--streak", type=int, default=1)
    parser.add_argument("--near", type=int, default=-1, help="Hamming distance of near-dedup; -1: exact only")
    parser.add_argument("--by-author", action="store_true")
    options = parser.parse_args(arguments)
    spark = build_session()
    files.write_parquet(COMMANDS[options.command](spark, options), options.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

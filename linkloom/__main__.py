"""Command line: ``python -m linkloom COMMAND ...`` runs the flows over TSV files.

profile RECORDS...                         counts of entity records
candidates S1 S2 S3 OUT                    candidate lists of the rule flow
match S1 S2 S3 OUT_DIR [--threshold --gap --max-matches]   matching_results and candidate_pairs
evaluate TRUTH MATCHES [--scope]           macro precision, recall, F0.5
validate MATCHES S1 [--candidates FILE] [--records FILE...]   one line for each rule that finds something
train S1 S2 S3 TRUTH MODEL                 fits the fast flow's model and tells its best threshold
submit S1 S2 S3 MODEL OUT_DIR [--threshold --gap --max-matches --bundle DIR]   the fast flow by a saved model; encoded targets are written once, a run that broke off goes on where it was
diagnose S1 S2 S3 TRUTH                    how many true pairs each class of keys covers, and pairs that none does
honest S1 S2 S3 TRUTH [--thresholds T...]  scores of the fast flow on records its model hasn't seen
sweep S1 S2 S3 MODEL TRUTH                 macro F0.5 of the fast flow's best candidates by threshold
predict S1 S2 S3 TRUTH OUT_DIR             the two-stage flow, trained on the truth
urls URLS OUT_DIR [--model DIR]            a line of JSON for each URL of a text file
serve [--host --port]                      the URL analysis as a JSON service
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.shipping import ship
from linkloom.functions.text import normalize_country, normalized_records
from linkloom.functions.url import analyze
from linkloom.operators import evaluation, models, selection
from linkloom.plans import flows
from linkloom.sources import io
from linkloom.sources.shared import spool

WARNINGS = {"matched_outside_candidates"}


def _lists(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """(s1_id, list) as written: neither trimmed nor deduplicated."""
    df = spark.read.options(sep="\t", header=True, quote="").csv(path)
    if not evaluation.header_is(df, header):
        raise SystemExit(f"{path}: expected the header {header}, tab-separated; found {df.columns}")
    return df.toDF("s1_id", "list").fillna({"list": ""})


def _show(row) -> None:
    print(json.dumps(row.asDict(recursive=True)))


def profile(spark: SparkSession, a: argparse.Namespace) -> int:
    records = io.read_records(spark, a.records)
    _show(evaluation.source_profile(records).first())
    _show(evaluation.integrity_report(records).first())
    for row in evaluation.country_histogram(records).orderBy(F.desc("n")).limit(50).collect():
        _show(row)
    return 0


def candidates(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = io.read_records(spark, a.s1), io.read_records(spark, [a.s2, a.s3])
    pairs = flows.rule_candidates(normalized_records(s1), normalized_records(targets))
    io.write_tsv(io.id_lists(pairs.select("s1_id", "cand_id"), s1.select(F.col("entity_id").alias("s1_id")), io.CANDIDATE_HEADER), a.out)
    return 0


def match(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = io.read_records(spark, a.s1), io.read_records(spark, [a.s2, a.s3])
    config = flows.LinkConfig(threshold=a.threshold, gap=a.gap, max_matches=a.max_matches)
    cands, found = flows.rule_flow(s1, targets, config)
    matches, lists = flows.outputs(found, cands, s1)
    io.write_tsv(matches, f"{a.out}/matching_results")
    io.write_tsv(lists, f"{a.out}/candidate_pairs")
    return 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    found = _lists(spark, a.matches, io.MATCH_HEADER).select("s1_id", io.parse_id_list(F.col("list")).alias("ids"))
    _show(evaluation.evaluate_matching(io.read_truth(spark, a.truth), found, a.scope).first())
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    required = io.read_id_column(spark, a.s1).withColumnRenamed("entity_id", "s1_id")
    known = io.read_records(spark, a.records).select("entity_id") if a.records else None
    held = _lists(spark, a.candidates, io.CANDIDATE_HEADER) if a.candidates else None
    bad = evaluation.submission_findings(_lists(spark, a.matches, io.MATCH_HEADER), required, known, held).where("offenders > 0").collect()
    for row in bad:
        print(f"{'warning' if row['rule'] in WARNINGS else 'error'}: {row['rule']}: {row['offenders']}, e.g. {row['examples']}")
    return int(any(row["rule"] not in WARNINGS for row in bad))


def _sides(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return io.read_records(spark, a.s1), io.read_records(spark, [a.s2, a.s3])


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = _sides(spark, a)
    truth = io.read_truth(spark, a.truth)
    compared = spool(flows.fast_pairs(s1, targets), "compared")
    model = flows.fit_fast_model(compared, io.truth_pairs(truth))
    model.save(spark, a.model)
    threshold, f = models.search_threshold(_best(model.score(compared)), truth)
    print(json.dumps({"threshold": threshold, "f05": round(f, 6), "stumps": len(model.stumps)}))
    return 0


def _best(scored: DataFrame) -> DataFrame:
    return selection.top_k(scored.select("s1_id", "cand_id", F.col("score").alias("p")), 1, ["cand_id"], "p", ["s1_id"])


def submit(spark: SparkSession, a: argparse.Namespace) -> int:
    """Matches and candidates of every S1 by buckets, of which a second run of the same command makes only those that are missing; then the two lists."""
    s1, targets = _sides(spark, a)
    config = flows.LinkConfig(fast_threshold=a.threshold, fast_gap=a.gap, fast_matches=a.max_matches)
    written = flows.submit(s1, targets, models.StumpModel.load(spark, a.model), a.out, config, a.bundle)
    held = spark.read.parquet(f"{a.out}/buckets").withColumnRenamed("s1_id", "source1_entity_id")
    io.write_tsv(held.select(*io.MATCH_HEADER), f"{a.out}/matching_results")
    io.write_tsv(held.select(*io.CANDIDATE_HEADER), f"{a.out}/candidate_pairs")
    print(json.dumps({"buckets_written": len(written)}))
    return 0


def sweep(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = _sides(spark, a)
    scored = models.StumpModel.load(spark, a.model).score(flows.fast_pairs(s1, targets))
    for threshold, f in models.tune_threshold(_best(scored), io.read_truth(spark, a.truth), [i / 20 for i in range(1, 20)]):
        print(json.dumps({"threshold": threshold, "f05": round(f, 6)}))
    return 0


def diagnose(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = _sides(spark, a)
    by_class, missed = flows.diagnose_keys(s1, targets, io.truth_pairs(io.read_truth(spark, a.truth)))
    for row in by_class.orderBy(F.desc("covered"), "class").collect():
        _show(row)
    missed = spool(missed, "missed")
    print(json.dumps({"uncovered": missed.count(), "examples": [list(r) for r in missed.orderBy("s1_id", "cand_id").limit(8).collect()]}))
    return 0


def honest(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = _sides(spark, a)
    for threshold, row in flows.honest_evaluation(s1, targets, io.read_truth(spark, a.truth), a.thresholds):
        print(json.dumps({"threshold": threshold} | row.asDict()))
    return 0


def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    known = lambda path: io.read_records(spark, path).withColumn("country", normalize_country(F.col("country")))
    s1 = known(a.s1)
    scored = flows.two_stage(s1, known(a.s2), known(a.s3), io.truth_pairs(io.read_truth(spark, a.truth)))
    cands = scored.select("s1_id", F.col("q_id").alias("cand_id"))
    matches, lists = flows.outputs(flows.final_matches(scored), cands, s1)
    io.write_tsv(matches, f"{a.out}/matching_results")
    io.write_tsv(lists, f"{a.out}/candidate_pairs")
    return 0


def urls(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = spark.read.text(a.urls).withColumnRenamed("value", "url")
    out = analyze(lines, score=models.url_scorer(models.url_model(spark, path=a.model)) if a.model else None)
    out.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(a.out)
    return 0


def serve(spark: SparkSession, a: argparse.Namespace) -> int:
    from linkloom.service import server

    server(spark, a.host, a.port).serve_forever()
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(run, *names: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__)
        p.set_defaults(run=run)
        for n in names:
            p.add_argument(n)
        return p

    command(profile).add_argument("records", nargs="+")
    command(candidates, "s1", "s2", "s3", "out")
    p = command(match, "s1", "s2", "s3", "out")
    p.add_argument("--threshold", type=float, default=0.62)
    p.add_argument("--gap", type=float, default=0.15)
    p.add_argument("--max-matches", type=int)
    command(evaluate, "truth", "matches").add_argument("--scope", choices=("union", "intersection"), default="union")
    p = command(validate, "matches", "s1")
    p.add_argument("--candidates")
    p.add_argument("--records", nargs="*")
    command(train, "s1", "s2", "s3", "truth", "model")
    p = command(submit, "s1", "s2", "s3", "model", "out")
    p.add_argument("--threshold", type=float, default=flows.LinkConfig.fast_threshold)
    p.add_argument("--gap", type=float, default=flows.LinkConfig.fast_gap)
    p.add_argument("--max-matches", type=int, default=flows.LinkConfig.fast_matches)
    p.add_argument("--bundle")
    command(sweep, "s1", "s2", "s3", "model", "truth")
    command(diagnose, "s1", "s2", "s3", "truth")
    command(honest, "s1", "s2", "s3", "truth").add_argument("--thresholds", type=float, nargs="+", default=[0.35, 0.45, 0.55, 0.65])
    command(predict, "s1", "s2", "s3", "truth", "out")
    command(urls, "urls", "out").add_argument("--model")
    p = command(serve)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    ship(spark)
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())

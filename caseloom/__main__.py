"""Run one step of a study: ``python -m caseloom STEP INPUT OUTPUT [options]``.

prepare     raw encounter CSV → clean Parquet with the score
compare     clean → comparison by readmission status (CSV)
dist        clean → distributions of diagnosis counts, procedure counts, score and readmission (CSV folders)
narrate     clean → narratives (Parquet); needs --dictionary
tokenize    narratives → token arrays (Parquet)
truncation  narratives → truncation statistics (CSV folders)
label       encounters → the same with the 30-day readmission label (Parquet); --patient, --admit, --key, --exclude
train       clean → predictions, probabilities, confusion matrix, ROC, importances and summary; --model forest, boosting, network
train-text  narratives → the same for the text classifier
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseloom.operators import evaluate, models
from caseloom.operators.experiments import Run
from caseloom.operators.readmission import exclude_disposition, readmission_label
from caseloom.operators.tokens import MAX_LENGTH
from caseloom.plans import workflow
from caseloom.session import build_session, remove_intermediates
from caseloom.sources import datasets
from caseloom.sources import encounters as enc
from caseloom.sources.dictionary import read_dictionary

STEPS = ("prepare", "compare", "dist", "narrate", "tokenize", "truncation", "label", "train", "train-text")


def write_run(run: Run, folder: str, name: str, features: list[str] | None = None) -> None:
    """The tables of a run as CSV folders, and its report appended to the summary."""
    datasets.write_csv(run.scored, f"{folder}/{name}_predictions")
    probability = "readmission_probability" if name == "text" else "predicted_probability"
    renamed = run.scored.withColumnsRenamed({"label": "true_label", "predicted_probability": probability})
    datasets.write_csv(renamed.drop("predicted_label"), f"{folder}/{name}_probabilities")
    datasets.write_csv(run.confusion(), f"{folder}/{name}_confusion_matrix")
    datasets.write_csv(evaluate.roc_curve(run.scored, "label", "predicted_probability"), f"{folder}/{name}_roc")
    if features and hasattr(run.model, "featureImportances"):
        datasets.write_csv(models.importances(run.model, features), f"{folder}/{name}_importances")
    if run.search:
        datasets.write_csv(models.search_results(run.search), f"{folder}/{name}_grid")
    datasets.append_summary(run.report().withColumn("run_id", F.lit(name)), f"{folder}/summary")


def labelled(encounters, key: str, patient: str, admit: str, excluded: str | None):
    """Encounters with the label; those that ended against advice are left out after their patients' stays are labelled."""
    found = readmission_label(encounters, key, patient, admit, enc.LABEL_COLUMN)
    return exclude_disposition(found, excluded) if excluded else found


def read_narratives(spark, path: str):
    """CSV where the path says so, else Parquet."""
    return datasets.read_narratives(spark, path, "csv" if path.rstrip("/").endswith(".csv") else "parquet")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="caseloom", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--dictionary", help="CSV with Code and Description")
    parser.add_argument("--label", default=enc.LABEL_COLUMN)
    parser.add_argument("--model", default="forest", choices=("forest", "boosting", "network"))
    parser.add_argument("--tier", default="rich", choices=tuple(enc.TIERS))
    parser.add_argument("--key", default=enc.ID_COLUMN)
    parser.add_argument("--patient", default="patient_id")
    parser.add_argument("--admit", default="admit")
    parser.add_argument("--exclude", metavar="COLUMN", help="disposition column; leave out encounters that ended against advice")
    parser.add_argument("--class-size", type=int, default=workflow.CLASS_SIZE)
    options = parser.parse_args(arguments)
    own = SparkSession.getActiveSession() is None
    spark = build_session("caseloom")
    output = options.output

    if options.step == "prepare":
        workflow.prepare(enc.read_encounter_csv(spark, options.input)).write.mode("overwrite").parquet(output)
    elif options.step == "compare":
        datasets.write_csv(workflow.compare(enc.read_encounters(spark, options.input), options.label), output)
    elif options.step == "dist":
        clean = enc.read_encounters(spark, options.input)
        datasets.write_csv(workflow.count_distribution(clean, "I10_NDX", "Diagnoses"), f"{output}/diagnoses")
        datasets.write_csv(workflow.count_distribution(clean, "NCPT", "Procedures"), f"{output}/procedures")
        datasets.write_csv(workflow.score_distribution(clean), f"{output}/score")
        datasets.write_csv(workflow.readmission_ratio(clean, options.label), f"{output}/readmission")
    elif options.step == "narrate":
        if not options.dictionary:
            parser.error("narrate needs --dictionary")
        names = read_dictionary(spark, options.dictionary)
        rows = workflow.narratives(enc.read_encounters(spark, options.input), names, options.label)
        rows.write.mode("overwrite").parquet(output)
    elif options.step == "tokenize":
        encoded = workflow.tokenize(read_narratives(spark, options.input))
        datasets.write_tokens(encoded, output, MAX_LENGTH)
    elif options.step == "truncation":
        stats, lengths = workflow.truncation(read_narratives(spark, options.input))
        datasets.write_csv(stats, f"{output}/statistics")
        datasets.write_csv(lengths, f"{output}/lengths")
    elif options.step == "label":
        rows = labelled(spark.read.parquet(options.input), options.key, options.patient, options.admit, options.exclude)
        rows.write.mode("overwrite").parquet(output)
    elif options.step == "train":
        clean = enc.read_encounters(spark, options.input)
        run = workflow.train(clean, options.model, options.tier, options.label, options.class_size)
        write_run(run, output, options.model, enc.tier_columns(options.tier))
    else:
        run = workflow.train_text(spark.read.parquet(options.input), options.class_size)
        write_run(run, output, "text")
    if own:  # a session that others use keeps its tables
        remove_intermediates(spark)


if __name__ == "__main__":
    main()

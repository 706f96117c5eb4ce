"""Queries: readers and writers, on files Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import views as V
from parley.catalog.common import rounded
from parley.operators.metrics import threshold_sweep
from parley.operators.ratings import keep_first
from parley.operators.tables import union_all
from parley.plans import evaluation
from parley.plans import modelling as plan
from parley.session import work_path
from parley.sources import readers, sinks

CORPUS = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("reply_to", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("is_moderator", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("dataset", T.StringType()),
    ]
)

# Bytes of a range of the single corpus file, so that even a small one is read in several tasks.
ONE_FILE_SPLIT = 1 << 19


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path, landed = work_path(spark, "corpus-csv"), work_path(spark, "corpus")
    sinks.write_csv(V.comments(spark, sf).withColumnRenamed("user_name", "user"), path)
    sinks.land_corpus(readers.read_corpus(spark, path, CORPUS), landed)
    return spark.read.parquet(landed)


def csv_single_file(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV file with line breaks, quotes and empty lines in its texts, read in many tasks."""
    path = f"{work_path(spark, 'corpus-file')}/corpus.csv"
    text = F.concat_ws("\n", "text", F.lit('she said "no",'), F.lit(""), "message_id")
    rows = V.comments(spark, sf).withColumnRenamed("user_name", "user").withColumn("text", text)
    sinks.write_csv(rows.coalesce(1), path)
    return readers.read_corpus(spark, path, CORPUS, split_bytes=ONE_FILE_SPLIT)


def split_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "splits")
    split = plan.splits(V.labelled(spark, sf), "should_intervene")
    sinks.write_splits(split.select("message_id", "dataset", "text", "split"), path)
    return readers.read_split(spark, path, "test", ["ds0", "ds1", "ds2"]).select(
        "message_id", "dataset", "text"
    )


def lookup_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_path(spark, 'lookup')}/items.tsv"
    rows = V.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("conv_id"), "text", F.col("source").alias("dataset"),
        "lang", "n_chars",
    )
    twice = rows.unionByName(rows.where("doc_id % 5 = 0"))
    twice.write.options(
        header=True, sep="\t", quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return readers.read_lookup(spark, path)


def human_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rating sheets, one per rater and pass, read back as one table."""
    path = work_path(spark, "sheets")
    cells = [
        F.when(F.col(s) != 0, F.concat(F.col(s).cast("string"), F.lit(" – level"))).alias(s)
        for s in readers.SCALES
    ]
    letter = F.element_at(F.array(*[F.lit(x) for x in "abcde"]), F.substring("annotator", 2, 1).cast("int"))
    sheets = V.ratings(spark, sf).where("is_human").select(
        "conv_id",
        F.lit(None).cast("string").alias("discussion"),
        "data_malformation",
        F.concat(F.lit("because\n"), "conv_id").alias("rationale/comments"),
        *cells,
        F.concat(
            F.lit("r"), letter, F.lit("0"), F.col("pass_no").cast("string"), F.lit("_part_"),
            F.col("pass_no").cast("string"), F.lit(".csv"),
        ).alias("sheet"),
    )
    sinks.write_csv(sheets, path, partition_by="sheet")
    rows = readers.alias_raters(readers.read_human_ratings(spark, path), ["ra", "rb", "rc", "rd", "re"])
    first = keep_first(rows, ["annotator", "conv_id"], ["file_path", "row_no"])
    return first.select("annotator", "conv_id", "data_malformation", "rationale", *readers.SCALES)


def file_name_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of survey answers, the model taken from the file name."""
    root = work_path(spark, "answers")
    answers = V.survey_responses(spark, sf)
    for column, suffix in (
        ("dual_response", "_dual.csv"),
        ("single_response_text", "_single.csv"),
    ):
        named = answers.select(
            "conv_id",
            F.col(column).alias("response"),
            sinks.export_name("", "model", suffix).alias("export"),
        )
        sinks.write_csv(named, f"{root}/{column}", partition_by="export")
    dual = readers.read_dual_responses(spark, root)
    single = readers.read_single_responses(spark, root)
    return dual.join(single, ["model", "conv_id"]).select(
        "model", "conv_id", "data_malformation", *readers.SCALES, "single_response"
    )


def prediction_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of both tasks from one scan of prediction files."""
    root = work_path(spark, "predictions")
    answers = V.responses(spark, sf)
    tasks = F.explode(F.array(F.lit("detection"), F.lit("prediction")))
    named = answers.withColumn("task", tasks).select(
        "message_id", "dataset", "is_moderator", "should_intervene", "response",
        F.concat("model", F.lit("_timing_"), "task", F.lit(".csv")).alias("export"),
    )
    sinks.write_csv(named, root, partition_by="export")
    rows = readers.read_predictions(spark, root)
    # Detection is about the comment itself, prediction about what follows it.
    truths = {"detection": "is_moderator", "prediction": "should_intervene"}
    metrics = union_all([
        evaluation.answer_metrics(rows.where(F.col("task") == task), truth).withColumn("task", F.lit(task))
        for task, truth in truths.items()
    ])
    names = ["precision", "recall", "f1p", "f1n", "accuracy"]
    return rounded(metrics, *names).select("task", "model", "dataset", *names, "support_rows")


def curve_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold tables of several runs, the run taken from the directory."""
    root = work_path(spark, "curves")
    curves = rounded(threshold_sweep(V.scored(spark, sf), keys=["dataset"]), "precision", "recall", "f1")
    out = curves.select(
        F.col("threshold").alias("Threshold"), F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"), F.col("f1").alias("F1"),
        "dataset", F.lit("pr_curves.csv").alias("file"),
    )
    sinks.write_csv(out, root, partition_by=["dataset", "file"])
    rows = readers.read_curves(spark, root)
    return rows.toDF("run", "threshold", "precision", "recall", "f1")


def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    """A second run with the same output path leaves the first result alone."""
    path = work_path(spark, "once")
    comments = V.comments(spark, sf).select("message_id", "dataset")
    sinks.write_once(spark, path, lambda: comments)
    sinks.write_once(spark, path, lambda: comments.where("dataset = 'ds0'"))
    return sinks.read_once(spark, path)


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "csv_single_file": csv_single_file,
    "split_round_trip": split_round_trip,
    "lookup_scan": lookup_scan,
    "human_scan": human_scan,
    "file_name_scan": file_name_scan,
    "prediction_scan": prediction_scan,
    "curve_scan": curve_scan,
    "skip_existing": skip_existing,
}


def _oracles() -> dict[str, str]:
    from parley.catalog.metrics import ORACLES as METRICS
    from parley.catalog.metrics import _eval_sql
    from parley.catalog.modelling import _SPLIT
    from parley.catalog.survey import _FIRST

    single = (
        "try_cast(nullif(regexp_extract(single_response_text,'([0-9]+)',1),'') as double)"
    )
    scales = ", ".join(f"cast({s} as bigint) as {s}" for s in readers.SCALES)
    return {
        "csv_round_trip": V.with_views(
            """select conv_id, message_id, reply_to, user_name as user, is_moderator, text, dataset
from comments""",
            "comments",
        ),
        "csv_single_file": V.with_views(
            """select conv_id, message_id, reply_to, user_name as user, is_moderator,
  concat(text, chr(10), 'she said "no",', chr(10), chr(10), message_id) as text, dataset from comments""",
            "comments",
        ),
        "split_round_trip": V.with_views(
            """select message_id, dataset, text from split
where split = 'test' and dataset in ('ds0','ds1','ds2')""",
            "labelled",
            extra=_SPLIT,
        ),
        "lookup_scan": "select cast(doc_id as string) as conv_id, text, source as dataset from documents",
        "human_scan": V.with_views(
            f"""select annotator, conv_id, data_malformation, 'because'||chr(10)||conv_id as rationale,
  {scales} from firsts where is_human""",
            "ratings",
            extra=_FIRST,
        ),
        "file_name_scan": V.with_views(
            f"""select model, conv_id, 'no' as data_malformation, p.positive_reinforcement,
  p.negative_reinforcement, p.no_reinforcement, {single} as single_response
from survey_responses s join (select model, conv_id, cast(regexp_extract(dual_response,
    'Positive: ([0-9]+)',1) as bigint) as positive_reinforcement,
    cast(regexp_extract(dual_response,'negative:([0-9]+)',1) as bigint) as negative_reinforcement,
    coalesce(try_cast(nullif(regexp_extract(dual_response,'No Reinforcement: ([0-9]+)',1),'') as bigint),0)
      as no_reinforcement from survey_responses) p using (model, conv_id)""",
            "survey_responses",
        ),
        "prediction_scan": " union all ".join(
            f"select '{task}' as task, model, dataset, precision, recall, f1p, f1n, accuracy, support_rows"
            f" from ({sql})"
            for task, sql in (
                ("detection", METRICS["eval_by_dataset"]),
                ("prediction", _eval_sql("responses", "should_intervene")),
            )
        ),
        "curve_scan": (
            "select dataset as run, threshold, precision, recall, f1 from ("
            + METRICS["threshold_sweep_by_dataset"]
            + ")"
        ),
        "skip_existing": V.with_views("select message_id, dataset from comments", "comments"),
    }


ORACLES = _oracles()

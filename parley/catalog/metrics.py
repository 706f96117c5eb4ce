"""Queries: answers, decisions, metrics, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import views as V
from parley.catalog.common import BLANKS_SQL, r6, rounded
from parley.functions.labels import decide, decide_logit, sigmoid
from parley.functions.parsing import (
    normalise_binary,
    normalise_binary_number,
    parse_dual,
    parse_single,
)
from parley.operators import metrics as M
from parley.operators.corpus import in_training_group
from parley.operators.scoring import log_loss
from parley.operators.tables import melt, spread
from parley.plans import evaluation

COUNTS = ("precision", "recall", "f1p", "f1n", "accuracy")
REPORT = ("model", "dataset", *COUNTS, "support_rows", "support_pos")


def parse_dual_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.survey_responses(spark, sf)
    parsed = parse_dual(F.col("dual_response"))
    lenient = parse_dual(F.col("dual_response"), lenient=True)
    return rows.select(
        "model", "conv_id", *[c.alias(n) for n, c in parsed.items()],
        lenient["positive_reinforcement"].alias("positive_lenient"),
    )


def parse_single_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.survey_responses(spark, sf)
    return rows.select(
        "model", "conv_id", parse_single(F.col("single_response_text")).alias("single_response")
    )


def normalise_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.responses(spark, sf, labels=False)
    return rows.select("model", "message_id", normalise_binary(F.col("response")).alias("answer"))


def normalise_number_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.scored(spark, sf)
    return rows.select(
        "message_id", normalise_binary_number(F.col("score") * 4 - 1).alias("answer")
    )


def eval_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    answers = V.responses(spark, sf, labels=False)
    return rounded(evaluation.answer_metrics(answers, "is_moderator"), *COUNTS).select(*REPORT)


def eval_without_excluded(spark: SparkSession, sf: str) -> DataFrame:
    answers = V.responses(spark, sf)
    rows = evaluation.answer_metrics(answers, "should_intervene", exclude=["ds3"])
    return rounded(rows, *COUNTS).select(*REPORT)


def eval_excluded_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.evaluate_by_dataset(
        V.responses(spark, sf), F.col("should_intervene"), normalise_binary(F.col("response")),
        exclude_before_macro=["ds3"],
    )
    return rounded(rows, *COUNTS).select(*REPORT)


def eval_quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = V.table(spark, sf, "labels")
    rows = M.evaluate(labels, F.col("quality"), F.lit(1) - F.col("toxic"))
    return rounded(rows, *COUNTS).select(*COUNTS, "support_rows", "support_pos")


def response_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.answer_distribution(V.responses(spark, sf, labels=False))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.threshold_sweep(V.scored(spark, sf)), "precision", "recall", "f1")


def threshold_sweep_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.threshold_sweep(V.scored(spark, sf), keys=["dataset"])
    return rounded(rows, "precision", "recall", "f1")


def metric_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.threshold_sweep(V.scored(spark, sf))
    long = melt(rows, ["threshold"], ["precision", "recall", "f1"], "metric", "value")
    return rounded(long, "value")


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds as rows, one column per dataset with its F1."""
    rows = M.threshold_sweep(V.scored(spark, sf), keys=["dataset"])
    names = [f"ds{i}" for i in range(6)]
    return rounded(spread(rows, ["threshold"], "dataset", "f1", names, fill=0.0), *names)


def training_group_rows(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"first": ("ds0", "ds2"), "second": ("ds1", "ds3", "ds4")}
    rows = in_training_group(V.scored(spark, sf), "second", groups)
    return rows.select("message_id", "dataset", F.col("label").cast("long").alias("label"))


def score_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.scored(spark, sf).withColumn("logit", (F.col("score") - 0.5) * 8)
    probability = sigmoid(F.col("logit"))
    return rows.select(
        "message_id",
        r6(probability).alias("probability"),
        decide(F.col("score")).alias("decision"),
        decide_logit(F.col("logit")).alias("decision_logit"),
    )


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return V.scored(spark, sf).withColumn("pred", decide(F.col("score")))


def score_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.evaluate(_decided(spark, sf), F.col("label"), F.col("pred"), ["dataset"])
    return rounded(rows, "precision", "recall", "f1p", "f1n").select(
        "dataset", "precision", "recall", "f1p", "f1n", F.col("support_pos").alias("support")
    )


def accuracy_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.evaluate(_decided(spark, sf), F.col("label"), F.col("pred"))
    return rounded(rows, "accuracy", "macro_f1").select("accuracy", F.col("macro_f1").alias("f1"))


def run_metric_reshape(spark: SparkSession, sf: str) -> DataFrame:
    scored = _decided(spark, sf).withColumn("prefix", F.concat(F.lit("run_"), "dataset"))
    names = ["loss", "accuracy", "f1"]

    def flat(keys: list[str], head) -> DataFrame:
        metrics = M.evaluate(scored, F.col("label"), F.col("pred"), keys)
        loss = log_loss(scored, keys)
        both = metrics.join(loss, keys) if keys else metrics.withColumn(
            "loss", loss.select("loss").scalar()
        )
        both = both.withColumn("f1", F.col("macro_f1"))
        long = melt(both.select(head.alias("head"), *names), ["head"], names, "m", "value")
        return long.select(F.concat_ws("_", "head", "m").alias("key"), "value")

    per_dataset = flat(["prefix"], F.concat(F.lit("eval_"), F.col("prefix")))
    entries = per_dataset.unionByName(flat([], F.lit("eval")))
    return rounded(M.reshape_run_metrics(entries), *names)


def collapse_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.evaluate(
        V.responses(spark, sf, labels=False),
        F.col("is_moderator"), normalise_binary(F.col("response")), ["model", "dataset"],
    )
    flags = M.collapse_flags(rows, floor=0.35)
    return rounded(flags, "f1p", "f1n").select(
        "model", "dataset", "f1p", "f1n", "collapsed", "best_f1p_model", "best_f1n_model"
    )


QUERIES = {
    "parse_dual": parse_dual_query,
    "parse_single": parse_single_query,
    "normalise_binary": normalise_query,
    "normalise_binary_number": normalise_number_query,
    "eval_by_dataset": eval_by_dataset,
    "eval_without_excluded": eval_without_excluded,
    "eval_excluded_first": eval_excluded_first,
    "eval_quality_labels": eval_quality_labels,
    "response_distribution": response_distribution,
    "threshold_sweep": threshold_sweep,
    "threshold_sweep_by_dataset": threshold_sweep_by_dataset,
    "metric_unpivot": metric_unpivot,
    "metric_pivot": metric_pivot,
    "training_group_rows": training_group_rows,
    "score_decision": score_decision,
    "score_eval": score_eval,
    "accuracy_macro_f1": accuracy_macro_f1,
    "run_metric_reshape": run_metric_reshape,
    "collapse_flags": collapse_flags,
}

_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}]"


def _scale_sql(head: str, blanks: str) -> str:
    return (
        "coalesce(try_cast(nullif(regexp_extract(dual_response, "
        f"'{head}:{_BLANK}{blanks}([0-9]+)', 1, 'i'),'') as bigint), 0)"
    )


def _norm(column: str) -> str:
    word = f"lower(trim({column}, {BLANKS_SQL}))"
    return (
        f"case when {word} in ('1','yes','y','true') then 1 "
        f"when {word} in ('0','no','n','false') then 0 end"
    )


def _counts(source: str, keys: str) -> str:
    return f"""select {keys + ',' if keys else ''}
  count(*) filter (y = 1 and p = 1) as tp, count(*) filter (y = 0 and p = 1) as fp,
  count(*) filter (y = 1 and p = 0) as fn, count(*) filter (y = 0 and p = 0) as tn
from {source} {f'group by {keys}' if keys else ''}"""


_MEASURES = """case when tp+fp+fn+tn = 0 then null else coalesce(cast(tp as double)/nullif(tp+fp,0),0) end as precision,
  case when tp+fp+fn+tn = 0 then null else coalesce(cast(tp as double)/nullif(tp+fn,0),0) end as recall,
  case when tp+fp+fn+tn = 0 then null else coalesce(2.0E0*tp/nullif(2*tp+fp+fn,0),0) end as f1p,
  case when tp+fp+fn+tn = 0 then null else coalesce(2.0E0*tn/nullif(2*tn+fp+fn,0),0) end as f1n,
  cast(tp+tn as double)/nullif(tp+fp+fn+tn,0) as accuracy,
  cast(tp+fp+fn+tn as bigint) as support_rows, cast(tp+fn as bigint) as support_pos"""

_ROUNDED = ", ".join(f"round({m},6) as {m}" for m in COUNTS)


def _eval_sql(view: str, truth: str, before: str = "", after: str = "") -> str:
    return V.with_views(
        f"""select model, dataset, {_ROUNDED}, support_rows, support_pos from (
select * from m
union all
select model, 'All', avg(precision), avg(recall), avg(f1p), avg(f1n), avg(accuracy),
  cast(sum(support_rows) as bigint), cast(sum(support_pos) as bigint) from m group by model
) {after}""",
        view,
        extra={
            "answers": f"select model, dataset, cast({truth} as double) as y, {_norm('response')} as p from responses",
            "c": _counts("answers", "model, dataset"),
            "m": f"select model, dataset, {_MEASURES} from c {before}",
        },
    )


_SWEEP_ROWS = {
    "t": "select round(i*0.05E0,2) as threshold from range(21) r(i)",
}


def _sweep_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""select {k}threshold,
  coalesce(cast(count(*) filter (score >= threshold and label = 1) as double)
    / nullif(count(*) filter (score >= threshold),0), 0) as precision,
  coalesce(cast(count(*) filter (score >= threshold and label = 1) as double)
    / nullif(count(*) filter (label = 1),0), 0) as recall,
  coalesce(2.0E0*count(*) filter (score >= threshold and label = 1)
    / nullif(count(*) filter (score >= threshold) + count(*) filter (label = 1),0), 0) as f1,
  count(*) filter (score >= threshold) as predicted,
  count(*) filter (score >= threshold and label = 1) as tp
from scored cross join t group by {k}threshold"""


_DECIDED = {
    "answers": """select message_id, dataset, label, score, label as y,
  case when score >= 0.5E0 then 1 else 0 end as p from scored"""
}
_MACRO = """(case when tp+fp+fn > 0 then 2.0E0*tp/(2*tp+fp+fn) else 0 end
  + case when tn+fp+fn > 0 then 2.0E0*tn/(2*tn+fp+fn) else 0 end)
  / (case when tp+fp+fn > 0 then 1 else 0 end + case when tn+fp+fn > 0 then 1 else 0 end)"""
_LOSS = """avg(-(label*ln(greatest(least(score,1-1E-15),1E-15))
  + (1-label)*ln(1-greatest(least(score,1-1E-15),1E-15))))"""

ORACLES = {
    "parse_dual": V.with_views(
        f"""select model, conv_id, {_scale_sql('positive', '')} as positive_reinforcement,
  {_scale_sql('negative', '*')} as negative_reinforcement,
  {_scale_sql('no reinforcement', '*')} as no_reinforcement,
  {_scale_sql('positive', '*')} as positive_lenient
from survey_responses""",
        "survey_responses",
    ),
    "parse_single": V.with_views(
        """select model, conv_id, try_cast(nullif(regexp_extract(single_response_text,
  '([0-9]+)', 1),'') as double) as single_response from survey_responses""",
        "survey_responses",
    ),
    "normalise_binary": V.with_views(
        f"select model, message_id, cast({_norm('response')} as bigint) as answer from responses",
        "responses",
    ),
    "normalise_binary_number": V.with_views(
        """select message_id, case when trunc(score*4-1) = 0 then cast(0 as bigint)
  when trunc(score*4-1) = 1 then 1 end as answer from scored""",
        "scored",
    ),
    "eval_by_dataset": _eval_sql("responses", "cast(is_moderator as int)"),
    "eval_without_excluded": _eval_sql("responses", "should_intervene", after="where dataset <> 'ds3'"),
    "eval_excluded_first": _eval_sql("responses", "should_intervene", before="where dataset <> 'ds3'"),
    "eval_quality_labels": V.with_views(
        f"select {_ROUNDED}, support_rows, support_pos from (select {_MEASURES} from c)",
        extra={
            "answers": "select quality as y, 1 - toxic as p from labels",
            "c": _counts("answers", ""),
        },
    ),
    "response_distribution": V.with_views(
        f"""select model, cast(p as bigint) as response, count(*) as n
from (select model, {_norm('response')} as p from responses) where p is not null group by model, p""",
        "responses",
    ),
    "threshold_sweep": V.with_views(
        f"""select threshold, round(precision,6) as precision, round(recall,6) as recall,
  round(f1,6) as f1, predicted, tp from ({_sweep_sql()})""",
        "scored",
        extra=_SWEEP_ROWS,
    ),
    "threshold_sweep_by_dataset": V.with_views(
        f"""select dataset, threshold, round(precision,6) as precision, round(recall,6) as recall,
  round(f1,6) as f1, predicted, tp from ({_sweep_sql('dataset')})""",
        "scored",
        extra=_SWEEP_ROWS,
    ),
    "metric_unpivot": V.with_views(
        """select threshold, 'precision' as metric, round(precision,6) as value from s
union all select threshold, 'recall', round(recall,6) from s
union all select threshold, 'f1', round(f1,6) from s""",
        "scored",
        extra={**_SWEEP_ROWS, "s": _sweep_sql()},
    ),
    "metric_pivot": V.with_views(
        "select threshold, "
        + ", ".join(
            f"round(coalesce(max(case when dataset='ds{i}' then f1 end),0),6) as ds{i}" for i in range(6)
        )
        + f" from ({_sweep_sql('dataset')}) group by threshold",
        "scored",
        extra=_SWEEP_ROWS,
    ),
    "training_group_rows": V.with_views(
        """select message_id, dataset, cast(label as bigint) as label from scored
where dataset in ('ds1','ds3','ds4')""",
        "scored",
    ),
    "score_decision": V.with_views(
        """select message_id, round(1/(1+exp(-((score-0.5E0)*8))),6) as probability,
  cast(case when score >= 0.5E0 then 1 else 0 end as bigint) as decision,
  cast(case when (score-0.5E0)*8 >= 0 then 1 else 0 end as bigint) as decision_logit from scored""",
        "scored",
    ),
    "score_eval": V.with_views(
        f"""select dataset, round(precision,6) as precision, round(recall,6) as recall,
  round(f1p,6) as f1p, round(f1n,6) as f1n, support_pos as support
from (select dataset, {_MEASURES} from c)""",
        "scored",
        extra={**_DECIDED, "c": _counts("answers", "dataset")},
    ),
    "accuracy_macro_f1": V.with_views(
        f"select round(cast(tp+tn as double)/(tp+fp+fn+tn),6) as accuracy, round({_MACRO},6) as f1 from c",
        "scored",
        extra={**_DECIDED, "c": _counts("answers", "")},
    ),
    "run_metric_reshape": V.with_views(
        f"""select 'run_'||c.dataset as dataset, round(l.loss,6) as loss,
  round(cast(tp+tn as double)/(tp+fp+fn+tn),6) as accuracy, round({_MACRO},6) as f1
from c join (select dataset, {_LOSS} as loss from answers group by dataset) l using (dataset)
union all
select 'ALL', round((select {_LOSS} from answers),6),
  round(cast(tp+tn as double)/(tp+fp+fn+tn),6), round({_MACRO},6) from a""",
        "scored",
        extra={**_DECIDED, "c": _counts("answers", "dataset"), "a": _counts("answers", "")},
    ),
    "collapse_flags": V.with_views(
        """select r.model, r.dataset, round(r.f1p,6) as f1p, round(r.f1n,6) as f1n, r.collapsed,
  p.model as best_f1p_model, n.model as best_f1n_model
from (select * from flagged union all
  select 'All', dataset, avg(f1p), avg(f1n), cast(null as boolean) from flagged group by dataset) r
left join (select dataset, model from flagged where not collapsed
  qualify row_number() over (partition by dataset order by round(f1p,9) desc, model) = 1) p using (dataset)
left join (select dataset, model from flagged where not collapsed
  qualify row_number() over (partition by dataset order by round(f1n,9) desc, model) = 1) n using (dataset)""",
        "responses",
        extra={
            "answers": f"select model, dataset, cast(is_moderator as int) as y, {_norm('response')} as p from responses",
            "c": _counts("answers", "model, dataset"),
            "m": f"select model, dataset, {_MEASURES} from c",
            "flagged": "select model, dataset, f1p, f1n, least(f1p,f1n) < 0.35 as collapsed from m",
        },
    ),
}

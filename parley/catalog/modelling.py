"""Queries: context, labels, splits, samples, batches, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import views as V
from parley.catalog.common import THREAD_PLACES, cut_sql, r6
from parley.functions.text import redact_prompt
from parley.operators import sampling
from parley.operators.batches import length_batches
from parley.operators.corpus import label_columns
from parley.operators.context import (
    ancestors,
    intervention_by_reply,
    reply_depth,
    with_context,
    with_context_length,
)
from parley.operators.metrics import class_ratio
from parley.operators.scoring import (
    batch_score,
    feature_rows,
    head_report,
    linear_score,
    score_rows,
    train_head,
)
from parley.operators.threads import thread_places
from parley.plans import modelling as plan
from parley.session import work_path
from parley.sources.readers import read_split
from parley.sources.sinks import land_corpus, write_parquet, write_splits
from parley.streaming.append import append_scored, stream_files

SHORT = 150
# The size in use, and one that needs the random top-up.
FULL_SUBSET, SUBSET = 2000, 53


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    return with_context(comments, comments).select(
        "message_id", "dataset", "n_ancestors", "discussion"
    )


def context_text_cut(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    return with_context(comments, comments, hops=4, max_chars=SHORT).select(
        "message_id", "n_ancestors", "discussion"
    )


def context_length(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    return with_context_length(comments, comments).select("message_id", "est_length")


def reply_chain(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    return ancestors(comments, comments).select(
        "target_id", F.col("hop").cast("long").alias("hop"), "message_id"
    )


def reply_position(spark: SparkSession, sf: str) -> DataFrame:
    return reply_depth(V.comments(spark, sf))


def thread_order(spark: SparkSession, sf: str) -> DataFrame:
    return thread_places(V.threads(spark, sf))


def reply_labels(spark: SparkSession, sf: str) -> DataFrame:
    return intervention_by_reply(V.threads(spark, sf)).select("message_id", "conv_id", "turn", "should_intervene")


def intervention_label(spark: SparkSession, sf: str) -> DataFrame:
    return V.labelled(spark, sf).select("message_id", "conv_id", "turn", "should_intervene")


def label_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.labelled(spark, sf)
    labels = label_columns(rows, ["is_moderator", "should_intervene"])
    return rows.select("message_id", *[c.alias(f"y_{n}") for n, c in labels.items()])


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = class_ratio(V.labelled(spark, sf), "should_intervene")
    return rows.withColumn("pos_weight", r6("pos_weight"))


def class_weights_train(spark: SparkSession, sf: str) -> DataFrame:
    train = plan.splits(V.labelled(spark, sf), "should_intervene").where("split = 'train'")
    rows = class_ratio(train, "should_intervene")
    return rows.withColumn("pos_weight", r6("pos_weight"))


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    split = plan.splits(V.labelled(spark, sf), "should_intervene")
    return split.select("message_id", F.col("should_intervene").alias("target"), "split")


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.hash_split(V.comments(spark, sf))
    return rows.select("message_id", "split")


def balanced_subset(spark: SparkSession, sf: str, n: int = SUBSET) -> DataFrame:
    path = work_path(spark, "splits")
    write_splits(plan.splits(V.labelled(spark, sf), "should_intervene"), path)
    subset = plan.test_subset(read_split(spark, path, "test"), V.comments(spark, sf), n=n)
    return subset.select("message_id", "dataset", "origin", "discussion")


def balanced_subset_full(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_subset(spark, sf, FULL_SUBSET)


def sample_remainder(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    taken = sampling.balanced_ids(comments, SUBSET)
    return sampling.remainder(comments, taken).select("message_id", "dataset")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and context lengths, written once: the batches read them a few times."""
    comments = V.comments(spark, sf)
    path = work_path(spark, "lengths")
    write_parquet(with_context_length(comments, comments).select("message_id", "est_length"), path)
    return spark.read.parquet(path)


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return length_batches(_sized(spark, sf)).select(
        "message_id", "est_length", "batch_id", "batch_order"
    )


def full_batches(spark: SparkSession, sf: str) -> DataFrame:
    return length_batches(_sized(spark, sf), batch_size=10, drop_last=True, epoch=3).select(
        "message_id", "est_length", "batch_id", "batch_order"
    )


def prompt_redaction(spark: SparkSession, sf: str) -> DataFrame:
    # The prompt words do not occur in the invented prose, so two that do
    # stand in for them next to the defaults.
    comments = V.comments(spark, sf)
    return comments.select(
        "message_id",
        redact_prompt(F.col("text")).alias("prompt"),
        redact_prompt(F.col("text"), 200, ("the", "The")).alias("masked"),
    )


def scored_answers(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    answers = batch_score(with_context(comments, comments), system_prompt="Answer 0 or 1.")
    return answers.select("message_id", "dataset", "response")


def weighted_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = feature_rows(V.table(spark, sf, "embeddings"), "embedding", F.col("label") < 5)
    model, split = train_head(rows.select("vec_id", "features", "label"), "vec_id")
    scored = score_rows(model, split.where("split = 'test'"))
    return scored.select("vec_id", "label", r6("score").alias("score"), "decision")


def classifier_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = feature_rows(V.table(spark, sf, "embeddings"), "embedding", F.col("label") < 5)
    model, split = train_head(rows.select("vec_id", "features", "label"), "vec_id")
    return score_rows(model, split).select("vec_id", r6("score").alias("score"), "decision")


def _fixed_weights(n: int = 64) -> list[float]:
    """A head given by a formula on the index."""
    return [((7 * i) % 11 - 5) / 4.0 for i in range(n)]


def linear_head_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = linear_score(V.table(spark, sf, "embeddings"), "embedding", _fixed_weights(), 0.25)
    return rows.select("vec_id", r6("score").alias("score"), "decision")


def weighted_head_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = feature_rows(V.table(spark, sf, "embeddings"), "embedding", F.col("label") < 5)
    model, split = train_head(rows.select("vec_id", "features", "label"), "vec_id")
    return head_report(model, split).withColumn("pos_weight", r6("pos_weight"))


def stream_append(spark: SparkSession, sf: str) -> DataFrame:
    arrived, out = work_path(spark, "arrived"), work_path(spark, "scored")
    comments = V.comments(spark, sf)
    land_corpus(comments, arrived)
    stream = stream_files(spark, arrived, comments.schema)
    query = append_scored(
        stream,
        lambda df: batch_score(df, text="text").select("message_id", "dataset", "response"),
        out,
        work_path(spark, "progress"),
    )
    query.awaitTermination()
    return spark.read.schema("message_id string, dataset string, response string").parquet(out)


QUERIES = {
    "context_text": context_text,
    "context_text_cut": context_text_cut,
    "context_length": context_length,
    "reply_chain": reply_chain,
    "reply_position": reply_position,
    "thread_order": thread_order,
    "intervention_by_reply": reply_labels,
    "intervention_label": intervention_label,
    "label_projection": label_projection,
    "class_ratio": class_weights,
    "class_ratio_train": class_weights_train,
    "stratified_split": stratified_split,
    "hash_split": hash_split,
    "balanced_subset": balanced_subset,
    "balanced_subset_2000": balanced_subset_full,
    "sample_remainder": sample_remainder,
    "length_batches": batches,
    "length_batches_full": full_batches,
    "prompt_redaction": prompt_redaction,
    "batch_score": scored_answers,
    "weighted_head": weighted_head,
    "classifier_score": classifier_score,
    "linear_head_score": linear_head_score,
    "weighted_head_report": weighted_head_report,
    "stream_append": stream_append,
}


def _context_sql(hops: int, n: int, columns: str) -> str:
    joins = "\n".join(
        f"left join cut p{h} on {'c' if h == 1 else f'p{h - 1}'}.reply_to = p{h}.message_id"
        for h in range(1, hops + 1)
    )
    found = " + ".join(
        f"case when p{h}.message_id is null then 0 else 1 end" for h in range(1, hops + 1)
    )
    parts = ", ".join(f"'<CTX>'||p{h}.t||'</CTX>'" for h in range(hops, 0, -1))
    body = f"""select {columns}, cast({found} as bigint) as n_ancestors,
  concat_ws(' ', {parts}, '<TGT>'||c.t||'</TGT>') as discussion
from cut c {joins}"""
    return body


def _cut(n: int) -> dict[str, str]:
    return {"cut": f"select *, {cut_sql('text', n)} as t from comments"}


_LENGTHS = {
    "sized": """select c.message_id, cast(length(c.text) + coalesce(length(p1.text),0)
  + coalesce(length(p2.text),0) + coalesce(length(p3.text),0) as bigint) as est_length
from comments c left join comments p1 on c.reply_to = p1.message_id
left join comments p2 on p1.reply_to = p2.message_id
left join comments p3 on p2.reply_to = p3.message_id"""
}

_SPLIT = {
    "ranked": """select *, row_number() over (partition by should_intervene
    order by md5('42|'||message_id), message_id) as rn,
  count(*) over (partition by should_intervene) as n
from labelled where should_intervene is not null""",
    "split": """select *, case when rn <= floor(n*0.6E0 + 0.5E0) then 'train'
  when rn <= floor(n*0.8E0 + 0.5E0) then 'val' else 'test' end as split from ranked""",
}


def _sample(source: str, n: int = SUBSET) -> dict[str, str]:
    return {
        "quota": f"select {n} // count(distinct dataset) as q from {source}",
        "even": f"""select message_id, dataset, md5('42|'||message_id) as h from {source}
qualify row_number() over (partition by dataset order by md5('42|'||message_id), message_id)
  <= (select q from quota)""",
        "extra": f"""select message_id, dataset, md5('42|'||message_id) as h from {source}
where message_id not in (select message_id from even)
qualify row_number() over (order by md5('42|'||message_id), message_id)
  <= {n} - (select count(*) from even)""",
        "sample": """select message_id, dataset, 'quota' as origin from even
union all select message_id, dataset, 'top_up' as origin from extra""",
    }


def _batches_sql(size: int, epoch: int, where: str) -> str:
    return V.with_views(
        f"""select message_id, est_length, batch_id, b.batch_order
from placed join b using (batch_id)""",
        "comments",
        extra={
            **_LENGTHS,
            "placed": f"""select *, cast(floor((row_number() over
  (order by est_length, md5('42|'||message_id), message_id) - 1) / {size}) as bigint) as batch_id
from sized""",
            "b": f"""select batch_id, row_number() over
  (order by md5('42|{epoch}|'||cast(batch_id as string)), batch_id) as batch_order
from (select batch_id, count(*) as s from placed group by batch_id) {where}""",
        },
    )


_RATIO = """select cast(sum(case when should_intervene = 0 then 1 else 0 end) as bigint) as negatives,
  cast(sum(case when should_intervene = 1 then 1 else 0 end) as bigint) as positives,
  round(cast(sum(case when should_intervene = 0 then 1 else 0 end) as double)
    / nullif(sum(case when should_intervene = 1 then 1 else 0 end), 0), 6) as pos_weight
from """

_ANSWER = """case when contains(t,'?') or contains(t,'please') or contains(t,'thank')
  or contains(t,'X') then '1' else '0' end"""

def _head_sql(select: str, penalties: tuple[float, ...] = (0.0, 0.01, 0.1), steps: int = 25) -> str:
    """The fit of the head step by step: one table per step with a row per penalty."""
    ctes = ["""labelled as (
  select vec_id, case when label < 5 then 1.0E0 else 0.0E0 end as y,
    list_transform(embedding, lambda v: cast(v as double)) as f from embeddings where label is not null)""",
        """ranked as (
  select *, row_number() over (partition by y order by md5('42|'||cast(vec_id as string)), cast(vec_id as string)) as rn,
    count(*) over (partition by y) as n from labelled)""",
        """split as (select vec_id, y, f, case when rn <= floor(n*0.6E0 + 0.5E0) then 'train'
  when rn <= floor(n*0.8E0 + 0.5E0) then 'val' else 'test' end as split from ranked)""",
        """spread as (select list(mu order by j) as mu, list(case when sd = 0 then 1.0E0 else sd end order by j) as sd
  from (select j, avg(v) as mu, stddev_pop(v) as sd
    from (select unnest(f) as v, generate_subscripts(f, 1) as j from split where split = 'train') group by j))""",
        """inputs as materialized (select vec_id, y, split, list_append(
    list_transform(range(1, len(f) + 1), lambda j: (f[j] - mu[j]) / sd[j]), 1.0E0) as x from split, spread)""",
        """classes as (select count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg
  from inputs where split = 'train')""",
        """train as materialized (select vec_id, y, x,
    case when y = 1 then neg::double / pos else 1.0E0 end / (2.0E0 * neg) as c
  from inputs, classes where split = 'train')""",
        "cells as (select vec_id, c, unnest(x) as v, generate_subscripts(x, 1) as j from train)",
        """curve as materialized (select max(s) / 4 as curvature from (select i, sum(abs(m)) as s
  from (select a.j as i, b.j as j, sum(a.c * a.v * b.v) as m from cells a join cells b using (vec_id) group by all)
  group by i))""",
        f"""w0 as materialized (select lam, list_transform(x, lambda v: 0.0E0) as w, list_transform(x, lambda v: 0.0E0) as prev
  from (select x from train limit 1), (values {", ".join(f"({p!r}::double)" for p in penalties)}) p(lam))"""]
    for k in range(steps):
        ctes += [f"""a{k} as materialized (select lam, w, list_transform(range(1, len(w) + 1),
    lambda j: w[j] + {k}.0E0 / {k + 3} * (w[j] - prev[j])) as ahead from w{k})""",
            f"""g{k} as materialized (select lam, j, sum(r * v) as g from (
    select lam, r, unnest(x) as v, generate_subscripts(x, 1) as j from (
      select lam, x, c * (1.0E0 / (1.0E0 + exp(-list_dot_product(ahead, x))) - y) as r from train, a{k}))
  group by lam, j)""",
            f"""w{k + 1} as materialized (select lam, list(now order by j) as w, any_value(w) as prev from (
    select lam, j, w, ahead[j] - (g + case when j < len(w) then lam else 0 end * ahead[j]) / (curvature + lam) as now
    from g{k} join a{k} using (lam), curve) group by lam)"""]
    ctes += [f"""scored as materialized (select lam, vec_id, y, split, 1.0E0 / (1.0E0 + exp(-list_dot_product(w, x))) as score
  from inputs, w{steps})""",
        """best as (select lam from scored where split = 'val' group by lam
  order by avg(-(y*ln(score) + (1-y)*ln(1-score))), lam limit 1)"""]
    return "with " + ",\n".join(ctes) + "\n" + select


_DECIDED = "round(score, 6) as score, cast(case when score >= 0.5E0 then 1 else 0 end as bigint) as decision"

ORACLES = {
    "weighted_head": _head_sql(
        f"select vec_id, y as label, {_DECIDED} from scored join best using (lam) where split = 'test'"
    ),
    "classifier_score": _head_sql(f"select vec_id, {_DECIDED} from scored join best using (lam)"),
    "context_text": V.with_views(
        _context_sql(3, 3000, "c.message_id, c.dataset"), "comments", extra=_cut(3000)
    ),
    "context_text_cut": V.with_views(
        _context_sql(4, SHORT, "c.message_id"), "comments", extra=_cut(SHORT)
    ),
    "context_length": V.with_views(
        "select message_id, est_length from sized", "comments", extra=_LENGTHS
    ),
    "reply_chain": V.with_views(
        """select c.message_id as target_id, cast(1 as bigint) as hop, c.reply_to as message_id
from comments c where c.reply_to is not null
union all select c.message_id, 2, p.reply_to from comments c
join comments p on c.reply_to = p.message_id where p.reply_to is not null
union all select c.message_id, 3, q.reply_to from comments c
join comments p on c.reply_to = p.message_id
join comments q on p.reply_to = q.message_id where q.reply_to is not null""",
        "comments",
    ),
    "reply_position": V.with_views(
        """select message_id, depth from (with recursive chain as (
  select c.message_id, cast(0 as bigint) as depth from comments c
  where c.reply_to is null or c.reply_to not in (select message_id from comments)
  union all select c.message_id, p.depth + 1 from comments c join chain p on c.reply_to = p.message_id
) select * from chain)""",
        "comments",
    ),
    "thread_order": V.with_views(
        "select conv_id, message_id, place from places", "threads", extra=THREAD_PLACES
    ),
    "intervention_by_reply": V.with_views(
        """select message_id, conv_id, turn, case when is_moderator then cast(null as double)
  when exists (select 1 from threads m where m.is_moderator and m.conv_id = t.conv_id and m.reply_to = t.message_id)
  then 1.0E0 else 0.0E0 end as should_intervene from threads t""",
        "threads",
    ),
    "intervention_label": V.with_views(
        "select message_id, conv_id, turn, should_intervene from labelled", "labelled"
    ),
    "label_projection": V.with_views(
        """select message_id, cast(cast(is_moderator as int) as double) as y_is_moderator,
  should_intervene as y_should_intervene from labelled""",
        "labelled",
    ),
    "class_ratio": V.with_views(_RATIO + "labelled", "labelled"),
    "class_ratio_train": V.with_views(
        _RATIO + "split where split = 'train'", "labelled", extra=_SPLIT
    ),
    "stratified_split": V.with_views(
        "select message_id, should_intervene as target, split from split", "labelled", extra=_SPLIT
    ),
    "hash_split": V.with_views(
        """select message_id, case when u < 0.6E0 then 'train' when u < 0.8E0 then 'val'
  else 'test' end as split
from (select message_id, cast(('0x'||substr(md5('42|'||message_id),1,8)) as bigint)
  / 4294967296.0E0 as u from comments)""",
        "comments",
    ),
    **{
        name: V.with_views(
            f"""select s.message_id, s.dataset, s.origin, d.discussion
from sample s join (select * from ({_context_sql(3, 3000, "c.message_id")})) d using (message_id)""",
            "labelled",
            extra={
                **_SPLIT,
                "test": "select * from split where split = 'test' and moderation_supported",
                **_sample("test", n),
                **_cut(3000),
            },
        )
        for name, n in (("balanced_subset", SUBSET), ("balanced_subset_2000", FULL_SUBSET))
    },
    "sample_remainder": V.with_views(
        """select message_id, dataset from comments
where message_id not in (select message_id from sample)""",
        "comments",
        extra=_sample("comments"),
    ),
    "length_batches": _batches_sql(64, 0, ""),
    "length_batches_full": _batches_sql(10, 3, "where s = 10"),
    "prompt_redaction": V.with_views(
        """select message_id,
  replace(replace(substr(coalesce(text,'nan'),1,3000),'moderator','X'),'Moderator','X') as prompt,
  replace(replace(substr(coalesce(text,'nan'),1,200),'the','X'),'The','X') as masked
from comments""",
        "comments",
    ),
    "batch_score": V.with_views(
        f"""select message_id, dataset, {_ANSWER} as response from (
  select message_id, dataset, replace(replace(substr(discussion,1,3000),'moderator','X'),
    'Moderator','X') as t
  from ({_context_sql(3, 3000, "c.message_id, c.dataset")}))""",
        "comments",
        extra=_cut(3000),
    ),
    "linear_head_score": """select vec_id, round(p, 6) as score, cast(case when p >= 0.5E0 then 1 else 0 end as bigint) as decision
from (select vec_id, 1.0E0 / (1.0E0 + exp(-(0.25E0 + list_sum(list_transform(range(64),
  lambda i: cast(embedding[i + 1] as double) * (((7 * i) % 11 - 5) / 4.0E0)))))) as p from embeddings)""",
    "weighted_head_report": """with labelled as (
  select vec_id, case when label < 5 then 1 else 0 end as y from embeddings where label is not null
), ranked as (
  select *, row_number() over (partition by y order by md5('42|'||cast(vec_id as string)), cast(vec_id as string)) as rn,
    count(*) over (partition by y) as n from labelled
), split as (
  select y, case when rn <= floor(n*0.6E0 + 0.5E0) then 'train'
    when rn <= floor(n*0.8E0 + 0.5E0) then 'val' else 'test' end as split from ranked
)
select split, count(*) as n, cast(sum(y) as bigint) as positives,
  (select round(sum(1 - y) / nullif(sum(y), 0)::double, 6) from split where split = 'train') as pos_weight,
  true as beats_constant
from split group by split""",
    "stream_append": V.with_views(
        f"""select message_id, dataset, {_ANSWER} as response from (
  select message_id, dataset, replace(replace(substr(text,1,3000),'moderator','X'),
    'Moderator','X') as t from comments)""",
        "comments",
    ),
}

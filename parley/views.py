"""The analysis tables, derived from the given base tables.

Each view exists twice: as a DataFrame here, for the queries, and as SQL text
in ``VIEW_SQL``, for the oracles. Both are row-wise rules on ids and lengths.
Constant dimensions enter through ``explode`` of a literal array, so no view
needs a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.context import intervention_label

HUMANS = ("A1", "A2", "A3", "A4", "A5")
MODELS = ("Qwen7b", "Olmo7b", "Llama8b")
PANEL = HUMANS + MODELS
RESPONDERS = (("m0", 3), ("m1", 17), ("m2", 40))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(rows, *names: str) -> Column:
    """A small constant list as an array of structs, to explode."""
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        conv.cast("string").alias("conv_id"),
        turn.alias("turn"),
        (conv * 1000 + turn).cast("string").alias("message_id"),
        F.when(turn != 0, (conv * 1000 + turn - 1).cast("string")).alias("reply_to"),
        F.concat_ws("_", "role", (conv % 7).cast("string")).alias("user_name"),
        ((F.col("role") == "assistant") & ((conv + turn) % 3 != 0)).alias("is_moderator"),
        (conv % 6 != 5).alias("moderation_supported"),
        F.col("text"),
        F.concat(F.lit("ds"), (conv % 6).cast("string")).alias("dataset"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments with branching replies: several starts, much answered comments, unknown parents."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn")
    parent = (
        F.when((turn == 0) | (turn % 11 == 10), F.lit(None).cast("string"))
        .when(turn % 13 == 12, F.concat(F.lit("x"), (conv % 3).cast("string")))
        .otherwise((conv * 1000 + conv % F.nullif(turn, F.lit(0))).cast("string"))
    )
    return comments(spark, sf_dir).withColumn("reply_to", parent)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervention_label(comments(spark, sf_dir))


def _noise() -> Column:
    conv = F.col("conv_id").cast("long")
    return F.char_length("text") * 37 + conv * 11 + F.col("turn") * 7


def responses(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """Noisy answers of three models. Without labels no window is needed."""
    base = labelled(spark, sf_dir) if labels else comments(spark, sf_dir)
    target = ["should_intervene"] if labels else []
    k = F.col("k")
    answer = (
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .when(k % 19 == 0, "maybe")
        .when(k % 11 == 0, " YES ")
        .when(k % 7 == 0, "False")
        .when(k % 5 < 2, "1")
        .otherwise("0")
    )
    return (
        base.withColumn("k0", _noise())
        .select(
            "message_id", "conv_id", "dataset", "is_moderator", *target, "k0",
            F.explode(literal_rows(RESPONDERS, "model", "off")).alias("m"),
        )
        .withColumn("k", F.col("k0") + F.col("m.off"))
        .select(
            F.col("m.model").alias("model"),
            "message_id", "conv_id", "dataset", "is_moderator", *target,
            answer.alias("response"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        comments(spark, sf_dir)
        .where("moderation_supported")
        .select(
            "message_id",
            "dataset",
            F.col("is_moderator").cast("int").alias("label"),
            ((_noise() % 1001) / F.lit(1000.0)).alias("score"),
        )
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raters = [(name, i + 1, name in HUMANS) for i, name in enumerate(PANEL)]
    doc, a, n, p = F.col("doc_id"), F.col("r.a"), F.col("n_chars"), F.col("pass_no")
    shift = F.when(a == 3, p).otherwise(0)
    return (
        table(spark, sf_dir, "documents")
        .select(
            "doc_id", "n_chars", "source",
            F.explode(literal_rows(raters, "annotator", "a", "is_human")).alias("r"),
        )
        .where((doc + a) % 4 != 0)
        .withColumn("pass_no", F.explode(F.array(F.lit(1), F.lit(2))))
        .where((p == 1) | (F.col("r.is_human") & (doc % 50 == 1)))
        .select(
            F.col("r.annotator").alias("annotator"),
            F.col("r.is_human").alias("is_human"),
            doc.cast("string").alias("conv_id"),
            F.col("source").alias("dataset"),
            "pass_no",
            ((doc * 7 + a * 13 + n + shift) % 6).alias("positive_reinforcement"),
            ((doc * 5 + a * 11 + n * 3) % 6).alias("negative_reinforcement"),
            ((doc * 3 + a * 17) % 6).alias("no_reinforcement"),
            F.when((doc + a) % 29 == 0, "yes").otherwise("no").alias("data_malformation"),
        )
    )


def survey_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("conv_id").cast("long")
    third = F.when(item % 9 == 0, "").otherwise(
        F.concat(F.lit("No Reinforcement: "), F.col("no_reinforcement").cast("string"))
    )
    return (
        ratings(spark, sf_dir)
        .where(~F.col("is_human"))
        .select(
            F.col("annotator").alias("model"),
            "conv_id",
            F.concat(
                F.lit("Positive: "), F.col("positive_reinforcement").cast("string"),
                F.lit("\nnegative:"), F.col("negative_reinforcement").cast("string"),
                F.lit("\n"), third,
            ).alias("dual_response"),
            F.when(item % 13 == 0, "unsure")
            .otherwise(F.concat(F.lit("I answer "), F.col("no_reinforcement").cast("string")))
            .alias("single_response_text"),
        )
    )


def documents_as_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts of the dataset they come from."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("source").alias("dataset"), F.col("text")
    )


VIEW_SQL = {
    "comments": """
select cast(conv_id as string) as conv_id, turn,
       cast(conv_id*1000+turn as string) as message_id,
       case when turn=0 then null else cast(conv_id*1000+turn-1 as string) end as reply_to,
       concat(role,'_',cast(conv_id % 7 as string)) as user_name,
       (role='assistant' and (conv_id+turn) % 3 <> 0) as is_moderator,
       (conv_id % 6 <> 5) as moderation_supported,
       text,
       concat('ds',cast(conv_id % 6 as string)) as dataset
from conversations""",
    "threads": """
select * replace (case when turn = 0 or turn % 11 = 10 then null
  when turn % 13 = 12 then 'x' || cast(cast(conv_id as bigint) % 3 as string)
  else cast(cast(conv_id as bigint) * 1000 + cast(conv_id as bigint) % nullif(turn, 0) as string) end as reply_to)
from comments""",
    "labelled": """
select *, case when is_moderator then cast(null as double)
  when coalesce(lead(is_moderator) over (partition by conv_id order by turn), false) then 1.0E0
  else 0.0E0 end as should_intervene
from comments""",
    "responses": """
select m.model, c.message_id, c.conv_id, c.dataset, c.is_moderator, c.should_intervene,
  case when k % 23 = 0 then null when k % 19 = 0 then 'maybe' when k % 11 = 0 then ' YES '
       when k % 7 = 0 then 'False' when k % 5 < 2 then '1' else '0' end as response
from (select l.*, length(text)*37 + cast(conv_id as bigint)*11 + turn*7 as k0 from labelled l) c
cross join (values ('m0',3),('m1',17),('m2',40)) m(model, off)
cross join lateral (select c.k0 + m.off as k) x""",
    "scored": """
select message_id, dataset, cast(is_moderator as int) as label,
  ((length(text)*37 + cast(conv_id as bigint)*11 + turn*7) % 1001) / 1000.0E0 as score
from comments where moderation_supported""",
    "raters": """
select * from (values ('A1',1,true),('A2',2,true),('A3',3,true),('A4',4,true),('A5',5,true),
  ('Qwen7b',6,false),('Olmo7b',7,false),('Llama8b',8,false)) r(annotator,a,is_human)""",
    "ratings": """
select r.annotator, r.is_human, cast(d.doc_id as string) as conv_id, d.source as dataset, p.pass_no,
  (d.doc_id*7 + r.a*13 + d.n_chars + (case when r.a=3 then p.pass_no else 0 end)) % 6
    as positive_reinforcement,
  (d.doc_id*5 + r.a*11 + d.n_chars*3) % 6 as negative_reinforcement,
  (d.doc_id*3 + r.a*17) % 6 as no_reinforcement,
  case when (d.doc_id + r.a) % 29 = 0 then 'yes' else 'no' end as data_malformation
from documents d cross join raters r cross join (values (1),(2)) p(pass_no)
where (d.doc_id + r.a) % 4 <> 0 and (p.pass_no = 1 or (r.is_human and d.doc_id % 50 = 1))""",
    "survey_responses": """
select annotator as model, conv_id,
 concat('Positive: ',cast(positive_reinforcement as string),chr(10),'negative:',
   cast(negative_reinforcement as string),chr(10),
   case when cast(conv_id as bigint) % 9 = 0 then ''
        else concat('No Reinforcement: ',cast(no_reinforcement as string)) end) as dual_response,
 case when cast(conv_id as bigint) % 13 = 0 then 'unsure'
      else concat('I answer ',cast(no_reinforcement as string)) end as single_response_text
from ratings where not is_human""",
}

_NEEDS = {
    "comments": (),
    "threads": ("comments",),
    "labelled": ("comments",),
    "responses": ("comments", "labelled"),
    "scored": ("comments",),
    "raters": (),
    "ratings": ("raters",),
    "survey_responses": ("raters", "ratings"),
}


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """An oracle query: the views it reads as common table expressions, then the body."""
    needed: list[str] = []
    for view in views:
        for name in (*_NEEDS[view], view):
            if name not in needed:
                needed.append(name)
    parts = [f"{name} as ({VIEW_SQL[name]})" for name in needed]
    parts += [f"{name} as ({sql})" for name, sql in (extra or {}).items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body

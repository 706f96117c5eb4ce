"""Queries: rater judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import views as V
from parley.catalog.common import rounded
from parley.functions.labels import (
    label_by_presence,
    label_by_threshold,
    label_code,
    label_name,
    short_label_name,
    strip_suffixes,
)
from parley.functions.parsing import malformed_flag, parse_single, rating_prefix, zero_as_missing
from parley.functions.text import shorten
from parley.operators import agreement as A
from parley.operators import ratings as R
from parley.plans import survey as plan
from parley.schemas import SCALES
from parley.views import HUMANS, MODELS, PANEL

GROUPS = {"humans": HUMANS[1:], "models": MODELS, "humans+models": HUMANS[1:] + MODELS}


def rating_parse(spark: SparkSession, sf: str) -> DataFrame:
    rating = F.col("positive_reinforcement").cast("string")
    cell = F.when(F.col("positive_reinforcement") == 0, F.lit(None)).otherwise(
        F.concat(rating, F.lit(" – level "), rating)
    )
    parsed = rating_prefix(cell)
    return V.ratings(spark, sf).select(
        "annotator", "conv_id", F.col("pass_no").cast("long").alias("pass_no"),
        parsed.alias("rating"),
        zero_as_missing(parsed).alias("rating_or_missing"),
        malformed_flag(F.col("data_malformation")).alias("malformed"),
    )


def _keys() -> list:
    return ["annotator", "conv_id", F.col("pass_no").cast("long").alias("pass_no")]


def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_ratings(V.ratings(spark, sf), ["pass_no"]).select(
        *_keys(), *[F.col(s).cast("long").alias(s) for s in SCALES]
    )


def repeated_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.repeated_rows(V.ratings(spark, sf)).select(*_keys())


def pass_numbers(spark: SparkSession, sf: str) -> DataFrame:
    label = label_by_presence(F.col(SCALES[0]), F.col(SCALES[1]))
    return R.pass_pairs(V.ratings(spark, sf), label)


def pass_numbers_threshold(spark: SparkSession, sf: str) -> DataFrame:
    label = label_by_threshold(F.col(SCALES[0]), F.col(SCALES[1]))
    return R.pass_pairs(V.ratings(spark, sf), label)


def self_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.self_consistency(pass_numbers(spark, sf)), "pct_agreement")


def align_union(spark: SparkSession, sf: str) -> DataFrame:
    return R.align_to_panel(V.ratings(spark, sf), PANEL)


def _single(spark: SparkSession, sf: str) -> DataFrame:
    return V.survey_responses(spark, sf).select(
        "model", "conv_id", parse_single(F.col("single_response_text")).alias("single_response")
    )


def align_reference(spark: SparkSession, sf: str) -> DataFrame:
    human_items = V.ratings(spark, sf).where("is_human and dataset <> 'src1'")
    return R.align_to_reference(human_items, _single(spark, sf), MODELS)


def wide_ratings(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.wide_ratings(V.ratings(spark, sf), HUMANS, MODELS)
    return rounded(wide, "total_malformed")


def wide_with_singles(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.wide_ratings(
        V.ratings(spark, sf), HUMANS, MODELS, item_columns=["dataset"], singles=_single(spark, sf)
    )
    return wide.select("conv_id", "dataset", *[f"{m}_single_response" for m in MODELS])


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    documents = V.table(spark, sf, "documents").where("source <> 'src7'")
    return documents.select(
        F.col("doc_id").cast("string").alias("conv_id"), F.col("source").alias("dataset")
    )


def attach_dataset(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.wide_ratings(V.ratings(spark, sf), HUMANS, MODELS)
    return rounded(
        R.attach_dataset(wide, _lookup(spark, sf)).select("conv_id", "total_malformed", "dataset"),
        "total_malformed",
    )


def missing_dataset(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.wide_ratings(V.ratings(spark, sf), HUMANS, MODELS)
    return R.missing_dataset(wide, _lookup(spark, sf))


def _aligned(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    return R.align_to_panel(V.ratings(spark, sf), PANEL, keep=keep, humans=HUMANS)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.coverage(_aligned(spark, sf))


def coverage_by_raters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.coverage_by_raters(_aligned(spark, sf)), "pct")


def null_report(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.wide_ratings(V.ratings(spark, sf), HUMANS, MODELS)
    return rounded(R.null_report(wide), "pct")


def final_label_presence(spark: SparkSession, sf: str) -> DataFrame:
    label = label_by_presence(F.col(SCALES[0]), F.col(SCALES[1]))
    return V.ratings(spark, sf).select(*_keys(), label.alias("label"))


def final_label_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_label(_aligned(spark, sf)).select("annotator", "conv_id", "label")


def final_label_missing(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_label(_aligned(spark, sf), missing="null").select("annotator", "conv_id", "label")


def label_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.with_label(_aligned(spark, sf))
    name = label_name(F.col("label"))
    column = F.concat("annotator", F.lit("_dual_final_label"))
    return rows.select(
        "annotator", "conv_id",
        name.alias("name"),
        short_label_name(F.col("label")).alias("short_name"),
        label_code(name).alias("code"),
        strip_suffixes(column, ("_final_label", "_dual")).alias("rater"),
        shorten(F.concat_ws(" ", "annotator", "conv_id", F.lit("says that this is"), name)).alias("caption"),
    )


def certainty_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.first_ratings(V.ratings(spark, sf), ["pass_no"])
    return R.certainty_histogram(rows, exclude=["A1"])


def label_share_rater(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.label_share(R.with_label(_aligned(spark, sf)), "annotator")
    return rounded(rows, "no", "positive", "negative", "both")


def label_share_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.label_share(R.with_label(_aligned(spark, sf, keep=["dataset"])), "dataset")
    return rounded(rows, "no", "positive", "negative", "both")


def label_counts_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.label_counts(R.with_label(_aligned(spark, sf, keep=["dataset"])), "dataset")
    return rounded(rows, "pct")


def majority_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.majority(plan.item_labels(V.ratings(spark, sf), HUMANS, MODELS), HUMANS, MODELS)
    return rounded(rows, "llm_agreement")


def no_human_agrees(spark: SparkSession, sf: str) -> DataFrame:
    rows = plan.top_disagreements(V.ratings(spark, sf), HUMANS, MODELS)
    return rounded(rows, "llm_agreement")


def no_human_agrees_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = plan.disagreement_cases(V.ratings(spark, sf), HUMANS, MODELS)
    return rounded(rows, "llm_agreement")


def pair_contingency(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.pair_contingency(A.rating_vectors(V.ratings(spark, sf), PANEL), PANEL)
    return rows.withColumn("value_1", F.col("value_1").cast("long")).withColumn(
        "value_2", F.col("value_2").cast("long")
    )


def pair_agreement(spark: SparkSession, sf: str) -> DataFrame:
    vectors = A.rating_vectors(V.ratings(spark, sf), PANEL)
    rows = A.pair_agreement(A.pair_contingency(vectors, PANEL))
    return rounded(rows, "pearson_r", "spearman_rho", "weighted_kappa")


def krippendorff_alpha(spark: SparkSession, sf: str) -> DataFrame:
    vectors = A.rating_vectors(V.ratings(spark, sf), PANEL)
    return rounded(A.ordinal_alpha(vectors, PANEL, GROUPS), "krippendorff_alpha")


def agreement_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = plan.agreement(V.ratings(spark, sf), PANEL, GROUPS)
    return rounded(
        rows, "pearson_r_mean", "spearman_rho_mean", "weighted_kappa_mean",
        "krippendorff_alpha", "avg_valid_samples",
    )


QUERIES = {
    "rating_parse": rating_parse,
    "keep_first": keep_first,
    "repeated_rows": repeated_rows,
    "pass_pairs": pass_numbers,
    "pass_pairs_threshold": pass_numbers_threshold,
    "self_consistency": self_consistency,
    "align_union": align_union,
    "align_reference": align_reference,
    "wide_ratings": wide_ratings,
    "wide_with_singles": wide_with_singles,
    "attach_dataset": attach_dataset,
    "missing_dataset": missing_dataset,
    "coverage": coverage,
    "coverage_by_raters": coverage_by_raters,
    "null_report": null_report,
    "final_label_presence": final_label_presence,
    "final_label_threshold": final_label_threshold,
    "final_label_missing": final_label_missing,
    "label_names": label_names,
    "certainty_hist": certainty_hist,
    "label_share_rater": label_share_rater,
    "label_share_dataset": label_share_dataset,
    "label_counts_dataset": label_counts_dataset,
    "majority_label": majority_label,
    "no_human_agrees": no_human_agrees,
    "no_human_agrees_all": no_human_agrees_all,
    "pair_contingency": pair_contingency,
    "pair_agreement": pair_agreement,
    "krippendorff_alpha": krippendorff_alpha,
    "agreement_summary": agreement_summary,
}

P, N, O = SCALES  # noqa: E741

_FIRST = {
    "firsts": """select * from ratings
qualify row_number() over (partition by annotator, conv_id order by pass_no) = 1"""
}
_ITEMS = {
    **_FIRST,
    "items": "select conv_id, any_value(dataset) as dataset from firsts where is_human group by conv_id",
}
_ALIGNED = {
    **_ITEMS,
    "aligned": f"""select i.conv_id, i.dataset, r.annotator, r.is_human, f.{P}, f.{N}, f.{O},
  coalesce(f.data_malformation,'no') as data_malformation
from items i cross join raters r
left join firsts f on f.conv_id = i.conv_id and f.annotator = r.annotator""",
}


def _label_sql(p: str, n: str) -> str:
    return (
        f"cast(case when coalesce({p},false) and coalesce({n},false) then 3 "
        f"when {p} then 1 when {n} then 2 else 0 end as bigint)"
    )


_THRESHOLD = _label_sql(f"({P} >= 3)", f"({N} >= 3)")
_PRESENCE = _label_sql(f"({P} <> 0)", f"({N} <> 0)")
_LABELLED = {**_ALIGNED, "named": f"select *, {_THRESHOLD} as label from aligned"}


def _wide_cells() -> str:
    cells = []
    for r in PANEL:
        cells += [f"max(case when annotator='{r}' then {s} end) as \"{r}_{s}\"" for s in SCALES]
        cells.append(
            f"coalesce(max(case when annotator='{r}' then case when trim(data_malformation)='yes' "
            f"then 1.0E0 else 0.0E0 end end), 0.0E0) as \"{r}_malformed\""
        )
    return ", ".join(cells)


_WIDE = {
    **_ITEMS,
    "wide": f"""select conv_id, {_wide_cells()} from firsts
where conv_id in (select conv_id from items) group by conv_id""",
}
_TOTAL = "(" + "+".join(f'"{h}_malformed"' for h in HUMANS) + f")/{len(HUMANS)}"

_PAIRS_OF_PASSES = """select a.annotator, a.conv_id, a.label as pass_1, b.label as pass_2
from numbered a join numbered b on a.annotator = b.annotator and a.conv_id = b.conv_id
where a.rn = 1 and b.rn = 2"""


def _numbered(label: str) -> dict[str, str]:
    return {
        "numbered": f"""select annotator, conv_id, {label} as label,
  row_number() over (partition by annotator, conv_id order by pass_no) as rn from ratings"""
    }


def _share_sql(key: str) -> str:
    cells = ", ".join(
        f"round(count(*) filter (label={c})*100.0E0/count(*),6) as {n}"
        for c, n in enumerate(("no", "positive", "negative", "both"))
    )
    return V.with_views(
        f"select {key}, {cells} from named group by {key}", "ratings", extra=_LABELLED
    )


_MAJORITY = {
    **_LABELLED,
    "votes": "select conv_id, label, count(*) as n from named where not is_human group by conv_id, label",
    "modes": """select conv_id, label as llm_mode, n / 3.0E0 as llm_agreement from votes
qualify row_number() over (partition by conv_id order by n desc, label) = 1""",
    "major": """select m.conv_id, m.llm_mode, m.llm_agreement,
  count(*) filter (h.is_human and h.label = m.llm_mode) as n_humans_agree
from modes m join named h on h.conv_id = m.conv_id group by m.conv_id, m.llm_mode, m.llm_agreement""",
}

_LONG = {
    **_FIRST,
    "long": " union all ".join(
        f"""select r.a, f.annotator, f.conv_id, '{s}' as scale, cast(f.{s} as bigint) as v
from firsts f join raters r on r.annotator = f.annotator where f.{s} <> 0"""
        for s in SCALES
    ),
}
_PAIRED = {
    **_LONG,
    "paired": """select x.scale, x.annotator as rater_1, y.annotator as rater_2, x.conv_id, x.v as v1, y.v as v2
from long x join long y on x.scale = y.scale and x.conv_id = y.conv_id and x.a < y.a""",
    "placed": """select *,
  rank() over (partition by scale, rater_1, rater_2 order by v1)
    + (count(*) over (partition by scale, rater_1, rater_2, v1) - 1) / 2.0E0 as k1,
  rank() over (partition by scale, rater_1, rater_2 order by v2)
    + (count(*) over (partition by scale, rater_1, rater_2, v2) - 1) / 2.0E0 as k2 from paired""",
    "used": """select scale, rater_1, rater_2, v,
  row_number() over (partition by scale, rater_1, rater_2 order by v) as place
from (select scale, rater_1, rater_2, v1 as v from paired
  union select scale, rater_1, rater_2, v2 from paired)""",
    "rows1": "select scale, rater_1, rater_2, v1 as v, count(*) as n from paired group by all",
    "cols2": "select scale, rater_1, rater_2, v2 as v, count(*) as n from paired group by all",
    "expect": """select a.scale, a.rater_1, a.rater_2,
  sum(a.n * b.n * (ua.place-ub.place) * (ua.place-ub.place)) as e
from rows1 a join cols2 b using (scale, rater_1, rater_2)
join used ua on ua.scale=a.scale and ua.rater_1=a.rater_1 and ua.rater_2=a.rater_2 and ua.v=a.v
join used ub on ub.scale=b.scale and ub.rater_1=b.rater_1 and ub.rater_2=b.rater_2 and ub.v=b.v
group by all""",
    "observe": """select p.scale, p.rater_1, p.rater_2, count(*) as n,
  sum((ua.place-ub.place) * (ua.place-ub.place)) as o
from paired p
join used ua on ua.scale=p.scale and ua.rater_1=p.rater_1 and ua.rater_2=p.rater_2 and ua.v=p.v1
join used ub on ub.scale=p.scale and ub.rater_1=p.rater_1 and ub.rater_2=p.rater_2 and ub.v=p.v2
group by all""",
    "corrs": """select scale, rater_1, rater_2,
  case when min(v1)=max(v1) or min(v2)=max(v2) then null else corr(v1, v2) end as pearson_r,
  case when min(v1)=max(v1) or min(v2)=max(v2) then null else corr(k1, k2) end as spearman_rho
from placed group by all""",
    "pairstats": """select c.scale, c.rater_1, c.rater_2, c.pearson_r, c.spearman_rho,
  case when e.e = 0 then null else 1 - cast(o.o as double) * o.n / e.e end as weighted_kappa, o.n as n_samples
from corrs c join observe o using (scale, rater_1, rater_2) join expect e using (scale, rater_1, rater_2)
where o.n >= 2""",
}
_GROUP_VALUES = ", ".join(f"('{g}','{r}')" for g, members in GROUPS.items() for r in members)
_ALPHA = {
    "members": f"select * from (values {_GROUP_VALUES}) m(rater_group, annotator)",
    "unit_counts": """select m.rater_group, l.scale, l.conv_id, l.v, count(*) as n,
  sum(count(*)) over (partition by m.rater_group, l.scale, l.conv_id) as m
from long l join members m on m.annotator = l.annotator group by m.rater_group, l.scale, l.conv_id, l.v""",
    "coin": """select x.rater_group, x.scale, x.v as c, y.v as k,
  sum(cast(x.n * (y.n - case when x.v = y.v then 1 else 0 end) as double) / (x.m - 1)) as o
from unit_counts x join unit_counts y using (rater_group, scale, conv_id) where x.m >= 2 group by all""",
    "margin": "select rater_group, scale, c as v, sum(o) as n from coin group by all",
    "dist": """select a.rater_group, a.scale, a.v as c, b.v as k, a.n as nc, b.n as nk,
  pow((select sum(g.n) from margin g where g.rater_group=a.rater_group and g.scale=a.scale
    and g.v between a.v and b.v) - (a.n + b.n)/2, 2) as d
from margin a join margin b on a.rater_group=b.rater_group and a.scale=b.scale and a.v < b.v""",
    "alphas": """select d.rater_group, d.scale, 1 - (any_value(t.n) - 1) * sum(coalesce(q.o,0) * d.d)
    / nullif(sum(d.nc * d.nk * d.d),0) as krippendorff_alpha
from dist d join (select rater_group, scale, sum(n) as n from margin group by all) t using (rater_group, scale)
left join coin q on q.rater_group=d.rater_group and q.scale=d.scale and q.c=d.c and q.k=d.k
group by d.rater_group, d.scale""",
}

ORACLES = {
    "rating_parse": V.with_views(
        f"""select annotator, conv_id, cast(pass_no as bigint) as pass_no, cast({P} as bigint) as rating,
  nullif(cast({P} as bigint),0) as rating_or_missing,
  case when data_malformation='yes' then 1.0E0 else 0.0E0 end as malformed from ratings""",
        "ratings",
    ),
    "keep_first": V.with_views(
        f"""select annotator, conv_id, cast(pass_no as bigint) as pass_no, cast({P} as bigint) as {P},
  cast({N} as bigint) as {N}, cast({O} as bigint) as {O} from firsts""",
        "ratings",
        extra=_FIRST,
    ),
    "repeated_rows": V.with_views(
        """select annotator, conv_id, cast(pass_no as bigint) as pass_no from ratings
qualify count(*) over (partition by annotator, conv_id) > 1""",
        "ratings",
    ),
    "pass_pairs": V.with_views(_PAIRS_OF_PASSES, "ratings", extra=_numbered(_PRESENCE)),
    "pass_pairs_threshold": V.with_views(_PAIRS_OF_PASSES, "ratings", extra=_numbered(_THRESHOLD)),
    "self_consistency": V.with_views(
        f"""select annotator, count(*) as n_pairs,
  round(avg(case when pass_1 = pass_2 then 1.0E0 else 0.0E0 end)*100,6) as pct_agreement
from ({_PAIRS_OF_PASSES}) group by annotator""",
        "ratings",
        extra=_numbered(_PRESENCE),
    ),
    "align_union": V.with_views(
        f"""select i.conv_id, r.annotator, cast(f.{P} as bigint) as {P}, cast(f.{N} as bigint) as {N},
  cast(f.{O} as bigint) as {O}, coalesce(f.data_malformation,'no') as data_malformation
from (select distinct conv_id from firsts) i cross join raters r
left join firsts f on f.conv_id = i.conv_id and f.annotator = r.annotator""",
        "ratings",
        extra=_FIRST,
    ),
    "align_reference": V.with_views(
        """select i.conv_id, m.annotator as model,
  try_cast(nullif(regexp_extract(s.single_response_text,'([0-9]+)',1),'') as double) as single_response
from (select distinct conv_id from ratings where is_human and dataset <> 'src1') i
cross join (select annotator from raters where not is_human) m
left join survey_responses s on s.conv_id = i.conv_id and s.model = m.annotator""",
        "survey_responses",
    ),
    "wide_ratings": V.with_views(
        f"select *, round({_TOTAL},6) as total_malformed from wide", "ratings", extra=_WIDE
    ),
    "wide_with_singles": V.with_views(
        """select i.conv_id, i.dataset, """
        + ", ".join(
            f"""max(case when s.model='{m}' then try_cast(nullif(regexp_extract(
  s.single_response_text,'([0-9]+)',1),'') as double) end) as "{m}_single_response\""""
            for m in MODELS
        )
        + """ from items i left join survey_responses s on s.conv_id = i.conv_id
group by i.conv_id, i.dataset""",
        "survey_responses",
        extra=_ITEMS,
    ),
    "attach_dataset": V.with_views(
        f"""select w.conv_id, round({_TOTAL},6) as total_malformed, d.source as dataset
from wide w join documents d on cast(d.doc_id as string) = w.conv_id where d.source <> 'src7'""",
        "ratings",
        extra=_WIDE,
    ),
    "missing_dataset": V.with_views(
        """select count(*) as n_missing from items where conv_id not in
  (select cast(doc_id as string) from documents where source <> 'src7')""",
        "ratings",
        extra=_ITEMS,
    ),
    "coverage": V.with_views(
        f"""select annotator, count(*) as n_items,
  count(*) filter ({P} is not null and {N} is not null and {O} is not null) as n_covered,
  count(*) filter ({P} is null or {N} is null or {O} is null) as n_missing
from aligned group by annotator""",
        "ratings",
        extra=_ALIGNED,
    ),
    "coverage_by_raters": V.with_views(
        f"""select n_raters, count(*) as n_items, round(count(*)*100.0E0/sum(count(*)) over (),6) as pct
from (select conv_id, count(*) filter (coalesce({P},{N},{O}) is not null) as n_raters
  from aligned group by conv_id) group by n_raters""",
        "ratings",
        extra=_ALIGNED,
    ),
    "null_report": V.with_views(
        " union all ".join(
            f"""select '{r}_{s}' as column_name, count(*) filter ("{r}_{s}" is null) as n_null,
  round(count(*) filter ("{r}_{s}" is null)*100.0E0/count(*),6) as pct from wide
having count(*) filter ("{r}_{s}" is null) > 0"""
            for r in PANEL
            for s in SCALES
        ),
        "ratings",
        extra=_WIDE,
    ),
    "final_label_presence": V.with_views(
        f"""select annotator, conv_id, cast(pass_no as bigint) as pass_no, {_PRESENCE} as label
from ratings""",
        "ratings",
    ),
    "final_label_threshold": V.with_views(
        "select annotator, conv_id, label from named", "ratings", extra=_LABELLED
    ),
    "final_label_missing": V.with_views(
        f"""select annotator, conv_id, case when {P} is null and {N} is null then null else label end
  as label from named""",
        "ratings",
        extra=_LABELLED,
    ),
    "label_names": V.with_views(
        """select annotator, conv_id, name, case name when 'Positive' then 'Pos' when 'Negative' then 'Neg'
  else name end as short_name, label as code, annotator as rater,
  case when length(caption) > 28 then substr(caption,1,27)||'…' else caption end as caption
from (select *, annotator||' '||conv_id||' says that this is '||name as caption from
  (select *, case label when 0 then 'No' when 1 then 'Positive' when 2 then 'Negative' else 'Both' end
    as name from named))""",
        "ratings",
        extra=_LABELLED,
    ),
    "certainty_hist": V.with_views(
        " union all ".join(
            f"""select '{k}' as kind, '{s}' as scale, cast({v} as bigint) as rating,
  count(*) filter (annotator <> 'A1' and {'is_human' if k == 'human' else 'not is_human'} and {s} = {v}) as n
from firsts"""
            for k in ("human", "model")
            for s in SCALES
            for v in range(1, 6)
        ),
        "ratings",
        extra=_FIRST,
    ),
    "label_share_rater": _share_sql("annotator"),
    "label_share_dataset": _share_sql("dataset"),
    "label_counts_dataset": V.with_views(
        """select dataset, label, count(*) as n,
  round(count(*)*100.0E0/sum(count(*)) over (partition by dataset),6) as pct
from named group by dataset, label""",
        "ratings",
        extra=_LABELLED,
    ),
    "majority_label": V.with_views(
        """select conv_id, llm_mode, round(llm_agreement,6) as llm_agreement, n_humans_agree from major""",
        "ratings",
        extra=_MAJORITY,
    ),
    "no_human_agrees": V.with_views(
        """select conv_id, llm_mode, round(llm_agreement,6) as llm_agreement,
  row_number() over (order by round(llm_agreement,9) desc, conv_id) as rank
from major where n_humans_agree = 0 qualify rank <= 10""",
        "ratings",
        extra=_MAJORITY,
    ),
    "no_human_agrees_all": V.with_views(
        """select conv_id, llm_mode, round(llm_agreement,6) as llm_agreement
from major where n_humans_agree = 0""",
        "ratings",
        extra=_MAJORITY,
    ),
    "pair_contingency": V.with_views(
        """select scale, rater_1, rater_2, v1 as value_1, v2 as value_2, count(*) as n
from paired group by all""",
        "ratings",
        extra=_PAIRED,
    ),
    "pair_agreement": V.with_views(
        """select scale, rater_1, rater_2, round(pearson_r,6) as pearson_r,
  round(spearman_rho,6) as spearman_rho, round(weighted_kappa,6) as weighted_kappa, n_samples
from pairstats""",
        "ratings",
        extra=_PAIRED,
    ),
    "krippendorff_alpha": V.with_views(
        """select scale, rater_group, round(krippendorff_alpha,6) as krippendorff_alpha from alphas""",
        "ratings",
        extra={**_LONG, **_ALPHA},
    ),
    "agreement_summary": V.with_views(
        """select g.rater_group, g.scale, round(pearson_r_mean,6) as pearson_r_mean,
  round(spearman_rho_mean,6) as spearman_rho_mean, round(weighted_kappa_mean,6) as weighted_kappa_mean,
  round(a.krippendorff_alpha,6) as krippendorff_alpha, round(avg_valid_samples,6) as avg_valid_samples
from (select x.rater_group, p.scale, avg(pearson_r) as pearson_r_mean, avg(spearman_rho) as spearman_rho_mean,
    avg(weighted_kappa) as weighted_kappa_mean, avg(n_samples) as avg_valid_samples
  from pairstats p join members x on x.annotator = p.rater_1
  join members y on y.annotator = p.rater_2 and y.rater_group = x.rater_group
  group by x.rater_group, p.scale) g
join alphas a using (rater_group, scale)""",
        "ratings",
        extra={**_PAIRED, **_ALPHA},
    ),
}

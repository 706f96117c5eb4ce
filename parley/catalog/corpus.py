"""Queries: corpus statistics and construction rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import views as V
from parley.catalog.common import THREAD_PLACES, r6, rounded
from parley.functions.hashing import ATTEMPTS, SMALL_MEAN, poisson_limits
from parley.operators import corpus as C
from parley.operators import statistics as S
from parley.operators.selection import exact_percentile
from parley.operators.tables import experiment_matrix, id_union, in_category_order, in_order
from parley.operators.threads import with_place
from parley.plans import exploration
from parley.schemas import FACILITATIVE_TACTICS, TACTIC_POLARITY

NAMES = {"ds0": "CeRI", "ds1": "WikiDisputes", "ds2": "Fora", "ds3": "UMOD"}
MODALITY = {"CeRI": "written", "WikiDisputes": "written", "UMOD": "written", "Fora": "spoken"}
MERGED = {"ds0": "wikipedia", "ds1": "wikipedia", "ds2": "wikipedia"}
REPLICATES = 1000
CATEGORIES = FACILITATIVE_TACTICS + ("Conceding/recanting", "I don't know")
TAXONOMY = TACTIC_POLARITY + (("CeRI", "Unlisted tactic", None),)
RUN_MODELS = tuple(f"model{i}" for i in range(1, 7))
RUN_PROMPTS = (
    ("detection", "timing_detection"), ("prediction", "timing_prediction"),
    ("dual", "survey_dual"), ("single", "survey_single"),
)


def normalised_corpus(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.normalise(V.comments(spark, sf), ["ds0", "ds1", "ds2", "ds3", "ds4"])
    named = C.with_modality(C.display_names(rows, exclude=["ds4"], names=NAMES), MODALITY)
    kept = C.supported_only(named, exclude=["UMOD"])
    return kept.select("message_id", "dataset", "modality", "is_moderator", "text")


def required_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.labelled(spark, sf).dropna(subset=["should_intervene"])
    return rows.select("message_id", "dataset", "should_intervene")


def moderator_comments(spark: SparkSession, sf: str) -> DataFrame:
    return C.moderator_rows(V.comments(spark, sf)).select("message_id", "dataset", "text")


def moderator_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.moderator_share(V.comments(spark, sf)), "moderator_percent")


def moderator_share_macro(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.moderator_share_macro(S.moderator_share(V.comments(spark, sf)))
    return rounded(rows, "mean_pct").orderBy(F.desc("mean_pct"), "dataset")


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploration.moderation_intervals(V.comments(spark, sf), REPLICATES)
    return rounded(rows, "mean_pct", "ci_low", "ci_high")


def discussion_size_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploration.size_histogram(V.comments(spark, sf))
    return rounded(rows, "bin_low", "bin_high", "density")


def words_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploration.word_histogram(V.comments(spark, sf))
    return rounded(rows, "bin_low", "bin_high", "density")


def document_words_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploration.word_histogram(V.documents_as_comments(spark, sf))
    return rounded(rows, "bin_low", "bin_high", "density")


def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_counts(V.comments(spark, sf))


def surviving_groups(spark: SparkSession, sf: str) -> DataFrame:
    shares = S.landed_groups(S.moderator_share(V.comments(spark, sf)))
    frequent = S.moderator_share_macro(shares).where(F.col("mean_pct") > 28)
    return rounded(S.surviving_groups(shares, frequent), "moderator_percent")


def quality_counters(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("dual_response")
    return S.quality_counters(
        V.survey_responses(spark, sf),
        n_without_third=~text.contains("No Reinforcement"),
        n_unparsed_single=~F.col("single_response_text").rlike("[0-9]"),
    )


def nonempty_multiuser(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.multi_user(C.drop_empty(V.comments(spark, sf)), user="user_name")
    return rows.select("message_id", "conv_id", "user_name")


def shared_discussions_removed(spark: SparkSession, sf: str) -> DataFrame:
    documents = V.table(spark, sf, "documents").where("source in ('src0', 'src3', 'src5')")
    other = documents.select(F.col("doc_id").cast("string").alias("conv_id"))
    return C.drop_shared(V.comments(spark, sf), other).select("message_id", "conv_id")


def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.language_only(V.table(spark, sf, "documents")).select("doc_id", "lang", "text")


def deleted_removed(spark: SparkSession, sf: str) -> DataFrame:
    # The prose has no such marker; every ninth comment stands for one.
    marked = F.when(F.col("message_id").cast("long") % 9 == 0, "[deleted]").otherwise(F.col("text"))
    return C.drop_deleted(V.comments(spark, sf).withColumn("text", marked)).select(
        "message_id", "text"
    )


def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    size = F.char_length("text")
    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), size % len(CATEGORIES))
    rows = V.comments(spark, sf).select(
        "message_id",
        "moderation_supported",
        F.when(F.col("dataset") == "ds0", category).alias("category"),
        F.when(F.col("dataset") != "ds0", (size % 101) / F.lit(100.0)).alias("rating"),
        ((size % 11) / F.lit(10.0)).alias("agreement"),
    )
    label = C.rule_moderator(
        F.col("category"), F.col("rating"), F.col("agreement"), F.col("moderation_supported"),
        FACILITATIVE_TACTICS,
    )
    return rows.select("message_id", "category", label.alias("is_moderator"))


def _discussion_scores(spark: SparkSession, sf: str) -> DataFrame:
    return V.comments(spark, sf).groupBy("conv_id").agg(
        (F.sum(F.char_length("text")) % 997 / F.lit(1000.0)).alias("derailment")
    )


def escalation_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return C.escalated(_discussion_scores(spark, sf), "derailment")


def percentile_values(spark: SparkSession, sf: str) -> DataFrame:
    scores = V.scored(spark, sf)
    cuts = scores.agg(F.count(F.lit(1)).alias("n"))
    for p in (0.0, 0.025, 0.6, 0.975, 1.0):
        cuts = cuts.withColumn(f"p{int(p * 1000)}", r6(exact_percentile(scores, "score", p)))
    return cuts


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.source_statistics(V.comments(spark, sf))


def chunks_of_six(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(V.comments(spark, sf))


def chunks_by_thread(spark: SparkSession, sf: str) -> DataFrame:
    placed = with_place(V.threads(spark, sf))
    return C.chunks(placed, position="place").withColumnRenamed("first_turn", "first_place")


def chunks_with_rest(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(V.comments(spark, sf), size=3, complete_only=False)


def facilitative_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.scored(spark, sf).withColumn("is_moderator", F.col("label") == 1)
    return C.facilitative_candidates(rows).select("message_id", "is_moderator", r6("score").alias("score"))


def capped_sources(spark: SparkSession, sf: str) -> DataFrame:
    return C.merged_and_capped(V.comments(spark, sf), MERGED, cap=40).select("message_id", "source")


def capped_sources_large(spark: SparkSession, sf: str) -> DataFrame:
    return C.merged_and_capped(V.comments(spark, sf), MERGED, cap=2000).select("message_id", "source")


def tactic_polarity(spark: SparkSession, sf: str) -> DataFrame:
    listed = V.literal_rows([t[:2] for t in TAXONOMY], "taxonomy", "tactic")
    pick = F.get(listed, F.char_length("text") % len(TAXONOMY))
    rows = V.comments(spark, sf).select("message_id", F.inline(F.array(pick)))
    return C.tactic_polarity(rows)


def pseudonymised(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.pseudonymise(V.comments(spark, sf), user="user_name", salt="pepper")
    return rows.select("message_id", F.col("user_name").alias("user"))


def id_union_query(spark: SparkSession, sf: str) -> DataFrame:
    comments = V.comments(spark, sf)
    items = V.ratings(spark, sf)
    return id_union([comments, items])


def ordered_output(spark: SparkSession, sf: str) -> DataFrame:
    counts = S.sample_counts(V.comments(spark, sf))
    return in_category_order(counts, "dataset", ["ds3", "ds1", "ds5"])


def sorted_comments(spark: SparkSession, sf: str) -> DataFrame:
    return in_order(V.comments(spark, sf).select("conv_id", "turn", "message_id"), "conv_id", "turn")


def experiment_matrix_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.comments(spark, sf).select("message_id", "dataset")
    return experiment_matrix(rows, RUN_MODELS, RUN_PROMPTS)


QUERIES = {
    "normalised_corpus": normalised_corpus,
    "required_target": required_target,
    "moderator_comments": moderator_comments,
    "moderator_share": moderator_share,
    "moderator_share_macro": moderator_share_macro,
    "bootstrap_ci": bootstrap_ci,
    "discussion_size_hist": discussion_size_hist,
    "words_hist": words_hist,
    "document_words_hist": document_words_hist,
    "sample_counts": sample_counts,
    "surviving_groups": surviving_groups,
    "quality_counters": quality_counters,
    "nonempty_multiuser": nonempty_multiuser,
    "shared_discussions_removed": shared_discussions_removed,
    "language_filter": language_filter,
    "deleted_removed": deleted_removed,
    "rule_labels": rule_labels,
    "escalation_percentile": escalation_percentile,
    "percentile_values": percentile_values,
    "corpus_stats": corpus_stats,
    "chunks_of_six": chunks_of_six,
    "chunks_by_thread": chunks_by_thread,
    "chunks_with_rest": chunks_with_rest,
    "facilitative_candidates": facilitative_candidates,
    "capped_sources": capped_sources,
    "capped_sources_large": capped_sources_large,
    "tactic_polarity": tactic_polarity,
    "pseudonymised": pseudonymised,
    "id_union": id_union_query,
    "ordered_output": ordered_output,
    "sorted_comments": sorted_comments,
    "experiment_matrix": experiment_matrix_query,
}


def _values(rows) -> str:
    def literal(v) -> str:
        return "null" if v is None else "'" + v.replace("'", "''") + "'"

    return ", ".join(f"({i}, {', '.join(literal(v) for v in row)})" for i, row in enumerate(rows))


def _case(column: str, names: dict[str, str], other: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in names.items())
    return f"case {column} {whens} else {other} end"


_SHARES = {
    "shares": """select dataset, conv_id, avg(cast(cast(is_moderator as int) as double))*100 as moderator_percent
from comments group by dataset, conv_id""",
    "macro": """select dataset, count(*) as n_discussions, avg(moderator_percent) as mean_pct
from shares group by dataset having avg(moderator_percent) > 0""",
}

_WORDS = r"len(regexp_extract_all(coalesce(text,'nan'), '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"


def _hist(source: str, bins: int, *views: str) -> str:
    return V.with_views(
        f"""select dataset, bin, round(lo + bin*w,6) as bin_low, round(lo + (bin+1)*w,6) as bin_high, n,
  round(n / (sum(n) over (partition by dataset) * w), 6) as density
from (select dataset, cast(least(floor((v-lo)*{bins}/(hi-lo)), {bins - 1}) as bigint) as bin,
    any_value(lo) as lo, any_value((hi-lo)/{bins}) as w, count(*) as n
  from vals, edges group by 1, 2)""",
        *views,
        extra={
            "vals": source,
            "edges": """select case when min(v)=max(v) then min(v)-0.5 else min(v) end as lo,
  case when min(v)=max(v) then max(v)+0.5 else max(v) end as hi from vals""",
        },
    )


def _capped(cap: int) -> str:
    return V.with_views(
        f"""select message_id, source from (select *, {_case('dataset', MERGED, 'dataset')} as source from comments)
qualify row_number() over (partition by source order by md5('42|'||message_id), message_id) <= {cap}""",
        "comments",
    )


_LIMITS = [poisson_limits(mean) for mean in range(1, SMALL_MEAN)]

ORACLES = {
    "normalised_corpus": V.with_views(
        f"""select message_id, name as dataset, {_case('name', MODALITY, 'null')} as modality,
  cast(cast(is_moderator as int) as double) as is_moderator, coalesce(text,'nan') as text
from (select *, {_case('dataset', NAMES, 'dataset')} as name from comments
  where dataset in ('ds0','ds1','ds2','ds3','ds4') and dataset <> 'ds4')
where moderation_supported and name <> 'UMOD'""",
        "comments",
    ),
    "required_target": V.with_views(
        "select message_id, dataset, should_intervene from labelled where should_intervene is not null",
        "labelled",
    ),
    "moderator_comments": V.with_views(
        "select message_id, dataset, text from comments where is_moderator", "comments"
    ),
    "moderator_share": V.with_views(
        "select dataset, conv_id, round(moderator_percent,6) as moderator_percent from shares",
        "comments",
        extra=_SHARES,
    ),
    "moderator_share_macro": V.with_views(
        "select dataset, n_discussions, round(mean_pct,6) as mean_pct from macro",
        "comments",
        extra=_SHARES,
    ),
    "bootstrap_ci": V.with_views(
        """select m.dataset, round(m.mean_pct,6) as mean_pct, round(b.lo,6) as ci_low, round(b.hi,6) as ci_high
from macro m join (select dataset, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi
  from means group by dataset) b using (dataset)""",
        "comments",
        extra={
            **_SHARES,
            "sizes": """select dataset, n_moderator, n_comments, n_moderator * 100.0E0 / n_comments as x, count(*) as n
from (select dataset, conv_id, count(*) filter (is_moderator) as n_moderator, count(is_moderator) as n_comments
  from comments group by dataset, conv_id)
where dataset in (select dataset from macro) group by all""",
            "attempts": f"""select dataset, n_moderator, n_comments, r, n, t, 2*(-0.059E0 + 0.02483E0*b) as a2, b,
  (('0x'||d[1:8])::bigint + 0.5E0) / 4294967296 - 0.5E0 as u, (('0x'||d[9:16])::bigint + 0.5E0) / 4294967296 as v
from (select *, 0.931E0 + 2.53E0*sqrt(n) as b,
    md5('42|'||r||'|'||dataset||'|'||n_moderator||'|'||n_comments||'|'||t) as d
  from sizes, range({REPLICATES}) q(r), range({ATTEMPTS}) p(t) where n >= {SMALL_MEAN})""",
            "rejected": """select dataset, n_moderator, n_comments, r, arg_min(k, t) filter (
    (edge >= 0.07 and v <= 0.9277E0 - 3.6224E0/(b-2)) or (k >= 0 and not (edge < 0.013 and v > edge)
    and ln(v) + ln(1.1239E0 + 1.1328E0/(b-3.4E0)) - ln(a2/2/(edge*edge) + b)
      <= k*ln(n) - n - lgamma(greatest(k, 0) + 1))) as w
from (select *, 0.5E0 - abs(u) as edge, floor((a2/(0.5E0 - abs(u)) + b)*u + n + 0.43E0) as k from attempts)
group by dataset, n_moderator, n_comments, r""",
            "inverted": f"""select dataset, n_moderator, n_comments, r, len(list_filter({_LIMITS}[n], lambda p: p <= word)) as w
from (select *, ('0x'||substr(md5('42|'||(r // 4)||'|'||dataset||'|'||n_moderator||'|'||n_comments),
    1 + 8*(r % 4), 8))::bigint as word from sizes, range({REPLICATES}) q(r) where n < {SMALL_MEAN})""",
            "drawn": """select dataset, r, w, x
from (from rejected union all from inverted) join sizes using (dataset, n_moderator, n_comments)""",
            "means": """select dataset, r, cast(sum(w*x) as double)/nullif(sum(w),0) as v
from drawn group by dataset, r""",
        },
    ),
    "discussion_size_hist": _hist(
        "select dataset, cast(least(count(*),500) as double) as v from comments group by dataset, conv_id",
        40, "comments",
    ),
    "words_hist": _hist(
        f"select dataset, cast(least({_WORDS},500) as double) as v from comments", 50, "comments"
    ),
    "document_words_hist": _hist(
        f"select source as dataset, cast(least({_WORDS},500) as double) as v from documents", 50
    ),
    "sample_counts": V.with_views(
        "select dataset, count(*) as n from comments group by dataset", "comments"
    ),
    "surviving_groups": V.with_views(
        """select dataset, conv_id, round(moderator_percent,6) as moderator_percent from shares
where dataset in (select dataset from macro where mean_pct > 28)""",
        "comments",
        extra=_SHARES,
    ),
    "quality_counters": V.with_views(
        """select count(*) as n_rows,
  count(*) filter (not contains(dual_response,'No Reinforcement')) as n_without_third,
  count(*) filter (not regexp_matches(single_response_text,'[0-9]')) as n_unparsed_single
from survey_responses""",
        "survey_responses",
    ),
    "nonempty_multiuser": V.with_views(
        """select message_id, conv_id, user_name from full_rows where conv_id in
  (select conv_id from full_rows group by conv_id having count(distinct user_name) >= 2)""",
        "comments",
        extra={"full_rows": "select * from comments where trim(text) <> ''"},
    ),
    "shared_discussions_removed": V.with_views(
        """select message_id, conv_id from comments where conv_id not in
  (select cast(doc_id as string) from documents where source in ('src0','src3','src5'))""",
        "comments",
    ),
    "language_filter": "select doc_id, lang, text from documents where lang = 'en'",
    "deleted_removed": V.with_views(
        """select message_id, text from (select message_id, case when cast(message_id as bigint) % 9 = 0
  then '[deleted]' else text end as text from comments) where text <> '[deleted]'""",
        "comments",
    ),
    "rule_labels": V.with_views(
        f"""select message_id, category, (moderation_supported and (coalesce(listed,false)
  or coalesce(rating >= 0.75 and agreement > 0.5, false))) as is_moderator
from (select c.message_id, c.moderation_supported,
    case when dataset = 'ds0' then k.name end as category,
    case when dataset = 'ds0' then k.i < {len(FACILITATIVE_TACTICS)} end as listed,
    case when dataset <> 'ds0' then (length(text) % 101)/100.0E0 end as rating,
    (length(text) % 11)/10.0E0 as agreement
  from comments c join (values {_values([(c,) for c in CATEGORIES])}) k(i, name)
    on length(c.text) % {len(CATEGORIES)} = k.i)""",
        "comments",
    ),
    "escalation_percentile": V.with_views(
        """select conv_id, derailment,
  derailment >= (select quantile_cont(derailment, 0.6) from scores) as escalated from scores""",
        "comments",
        extra={
            "scores": """select conv_id, cast(sum(length(text)) as bigint) % 997 / 1000.0E0 as derailment
from comments group by conv_id"""
        },
    ),
    "percentile_values": V.with_views(
        """select count(*) as n, round(min(score),6) as p0, round(quantile_cont(score,0.025),6) as p25,
  round(quantile_cont(score,0.6),6) as p600, round(quantile_cont(score,0.975),6) as p975,
  round(max(score),6) as p1000 from scored""",
        "scored",
    ),
    "corpus_stats": V.with_views(
        """select dataset, count(*) as n_comments, count(distinct conv_id) as n_discussions
from comments group by dataset""",
        "comments",
    ),
    "chunks_of_six": V.with_views(
        """select conv_id, chunk, min(turn) as first_turn, count(*) as n_comments,
  string_agg(text, chr(10) order by turn) as discussion from n group by conv_id, chunk having count(*) = 6""",
        "comments",
        extra={
            "n": """select *, cast((row_number() over (partition by conv_id order by turn) - 1) // 6 as bigint)
  as chunk from comments"""
        },
    ),
    "chunks_by_thread": V.with_views(
        """select conv_id, chunk, min(place) as first_place, count(*) as n_comments,
  string_agg(text, chr(10) order by place) as discussion from n group by conv_id, chunk having count(*) = 6""",
        "threads",
        extra={
            **THREAD_PLACES,
            "n": """select t.conv_id, t.text, p.place, cast((p.place - 1) // 6 as bigint) as chunk
  from threads t join places p on p.conv_id = t.conv_id and p.message_id = t.message_id""",
        },
    ),
    "chunks_with_rest": V.with_views(
        """select conv_id, chunk, min(turn) as first_turn, count(*) as n_comments,
  string_agg(text, chr(10) order by turn) as discussion from n group by conv_id, chunk""",
        "comments",
        extra={
            "n": """select *, cast((row_number() over (partition by conv_id order by turn) - 1) // 3 as bigint)
  as chunk from comments"""
        },
    ),
    "facilitative_candidates": V.with_views(
        """select message_id, label = 1 as is_moderator, round(score,6) as score from scored
where label = 1 or score > 0.6E0""",
        "scored",
    ),
    "capped_sources": _capped(40),
    "capped_sources_large": _capped(2000),
    "tactic_polarity": V.with_views(
        f"""select c.message_id, t.taxonomy, t.tactic,
  case t.polarity when '+' then 'positive' when '-' then 'negative' when '' then 'none' end as polarity
from comments c join (values {_values(TAXONOMY)}) t(i, taxonomy, tactic, polarity)
  on length(c.text) % {len(TAXONOMY)} = t.i""",
        "comments",
    ),
    "pseudonymised": V.with_views(
        "select message_id, sha256('pepper'||user_name) as user from comments", "comments"
    ),
    "id_union": V.with_views(
        "select conv_id from comments union select conv_id from ratings", "comments", "ratings"
    ),
    "ordered_output": V.with_views(
        "select dataset, count(*) as n from comments group by dataset", "comments"
    ),
    "sorted_comments": V.with_views(
        "select conv_id, turn, message_id from comments order by conv_id, turn", "comments"
    ),
    "experiment_matrix": V.with_views(
        f"""select message_id, dataset, model, task, prompt from comments
cross join (values {', '.join(f"('{m}')" for m in RUN_MODELS)}) m(model)
cross join (values {', '.join(f"('{t}','{p}')" for t, p in RUN_PROMPTS)}) r(task, prompt)""",
        "comments",
    ),
}

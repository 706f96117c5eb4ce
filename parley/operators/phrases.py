"""Phrase mining: frequent phrases, exact TF-IDF, characteristic phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.text import (
    ENGLISH_STOP_WORDS,
    GLUED_WORDS,
    WEB_STOP_WORDS,
    clean_text,
    content_words,
)
from parley.operators.ordering import first_k
from parley.session import landed, pinned

STOP_WORDS = ENGLISH_STOP_WORDS + WEB_STOP_WORDS
# Characters of text whose phrases share a bucket, on average: bounds a task.
BUCKET_CHARS = 8_000_000
# Deals of texts a task: the texts of a deal share a row per bucket.
DEALS = 4
# Codes, in a key, of the characters that part lines and fields of a cell.
_ESCAPES = (("\x1a", "\x1aa"), ("\n", "\x1ab"), ("\t", "\x1ac"))
# Hash slots of a dataset's phrases, and how many of the largest are counted first: change speed, never results.
SLOTS, FIRST_SLOTS = 16_384, 512
# Tables dealt out by bucket are joined by bucket and phrase, or bucket and text, where they are.
BY_BUCKET = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def document_phrases(
    texts: DataFrame,
    doc: str,
    dataset: str = "dataset",
    text: str = "text",
    stop_words: Sequence[str] = STOP_WORDS,
    sizes: Sequence[int] = (2, 3),
    glued: Sequence[tuple[str, str]] = (),
    tasks: int | None = None,
    deal: Column | None = None,
) -> DataFrame:
    """(doc, dataset, phrase, tf): every distinct phrase of every text.

    With a ``deal`` also (_deal, pair): then a phrase of two words is left out if the first one of
    three that begins with it has all its places, and ``pair`` says that the row stands for both.

    Texts are dealt out by id (or deal) first: their phrases are several times as large,
    so that costs little, and the work does not depend on how files are cut.
    Phrases are sorted and counted inside the row, so a text leaves one row per
    distinct phrase. Each step is its own projection of whole arrays and no
    lambda looks outside its elements: a text is cleaned and sorted once.
    """
    words = content_words(clean_text(F.col(text), glued), stop_words)
    tasks = tasks or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = [] if deal is None else [deal.alias("_deal")]
    own = [doc, dataset, *(["_deal"] if number else [])]
    dealt = texts.select(doc, dataset, text, *number).repartition(tasks, "_deal" if number else doc)
    runs = dealt.select(*own, words.alias("_p1"))
    for size in range(2, max(sizes) + 1):
        n = F.greatest(F.size("_p1") - (size - 1), F.lit(0))
        longer = F.zip_with(
            F.slice(f"_p{size - 1}", F.lit(1), n),
            F.slice("_p1", F.lit(size), n),
            lambda run, word: F.concat(run, F.lit(" "), word),
        )
        runs = runs.withColumn(f"_p{size}", longer)
    ordered = runs.select(
        *own, F.sort_array(F.concat(*[F.col(f"_p{size}") for size in sizes])).alias("phrase")
    )
    n = F.size("phrase")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    before = F.slice(F.array_prepend("phrase", F.lit(None)), F.lit(1), n)
    numbered = ordered.select(
        *own, n.alias("n"),
        F.arrays_zip("phrase", before.alias("before"), places.alias("at")).alias("all"),
    )
    first = F.filter("all", lambda x: ~x["phrase"].eqNullSafe(x["before"]))
    starts = numbered.select(*own, "n", first.alias("first"))
    ends = F.array_append(F.slice(F.transform("first", lambda x: x["at"]), F.lit(2), F.size("first")), F.col("n"))
    counted = F.zip_with(
        "first", ends.alias("end"),
        lambda x, end: F.struct(x["phrase"].alias("phrase"), (end - x["at"]).cast("long").alias("tf")),
    )
    if deal is None:
        return starts.select(*own, F.inline(counted).alias("phrase", "tf"))
    # Most pairs of words occur in one triple of a text only: the triple stands for both.
    found = starts.select(*own, counted.alias("all"))
    n = F.size("all")
    beside = F.arrays_zip(
        "all", F.slice(F.array_prepend("all", F.lit(None)), F.lit(1), n).alias("before"),
        F.slice(F.array_append("all", F.lit(None)), F.lit(2), n).alias("after"),
    )
    kept = F.filter(beside, lambda x: ~_goes_with(x["all"], x["after"]))
    marked = F.transform(
        "kept", lambda x: F.struct(x["all"]["phrase"], x["all"]["tf"], _goes_with(x["before"], x["all"]).alias("pair"))
    )
    return found.select(*own, kept.alias("kept")).select(*own, F.inline(marked).alias("phrase", "tf", "pair"))


def _goes_with(pair: Column, triple: Column) -> Column:
    """Whether a phrase of two words occurs in the phrase of three that follows it in order, and nowhere else."""
    words = F.substring_index(triple["phrase"], " ", 3)
    inside = (words == triple["phrase"]) & (F.substring_index(words, " ", 2) == pair["phrase"])
    return F.coalesce(inside & (words != pair["phrase"]) & F.contains(pair["phrase"], F.lit(" ")) & (pair["tf"] == triple["tf"]), F.lit(False))


def _landed_words(
    texts: DataFrame, doc: str, dataset: str, text: str, stop_words: Sequence[str], glued: Sequence[tuple[str, str]]
) -> DataFrame:
    """(dataset, words): the content words of every text, cleaned once."""
    words = content_words(clean_text(F.col(text), glued), stop_words)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(doc, dataset, text).repartition(tasks, doc)
    return landed(dealt.select(dataset, F.array_join(words, " ").alias("_words")), "words")


def _occurrences(words: DataFrame, dataset: str, sizes: Sequence[int]) -> DataFrame:
    """(row, dataset, phrase, slot): a row for every place of a phrase; a slot is a hash of the phrase."""
    split = words.select(
        F.monotonically_increasing_id().alias("_row"), dataset, F.split("_words", " ").alias("_all")
    )
    places = range(max(sizes))
    zipped = F.arrays_zip(*[F.slice("_all", F.lit(at + 1), F.size("_all")).alias(f"_w{at}") for at in places])
    runs = split.select("_row", dataset, F.inline(zipped).alias(*[f"_w{at}" for at in places]))
    found = [
        F.when(F.col(f"_w{size - 1}").isNotNull(), F.concat_ws(" ", *[f"_w{at}" for at in range(size)]))
        for size in sorted(set(sizes))
    ]
    phrases = runs.select("_row", dataset, F.explode(F.array(*found)).alias("phrase")).where(F.col("phrase") != "")
    return phrases.withColumn("_slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)).cast("int"))


def _counted(found: DataFrame, chosen: DataFrame, dataset: str, min_df: int, top: int) -> DataFrame:
    """The first phrases of every dataset among those of the chosen slots, counted exactly."""
    own = chosen.select(F.col(dataset).alias("_of"), F.col("_slot").alias("_of_slot"))
    kept = found.join(own, F.col(dataset).eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_of_slot")), "left_semi")
    counts = (
        kept.groupBy(dataset, "phrase", "_row").agg(F.count(F.lit(1)).alias("_tf"))
        .groupBy(dataset, "phrase").agg(F.sum("_tf").alias("n"), F.count(F.lit(1)).alias("_df"))
        .where(F.col("_df") >= min_df)
        .drop("_df")
    )
    return landed(first_k(counts, [dataset], _most(), top), "phrase-counts")


def _most() -> list[Column]:
    return [F.desc("n"), F.asc("phrase")]


def frequent_phrases(
    texts: DataFrame,
    doc: str,
    dataset: str = "dataset",
    min_df: int = 2,
    top: int = 10,
    text: str = "text",
    stop_words: Sequence[str] = STOP_WORDS,
    sizes: Sequence[int] = (2, 3),
    glued: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Most frequent phrases per dataset among those in ``min_df`` texts; ties by phrase.

    Exact, and most phrases never move. First every place of a phrase is counted
    under its (dataset, slot), combined where the texts are: no phrase occurs more
    often than its slot. The phrases of each dataset's largest slots are then
    counted one by one. If the last of the first ``top`` occurs at least as often
    as the smallest of those slots, no phrase outside can be among them;
    datasets where it does not count all slots as large as what was found.
    """
    found = _occurrences(_landed_words(texts, doc, dataset, text, stop_words, glued), dataset, sizes)
    slots = landed(found.groupBy(dataset, "_slot").agg(F.count(F.lit(1)).alias("_n")), "phrase-slots")
    largest = first_k(slots, [dataset], [F.desc("_n"), F.asc("_slot")], FIRST_SLOTS)
    least = landed(largest.groupBy(F.col(dataset).alias("_of")).agg(F.min("_n").alias("_least")), "phrase-least")

    def chosen(bounds: DataFrame) -> DataFrame:
        return slots.join(bounds, F.col(dataset).eqNullSafe(F.col("_of")) & (F.col("_n") >= F.col("_least")), "left_semi")

    first = _counted(found, chosen(least), dataset, min_df, top)
    # The smallest count that a phrase outside would have to reach; with too few phrases, any.
    reached = first.groupBy(F.col(dataset).alias("_dataset")).agg(
        F.when(F.count(F.lit(1)) >= top, F.min("n")).alias("_reached")
    )
    state = least.join(reached, F.col("_of").eqNullSafe(F.col("_dataset")), "left").select(
        "_of", "_least", F.greatest(F.coalesce("_reached", F.lit(min_df)), F.lit(min_df)).alias("_bound")
    )
    open_ = landed(state.where(F.col("_bound") < F.col("_least")).select("_of", F.col("_bound").alias("_least")), "phrase-open")
    counts = first
    if not open_.isEmpty():
        more = _counted(found, chosen(open_), dataset, min_df, top)
        proven = first.join(open_, F.col(dataset).eqNullSafe(F.col("_of")), "left_anti")
        counts = landed(proven.unionByName(more), "phrase-counts")
    ranked = first_k(counts, [dataset], _most(), top, rank="rank")
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def _escaped(key: Column) -> Column:
    """A key without tabs and line breaks; see `_unescaped`."""
    for found, kept in _ESCAPES:
        key = F.replace(key, F.lit(found), F.lit(kept))
    return key


def _unescaped(key: Column) -> Column:
    for found, kept in reversed(_ESCAPES):
        key = F.replace(key, F.lit(kept), F.lit(found))
    return key


def _bucketed(terms: DataFrame, doc: str, dataset: str, buckets: int) -> DataFrame:
    """(bucket, cell): the phrases of one deal of texts in one bucket, as one row; the only time phrases move.

    A bucket holds all phrases that begin with the same two words. A cell is
    [dataset, phrases one a line, each with its count if above one and the key of its text, a plus before
    the count if the line stands for its first two words too]: sorted phrases share prefixes, so a line shrinks. With more texts there are more
    buckets and a text leaves hardly two phrases in one; a deal still leaves many, so the bytes of a phrase do
    not grow. Nothing of a cell can be left out of a plan, and nothing that is joined is ever null, so no plan
    over cells has a filter of its own below the exchange: all of them reuse it.
    """
    first = F.substring_index("phrase", " ", 2)
    bucket = F.coalesce(F.pmod(F.xxhash64(first), F.lit(buckets)).cast("int"), F.lit(0))
    key = F.coalesce(F.concat(F.lit("="), _escaped(F.col(doc).cast("string"))), F.lit(""))
    count = F.when(F.col("tf") > 1, F.col("tf").cast("string")).otherwise(F.lit(""))
    line = F.concat_ws("\t", "phrase", F.concat(F.when(F.col("pair"), F.lit("+")).otherwise(F.lit("")), count), key)
    # Texts were dealt out by deal, so their cells are put together where they are.
    cells = terms.groupBy("_deal", F.col(dataset).cast("string").alias("_dataset"), bucket.alias("_bucket")).agg(
        F.collect_list(line).alias("_lines")
    )
    cell = F.array("_dataset", F.array_join(F.sort_array("_lines"), "\n"))
    return cells.select("_bucket", cell.alias("_cell")).repartition(buckets, "_bucket")


def _packed(rows: DataFrame, value: str) -> DataFrame:
    """(bucket, slice, keys, values): the numbers of a slice of the texts in one bucket, as one row."""
    packed = rows.groupBy("_bucket", "_slice").agg(F.collect_list("_key").alias("_keys"), F.collect_list(value).alias("_values"))
    return packed.select("_bucket", "_slice", F.array_join("_keys", "\n").alias("_keys"), "_values")


def _unpacked(packed: DataFrame, value: str) -> DataFrame:
    """(bucket, slice, key, value): a row for every number of `_packed`."""
    both = F.arrays_zip(F.split("_keys", "\n").alias("key"), F.col("_values").alias("value"))
    return packed.select("_bucket", "_slice", F.inline(both).alias("_key", value))


def _weighted(
    texts: DataFrame, doc: str, dataset: str, min_df: int, glued: Sequence[tuple[str, str]], **options
) -> DataFrame:
    """(bucket, doc, dataset, phrase, tfidf), to be run with ``BY_BUCKET``: then only cells and norms move."""
    text = options.get("text", "text")
    n_texts, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length(text).cast("long"))).first()
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-(chars or 0) // BUCKET_CHARS))
    # Repeated ids are spread by their texts.
    deal = F.pmod(F.xxhash64(doc, text), F.lit(buckets * DEALS))
    cells = _bucketed(
        document_phrases(texts, doc, dataset, glued=glued, tasks=buckets, deal=deal, **options), doc, dataset, buckets
    )
    lines = cells.select("_bucket", "_cell", F.explode_outer(F.split(F.get("_cell", F.lit(1)), "\n")).alias("_line"))
    parsed = lines.select(
        "_bucket", F.coalesce(F.substring_index("_line", "\t", -1), F.lit("")).alias("_key"),
        F.get("_cell", F.lit(0)).alias("_dataset"),
        F.substring_index("_line", "\t", 1).alias("_phrase"),
        F.substring_index(F.substring_index("_line", "\t", 2), "\t", -1).alias("_count"),
    )
    both = F.when(F.startswith("_count", F.lit("+")), F.array("_phrase", F.substring_index("_phrase", " ", 2)))
    digits = F.ltrim("_count", F.lit("+"))
    count = F.when(digits == "", F.lit(1).cast("long")).otherwise(digits.cast("long"))
    terms = parsed.select(
        "_bucket", "_key", "_dataset", F.explode_outer(both.otherwise(F.array("_phrase"))).alias("phrase"), count.alias("tf")
    )
    frequency = terms.groupBy("_bucket", "phrase").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= min_df)
    idf = F.log((F.lit(1.0) + n_texts) / (F.lit(1.0) + F.col("_df"))) + 1.0
    frequency = frequency.select("_bucket", "phrase", idf.alias("_idf")).hint("shuffle_hash")
    weighted = terms.join(frequency, ["_bucket", "phrase"]).withColumn("_w", F.col("tf") * F.col("_idf"))
    # A number per text and bucket goes to its text and comes back as the norm, packed by slices of the texts.
    parts = weighted.groupBy("_bucket", "_key").agg(F.sum(F.col("_w") * F.col("_w")).alias("_squares"))
    sliced = parts.withColumn("_slice", F.pmod(F.xxhash64("_key"), F.lit(buckets * DEALS)))
    parts = _unpacked(_packed(sliced, "_squares").repartition("_slice"), "_squares")
    norm = F.sqrt(F.sum("_squares").over(Window.partitionBy("_slice", "_key"))).alias("_norm")
    norms = _packed(parts.select("_bucket", "_slice", "_key", norm), "_norm").repartition(buckets, "_bucket")
    norms = _unpacked(norms, "_norm").select("_bucket", "_key", "_norm").hint("shuffle_hash")
    own = F.when(F.col("_key") != "", _unescaped(F.substr("_key", F.lit(2)))).cast(texts.schema[doc].dataType)
    return weighted.join(norms, ["_bucket", "_key"]).select(
        "_bucket", own.alias(doc), F.col("_dataset").cast(texts.schema[dataset].dataType).alias(dataset),
        "phrase", (F.col("_w") / F.col("_norm")).alias("tfidf"),
    )


def tfidf(
    texts: DataFrame,
    doc: str,
    dataset: str = "dataset",
    min_df: int = 2,
    glued: Sequence[tuple[str, str]] = GLUED_WORDS,
    **options,
) -> DataFrame:
    """(doc, dataset, phrase, tfidf): smooth idf, every text scaled to length one.

    Exact: no phrase stands for another. Phrases move once, as cells of a text's
    phrases in one bucket; frequencies, weights and norms are found inside the
    buckets, and only a number per text and bucket moves besides.
    """
    with pinned(texts.sparkSession, BY_BUCKET):
        weights = _weighted(texts, doc, dataset, min_df, glued, **options)
        return landed(weights.select(doc, dataset, "phrase", "tfidf"), "tfidf")


def characteristic_phrases(
    texts: DataFrame,
    doc: str,
    dataset: str = "dataset",
    top: int = 10,
    min_df: int = 2,
    glued: Sequence[tuple[str, str]] = GLUED_WORDS,
    **options,
) -> DataFrame:
    """Phrases with the highest mean TF-IDF per dataset, relative to its best.

    Texts without the phrase count as zero in the mean. The best phrase is
    among the top ones, so the scaling reads only those. A phrase is in one
    bucket, so its weights are added up there and only the first ones leave it.
    """
    sizes = texts.groupBy(dataset).agg(F.count(F.lit(1)).alias("_texts"))
    # Sums may differ in the last bits from run to run; rounding keeps ties ties.
    order = [F.desc(F.round("_sum", 9)), F.asc("phrase")]
    with pinned(texts.sparkSession, BY_BUCKET):
        weights = _weighted(texts, doc, dataset, min_df, glued, **options)
        sums = weights.groupBy("_bucket", dataset, "phrase").agg(F.sum("tfidf").alias("_sum"))
        first = landed(first_k(sums.drop("_bucket"), [dataset], order, top), "characteristic")
    best = first_k(first, [dataset], order, top, rank="rank").join(sizes, dataset)
    mean = F.col("_sum") / F.col("_texts")
    highest = F.max(mean).over(Window.partitionBy(dataset))
    return best.select(
        dataset, "phrase", F.try_divide(mean, highest).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )

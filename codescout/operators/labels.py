"""Code labels of queries: collecting, validating, merging and tracking them.

Label tables are long where a list could grow with the data (queries or codes of a
specialty) and nested where the vocabulary bounds it (codes of one query). Repeats
are removed by partial aggregation before any list is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescout.functions.text import (
    KEYWORD_CODES,
    SPACE_CHARS,
    default_code,
    file_safe,
    fill_template,
    keyed_specialty,
    keyword_codes,
    parse_code_list,
    strip_space,
)
from codescout.operators.running import row_numbers
from codescout.session import materialise


def group_queries_by_specialty(records: DataFrame, order: str) -> DataFrame:
    """Distinct queries and codes per keyed specialty with the order of first sight.

    ``records`` is (query, nucc_spec, nucc_class, related_icd10cm, order). Long form:
    one row per specialty, kind (``query`` or ``code``) and item. Empty queries are
    left out, their codes are not.

    Order and position are one number while they are compared: the smallest of numbers is kept in a hash table with a row per item,
    the smallest of structs by sorting all rows first.
    """
    keyed = records.select(
        keyed_specialty(F.col("nucc_class"), F.col("nucc_spec")).alias("keyed_specialty"),
        F.col(order).alias("_order"),
        "query",
        "related_icd10cm",
    )
    queries = keyed.filter(F.col("query") != "").select(
        "keyed_specialty", F.lit("query").alias("kind"), F.col("query").alias("item"), "_order", F.lit(0).alias("_pos")
    )
    codes = keyed.select(
        "keyed_specialty", F.lit("code").alias("kind"), "_order", F.posexplode("related_icd10cm").alias("_pos", "item")
    )
    rows, kind = queries.unionByName(codes), keyed.schema["_order"].dataType
    of_item = rows.groupBy("keyed_specialty", "kind", "item")
    if isinstance(kind, T.IntegralType):
        least = F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")  # stands for null, which comes first
        one = F.coalesce(F.col("_order").cast("decimal(20,0)"), least) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_pos")
        seen = of_item.agg(F.min(one).alias("_one"))
        pos = F.pmod(F.col("_one"), F.lit(1 << 31).cast("decimal(10,0)")).cast("int")
        first = ((F.col("_one") - pos) / F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(20,0)")
        first = F.when(first > least, first.cast(kind))
    else:
        seen = of_item.agg(F.min(F.struct("_order", "_pos")).alias("_seen"))
        first, pos = F.col("_seen")["_order"], F.col("_seen")["_pos"]
    return seen.select("keyed_specialty", "kind", "item", first.alias("first_seen"), pos.alias("first_position"))


def merge_label_list(labels: DataFrame) -> DataFrame:
    """One row per specialty and query with the sorted union of its codes; empty lists stay."""
    codes = labels.select("specialty", "query", F.explode_outer("codes").alias("code")).distinct()
    return codes.groupBy("specialty", "query").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def consolidate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two label sets: missing or empty lists give way to the other set's."""
    columns = ["specialty", "query", "codes"]
    return merge_label_list(first.select(columns).unionByName(second.select(columns)))


def find_empty_queries(labels: DataFrame) -> DataFrame:
    """Queries that have no code."""
    return labels.filter(F.size("codes") == 0).select("specialty", "query")


def consolidation_summary(first: DataFrame, second: DataFrame, merged: DataFrame) -> DataFrame:
    """Entries, queries and queries without codes of each set, and how many empty ones went away.

    An entry is one specialty of one input list, told apart by the ``entry`` column
    where a set has one.
    """
    parts = None
    for name, labels in (("set1", first), ("set2", second), ("consolidated", merged)):
        entry = F.struct("entry", "specialty") if "entry" in labels.columns else F.col("specialty")
        part = labels.agg(
            F.count_distinct(entry).alias("specialties"),
            F.count("*").alias("queries"),
            F.count_if(F.size("codes") == 0).alias("empty"),
        ).withColumn("data_set", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    empty_of = {n: F.sum(F.when(F.col("data_set") == n, F.col("empty"))) for n in ("set1", "set2", "consolidated")}
    reduction = parts.agg((empty_of["set1"] + empty_of["set2"] - empty_of["consolidated"]).alias("queries")).select(
        F.lit("reduction").alias("data_set"),
        F.lit(0).cast("long").alias("specialties"),
        F.lit(0).cast("long").alias("queries"),
        F.col("queries").alias("empty"),
    )
    return parts.select("data_set", "specialties", "queries", "empty").unionByName(reduction)


# --- codes and the reference ---------------------------------------------------------------


def last_descriptions(codes: DataFrame, order: str) -> DataFrame:
    """One description per code, the last one of a repeated code."""
    return codes.groupBy("code").agg(F.max_by("description", order).alias("description"))


def validate_codes(replies: DataFrame, reference: DataFrame, keys: Sequence[str] = ("specialty", "query")) -> DataFrame:
    """Codes of each reply that exist in the reference, order and repeats kept.

    A reply without valid codes keeps an empty list. Copies of a reply count once.
    """
    parsed = replies.select(*keys, F.posexplode_outer(parse_code_list(F.col("reply"))).alias("_pos", "code"))
    known = reference.select(F.col("code").alias("_known")).distinct()
    checked = parsed.join(known, F.col("code") == F.col("_known"), "left")
    item = F.when(F.col("_known").isNotNull(), F.struct("_pos", "code"))
    return checked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_set(item)), lambda m: m["code"]).alias("codes")
    )


def codes_to_descriptions(
    labels: DataFrame, descriptions: DataFrame, keys: Sequence[str] = ("specialty", "query"), distinct: bool = False
) -> DataFrame:
    """Descriptions of each query's codes, in order with repeats, or as a sorted set."""
    found = labels.select(*keys, F.posexplode("codes").alias("_pos", "code")).join(descriptions, "code")
    if distinct:
        return (
            found.select(*keys, "description")
            .distinct()
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list("description")).alias("descriptions"))
        )
    return found.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct("_pos", "description"))), lambda m: m["description"]
        ).alias("descriptions")
    )


def remove_nonrelevant(labels: DataFrame, replies: DataFrame, keys: Sequence[str] = ("specialty", "query")) -> DataFrame:
    """Take the codes that a reply names as non-relevant out of a query's list."""
    named = replies.select(*keys, parse_code_list(F.col("reply")).alias("_out"))
    merged = named.select(*keys, F.explode("_out").alias("_code")).distinct().groupBy(*keys).agg(
        F.collect_list("_code").alias("_out")
    )
    kept = F.filter("codes", lambda code: ~F.array_contains(F.col("_out"), code))
    return labels.join(merged, list(keys), "left").select(
        *keys, F.when(F.col("_out").isNull(), F.col("codes")).otherwise(kept).alias("codes")
    )


def query_keyword_codes(
    queries: DataFrame,
    order: str,
    keywords: Mapping[str, Sequence[str]] = KEYWORD_CODES,
    default: Column | None = None,
) -> DataFrame:
    """Codes per query by the keywords in its text.

    A query of several specialties takes the default of the last one in ``order``.
    """
    latest = queries.groupBy("query").agg(F.max_by("specialty", order).alias("specialty"))
    fallback = default if default is not None else default_code(F.col("specialty"))
    return latest.select("query", keyword_codes(F.col("query"), keywords, fallback).alias("codes"))


# --- work items ------------------------------------------------------------------------------


def pending_items(items: DataFrame, written: DataFrame, answered: DataFrame) -> DataFrame:
    """Work items whose specialty is not written and whose query is not answered yet."""
    named = items.withColumn("specialty", file_safe(F.col("specialty")))
    return named.join(written.select("specialty").distinct(), "specialty", "left_anti").join(
        answered.select("specialty", "query").distinct(), ["specialty", "query"], "left_anti"
    )


def labelling_progress(items: DataFrame) -> DataFrame:
    """Totals per specialty; ``completed`` once no item is open, else ``in_progress``."""
    counted = items.groupBy("specialty").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    closed = F.col("completed") + F.col("failed") == F.col("total")
    return counted.withColumn("status", F.when(closed, "completed").otherwise("in_progress"))


def overall_progress(items: DataFrame) -> DataFrame:
    """Totals over all specialties."""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def split_by_specialty(rows: DataFrame, chunks: int, specialty: str = "specialty") -> DataFrame:
    """Assign contiguous runs of specialties, in order, to numbered chunks."""
    names = rows.select(specialty).distinct()
    numbered = row_numbers(names, [F.col(specialty).asc()], "_place")
    total = names.agg(F.count("*").alias("n")).first().n
    size = max(1, -(-total // chunks))
    placed = numbered.select(specialty, F.floor((F.col("_place") - 1) / size).cast("int").alias("chunk"))
    return rows.join(placed, specialty)


# --- requests to a model ---------------------------------------------------------------------


# The placeholders of prompt templates.
QUERY_PLACEHOLDER = "medical_query"
SPECIALTY_PLACEHOLDER = "medical_specialty_subspecialty"
CODES_PLACEHOLDER = "icd_code_description_list"


def build_requests(
    labels: DataFrame,
    descriptions: DataFrame,
    template: str,
    keys: Sequence[str] = ("specialty", "query"),
) -> DataFrame:
    """Fill a prompt template per query with its ordered ``code: description`` list.

    Placeholders: ``{medical_query}``, ``{medical_specialty_subspecialty}`` and
    ``{icd_code_description_list}``.
    """
    listed = (
        labels.select(*keys, F.explode_outer("codes").alias("code"))
        .distinct()
        .join(descriptions, "code", "left")
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("code").isNotNull(), F.concat("code", F.lit(": "), F.coalesce("description", F.lit("")))))
            ).alias("_list")
        )
    )
    text = F.concat(F.lit("["), F.array_join("_list", ", "), F.lit("]"))
    return listed.select(
        *keys,
        fill_template(
            template,
            {
                QUERY_PLACEHOLDER: F.col("query"),
                SPECIALTY_PLACEHOLDER: F.col("specialty"),
                CODES_PLACEHOLDER: text,
            },
        ).alias("request"),
    )


# --- labels out of a vocabulary ----------------------------------------------------------------


def _parts(text: Column) -> Column:
    """All distinct parts of a text of three characters, or the whole text if it is shorter."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(3))))


def _short_parts(text: Column) -> Column:
    """All distinct parts of a text of up to two characters, the empty one included."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def of_length(n: int) -> Column:
        return F.transform(at, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), of_length(1), of_length(2)))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, f"[{SPACE_CHARS}]+", -1), lambda word: word != ""))


def rarest_part(texts: DataFrame, key: str, text: str, others: DataFrame, other_text: str) -> DataFrame:
    """``texts`` with ``_part``: of all parts of three characters the one that the fewest of ``others`` have.

    Whatever contains a text has that part. Texts with a part that none of the others has are left out, as are those below three
    characters.
    """
    long = texts.filter(F.length(text) >= 3)
    counted = others.select(F.explode(_parts(F.col(other_text))).alias("_part")).groupBy("_part").agg(F.count("*").alias("_n"))
    parts = long.select(key, F.explode(_parts(F.col(text))).alias("_part")).join(counted, "_part", "left")
    rarest = parts.groupBy(key).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_part")).alias("_r"))
    return long.join(rarest.filter("_r.n > 0").select(key, F.col("_r._part").alias("_part")), key)


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(``_inner``, ``_outer``) of candidates: texts of three characters or more meet by the rarest part of the contained one."""
    by_part = rarest_part(inner, "_inner", "_small", outer, "_large")
    met = by_part.join(outer.select("_outer", "_large", F.explode(_parts(F.col("_large"))).alias("_part")), "_part")
    return met.select("_inner", "_outer", "_small", "_large")


def _inside(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(``_asked``, ``_in``): the first label that contains a prediction or is contained in it.

    Of texts below three characters only the first label for each is looked up, so they list no pairs.
    """
    one = asked.select(F.col("_asked").alias("_inner"), F.col("_low").alias("_small"))
    held = containing(one, names.select(F.col("_ord").alias("_outer"), F.col("_name").alias("_large")))
    held = held.filter(F.contains("_large", "_small")).select(F.col("_inner").alias("_asked"), F.col("_outer").alias("_ord"))
    other = names.select(F.col("_ord").alias("_inner"), F.col("_name").alias("_small"))
    holding = containing(other, asked.select(F.col("_asked").alias("_outer"), F.col("_low").alias("_large")))
    holding = holding.filter(F.contains("_large", "_small")).select(F.col("_outer").alias("_asked"), F.col("_inner").alias("_ord"))
    # The first label with each part of up to two characters, and the first label that is one.
    first_with = names.select("_ord", F.explode(_short_parts(F.col("_name"))).alias("_low")).groupBy("_low").agg(F.min("_ord").alias("_ord"))
    short_asked = asked.filter(F.length("_low") < 3).join(first_with, "_low").select("_asked", "_ord")
    first_is = names.filter(F.length("_name") < 3).groupBy(F.col("_name").alias("_part")).agg(F.min("_ord").alias("_ord"))
    short_name = asked.select("_asked", F.explode(_short_parts(F.col("_low"))).alias("_part")).join(first_is, "_part").select("_asked", "_ord")
    found = held.unionByName(holding).unionByName(short_asked).unionByName(short_name)
    return found.groupBy("_asked").agg(F.min("_ord").alias("_in"))


def _single_word(known: DataFrame, postings: DataFrame) -> DataFrame:
    """(``_asked``, ``_ord``, ``_score``): the best label by one common word, from the first label of each size with the word."""
    sizes = postings.groupBy("_word", "_other").agg(F.min("_ord").alias("_ord"))
    listed = sizes.groupBy("_word").agg(F.array_sort(F.collect_list(F.struct("_other", "_ord"))).alias("_sizes"))
    best = F.struct((-F.try_divide(F.lit(1), F.greatest("_own", "_size._other"))).alias("s"), F.col("_size._ord").alias("o"))
    each = known.join(listed, "_word").select("_asked", "_own", F.explode("_sizes").alias("_size"))
    first = each.groupBy("_asked").agg(F.min(best).alias("_b"))
    return first.select("_asked", F.col("_b.o").alias("_ord"), (-F.col("_b.s")).alias("_score"))


def word_candidates(known: DataFrame, postings: DataFrame, at_least: DataFrame, start: int) -> DataFrame:
    """(``_asked``, ``_ord``, ``_score``) of labels that share two words or more and may score what ``at_least`` has.

    ``known`` numbers the words of a prediction from the rarest on (``_place`` from 1 to ``_known``). A label with a score of s has
    c >= s times ``_own`` of them, so it has one of the rarest ``_known`` - c + 1: only these are looked up, from ``start`` on, and
    never the most frequent one.
    """
    needed = F.greatest(F.lit(2), F.ceil(F.col("_least") * F.col("_own") - 1e-9))
    used = known.join(at_least.select("_asked", F.col("_score").alias("_least")), "_asked")
    used = used.filter((F.col("_place") >= start) & (F.col("_place") <= F.col("_known") - needed + 1))
    met = used.join(postings, "_word").select("_asked", "_ord", "_own", "_other", "_said", "_says")
    common = F.size(F.array_intersect("_said", "_says"))
    return met.select("_asked", "_ord", (common / F.greatest("_own", "_other")).alias("_score")).distinct()


def _shared(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(``_asked``, ``_shared``): the first of the labels with the highest share of common words."""
    said = asked.select("_asked", _words(F.col("_low")).alias("_said")).withColumn("_own", F.size("_said"))
    says = names.select("_ord", _words(F.col("_name")).alias("_says")).withColumn("_other", F.size("_says"))
    postings = materialise(says.select("_ord", "_says", "_other", F.explode("_says").alias("_word")))
    counted = postings.groupBy("_word").agg(F.count("*").alias("_n"))
    words = said.select("*", F.explode("_said").alias("_word")).join(counted, "_word")
    place = Window.partitionBy("_asked").orderBy("_n", "_word")
    numbered = words.withColumn("_place", F.row_number().over(place)).withColumn("_known", F.count("*").over(Window.partitionBy("_asked")))
    known = materialise(numbered.drop("_n"))

    def best(found: DataFrame) -> DataFrame:
        top = found.groupBy("_asked").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_ord").alias("o"))).alias("_b"))
        return top.select("_asked", F.col("_b.o").alias("_ord"), (-F.col("_b.s")).alias("_score"))

    one = _single_word(known, postings)
    # The rarest word first: what it finds leaves fewer of the others to look up.
    first = materialise(best(one.unionByName(word_candidates(known.filter("_place = 1"), postings, one, 1))))
    rest = word_candidates(known, postings, first, 2)
    return best(first.unionByName(rest)).select("_asked", F.col("_ord").alias("_shared"))


def closest_labels(
    df: DataFrame, labels: DataFrame, predicted: str = "predicted", label: str = "label", order: str = "ord"
) -> DataFrame:
    """``df`` with ``closest``: the label nearest to the predicted one, null for null and without labels.

    The first label (by ``order``, which is unique) that contains the prediction or is contained in it wins. Otherwise the highest
    share of common words wins, the first on ties, and the first label of all when no word is shared. Distinct predictions meet
    labels by equi-joins on what is rare in them: the rarest three characters of the contained text, and words from the rarest on for
    as long as a label that wasn't met yet can still win. So a word that all labels have lists no pairs.
    """
    names = labels.select(F.col(label).alias("_label"), F.col(order).alias("_ord"), F.lower(label).alias("_name")).filter("_name IS NOT NULL")
    asked = df.select(F.col(predicted).alias("_asked")).filter("_asked IS NOT NULL").distinct().withColumn("_low", F.lower("_asked"))
    equal = asked.join(names.groupBy(F.col("_name").alias("_low")).agg(F.min("_ord").alias("_equal")), "_low", "left")
    inside, shared = _inside(asked, names), _shared(asked, names)
    lowest = labels.agg(F.min(order)).first()[0]
    chosen = equal.join(inside, "_asked", "left").join(shared, "_asked", "left")
    first = F.lit(lowest).cast(names.schema["_ord"].dataType)
    chosen = chosen.select("_asked", F.coalesce(F.least("_in", "_equal"), "_shared", first).alias("_ord"))
    chosen = chosen.join(labels.select(F.col(order).alias("_ord"), F.col(label).alias("_label")), "_ord", "left")
    found = chosen.select(F.col("_asked").alias(predicted), F.col("_label").alias("closest"))
    return df.join(found, predicted, "left")


def validated_labels(
    df: DataFrame,
    labels: DataFrame,
    predicted: str = "predicted",
    label: str = "label",
    order: str = "ord",
    fallback: str = "general_practice",
) -> DataFrame:
    """``df`` with ``valid``: a listed label as it is, the closest one for others, the first for null, ``fallback`` without labels."""
    first = labels.agg(F.min_by(label, order)).first()[0]
    listed = labels.select(F.col(label).alias(predicted)).distinct().withColumn("_listed", F.lit(True))
    others = df.join(listed, predicted, "left")
    near = closest_labels(others.filter("_listed IS NULL").select(predicted).distinct(), labels, predicted, label, order)
    joined = others.join(near, predicted, "left")
    valid = F.when(F.col("_listed"), F.col(predicted)).otherwise(F.coalesce("closest", F.lit(first), F.lit(fallback)))
    return joined.select(*df.columns, valid.alias("valid"))


def top_labels(
    df: DataFrame, labels: DataFrame, key: str, reply: str = "reply", label: str = "label", wanted: int = 3
) -> DataFrame:
    """(``key``, ``labels``, ``complete``): the known labels of a comma list in order, and whether there are as many as wanted.

    ``key`` is unique. Items meet the labels in a join, so the vocabulary may be of any size.
    """
    items = F.transform(F.split(F.coalesce(reply, F.lit("")), ",", -1), strip_space)
    placed = df.select(key, F.posexplode(items).alias("_pos", "_item"))
    known = placed.join(labels.select(F.col(label).alias("_item")).distinct(), "_item", "left_semi")
    lists = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_found"))
    found = F.coalesce(F.col("_found._item"), F.array().cast("array<string>"))
    return df.select(key).join(lists, key, "left").select(key, found.alias("labels"), (F.size(found) == wanted).alias("complete"))

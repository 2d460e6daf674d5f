"""Column functions over queries, codes and model replies. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that whitespace splitting and trimming treat as space.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

SPACES = "".join(filter(str.isspace, map(chr, range(0x3001))))

# The text formats that downstream encoders were trained with.
INSTRUCTION_HEAD = "Instruct: Given a medical query in the field of "
INSTRUCTION_MIDDLE = ", retrieve the relevant ICD description\nQuery: "
QUERY_PREFIX = "query: "

# Labels accepted from a model.
RELEVANCE_LABELS = ("relevant", "non-relevant", "CANNOT_DECIDE")
CLASSIFICATIONS = ("diagnostic", "procedural", "exclude")
PROCEDURAL_TERMS = ("therapy", "surgery", "MRI", "replacement", "treatment", "rehab")


def strip_space(text: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null and empty text count 0.

    A plain letter is told from a space by one range check; the full list of spaces is
    only looked through for other characters.
    """
    word = f"[^[^!-~]&&[{SPACE_CHARS}]]+"
    return F.coalesce(F.regexp_count(text, F.lit(word)), F.lit(0))


def triplet_word_length(*texts: Column) -> Column:
    """Words in all texts of a triplet together."""
    total = word_count(texts[0])
    for text in texts[1:]:
        total = total + word_count(text)
    return total


def triplet_length(*texts: Column) -> Column:
    """Longest text of a triplet in words; a null text counts 0 and never fails."""
    return F.greatest(*[word_count(text) for text in texts])


def code_family(code: Column) -> Column:
    """Family of a code: ``F32.44`` and ``F32`` both belong to ``F32``."""
    head = r"^([A-Z]\p{Nd}+)"
    return (
        F.when(F.contains(code, F.lit(".")), F.substring_index(code, ".", 1))
        .when(code.rlike(head), F.regexp_extract(code, head, 1))
        .otherwise(code)
    )


def keyed_specialty(classification: Column, specialisation: Column) -> Column:
    """``class_spec`` in lower case without slashes."""
    key = F.concat(
        F.lower(F.coalesce(classification, F.lit(""))),
        F.lit("_"),
        F.lower(F.coalesce(specialisation, F.lit(""))),
    )
    return F.replace(key, F.lit("/"), F.lit(""))


def file_safe(name: Column) -> Column:
    """A specialty name that can be used as a file name."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def parse_code_list(reply: Column) -> Column:
    """Comma list of codes to an array, order and repeats kept; ``[]`` is empty.

    Brackets around a list are not removed, so ``[A00`` later fails validation.
    A null reply has no codes.
    """
    none = F.array().cast("array<string>")
    return F.when(reply.isNull() | (strip_space(reply) == "[]"), none).otherwise(
        F.transform(F.split(reply, ",", -1), strip_space)
    )


def instruction_anchor(specialty: Column, query: Column) -> Column:
    """Instruction-style anchor text for encoders that expect a task description."""
    return F.concat(
        F.lit(INSTRUCTION_HEAD),
        F.coalesce(specialty, F.lit("")),
        F.lit(INSTRUCTION_MIDDLE),
        F.coalesce(query, F.lit("")),
    )


def query_prefix(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), text)


def parse_relevance_label(reply: Column) -> Column:
    """The label of a relevance reply, null when it is none of the three."""
    label = strip_space(reply)
    return F.when(label.isin(*RELEVANCE_LABELS), label)


def parse_classification(reply: Column) -> Column:
    """``classification`` and ``reason`` lines of a reply; an unknown class is ``exclude``."""
    label = F.regexp_extract(reply, r"(?m)classification:[ \t]*(\S+)", 1)
    reason = F.regexp_extract(reply, r"(?m)reason:[ \t]*([^\r\n]*)", 1)
    return F.struct(
        F.when(label.isin(*CLASSIFICATIONS), label).otherwise("exclude").alias("classification"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def parse_query_list(reply: Column) -> Column:
    """Items of a list literal of quoted strings, in order."""
    # Possessive loops keep the matcher from descending once per character of a long item.
    quoted = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
    items = F.regexp_extract_all(reply, F.lit(quoted), F.lit(0))
    return F.transform(
        items,
        lambda item: F.regexp_replace(F.substring(item, F.lit(2), F.length(item) - 2), r"\\(.)", "$1"),
    )


def has_procedural_term(query: Column, terms: Sequence[str] = PROCEDURAL_TERMS) -> Column:
    """Whether a query names a procedure, matched as whole words without regard to case."""
    letter = r"[\p{L}\p{N}_]"
    return query.rlike(f"(?i)(?<!{letter})({'|'.join(terms)})(?!{letter})")


def next_status(succeeded: Column, attempts: Column, max_attempts: int = 3) -> Column:
    """State of a work item after a try: done, given up, or back in line."""
    return (
        F.when(succeeded, "completed").when(attempts >= max_attempts, "failed").otherwise("pending")
    )


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Replace each ``{name}`` of a template by a column, in one pass over the template.

    Text that comes out of a column is never searched for further placeholders.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in values]
        hits = [hit for hit in hits if hit[0] >= 0]
        if not hits:
            pieces.append(F.lit(rest))
            break
        position, name = min(hits)
        if position:
            pieces.append(F.lit(rest[:position]))
        pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[position + len(name) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")


def keyword_codes(query: Column, keywords: Mapping[str, Sequence[str]], default: Column) -> Column:
    """Sorted codes of all keywords that a query contains, else the default code."""
    lowered = F.lower(query)
    none = F.array().cast("array<string>")
    found = [
        F.when(F.contains(lowered, F.lit(word)), F.array(*[F.lit(code) for code in codes])).otherwise(none)
        for word, codes in keywords.items()
    ]
    codes = F.array_sort(F.array_distinct(F.flatten(F.array(*found)))) if found else none
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(default))


# The demonstration table of keywords and the codes per specialty without a hit.
KEYWORD_CODES = {
    "heart": ["I25", "I21"],
    "chest pain": ["R07.9", "I20"],
    "cardiac": ["I50", "I46"],
    "coronary": ["I25.1"],
    "acne": ["L70"],
    "eczema": ["L20"],
    "rash": ["L30.9"],
    "psoriasis": ["L40"],
    "mole": ["D22", "C43"],
    "skin cancer": ["C44"],
    "rosacea": ["L71"],
}


def default_code(specialty: Column) -> Column:
    """Code of a query without keyword, by specialty."""
    name = F.lower(specialty)
    return (
        F.when(F.contains(name, F.lit("cardio")), "I99")
        .when(F.contains(name, F.lit("derma")), "L99")
        .otherwise("R69")
    )


def closest_label(predicted: Column, labels: Sequence[str]) -> Column:
    """The label nearest to a predicted one; null when there are no labels.

    The first label that contains the prediction or is contained in it wins.
    Otherwise the highest share of common words wins, the first on ties, and the
    first label when no word is shared.
    """
    if not labels:
        return F.lit(None).cast("string")
    table = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(label.lower()).alias("lowered"),
                F.array(*[F.lit(w) for w in sorted(set(label.lower().split()))]).cast("array<string>").alias("words"),
            )
            for label in labels
        ]
    )
    lowered = F.lower(predicted)
    words = F.array_distinct(
        F.filter(F.split(lowered, f"[{SPACE_CHARS}]+", -1), lambda word: word != "")
    )
    inside = F.filter(
        table, lambda row: F.contains(row["lowered"], lowered) | F.contains(lowered, row["lowered"])
    )

    def score(row: Column) -> Column:
        common = F.size(F.array_intersect(words, row["words"])).cast("double")
        return common / F.greatest(F.size(words), F.size(row["words"]), F.lit(1))

    best = F.aggregate(
        table,
        F.struct(F.lit(0.0).alias("score"), F.lit(labels[0]).alias("label")),
        lambda state, row: F.when(
            score(row) > state["score"], F.struct(score(row).alias("score"), row["label"].alias("label"))
        ).otherwise(state),
    )
    return F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["label"]).otherwise(best["label"])


def validate_label(predicted: Column, labels: Sequence[str], fallback: str = "general_practice") -> Column:
    """Keep a listed label, move others to the closest; a failed call gets the first label."""
    if not labels:
        return F.lit(fallback)
    return (
        F.when(predicted.isNull(), F.lit(labels[0]))
        .when(predicted.isin(*labels), predicted)
        .otherwise(closest_label(predicted, labels))
    )


def parse_top_labels(reply: Column, labels: Sequence[str], wanted: int = 3) -> Column:
    """Known labels of a comma list in order, with a flag for the wrong number of them."""
    known = F.filter(
        F.transform(F.split(F.coalesce(reply, F.lit("")), ",", -1), strip_space),
        lambda item: item.isin(*labels),
    )
    return F.struct(known.alias("labels"), (F.size(known) == wanted).alias("complete"))

"""A Merkle manifest of a data set: a digest of every row, of every source and of everything, and a proof for every row.

Rows of a source are numbered in order, and the number is read as digits of base three. A block holds all numbers that agree but for
their last ``DIGITS`` digits. Inside a block the digits are grouped away one after the other, the last one first: each round turns up to
three nodes into their parent, a struct that holds its children, so a block ends as one row with a whole subtree in it. All rounds
of a block need the one shuffle that brought it together. The roots of blocks are rows of a smaller table, numbered by block, and are
rolled up in the same way until every source has one node; the sources' nodes, numbered by source, likewise.

Proofs go down again: the subtree in a row is unfolded by nested transforms, each level adding its siblings, and exploded. What a
block's root has above it arrives by a union and a grouping on the block, two rows for each, so neither joins nor broadcasts are made.

Everything is made of DataFrame functions but for the numbering, which is ``row_numbers`` (one range shuffle, no window over a source).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescout.llm.common import ready
from codescout.operators.running import row_numbers
from codescout.session import materialise

#: Children of a node, and digits inside a block: 729 leaves at most.
FAN, DIGITS = 3, 6


def digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its bytes in UTF-8 with their number and a colon before; lower-case hex."""
    texts = [v.cast("string") for v in values]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*marked), 256)


def _parent(index: Column, kids: Column) -> Column:
    """The digest of a node. A first node with one child is no parent: numbers have no gaps, so that child is alone on its level."""
    hashes = F.transform(kids, lambda k: k["hash"])
    return F.when((index == 0) & (F.size(kids) == 1), hashes[0]).otherwise(F.sha2(F.array_join(hashes, ""), 256))


def _rolled(nodes: DataFrame, group: str, payload: Sequence[str], digits: int) -> DataFrame:
    """(``group``, ``_number``, ``hash``, ``kids``) of every block of the nodes (``group``, ``_number``, ``hash``, payload)."""
    places = [F.expr(f"(_number div {FAN**i}) % {FAN}").cast("int").alias(f"_d{i}") for i in range(digits)]
    state = nodes.select(
        F.col(group).alias("_group"), F.expr(f"_number div {FAN**digits}").alias("_block"), *places, "hash", F.struct(*payload).alias("kids")
    ).repartition("_group", "_block")
    for i in range(digits):
        above = [f"_d{j}" for j in range(i + 1, digits)]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"_d{i}").alias("place"), "hash", "kids")))
        state = state.groupBy("_group", "_block", *above).agg(kids.alias("kids"))
        # The number of the node on its level: nought if all digits above are.
        index = F.col("_block")
        for name in above:
            index = index + F.col(name)
        state = state.withColumn("hash", _parent(index, F.col("kids")))
    return state.select(F.col("_group").alias(group), F.col("_block").alias("_number"), "hash", "kids")


def _steps(kids: Column, i: Column, single: Column) -> Column:
    """The siblings left and right of child ``i``; nothing where the child is alone on its level."""
    hashes = F.transform(kids, lambda k: k["hash"])
    left = F.array_join(F.slice(hashes, F.lit(1), i), "")
    right = F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "")
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.when(single, F.slice(step, 1, 0)).otherwise(step)


def _unfolded(kids: Column, index: Column, digits: int, path: Column) -> Column:
    """All nodes at the bottom of the subtree of node ``index``: number, digest, payload, and the steps from each up to the root of
    the subtree, lowest first, before ``path``."""

    def below(kid: Column, i: Column) -> Column:
        own = index * F.lit(FAN) + kid["place"]
        whole = F.concat(_steps(kids, i, (index == 0) & (F.size(kids) == 1)), path)
        if digits > 1:
            return _unfolded(kid["kids"], own, digits - 1, whole)
        return F.array(F.struct(own.alias("number"), kid["hash"].alias("hash"), kid["kids"].alias("payload"), whole.alias("steps")))

    return F.flatten(F.transform(kids, below))


def _tower(nodes: DataFrame, group: str, payload: Sequence[str], digits: int) -> list[DataFrame]:
    """Tables of blocks, level by level, up to one block per group. The first one carries the payload, the others none."""
    levels = [materialise(_rolled(nodes, group, payload, digits))]
    while (levels[-1].agg(F.max("_number")).first()[0] or 0) > 0:
        levels.append(materialise(_rolled(levels[-1].withColumn("_none", F.lit(0)), group, ["_none"], digits)))
    return levels


def _descend(levels: list[DataFrame], above: DataFrame, group: str, carried: Sequence[str], digits: int) -> DataFrame:
    """(``group``, ``_number``, ``hash``, ``payload``, ``steps``, carried) of every node below a tower.

    ``above`` has (``group``, ``_number``, ``steps``, carried) for the block on top of each group.
    """
    kept = [group, "_number", "steps", *carried]
    for level in reversed(levels):
        trees = level.select(group, "_number", F.struct("kids").alias("_tree"))
        nothing = [F.lit(None).cast(above.schema[c].dataType).alias(c) for c in kept[2:]]
        both = trees.select(group, "_number", *nothing, "_tree").unionByName(
            above.select(*kept, F.lit(None).cast(trees.schema["_tree"].dataType).alias("_tree"))
        )
        met = both.groupBy(group, "_number").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*kept[2:], "_tree")])
        nodes = F.explode(_unfolded(F.col("_tree")["kids"], F.col("_number"), digits, F.col("steps"))).alias("_node")
        above = met.select(group, *carried, nodes).select(
            group, F.col("_node")["number"].alias("_number"), *[F.col("_node")[c].alias(c) for c in ("hash", "payload", "steps")], *carried
        )
    return above


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    found: Mapping[str, Column] | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    A leaf is the digest of ``columns``. The leaves of a source, in order of ``key``, are the lowest level of its tree; while a level has
    several nodes, three neighbours each become one of the next (fewer at its end). What remains is ``subroot``. The subroots in order of
    ``source`` have ``root`` above them, made likewise. ``proof_sha256`` is the digest of all siblings on the way up, and ``folded_root``
    what the row as found and its siblings lead to: ``found`` has columns as they are found now, by name, where these differ from
    ``docs``. A row is ``verified`` if that is ``root``.

    Null keys come first in a source, and null is a source of its own, the first one. Rows with the same key are in order of their leaves;
    equal rows are one leaf each. Null and empty text differ. Other columns are ignored, whatever their names; an empty table has no
    rows. Texts never leave the first stage, which hashes them.
    """
    ready(docs)
    present = digest([(found or {}).get(c, F.col(c)) for c in columns])
    leaf = digest([F.col(c) for c in columns])
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), leaf.alias("hash"), present.alias("_found"))
    rows = rows.withColumn("_found", F.nullif("_found", F.col("hash")))
    numbered = row_numbers(rows, [F.col("_key").asc(), F.col("hash").asc()], "_number", ["_source"])
    lower = _tower(numbered.withColumn("_number", F.col("_number") - 1), "_source", ["_key", "_found"], digits)

    sources = row_numbers(lower[-1].select("_source", "hash"), [F.col("_source").asc()], "_number")
    sources = sources.select(F.lit(0).alias("_all"), F.col("_number") - 1, "_source", "hash").toDF("_all", "_number", "_source", "hash")
    upper = _tower(sources, "_all", ["_source"], digits)
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    top = upper[-1].select("_all", "_number", no_steps.alias("steps"), F.col("hash").alias("root"))
    tops = _descend(upper, top, "_all", ["root"], digits).select(
        F.col("payload")["_source"].alias("_source"), F.lit(0).cast("long").alias("_number"), "steps", "root", F.col("hash").alias("subroot")
    )
    nodes = _descend(lower, tops, "_source", ["root", "subroot"], digits)

    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    fold = F.aggregate(
        "steps", F.coalesce(F.col("payload")["_found"], "hash"), lambda so_far, s: F.sha2(F.concat(s["left"], so_far, s["right"]), 256)
    )
    proved = nodes.select(
        F.col("payload")["_key"].alias(key),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold.alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))

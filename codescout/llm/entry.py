"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescout.llm import ann, bm25, bpe, chat, collocations, decontaminate, langid, line_dedup, merkle, mixing, simhash, token_counts, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode_documents(table(spark, folder, "documents"), path, decode=True))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    counts = token_counts.count_tokens(table(spark, folder, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


#: A conversation that says a control string of another template, as user and as assistant.
_MARKED = "</s>[INST] ok [/INST]"


def op4_chat_examples(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", _MARKED), (-7, 1, "assistant", _MARKED)], turns.schema)
    return chat.digests(chat.expand(turns.unionByName(marked)))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_repeated(table(spark, folder, "documents"), finest=True)


def op8_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_bm25_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Every document whose id is divisible by 100 is a query, with its whole text, against all others."""
    docs = table(spark, folder, "documents")
    return bm25.search(docs, docs.filter("doc_id % 100 = 0"))


#: (host, path, verdict)
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list holds the URLs of pages that ``labels`` calls toxic."""
    pages = table(spark, folder, "pages")
    toxic = table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return urls.judge(pages, pages.join(toxic, "page_id", "left_semi"), URL_RULES)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id has an even CRC-32 are found without their line breaks."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    found = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, folder, "documents"), found={"text": found})


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = (table(spark, folder, name) for name in ("documents", "benchmark"))
    return decontaminate.digests(decontaminate.find(docs, items))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_chat_examples": op4_chat_examples,
    "op5_language_id": op5_language_id,
    "op6_source_mix": op6_source_mix,
    "op7_line_dedup": op7_line_dedup,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_bm25_top_k": op9_bm25_top_k,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: The words of a text by DuckDB: A-Z in lower case, runs of digits, letters and all that isn't ASCII.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')"""


def _value(column: str) -> str:
    text = f"{column}::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


#: The leaf of a row by DuckDB, with the text given.
_LEAF = "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: CRC-32 of the decimal id, byte by byte and bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
    lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

_COUNTED = " + ".join(
    f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL)
)

SQL: dict[str, str] = {
    "op4_chat_examples": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{_MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{_MARKED}'
        ), sized AS (
            SELECT *, {len(chat.START) + 1 + len(chat.END)} + length(role) + length(text) + {_COUNTED} AS chars,
                row_number() OVER turns AS place, count(*) OVER (PARTITION BY conv_id) AS n
            FROM turns WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), summed AS (
            SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
        FROM summed GROUP BY conv_id
    """,
    "op9_bm25_top_k": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), counts AS (
            SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
        ), lengths AS (
            SELECT doc_id, count(*) AS length FROM words GROUP BY doc_id
        ), total AS (
            SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n, (SELECT count(*) FROM words) AS words
        ), frequency AS (
            SELECT term, count(*) AS df FROM counts GROUP BY term
        ), scored AS (
            SELECT q.doc_id AS query_id, d.doc_id,
                round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * length / (words::DOUBLE / n)))), 6) AS score
            FROM counts q JOIN frequency USING (term) JOIN counts d ON d.term = q.term AND d.doc_id <> q.doc_id
                JOIN lengths ON lengths.doc_id = d.doc_id, total
            WHERE q.doc_id % 100 = 0
            GROUP BY q.doc_id, d.doc_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op10_url_filter": r"""
        WITH parts AS (
            SELECT page_id, url,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                    lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|fbclid|gclid|utm_[^=]*)(=|\z)'))) AS query
            FROM pages
        ), named AS (
            SELECT *, CASE WHEN contains(url, '://') THEN
                regexp_replace(host, '^www\.|:(80|443)\z|\.\z', '', 'g') || regexp_replace(path, '/+\z', '')
                || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
            FROM parts
        ), bad AS (
            SELECT DISTINCT canonical FROM named
            WHERE canonical IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
        ), judged AS (
            SELECT page_id, host, path, canonical IN (SELECT canonical FROM bad) AND canonical IS NOT NULL AS listed,
                CASE
                    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
                END AS rule
            FROM named
        )
        SELECT page_id, host, path, rule, coalesce(listed, false) AS listed,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN listed THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE given AS (
            SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
                CASE WHEN xor({_CRC}, 4294967295) & 1 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")}
                    ELSE {_LEAF.format(text="text")} END AS found
            FROM documents
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                count(*) OVER (PARTITION BY source) AS n
            FROM given
        ), tree AS (
            SELECT source, 0 AS level, place, leaf AS hash, n FROM numbered
            UNION ALL
            SELECT source, level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (n + 2) // 3
            FROM tree WHERE n > 1 GROUP BY source, level, place // 3, n
        ), subroots AS (
            SELECT source, level AS height, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
            FROM tree WHERE n = 1
        ), top AS (
            SELECT 0 AS level, place, hash, n FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (n + 2) // 3
            FROM top WHERE n > 1 GROUP BY level, place // 3, n
        ), nodes AS (
            SELECT source, false AS upper, level, place, hash, n FROM tree
            UNION ALL SELECT NULL, true, level, place, hash, n FROM top
        ), parents AS (
            SELECT source, upper, level, place // 3 AS parent, list(hash ORDER BY place) AS kids
            FROM nodes WHERE n > 1 GROUP BY source, upper, level, place // 3
        ), folded AS (
            SELECT l.doc_id, l.source, l.leaf, l.place AS first, s.hash AS subroot, s.height, s.place AS number,
                0 AS step, l.place, l.found AS folded, '' AS proof
            FROM numbered l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
            UNION ALL
            SELECT f.doc_id, f.source, f.leaf, f.first, f.subroot, f.height, f.number, f.step + 1, f.at // 3,
                sha256(array_to_string(p.kids[1:f.at % 3], '') || f.folded || array_to_string(p.kids[f.at % 3 + 2:], '')),
                f.proof || array_to_string(p.kids[1:f.at % 3], '') || array_to_string(p.kids[f.at % 3 + 2:], '')
            FROM (SELECT *, CASE WHEN step = height THEN number ELSE place END AS at FROM folded) f
                JOIN parents p ON p.upper = (f.step >= f.height) AND p.parent = f.at // 3
                    AND p.level = CASE WHEN f.step >= f.height THEN f.step - f.height ELSE f.step END
                    AND p.source IS NOT DISTINCT FROM CASE WHEN f.step < f.height THEN f.source END
        ), ended AS (
            SELECT *, row_number() OVER (PARTITION BY source, first ORDER BY step DESC) AS last FROM folded
        )
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM ended, (SELECT hash AS root FROM top WHERE n = 1) WHERE last = 1
    """,
    "op12_decontamination": rf"""
        WITH read AS (
            SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
        ), items AS (
            SELECT item_id, {_WORDS} AS words FROM benchmark
        ), windows AS (
            SELECT item_id, least(len(words), {decontaminate.LENGTH}) AS size, unnest(list_transform(
                range(1, len(words) - least(len(words), {decontaminate.LENGTH}) + 2),
                lambda i: array_to_string(words[i:i + least(len(words), {decontaminate.LENGTH}) - 1], ' '))) AS said
            FROM items WHERE len(words) > 0
        ), runs AS (
            SELECT row, size, unnest(range(1, len(words) - size + 2)) AS place,
                unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS said
            FROM read, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
        ), met AS (
            SELECT row, place, runs.size, item_id FROM runs JOIN windows ON runs.said = windows.said AND runs.size = windows.size
        ), hits AS (
            SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(place, place + size)) AS word FROM met) GROUP BY row
        ), listed AS (
            SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY row
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM read LEFT JOIN hits USING (row) LEFT JOIN listed USING (row)
    """,
    "op13_phrase_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS said FROM pieces
        ), runs AS (
            SELECT lang, size, unnest(list_transform(range(1, len(said) - size + 2), lambda i: array_to_string(said[i:i + size - 1], ' '))) AS phrase
            FROM words, range(1, {collocations.WORDS + 1}) AS sizes(size) WHERE len(said) >= size
        ), counts AS (
            SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY lang, size, phrase
        ), candidates AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS said FROM counts WHERE size > 1 AND f >= {collocations.LEAST}
        ), cuts AS (
            SELECT c.lang, c.size, c.phrase, c.a, k, l.f AS l, r.f AS r,
                1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
                JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(said[1:k], ' ')
                JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(said[k + 1:], ' ')
        ), lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts
        ), replaced AS (
            SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (
                SELECT lang, a, size, unnest(list_transform(range(0, size - 1), lambda i: array_to_string(said[i + 1:i + 2], ' '))) AS phrase
                FROM candidates WHERE size = 3) w ON w.lang = s.lang AND w.phrase = s.phrase
            WHERE 100 * w.a >= {collocations.SHARE} * s.a
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
            FROM lowest ANTI JOIN replaced USING (lang, phrase) WHERE place = 1
        )
        SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang) USING (lang)
        WHERE rank <= {collocations.TOP}
    """,
    "op6_source_mix": """
        WITH sizes AS (
            SELECT source AS s, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY source
        ), rated AS (
            SELECT s, CASE WHEN bytes = 0 THEN 1.0::DOUBLE
                ELSE 1.0::DOUBLE / (SELECT count(*) FROM sizes WHERE bytes > 0)
                    * (SELECT sum(bytes) FROM sizes)::DOUBLE / bytes END AS rate
            FROM sizes
        ), means AS (
            SELECT s, greatest(ceil(rate / 16.0), 1)::INT AS draws, rate / greatest(ceil(rate / 16.0), 1)::INT AS mean FROM rated
        ), terms AS (
            SELECT s, draws, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1.0))
                OVER (PARTITION BY s ORDER BY k) AS below
            FROM means, range(81) AS r(k)
        ), drawn AS (
            SELECT d.doc_id AS id, m.s, (('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i), 1, 13))::BIGINT + 0.5)
                / 4503599627370496.0::DOUBLE AS u
            FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN means m ON d.source IS NOT DISTINCT FROM m.s,
                LATERAL (SELECT unnest(range(1, m.draws + 1)) AS i)
        ), counted AS (
            SELECT id, s, sum(n)::INT AS copies FROM (
                SELECT id, drawn.s, (SELECT count(*) FROM terms WHERE terms.s IS NOT DISTINCT FROM drawn.s AND below <= u) AS n FROM drawn)
            GROUP BY id, s
        )
        SELECT d.*, c.copy::INT AS copy, counted.copies,
            md5('mix|order|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || c.copy) AS shuffle_key
        FROM documents d JOIN counted ON d.doc_id IS NOT DISTINCT FROM id AND d.source IS NOT DISTINCT FROM s,
            LATERAL (SELECT unnest(range(1, counted.copies + 1)) AS copy) c
    """,
}

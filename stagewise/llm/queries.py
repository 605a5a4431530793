"""The queries of the operators with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagewise.session import configure, ship_packages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_packages(configure(spark), "stagewise")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to shards and read back."""
    import public_tokenizers

    from stagewise.llm.token_files import token_ids

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_ids(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("shard", "place")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    from stagewise.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    from stagewise.llm.mixing import mix

    decided = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return decided.select("row.doc_id", "size", "source_size", "target", "taken", "copies")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    from stagewise.llm.decontaminate import leaks_in

    return leaks_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = """
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
    SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM w WHERE len(words) >= 20
), k AS (
    SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS key FROM s
), r AS (
    SELECT doc_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM r
), lost AS (
    SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words ELSE
           list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


@query("op8_repeated_words", OP8_SQL)
def op8_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated windows of words."""
    from stagewise.llm.repeated_words import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w
), s AS (
    SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM g
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM p WHERE 100 * common >= 75 * (na + nb - common)
), reach AS (
    SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
    SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT g.doc_id, len(shingles) AS n_shingles, least(g.doc_id, coalesce(other, g.doc_id)) AS component_id,
       g.doc_id = least(g.doc_id, coalesce(other, g.doc_id)) AS kept
FROM g LEFT JOIN least USING (doc_id)
"""


@query("op9_near_documents", OP9_SQL)
def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    from stagewise.llm.near_text import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_repeated_bytes")
def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of bytes."""
    from stagewise.llm.repeated_bytes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    from stagewise.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    from stagewise.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP3_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
    SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
    SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
    SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id
), n AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query("op3_near_vectors", OP3_SQL)
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near copies among all vectors."""
    from stagewise.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = 2) -> str:
    """Codebooks of the first vectors, then assignments and means in turn."""
    near = """
, a{r} AS MATERIALIZED (
    SELECT vec_id, label, p, x, min(64 * d + k) // 64 AS d, min(64 * d + k) % 64 AS k FROM (
        SELECT vec_id, label, p, x, k, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
        FROM parts JOIN c{r} USING (p)) GROUP BY ALL
)"""
    mean = """
, c{n} AS MATERIALIZED (
    SELECT p, k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
        SELECT p, k, list(v ORDER BY i) AS m FROM (
            SELECT p, k, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS i FROM a{r})
            GROUP BY p, k, i) GROUP BY p, k) USING (p, k)
)"""
    return (
        """
WITH v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, e[p * (len(e) // 16) + 1:(p + 1) * (len(e) // 16)] AS x FROM v, range(16) AS t(p)
), c0 AS MATERIALIZED (
    SELECT p, k, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < 64
)"""
        + "".join(near.format(r=r) + mean.format(r=r, n=r + 1) for r in range(rounds))
        + near.format(r=rounds)
        + f"""
, book AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}
), coded AS MATERIALIZED (
    SELECT vec_id, label, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""
    )


@query("op12_vector_codes", _op12_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks fitted to all vectors."""
    from stagewise.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), total AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), f AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS f FROM (
        SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
        FROM w, range(1, 6) AS t(m) WHERE len(ws) >= m)
    GROUP BY ALL
), cand AS MATERIALIZED (
    SELECT lang, m, phrase, f AS a FROM f WHERE m > 1 AND f >= 100
), cut AS (
    SELECT lang, m, phrase, a, k, string_split(phrase, ' ') AS ws FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:c.m], ' ') JOIN total ON total.lang = c.lang
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT * FROM weakest s WHERE NOT EXISTS (
        SELECT 1 FROM cand c WHERE c.lang = s.lang AND 100 * c.a >= 100 * s.a AND len(c.phrase) > len(s.phrase)
            AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of all documents, by language."""
    from stagewise.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


#: The given pages all keep their article in one ``article`` of headings and paragraphs, so that SQL can cut it out by patterns.
OP13_SQL = """
WITH a AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), b AS (
    SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS raw
    FROM a
), c AS (
    SELECT page_id, url, list_transform(raw, lambda x: trim(regexp_replace(
        regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
            '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g'), '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{85}]+', ' ', 'g'))) AS blocks FROM b
), d AS (
    SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM c
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""


@query("op13_page_text", OP13_SQL)
def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from stagewise.llm.page_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))

"""The registered queries of the text operators, with SQL where SQL expresses the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphbatch.llm.common import read_table, scratch_path

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.quality_rules import quality_verdicts

    return quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.toxicity import toxicity_scores

    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.ngram_join import similar_components

    return similar_components(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.pii import pseudonymise

    # A key for tests only; whoever publishes pseudonyms passes a secret one.
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key="key of the registered query", count_col="n_replaced")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.decontamination import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.substring_dedup import repeated_passages

    return repeated_passages(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.bpe import encode_texts

    return encode_texts(read_table(spark, sf_dir, "documents"), digests_only=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.warc import read_archives, record_roles, write_archives

    manifest = write_archives(record_roles(read_table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.url_filters import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.token_output import read_token_files, write_token_files

    manifest = write_token_files(read_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    return read_token_files(manifest, with_ids=False)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.language_id import predicted_languages

    return predicted_languages(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"), ["vec_id"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphbatch.llm.merkle import document_manifest

    return document_manifest(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_toxicity, op3_ngram_join, op4_pii, op5_decontamination, op6_substring_dedup, op7_bpe, op8_warc, op9_url_filters, op10_token_output, op11_language_id, op12_whitening, op13_merkle_manifest)
    return {f.__name__: f for f in (*ops, pipeline)}


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
     f AS (SELECT x, min(page_id) AS m FROM p GROUP BY x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(p.x, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p JOIN f ON p.x = f.x
"""

OP9_SQL = r"""
WITH r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     m AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
           FROM b JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT b.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b LEFT JOIN m ON b.page_id = m.page_id AND k = 1
"""


OP3_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
g AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id WHERE r.root < g.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""


def _op13_sql(depth: int = 8, top_depth: int = 4) -> str:
    """Runs of eight by window and grouping, level by level: up to 8^8 documents a lang and 8^4 langs. A group that is down to one node keeps it."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(d::VARCHAR) + 1), lambda i: unicode(substr(d::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    out = [
        f"h AS MATERIALIZED (SELECT doc_id AS d, lang, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents)",
        "g AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents))",
        f"r AS MATERIALIZED (SELECT d, leaf, g, row_number() OVER (PARTITION BY g ORDER BY d NULLS FIRST, leaf) - 1 AS i, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN low ELSE leaf END AS f0 FROM h JOIN g ON h.lang IS NOT DISTINCT FROM g.lang)",
        "n0 AS MATERIALIZED (SELECT g, i, leaf AS x FROM r)",
    ]

    def level(k: int, name: str) -> None:
        # e: each node with the digests beside it and whether its group goes on; n: the next level's nodes.
        out.append(f"e{k} AS MATERIALIZED (SELECT g, i, x, count(*) OVER (PARTITION BY g) > 1 AS more, coalesce(string_agg(x, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(x, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM n{k})")
        out.append(f"{name} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN any_value(more) THEN sha256(string_agg(x, '' ORDER BY i)) ELSE any_value(x) END AS x FROM e{k} GROUP BY g, i // 8)")

    for k in range(depth):
        level(k, f"n{k + 1}")
    out.append(f"n{depth + 1} AS MATERIALIZED (SELECT 0 AS g, g AS i, x FROM n{depth})")
    for k in range(depth + 1, depth + 1 + top_depth):
        level(k, f"n{k + 1}")
    out.append("p0 AS MATERIALIZED (SELECT d, leaf, g AS own, g, i, '' AS p, f0 AS f FROM r)")
    step, last = 0, depth + 1 + top_depth
    for k in range(last):
        if k == depth:
            continue
        up = "0 AS g, p.g AS i" if k == depth - 1 else "p.g, p.i // 8 AS i"
        out.append(f"p{step + 1} AS MATERIALIZED (SELECT d, leaf, own, {up}, p || a || b AS p, CASE WHEN more THEN sha256(a || f || b) ELSE f END AS f FROM p{step} p JOIN e{k} e ON e.g = p.g AND e.i = p.i)")
        step += 1
    return f"WITH {', '.join(out)} SELECT d AS doc_id, leaf, s.x AS subroot, t.x AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.x AS verified FROM p{step} p JOIN n{depth} s ON s.g = p.own, n{last} t"


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op8_warc": OP8_SQL, "op9_url_filters": OP9_SQL, "op13_merkle_manifest": _op13_sql()}

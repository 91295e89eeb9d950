"""The queries of the text operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_part=2, parts=4)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"), block=18)


OP2_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
pos AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS win FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
rep AS (SELECT win FROM pos GROUP BY win HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, i + k AS p FROM pos JOIN rep USING (win), range(35) AS t(k)),
tok AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM tok ANTI JOIN covered USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_part=1, parts=3)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_assignment

    return shard_assignment(table(spark, sf_dir, "documents"), shards=16)


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE common >= 0.8 * (nx.k + ny.k - common) - 1e-9),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x),
d AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT c.x AS doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links FROM c LEFT JOIN d USING (x)
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op8_sql() -> str:
    from .licenses import BASE, LICENSES, NOTICES, template_regex

    phrases = "\n".join(f"UNION ALL SELECT rid, i - 1 AS pos, '{label}' AS label FROM w, unnest(range(1, len(ws) - {len(p.split()) - 2})) AS u(i) WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in BASE)
    templates = "\n".join(f"UNION ALL SELECT rid, '{label}', {score} FROM w WHERE regexp_matches(line, ' {template_regex(t)}')" for score, kind in ((1.0, LICENSES), (0.95, NOTICES)) for label, t in kind)
    return f"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
w AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM words),
place(rid, pos, label) AS (SELECT 0::BIGINT, 0::BIGINT, '' WHERE false {phrases}),
accepted(rid, label, score) AS (SELECT 0::BIGINT, '', 0.0 WHERE false {templates}),
s AS (SELECT rid, max(score) AS score FROM accepted GROUP BY rid),
b AS (SELECT rid, count(*) AS n, min(pos) AS low, max(pos) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY rid),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM place UNION SELECT rid, label FROM accepted) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
coalesce(s.score, CASE WHEN n > 0 THEN 0.9 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN s USING (rid)
"""


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import token_digests, write_token_files

    return token_digests(write_token_files(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import code_digests

    return code_digests(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A chain of CTEs, two a round: every part meets all entries of its codebook, then the entries become floored means."""

    def floored(total: str, count: str) -> str:
        return f"(({total} - ((({total} % {count}) + {count}) % {count})) // {count})"

    steps = ""
    for k in range(rounds + 1):
        steps += f""",
near{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (SELECT v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN book{k} b USING (part, place) GROUP BY ALL) GROUP BY rid, part)"""
        if k < rounds:
            steps += f""",
mean{k} AS (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*)::BIGINT AS c FROM v JOIN near{k} USING (rid, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce({floored("s", "c")}, x) AS x FROM book{k} LEFT JOIN mean{k} USING (part, entry, place))"""
    return f"""
WITH ok AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT rid, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS place, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x FROM ok, unnest(range(1, len(embedding) + 1)) AS u(i)),
book0 AS (SELECT part, rid - 1 AS entry, place, x FROM v WHERE rid <= {entries}){steps},
code AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid),
by_label AS (SELECT label, sum(error)::BIGINT AS label_error FROM ok JOIN code USING (rid) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM ok JOIN code USING (rid) JOIN by_label ON by_label.label IS NOT DISTINCT FROM ok.label
"""


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP12_SQL = """
WITH ok AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT rid, i, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM ok, unnest(range(1, len(embedding) + 1)) AS u(i)),
s AS (SELECT q.rid AS qid, c.rid AS cid, sum(q.x * c.x)::BIGINT AS score FROM (SELECT v.* FROM v JOIN ok USING (rid) WHERE vec_id % 50 = 0) q JOIN v c ON q.i = c.i AND q.rid <> c.rid GROUP BY ALL),
r AS (SELECT qid, c.vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, c.vec_id NULLS LAST)::INTEGER AS rank FROM s JOIN ok c ON c.rid = cid)
SELECT ok.vec_id AS query_id, rank, r.vec_id, score FROM r JOIN ok ON ok.rid = qid WHERE rank <= 5
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whitening_digests

    return whitening_digests(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality, op2_passages, op3_bpe, op4_toxicity, op5_shards, op6_leaks, op7_near_duplicates, op8_licenses, op9_exact, op10_token_files, op11_vector_codes, op12_top_k, op13_whitening)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_passages": OP2_SQL, "op7_near_duplicates": OP7_SQL, "op8_licenses": op8_sql(), "op9_exact": OP9_SQL, "op11_vector_codes": op11_sql(), "op12_top_k": OP12_SQL}

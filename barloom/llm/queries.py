"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table


def op1_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated multi-line chunks taken out of all documents."""
    from barloom.llm.linechunks import drop_repeated_chunks

    docs = drop_repeated_chunks(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.col("_chunks").cast("long").alias("n_chunks"),
        F.size("_dropped").cast("long").alias("n_dropped"),
        F.concat_ws(",", F.col("_dropped").cast("array<string>")).alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: The chunking of :mod:`linechunks` for window 2 and divisor 3 in DuckDB, with pairs of lines counted by their texts.
OP1_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), hashed AS (
  SELECT doc_id, body, lines, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM lines
), spots AS (
  SELECT doc_id, unnest(range(1, len(lines))) AS spot, len(lines) AS n_lines,
    unnest(list_transform(range(1, len(lines)), lambda i: lines[i] || chr(10) || lines[i + 1])) AS pair,
    unnest(list_transform(range(1, len(lines)), lambda i: i > 1 AND ((h[i - 1] * 1000003) + h[i]) % 2147483647 % 3 = 0)) AS drawn
  FROM hashed
), counted AS (
  SELECT doc_id, spot, n_lines, drawn, count(*) OVER (PARTITION BY pair) AS n FROM spots
), beside AS (
  SELECT *, coalesce(lag(n, 2) OVER w, 1) AS n2, coalesce(lag(n) OVER w, 1) AS n1, coalesce(lead(n) OVER w, 1) AS n3
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY spot)
), edged AS (
  SELECT *, n <= n1 AND n <= n3 AND (n < n1 OR n < n3) AND NOT (n > 1 AND n = n1 AND n1 < n2) AS edge FROM beside
), clear AS (
  SELECT *, drawn AND spot < n_lines - 1 AND NOT edge AND NOT coalesce(lag(edge) OVER w, false) AND NOT coalesce(lead(edge) OVER w, false) AS free
  FROM edged WINDOW w AS (PARTITION BY doc_id ORDER BY spot)
), apart AS (
  SELECT doc_id, spot, edge OR (free AND NOT coalesce(lag(free) OVER (PARTITION BY doc_id ORDER BY spot), false)) AS cut FROM clear
), inner_ends AS (
  SELECT doc_id, list(spot ORDER BY spot) AS ends FROM apart WHERE cut GROUP BY doc_id
), marked AS (
  SELECT doc_id, body, lines, list_append(coalesce(ends, []), len(lines)) AS ends FROM hashed LEFT JOIN inner_ends USING (doc_id)
), pieces AS (
  SELECT doc_id, body, len(ends) AS n_chunks, unnest(range(0, len(ends))) AS place,
    unnest(list_transform(range(1, len(ends) + 1), lambda k: lines[(CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1 : ends[k]])) AS part
  FROM marked
), ranked AS (
  SELECT doc_id, body, n_chunks, place, array_to_string(part, chr(10)) AS chunk, len(part) > 1
      AND regexp_matches(array_to_string(part, chr(10)), '[^\x20\x09-\x0D]') AS eligible FROM pieces
), judged AS (
  SELECT *, eligible AND row_number() OVER (PARTITION BY eligible, chunk ORDER BY doc_id, place) > 1 AS gone FROM ranked
)
SELECT doc_id, any_value(n_chunks)::BIGINT AS n_chunks, count(*) FILTER (gone)::BIGINT AS n_dropped,
  coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (gone), '') AS dropped,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents at four differing bits."""
    from barloom.llm.simhash import simhash_groups

    groups = simhash_groups(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    from barloom.llm.packing import pack

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight contiguous shards of equal bytes."""
    from barloom.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, folder, "documents"))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents, by rules and by bootstrapped contexts."""
    from barloom.llm.pii import KINDS, find_personal_data, written

    found = find_personal_data(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)
    ]
    shown = F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    n_spans, n_base = F.size("spans").cast("long"), F.size("base").cast("long")
    return found.select("doc_id", *counts, *shown, n_spans.alias("n_spans"), (n_spans - n_base).alias("n_added"))


def op6_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and perplexity bands over all documents."""
    from barloom.llm.perplexity import judged

    return judged(table(spark, folder, "documents"))


def op7_projections(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all embeddings at a cosine of 0.95."""
    from barloom.llm.projections import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def op8_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without strings of 100 bytes that start earlier."""
    from barloom.llm.suffixes import repeated_spans

    return repeated_spans(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their calibrated sampling rate and how often they are drawn."""
    from barloom.llm.mixing import described, mixed_described
    from barloom.session import settle

    slim = described(table(spark, folder, "documents")).select("doc_id", "source", "lang", "topic", "tokens")
    # Texts are read once; the mix needs only what is derived from them.
    docs = mixed_described(settle(slim, "described"))
    weight = F.round("weight", 6).alias("weight")
    return docs.select("doc_id", "source", "lang", "topic", "tokens", weight, "copies", (F.col("copies") > 0).alias("kept"))


def _op9_sql() -> str:
    """Raking unrolled: one common table per margin and round."""
    from barloom.llm.mixing import ROUNDS, TOPIC_SHARES

    total = sum(TOPIC_SHARES.values())
    assert abs(total - 1) < 1e-9
    topics = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in TOPIC_SHARES.items())
    steps, last, k = [], "c0", 0
    for _ in range(ROUNDS):
        for m in ("source", "lang", "topic"):
            k += 1
            steps.append(
                f"c{k} AS MATERIALIZED (SELECT * REPLACE (w * s_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM {last})"
            )
            last = f"c{k}"
    return f"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
), named AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
    CASE WHEN contains(t, ' | ') THEN 'table'
      WHEN contains(t, '%%%') OR contains(t, '$$$') OR contains(t, '###') OR contains(t, '&&&') THEN 'symbols'
      WHEN contains(t, '@') THEN 'contact' WHEN contains(t, 'icens') THEN 'licence'
      WHEN NOT regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') THEN 'capitals' ELSE 'prose' END AS topic
  FROM d
), cells AS (
  SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM named GROUP BY ALL HAVING sum(tokens) > 0
), src AS (SELECT source, pow(sum(tokens)::DOUBLE, 0.5) AS s FROM cells GROUP BY source),
lng AS (SELECT lang, pow(sum(tokens)::DOUBLE, 0.5) AS s FROM cells GROUP BY lang),
tpc AS (SELECT topic, CASE topic {topics} END AS s FROM cells GROUP BY topic),
c0 AS MATERIALIZED (
  SELECT c.*, c.tokens::DOUBLE AS w, src.s / (SELECT sum(s) FROM src) AS s_source,
    lng.s / (SELECT sum(s) FROM lng) AS s_lang, tpc.s / (SELECT sum(s) FROM tpc) AS s_topic
  FROM cells c JOIN src ON src.source IS NOT DISTINCT FROM c.source
    JOIN lng ON lng.lang IS NOT DISTINCT FROM c.lang JOIN tpc ON tpc.topic = c.topic
), {", ".join(steps)}, rated AS (
  SELECT n.*, coalesce(c.w * (SELECT sum(tokens)::DOUBLE FROM cells) / c.tokens, 1) AS weight,
    ('0x' || substr(md5('9:' || n.doc_id), 1, 7))::BIGINT / 268435456.0 AS u, c.tokens IS NULL AS none
  FROM named n LEFT JOIN {last} c ON n.source IS NOT DISTINCT FROM c.source
    AND n.lang IS NOT DISTINCT FROM c.lang AND n.topic = c.topic
)
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, copies, copies > 0 AS kept
FROM (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM (SELECT *, CASE WHEN none THEN 1 ELSE weight * 0.7 END AS rate FROM rated))
"""


def op10_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations in reply order without quotes."""
    from barloom.llm.quotes import reply_order

    return reply_order(table(spark, folder, "conversations"))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings in forty clusters after five rounds over a pivot table."""
    from barloom.llm.centroids import cluster, described

    return described(*cluster(table(spark, folder, "embeddings")))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, unrolled by rounds; integers throughout."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (pos) GROUP BY 1, 2) GROUP BY 1)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.pos, coalesce(({floor})::BIGINT, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM v JOIN d{r} USING (vec_id) GROUP BY 1, 2) m USING (cluster, pos))"""
            )
    return f"""
WITH good AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(list_transform(e, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x FROM good
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS cluster FROM (SELECT vec_id, sha256('2:' || vec_id) AS h FROM good ORDER BY h LIMIT {k})
), c0 AS MATERIALIZED (SELECT cluster, pos, x FROM v JOIN seeds USING (vec_id)),
{", ".join(steps)},
names AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM d{rounds} JOIN names USING (cluster)
"""


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents, by rules and by a network over every candidate."""
    from barloom.llm.credentials import KINDS, find_secrets, written

    found = find_secrets(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])
    ]
    learned = (F.size("spans") - F.size("base")).cast("long").alias("n_learned")
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), learned
    )


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    """All documents rearranged for filling in the middle, and rebuilt."""
    from barloom.llm.infill import fill_in_middle, restored

    found = fill_in_middle(table(spark, folder, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


OP13_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    list_transform(range(0, 4), lambda i: ('0x' || substr(sha256('42:' || doc_id), i * 8 + 1, 8))::BIGINT) AS h
  FROM documents
), cut AS (
  SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a,
    greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, t, n::BIGINT AS n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""

_OPERATORS = (
    op1_line_chunks, op2_simhash, op3_packing, op4_sharding, op5_personal_data, op6_perplexity, op7_projections, op8_suffixes, op9_mixing,
    op10_quotes, op11_centroids, op12_secrets, op13_infill,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
SQL: dict[str, str] = {"op1_line_chunks": OP1_SQL, "op9_mixing": _op9_sql(), "op11_centroids": _op11_sql(), "op13_infill": OP13_SQL}

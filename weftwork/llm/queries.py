"""The registered queries opN_ and pipeline, and the SQL that DuckDB can check some of them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common, decontaminate, language, line_dedup, lm_score, mixing, mpeg_audio, near_dup, sharding, token_store, warc
from weftwork.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return token_store.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of their links."""
    groups = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, a row for each pair, with the best window."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's and the base scores of all documents."""
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, written and read back."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.col("__grown").alias("grown_shard"),
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where in training its first copy stands (null: nowhere), in ranges of position."""
    docs = table(spark, sf_dir, "documents")
    sizes = common.stage(docs.select("doc_id", "source", mixing.size_of("text").alias("size")), "sizes")
    out = mixing.assign(sizes, size=F.col("size"))
    first = F.round(F.array_min("__positions"), 9).alias("position")
    out = out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.size("__positions")).alias("taken"), first)
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, fitted on its labelled rows; sources are the hosts."""
    out = language.of_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", "grams", "accepted")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as MPEG audio, stored and read back."""
    return mpeg_audio.media_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in Zstandard archives, written and read back."""
    out = common.new_path(spark, "archives")
    return warc.read_archives(spark, out, warc.write_archives(table(spark, sf_dir, "pages"), out))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go from each document, and its lines' links to other line sets."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def lang_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 on the pages, with their markup's language, address and host; fitted on the documents."""
    model = language.fit(table(spark, sf_dir, "documents"))
    out = language.of_pages(table(spark, sf_dir, "pages"), model)
    return out.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", "grams", "accepted")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_simhash_groups, op3_decontaminate, op4_lm_score, op5_shards, op6_mix, op7_language, op8_mpeg_audio, op9_warc, op10_line_dedup, lang_pages)}


def _due_sql(schedule: tuple) -> str:
    """demand_inverse of one schedule, as SQL over q."""
    times, weights, sums = mixing._schedule_arrays(schedule)
    cases = [
        f"WHEN q < {end!r} THEN {t!r} + 2.0 * (q - {start!r}) / ({v!r} + sqrt(greatest(0.0, {v * v!r} + {2.0 * (w - v) / (u - t)!r} * (q - {start!r}))))"
        for t, u, v, w, start, end in zip(times, times[1:], weights, weights[1:], sums, sums[1:], strict=False)
    ]
    return f"CASE {' '.join(cases)} ELSE {times[-1]!r} END"


def _double(sql: str) -> str:
    """Numbers with a fraction as DOUBLE, which DuckDB would read as DECIMAL."""
    import re

    return re.sub(r"(?<![\w.'])(\d+\.\d+(?:e-?\d+)?)(?![\w.'])", r"CAST('\1' AS DOUBLE)", sql)


OP6_SQL = _double(f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('7:' || doc_id) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM s),
w AS (SELECT *, CASE place WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w, 2.0 * source_size AS stop FROM p),
l AS (SELECT *, (1.5 * sum(source_size) OVER ()
       - coalesce(sum(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
       / sum(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, stop / w) AS level FROM l WHERE level * w < stop),
t AS (SELECT source, source_size, place, CASE WHEN f.level IS NULL THEN stop ELSE least(stop, f.level * w) END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
       sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, (start + size / 2.0) AS m0, (start + source_size + size / 2.0) AS m1 FROM c),
n AS (SELECT *, (size > 0 AND m0 < target)::BIGINT AS n0, (size > 0 AND m1 < target)::BIGINT AS n1, m0 / target AS q FROM m)
SELECT doc_id, size, source_size, target, size * (n0 + n1) AS taken,
  CASE WHEN n0 = 1 THEN round(greatest(0.0, least(1.0, CASE place WHEN 0 THEN {_due_sql(mixing.SCHEDULES[0])} WHEN 1 THEN {_due_sql(mixing.SCHEDULES[1])}
  ELSE {_due_sql(mixing.SCHEDULES[2])} END)), 9) END AS position
FROM n
""")

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mix": OP6_SQL, "op9_warc": OP9_SQL}

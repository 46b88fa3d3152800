"""The queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.llm import audit, byte_repeats, collocations, html_text, lines, media, mixing, packing, quality, sharding, simhash, substrings, token_output
from vialens.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in bins of 2,048 words, no bin with two documents of one source or of one group of near-duplicates."""
    docs = table(spark, sf_dir, "documents")
    alike = simhash.near_duplicates(docs, shingle_words=3, most=2)
    return packing.pack(docs, clusters=alike.select("doc_id", F.col("component_id").alias("cluster")))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written as ORC in doc_id order and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_output.token_digests(token_output.read_tokens(spark, path))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix with source weights 1, 2, 3, repeating, takes."""
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that start anywhere else."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that over 5% of its source's documents, and 2 at least, contain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.length("text").alias("chars_before"))
    return lines.drop_boilerplate(docs).select("doc_id", "source", "text", (F.col("chars_before") - F.length("text")).cast("long").alias("chars_dropped"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least doc_id that links of at most 2 bits reach."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, most=2)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document; the forest is fitted and calibrated on labelled rows."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, "doc_id").drop("anomaly")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a motion-JPEG file, read back, with its timed clips as the feature."""
    return media.media_digests(media.to_media(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``."""
    rows = sharding.external_shuffle(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters on texts overlap, for each lang, in all 120 orders and each of their steps."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start anywhere else."""
    found = byte_repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases by their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_token_output, op3_mixing, op4_substring_dedup, op5_html_extraction, op6_line_dedup, op7_simhash, op8_quality_rules, op9_media_columns, op10_sharding, op11_filter_audit, op12_byte_repeats, op13_collocations)}
ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
with l as (
  select doc_id, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as k
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents where text is not null)),
t as (select source, count(*) as total from documents group by source),
c as (select source, k, count(distinct doc_id) as pages from l where k <> '' group by source, k),
b as (select c.source, k from c join t on c.source is not distinct from t.source where pages >= 2 and pages / total > 0.05),
kept as (
  select l.doc_id, string_agg(line, chr(10) order by i) filter (where b.k is null) as text
  from l left join b on l.source is not distinct from b.source and l.k = b.k group by l.doc_id)
select d.doc_id, d.source, case when d.text is null then null else coalesce(kept.text, '') end as text,
       cast(length(d.text) - length(coalesce(kept.text, '')) as bigint) as chars_dropped
from documents d left join kept using (doc_id)""",
    "op11_filter_audit": r"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (
  select doc_id, part,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x))::int
    + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by x), false)::int as mask
  from t),
s as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join s using (doc_id) group by part, mask),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
p as (select filter_order, step::int as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier from o, range(1, 6) r(step))
select part, filter_order, step,
  coalesce(sum(n) filter (where mask & (bit | earlier) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (where mask & bit <> 0 and mask & earlier = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where mask & bit <> 0 and mask & earlier <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where mask & bit <> 0 and mask & earlier = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where mask & bit <> 0 and mask & earlier = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask::int), 1))) filter (where mask & bit <> 0), 0)::bigint as shapley
from c, p group by part, filter_order, step""",
    "op13_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
g as (
  select lang, k::int as words, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 6) r(k)) group by all),
t as (select lang, sum(f) as n from g where words = 1 group by lang),
often as (select * from g where f >= 100),
free as (
  select c.* from often c where words > 1 and not exists (
    select 1 from often x where x.lang = c.lang and x.words > c.words and 100 * x.f >= 100 * c.f and contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cut as (
  select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, n, k, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
  from free c, range(1, 5) s(k), often l, often r, t
  where k < c.words and l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
    and r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') and t.lang = c.lang),
weak as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weak)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000""",
}

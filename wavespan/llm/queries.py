"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.llm import (ann, linededup, lm_score, mixing, neardup, packing, quality, secretscan,
                          tokenfile, toxicity, trie, urls, whitening)
from wavespan.llm.registry import query, table
from wavespan.llm.tokens import default_path
from wavespan.session import shared_folder


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"), default_path())


@query("op8_token_file")
def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/wavespan/{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, default_path())
    return tokenfile.read_tokens(spark, path)


MIX_SQL = r"""
with sized as (
  select doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         case when count(*) over (partition by doc_id, source, text) = 1 then '' else concat(
           ':', coalesce(lang, ''), ':', coalesce(n_chars::varchar, ''), ':',
           row_number() over (partition by doc_id, source, text, lang, n_chars)) end as own
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, case (row_number() over (order by source asc nulls last) - 1) % 3
              when 0 then 5 when 1 then 2 else 1 end as weight
  from sources
), shares as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over stopped, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over stopped, 0)) as share
  from weighted
  window stopped as (order by 3 * source_size / weight::double, source asc nulls last
                     rows between unbounded preceding and 1 preceding)
), level as (
  select max(share) as level from shares where share * weight <= 3 * source_size
), targets as (
  select source, source_size,
         case when level is null or 3 * source_size / weight::double <= level
              then (3 * source_size)::double else level * weight end as target
  from shares, level
), rates as (
  select *, case when source_size > 0 then least(target / source_size, 3.0::double)
                 else 0.0::double end as rate
  from targets
)
select doc_id, size::bigint as size, source_size, target,
       (size * (floor(rate)::bigint + case when
          ('0x' || substr(md5(concat('20240229:', coalesce(doc_id::varchar, ''), ':',
                                     coalesce(d.source, ''), ':', md5(coalesce(text, '')),
                                     own)),
                          1, 13))::bigint / 4503599627370496.0::double
          < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized d join rates r on d.source is not distinct from r.source
"""


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_url_reputation")
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path names the document whose text it carries; that document's label is its
    outcome: bad if of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/(\d{1,18})", 1)
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    named = pages.select("page_id", number.try_cast("bigint").alias("doc_id"))
    outcomes = named.join(labels.select("doc_id", bad.alias("bad")), "doc_id")
    judged = urls.judge(pages, outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict", "p_bad")


@query("op7_compression_bands")
def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


@query("op2_block_join")
def op2_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a vec_id count as one candidate, that of the least vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where("vec_id % 100 = 0"), vectors)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(docs, labels.where(fold != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.coalesce(fold, F.lit(1)) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts are the target, all documents the background."""
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return lm_score.score(table(spark, sf_dir, "documents"), wanted, default_path())


@query("op5_minhash")
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


LINES_SQL = r"""
with recursive texts as (
  select doc_id, text, row_number() over () as row from documents
), exploded as (
  select doc_id, text, row, pos - 1 as pos, lines[pos] as line
  from (select *, string_split(text, chr(10)) as lines from texts where text is not null),
       unnest(range(1, len(lines) + 1)) as u(pos)
), tokens as (
  select doc_id, text, row, pos, line,
         list_transform(string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' '),
                        lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as toks
  from exploded
), parsed as (
  select doc_id, text, row, pos, line, toks, array_to_string(toks, ' ') as m,
         len(toks)::varchar || ' ' || array_to_string(toks[1:3], ' ') as leaf
  from tokens where len(list_filter(toks, lambda x: x not in ('', '<*>'))) > 0
), lines as (
  select leaf, m, any_value(toks[4:]) as tail, any_value(len(toks) > 50) as passage,
         count(distinct text) as texts, min(doc_id) as first_id
  from parsed group by leaf, m
), open_lines as (
  select leaf, m, tail, texts from lines
  where leaf in (select leaf from lines group by leaf having count(*) > 1 and sum(texts) >= 3)
), rounds as (
  select l.leaf, l.m, l.tail, l.texts, h.head,
         len(list_filter(range(1, len(l.tail) + 1), lambda i: l.tail[i] = h.head_tail[i]))
         >= 0.6::double * len(l.tail) as near
  from open_lines l join (
    select leaf, first(m order by texts desc, m) as head,
           first(tail order by texts desc, m) as head_tail from open_lines group by leaf) h using (leaf)
  union all
  select l.leaf, l.m, l.tail, l.texts, h.head,
         len(list_filter(range(1, len(l.tail) + 1), lambda i: l.tail[i] = h.head_tail[i]))
         >= 0.6::double * len(l.tail) as near
  from rounds l join (
    select leaf, first(m order by texts desc, m) as head,
           first(tail order by texts desc, m) as head_tail
    from rounds where not near group by leaf
    having count(*) > 1 and sum(texts) >= 3) h using (leaf)
  where not l.near
), templates as (
  select leaf, m, head as template from rounds where near
), wide as (
  select t.leaf, t.template, min(p.doc_id) as first_id
  from parsed p join templates t on p.leaf = t.leaf and p.m = t.m
  group by t.leaf, t.template having count(distinct p.text) >= 3
), shared as (
  select t.leaf, t.m, w.first_id, false as pair from templates t join wide w using (leaf, template)
), again as (
  select * from shared
  union all
  select leaf, m, first_id, texts < 3 from lines
  where texts >= case when passage then 2 else 3 end
    and (leaf, m) not in (select (leaf, m) from shared)
), marked as (
  select n.row, n.pos, a.pair,
         sum(case when a.pair then strlen(n.line) else 0 end) over (partition by n.row) * 2
         > strlen(n.text) as copied
  from parsed n join again a
    on n.leaf = a.leaf and n.m = a.m and n.doc_id is distinct from a.first_id
), gone as (
  select row, pos from marked where not (pair and copied)
), left_over as (
  select t.row, count(*) as n_lines, count(g.pos) as n_dropped,
         string_agg(case when g.pos is null then e.line end, chr(10) order by e.pos) as kept
  from texts t join exploded e on t.row = e.row
  left join gone g on g.row = e.row and g.pos = e.pos
  group by t.row
)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped,
       length(coalesce(kept, ''))::bigint as chars_left, md5(coalesce(kept, '')) as text_md5
from texts left join left_over using (row)
"""


@query("op10_line_templates", LINES_SQL)
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_recurring(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.length(text).cast("long").alias("chars_left"),
                       F.md5(text).alias("text_md5"))


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt with the heads of every fifth one."""
    turns = trie.numbered(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(*trie.with_shared_heads(turns))


@query("op13_spectrum_whitening")
def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_assignment_secrets")
def op12_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(found):
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("found", lambda x: x["kind"] != "literal")
    return secretscan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"),
        number("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), number("literal").alias("n_literal"))

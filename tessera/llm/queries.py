"""One registered query per operator, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (alignment, lexical, lm, mixing, neighbours, oneperm, packing, quality, sanitise, sharding, simhash,
                         tokenfile, warc)
from tessera.llm.common import documents

TOKENIZER = "byte_bpe_50k.json"
SECOND_TOKENIZER = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base and model log-probability of every document."""
    return lm.scored(documents(spark, sf_dir))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: 3-word shingles, 2 bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=2, seed=42)
    return found.select("doc_id", "fingerprint", "component_id")


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for each whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids that hold every document."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=0)


OP5_SQL = r"""
with d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                  lambda x: x <> '')) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as place from s),
w as (select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as most,
             1.5::double * sum(source_size) over () as budget from r),
l as (select *, (budget - coalesce(sum(most) over (order by most::double / weight, place
                       rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (order by most::double / weight, place rows between current row and unbounded following)
               as level from w),
f as (select *, (select level from l where most::double / weight > level order by most::double / weight, place limit 1) as free
      from l),
t as (select *, case when free is null or most <= weight * free then most::double else weight * free end as target from f),
q as (select d.doc_id, d.size, t.source_size, t.place, t.target, e.epoch, md5('mix-' || d.doc_id) as ord,
             sum(d.size) over (partition by t.place, e.epoch order by md5('mix-' || d.doc_id) rows unbounded preceding)
             + e.epoch * t.source_size as through
      from d join t on d.source is not distinct from t.source, (select unnest([0, 1]) as epoch) e),
h as (select *, greatest(0, least(size, floor(target)::bigint - (through - size)))::bigint as head from q where size > 0),
p as (select *, 0 as part, head as words, (through - size + head) / target as time from h where head > 0
      union all select *, 1, size - head, through / target from h where head < size),
g as (select doc_id, words, (select floor(1.5 * sum(size))::bigint from d)
             - coalesce(sum(words) over (order by time, place, epoch, ord, part
                        rows between unbounded preceding and 1 preceding), 0) as room from p),
k as (select doc_id, sum(greatest(0, least(words, room)))::bigint as taken from g group by doc_id)
select d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0) as taken
from d join t on d.source is not distinct from t.source left join k on k.doc_id = d.doc_id
"""


@query("op5_mixing_sources", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with recursive names as (select i, 'shard-' || lpad(i::varchar, 2, '0') as name from (select unnest(range(0, 16)) as i)),
prefs as (select list(('0x' || substr(md5(name || '/offset'), 1, 15))::bigint % 4099 order by i) as offsets,
                 list(('0x' || substr(md5(name || '/step'), 1, 15))::bigint % 4098 + 1 order by i) as steps from names),
turns as (select 0::bigint as turn, offsets, steps, list_transform(range(0, 4099), lambda x: -1::bigint) as owner from prefs
          union all
          select turn + 1, offsets, steps, owner[1:slot] || [(turn % 16)::bigint] || owner[slot + 2:]
          from (select *, (offsets[turn % 16 + 1] + steps[turn % 16 + 1] * list_filter(range(0, 4099), lambda j:
                          owner[(offsets[turn % 16 + 1] + j * steps[turn % 16 + 1]) % 4099 + 1] < 0)[1]) % 4099 as slot
                from turns where turn < 4099)),
slots as (select unnest(range(0, 4099)) as slot, unnest(owner) as i from turns where turn = 4099),
d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % 4099 as slot from documents)
select d.doc_id, d.slot::int as slot, n.name as shard from d join slots s on s.slot = d.slot join names n on n.i = s.i
"""


@query("op6_sharding", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document among sixteen."""
    shards = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]
    return sharding.placed(documents(spark, sf_dir), "doc_id", shards, sharding.SLOTS).select("doc_id", "slot", "shard")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, written to compressed files and read back."""
    return tokenfile.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=2)


@query("op8_pii_sanitisation")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document, as spans."""
    return sanitise.report(sanitise.find(documents(spark, sf_dir)))


_UNSPACED = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in quality.UNSPACED)
OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select doc_id, pos, array_to_string(words[pos:pos + 7], ' ') as gram
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as pos from w where len(words) >= 8)),
twice as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, gram) as n from win) where n > 1),
rep as (select doc_id, count(distinct pos + k) as n from twice, (select unnest(range(0, 8)) as k) group by doc_id),
m as (select w.doc_id, len(words) as n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(lines) as n_lines,
             length(text) - length(regexp_replace(text, '[UNSPACED]', '', 'g')) as unspaced_chars,
             coalesce(list_sum(list_transform(list_filter(words, lambda x: length(x) > 1000),
                                              lambda x: length(regexp_replace(x, '[UNSPACED]', '', 'g')))), 0) as giant_chars
      from w left join rep on rep.doc_id = w.doc_id),
b as (select *, (n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int
             + 4 * (word_chars < 2 * n_words)::int + 8 * (word_chars - unspaced_chars - giant_chars > 30 * n_words)::int
             + 16 * (5 * giant_chars > 4 * word_chars)::int + 32 * (2 * n_symbols > word_chars)::int
             + 64 * (n_lines >= 5 and 10 * n_dup_lines > 7 * n_lines)::int as failure_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & 3) <> 0 as base_failed, failure_bits = 0 as kept, failure_bits,
       (failure_bits & 3) = 0 as kept_base, (failure_bits & 31) = 0 as kept_v1, failure_bits = 0 as kept_v2 from b
""".replace("UNSPACED", _UNSPACED)


@query("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document, written to the shared folder; every version of the policy is judged by its bits."""
    book, _ = quality.stored(documents(spark, sf_dir))
    judged = quality.verdicts(book)
    return judged.select("doc_id", *quality.MEASURES[:5], (~F.col("kept_base")).alias("base_failed"),
                         F.col(f"kept_{quality.PRODUCTION}").alias("kept"), "failure_bits", *[f"kept_{p}" for p in quality.POLICIES])


OP10_SQL = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest,
                  octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
f as (select *, min(page_id) over (partition by payload_digest) as least from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id is distinct from least then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id is distinct from least then least end as refers_to
from f
"""


@query("op10_warc", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back from the archives."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op11_document_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness: 5-word shingles, 512 bins of 4 bits."""
    return oneperm.compared(documents(spark, sf_dir), oneperm.OnePermutation(bins=512, bits=4, shingle=5))


OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
g as (select count(*) filter (len(terms) > 0) as docs, sum(len(terms))::bigint as words from d),
i as (select item_id, unnest(list_distinct(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
e as (select doc_id, len(terms) as n, unnest(terms) as term from d),
p as (select doc_id, n, term, count(*) as tf from e where term in (select term from i) group by doc_id, n, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
      from (select term, count(*) as df from p group by term), g),
x as (select p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) as impact
      from p join w on w.term = p.term, g),
s as (select item_id, doc_id, sum(impact)::bigint as score from i join x on x.term = i.term group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""


@query("op12_ranked_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, in groups that end together, and how common their links are."""
    return alignment.aligned(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(SECOND_TOKENIZER))

"""The operators' registered queries over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, huffman, licenses, multiset_hash, packing, permutation_index, pii, quality, secrets, simhash, spelling
from .common import read_table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; tasks see the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"), secrets.train(spark))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents"))


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited(read_table(spark, sf_dir, "documents"))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ids=False, decoded=False)


def op6_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read_table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_entities", "entity_kinds")


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20."""
    return permutation_index.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_rule_ensemble, op2_markov_secrets, op3_simhash_pigeonring, op4_multiset_hash, op5_bpe_trie, op6_min_bin_slack, op7_huffman_files,
    op8_extendible_dedup, op9_license_join, op10_surrogates, op11_symmetric_delete, op12_permutation_index, op13_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


#: White space as the contracts name it.
_SPACE = r"[\x20\x09-\x0D]"

_OP8 = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') as body from documents),
r as (select doc_id, body, first_value(doc_id) over (partition by body order by length(text) desc, doc_id) as keep_id, count(*) over (partition by body) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from r
"""


_OP13 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, row_number() over () as pid, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, array_to_string(ws[i:i + k - 1], ' ') as phrase, k from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(ws) >= k)),
f as (select lang, phrase, k, count(*) as a from g group by all),
t as (select lang, sum(a) as n from f where k = 1 group by lang),
c as (select lang, phrase, k, a, string_split(phrase, ' ') as ws from f where k >= 2 and a >= 100),
q as (select c.lang, c.phrase, c.a, l.a as l, r.a as r, n::bigint as n, j, ((1000::hugeint * c.a * n::hugeint) // (l.a::hugeint * r.a))::bigint as score
  from (select *, unnest(range(1, k)) as j from c) c join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[j + 1:], ' ') join t on t.lang = c.lang),
s as (select * from q qualify row_number() over (partition by lang, phrase order by score, j) = 1),
x as (select lang, sub, max(a) as a from (select lang, a, array_to_string(ws[i:i + m - 1], ' ') as sub from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c))) group by all),
d as (select s.* from s left join x on x.lang = s.lang and x.sub = s.phrase where x.a is null or x.a < s.a)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from d) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_extendible_dedup": _OP8, "op13_collocations": _OP13}

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.bpe import tokenize

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.topk import top_k_digest

    return top_k_digest(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.suffix_dedup import suffix_digest

    return suffix_digest(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.chat import chat_digest

    return chat_digest(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.warc import warc_digest

    return warc_digest(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.simhash import simhash_digest

    return simhash_digest(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.flac import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.treebpe import tree_tokenize

    return tree_tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk_search": op2_topk_search,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_media_columns": op10_media_columns,
    "op11_tree_bpe": op11_tree_bpe,
    "op12_resampling": op12_resampling,
    "op13_spelling": op13_spelling,
}

#: CRC-32 in SQL: the table of its 256 steps.
_CRC = """
    bits as (select i, list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) as v from (select unnest(range(256)) as i)),
    crc as (select list(v order by i) as tab from bits),
"""

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": """
with d as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (
    select doc_id, s, substr(h, 2 * s + 1, 200) as w from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) as s from d)
), late as (
    select doc_id, s from (select doc_id, s, row_number() over (partition by w order by doc_id, s) as r from w) where r > 1
), marked as (
    select doc_id, s, case when s > lag(s) over (partition by doc_id order by s) + 100 then 1 else 0 end as fresh from late
), runs as (
    select doc_id, min(s) as a, max(s) + 100 as b
    from (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as n from marked) group by doc_id, n
), gaps as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs
), cut as (
    select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head
    from gaps join d using (doc_id) group by doc_id
)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join cut using (doc_id)
""",
    "op4_chat_formatting": """
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
    select *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as body, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') as head from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(head) + length(body) + 24) as bigint) as formatted_chars
from e group by conv_id
""",
    "op2_topk_search": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
    from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op12_resampling": f"""
with {_CRC} texts as (
    select 0 as side, row_number() over () as r, doc_id, text from documents union all select 1, 0, null, text from benchmark
), found as (
    select side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from texts
), counted as (
    select side, r, word, count(*) as n from found group by side, r, word
), hexed as (
    select word, hex(encode(word)) as h from (select distinct word from counted)
), hashed as (
    select word, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: cast('0x' || substr(h, i, 2) as bigint)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 as bucket from hexed, crc
), sides as (
    select bucket, cast(sum(n) filter (where side = 0) as double) as s, cast(sum(n) filter (where side = 1) as double) as t from counted join hashed using (word) group by bucket
), gains as (
    select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) as bigint) as gain
    from sides, (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from sides)
), weights as (
    select r, sum(n) as n_features, sum(n * gain) as weight from counted join hashed using (word) join gains using (bucket) where side = 0 group by r
), scored as (
    select doc_id, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
        cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
    from texts left join weights using (r) where side = 0
), placed as (
    select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first, n_features, weight) as place, count(*) over (partition by n_features >= 20) as n from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= n * 10 // 100 then place end as rank from placed
""",
    "op13_spelling": f"""
with recursive {_CRC} found as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents
), counted as (
    select doc_id, run, count(*) as n from found group by doc_id, run
), hexed as (
    select *, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as h from counted
), hashed as (
    select run, n, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: cast('0x' || substr(h, i, 2) as bigint)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295), 4294967295) as h from hexed, crc
), dropped as (
    select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed
), words as (
    select word, cast(sum(n) as bigint) as n from dropped where length(word) >= 6 group by word having sum(n) >= 5
), gaps as (
    select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less, substr(word, 1, i) || '*' || substr(word, i + 2) as hole from (select word, n, unnest(range(length(word))) as i from words)
), pairs as (
    select x.word, x.n, y.word as near, y.n as near_n from gaps x join gaps y on x.hole = y.hole and x.word <> y.word
    union select x.word, x.n, y.word, y.n from gaps x join words y on x.less = y.word
    union select y.word, y.n, x.word, x.n from gaps x join words y on x.less = y.word
), best as (
    select word, n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n
    from (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as r from pairs) where r = 1
), follow as (
    select word, word as root, 0 as step from words
    union all select f.word, b.form, step + 1 from follow f join best b on b.word = f.root where b.form is not null
), roots as (
    select word, max_by(root, step) as root from follow group by word
)
select word, form, root, n, coalesce(n_near, 0) as n_near, form_n from words join roots using (word) left join best using (word)
""",
}

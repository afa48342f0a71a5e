"""Registered queries: one per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    chat, decontaminate, minhash, mixing, multiindex, paragraphs, pieces, ranking, spelling, tokencount, topk, toxicity,
    warc,
)


def piece_model() -> str:
    """The file of the public SentencePiece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(table(spark, sf_dir, "pages"), min_bytes=0)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.linked_vectors(table(spark, sf_dir, "embeddings"), similarity=0.98)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(given.unionByName(more)))


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraphs.drop_repeated_paragraphs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chars", "n_removed")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), piece_model())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "lang", "source", "epoch", "n_tokens")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), min_length=7, min_count=2, drop_every=31)
    return spelling.variants(words, min_length=7, ratio=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_exact_top_k, op3_warc, op4_minhash, op5_pieces, op6_multi_index,
        op7_chat, op8_paragraphs, op9_token_counts, op10_mixing, op11_decontamination, op12_ranked_search, op13_spelling,
    )
}

#: Queries whose result SQL can express.
ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
            where q.vec_id % 50 = 0
        ), ranked as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        s as (
            select page_id, strlen(html) as payload_bytes, sha1(html) as sha,
                   min(page_id) over (partition by html) as first, count(*) over (partition by html) as n
            from p
        )
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + cast(((cast('0x' || substr(sha, 1 + 5 * (i // 4), 5) as bigint) >> (5 * (3 - i % 4))) & 31) as integer), 1)),
                   'string_agg', '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from s
    """,
    "op7_chat": """
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
               cast(sum(length(role) + length(text) + 17 + length(regexp_replace(role, '[^<#>\\\\]', '', 'g'))
                        + length(regexp_replace(text, '[^<#\\\\]', '', 'g'))) as bigint) as formatted_chars
        from c group by conv_id
    """,
    "op11_decontamination": r"""
        with d as (
            select row_number() over () as r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
            from documents
        ), b as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
            from benchmark
        ), w as (
            select item_id, least(10, len(ws)) as k, unnest(range(1, cast(len(ws) - least(10, len(ws)) + 2 as bigint))) as i, ws from b where len(ws) > 0
        ), windows as (select distinct item_id, k, array_to_string(ws[i : i + k - 1], ' ') as win from w),
        places as (
            select r, k, i, array_to_string(ws[i : i + k - 1], ' ') as win
            from (select r, k, ws, unnest(range(1, cast(len(ws) - k + 2 as bigint))) as i from d, (select distinct k from windows) where len(ws) >= k)
        ), found as (select r, p.k, i, item_id from places p join windows using (k, win)),
        hit as (
            select r, count(distinct w) as n
            from (select r, unnest(range(i, i + k)) as w from (select distinct r, k, i from found)) group by r
        ), named as (
            select r, count(*) as n, string_agg(item, ',' order by item) as items
            from (select distinct r, cast(item_id as varchar) as item from found where item_id is not null) group by r
        )
        select doc_id, len(ws) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
        from d left join hit using (r) left join named using (r)
    """,
    "op12_ranked_search": r"""
        with d as (
            select row_number() over () as r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws
            from documents
        ), c as (select count(*) as docs, cast(sum(len(ws)) as bigint) as total from d where len(ws) > 0),
        q as (
            select item_id, t, count(*) as times
            from (
                select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
                from (select distinct item_id, text from benchmark where item_id is not null)
            ) group by item_id, t
        ), tf as (
            select r, t, count(*) as tf from (select r, unnest(ws) as t from d) where t in (select t from q) group by r, t
        ), w as (
            select t, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, c group by t
        ), gain as (
            select r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(ws) * docs) // total)))) as gain
            from tf join w using (t) join d using (r), c
        ), s as (
            select item_id, r, cast(sum(times * gain) as bigint) as score from q join gain using (t) group by item_id, r
        ), ranked as (
            select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
            from s join d using (r) where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= 20
    """,
    "op13_spelling": r"""
        with recursive bits as (
            select list_transform(range(0, 256), lambda n: list_reduce(range(0, 9), lambda v, k:
                case when k = 0 then v when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, n)) as t
        ), runs as (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[A-Za-z\x{C0}-\x{FF}]+')) as run
            from documents
        ), counted as (
            select doc_id, run, count(*) as n from runs where length(run) >= 7 group by doc_id, run
        ), hexed as (
            select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as h from counted
        ), hashed as (
            select run, n, xor(4294967295, list_reduce(
                       list_transform(range(1, cast(length(h) as bigint), 2), lambda i: cast('0x' || substr(h, i, 2) as bigint)),
                       lambda crc, b: xor(crc >> 8, t[1 + cast(xor(crc, b) & 255 as bigint)]), cast(4294967295 as bigint))) as h
            from hexed, bits
        ), cut as (
            select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n
            from hashed
        ), v as (
            select word, cast(sum(n) as bigint) as n from cut where length(word) >= 7 group by word having sum(n) >= 2
        ), dels as (
            select distinct word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as del
            from (select word, n, unnest(range(1, cast(length(word) + 1 as bigint))) as i from v)
        ), near as (
            select distinct a.word as word, b.word as other, b.n as n from dels a join dels b using (del, i)
            where a.word <> b.word and length(a.word) = length(b.word)
            union
            select v.word, d.word, d.n from v join dels d on d.del = v.word
            union
            select d.word, v.word, v.n from v join dels d on d.del = v.word
        ), best as (
            select word, count(*) as n_near, max(n) as most, arg_min(other, row(-n, other)) as other from near group by word
        ), f as (
            select v.word, case when most >= 10 * v.n then other end as form, v.n, coalesce(n_near, 0) as n_near,
                   case when most >= 10 * v.n then most end as form_n
            from v left join best using (word)
        ), walk as (
            select word, word as here, 0 as depth from f
            union all
            select w.word, f.form, depth + 1 from walk w join f on f.word = w.here where f.form is not null
        )
        select f.word, form, root, n, n_near, form_n
        from f join (select word, arg_max(here, depth) as root from walk group by word) using (word)
    """,
}

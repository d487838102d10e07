"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, decontaminate, exact_dedup, html_extract, jaccard_forest, knn_quality, lexical_rank, line_templates,
               prefix_bpe, soft_mix, string_kernel, url_filter, warc_index)
from .common import read

LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: production parameters
URL_RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
             url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


#: share of all tokens each domain should have
TARGETS = {"en": 0.40, "fr": 0.20, "de": 0.20, "es": 0.15, "low": 0.05}


def mixed(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Domains: the language of labelled documents of quality 1, and ``low`` for those of quality 0."""
    domain = F.when(F.col("__label") == 0, F.lit("low")).otherwise(F.col("lang"))
    return soft_mix.mix(docs, labels, domain, TARGETS, carry)


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), carry=["doc_id"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive_and_index(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.near_duplicates(read(spark, sf_dir, "documents")).drop("text_key")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(read(spark, sf_dir, "conversations")))


def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.token_digests(read(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_knn_quality": op1_knn_quality,
    "op2_soft_mix": op2_soft_mix,
    "op3_line_templates": op3_line_templates,
    "op4_string_kernel": op4_string_kernel,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc_index": op6_warc_index,
    "op7_jaccard_forest": op7_jaccard_forest,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_rank": op12_lexical_rank,
    "op13_prefix_bpe": op13_prefix_bpe,
}

#: SQL pieces of op3: characters of scripts without blanks, constant tokens of a list, and the rule for a template
UNSPACED = (r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{19e0}-\x{19ff}\x{2e80}-\x{2fdf}\x{3005}-\x{3007}"
            r"\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a9e0}-\x{a9ff}\x{aa60}-\x{aa7f}"
            r"\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3ffff}]")
CONSTANTS = r"len(list_filter({w}, lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}]') and not regexp_matches(x, '[0-9]')))"
HOLDS = "({c} >= 4 and 2 * {c} >= {n})"


def _block_template(k: int) -> str:
    """The line with the k-th block of its tail as a field, if enough constant tokens are left."""
    block = f"w[4 + {k} * q:3 + {k + 1} * q]"
    enough = HOLDS.format(c=f"(c - {CONSTANTS.format(w=block)})", n="n")
    rest = f"array_to_string(w[1:3 + {k} * q], ' '), ' * ', array_to_string(w[4 + {k + 1} * q:], ' ')"
    return f"case when not digits or {enough} then concat('{k} ', n, ' ', {rest}) end"


ORACLE = {
    "op3_line_templates": rf"""
        with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line,
                          unnest(range(len(string_split(text, chr(10))))) as i from documents),
             p as (select doc_id, i, regexp_matches(line, '[0-9]') as digits, list_filter(string_split_regex(
                       regexp_replace(line, '({UNSPACED})', ' \1 ', 'g'), '[ \t\r\f]+'), lambda x: x <> '') as w from l),
             h as (select doc_id, i, digits, len(w) as n,
                          case when digits and {HOLDS.format(c=CONSTANTS.format(w='w'), n='len(w)')} then list_transform(
                              w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) else w end as w
                   from p where len(w) > 0),
             m as (select *, cast(ceil((n - 3) / 4) as integer) as q, {CONSTANTS.format(w='w')} as c from h),
             k as (select doc_id, i, n, unnest(list_filter(case when n < 10 then [array_to_string(w, ' ')] else [
                          array_to_string(w, ' '),
                          {_block_template(0)},
                          {_block_template(1)},
                          {_block_template(2)},
                          {_block_template(3)}] end, lambda g: g is not null)) as g from m),
             r as (select g, n, max(doc_id) as keeper from k group by g, n
                   having count(distinct doc_id) >= case when n < 10 then 10 else 2 end),
             gone as (select distinct doc_id, i from k join r using (g, n) where doc_id <> keeper)
        select l.doc_id, coalesce(string_agg(line, chr(10) order by l.i) filter (where gone.i is null), '') as text,
               cast(count(*) as integer) as n_lines, cast(count(gone.i) as integer) as n_dropped
        from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id""",
    "op5_exact_dedup": f"""
        with d as (select doc_id, sha256({LOWER.format(c='text')}) as h from documents),
             g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256
        from d join g using (h)""",
    "op6_warc_index": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
                          sha1(coalesce(html, '')) as h from pages),
             g as (select h, max(page_id) as first_id from p group by h),
             q as (select p.*, first_id, list_transform(range(8), lambda g: cast('0x' || substr(h, 1 + 5 * g, 5) as integer))
                          as v from p join g using (h))
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((v[1 + i // 4] >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), 'string_agg', '')
                   as payload_digest,
               case when page_id = first_id then 'response' else 'revisit' end as record_type,
               case when page_id <> first_id then first_id end as refers_to
        from q""",
    "op8_decontaminate": rf"""
        with dw as (select doc_id, row_number() over () as r,
                           regexp_extract_all({LOWER.format(c='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
                    from documents),
             iw as (select item_id, regexp_extract_all({LOWER.format(c='text')},
                                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
                    from benchmark where item_id is not null),
             wins as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[s:s + 12], ' ') as g
                      from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from iw
                            where len(w) > 0)),
             sizes as (select distinct n from wins),
             grams as (select r, n, s, array_to_string(w[s:s + n - 1], ' ') as g
                       from (select r, n, w, unnest(range(1, len(w) - n + 2)) as s from dw, sizes where len(w) >= n)),
             hit as (select grams.r, grams.n, s, item_id from grams join wins on grams.g = wins.g and grams.n = wins.n),
             pos as (select r, count(distinct p) as n_hit
                     from (select r, unnest(range(s, s + n)) as p from hit) group by r),
             ids as (select r, count(*) as n_items, string_agg(i, ',' order by i) as items
                     from (select distinct r, cast(item_id as varchar) as i from hit) group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from dw left join pos using (r) left join ids using (r)""",
    "op9_url_filter": """
        with a as (select page_id, case when contains(url, '://')
                          then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as r
                   from pages),
             b as (select page_id, translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz') as host, r from a),
             c as (select page_id, host, substr(r, length(host) + 1) as path from b),
             rules(verdict, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                          ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
             m as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule,
                          arg_max(verdict, length(rh || rp)) as verdict
                   from c join rules on ends_with('.' || host, '.' || rh) and starts_with(path, rp) group by page_id)
        select c.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from c left join m using (page_id)""",
    "op12_lexical_rank": rf"""
        with d as (select row_number() over () as r, doc_id,
                          regexp_extract_all({LOWER.format(c='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
                   from documents),
             c as (select count(*) filter (len(w) > 0) as docs, sum(len(w)) as words from d),
             q as (select distinct item_id, unnest(regexp_extract_all({LOWER.format(c='text')},
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from benchmark),
             f as (select r, doc_id, t, any_value(len(w)) as n, count(*) as tf
                   from (select r, doc_id, w, unnest(w) as t from d) group by r, doc_id, t),
             g as (select t, count(*) as df from f group by t),
             s as (select item_id, r, doc_id, cast(sum(cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
                          * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) as bigint)
                          as score
                   from q join f using (t) join g using (t), c group by item_id, r, doc_id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer)
               as rank, doc_id, score
        from s where score > 0
        qualify row_number() over (partition by item_id order by score desc, doc_id nulls last) <= 50""",
}

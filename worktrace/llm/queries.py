"""The registered queries of the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.llm import (
    bpe_tree, collocations, conversations, exact, hyperminhash, license_rules, licenses, lines, mix, quality, suffix, token_counts, token_store, warc,
)
from worktrace.llm.common import new_path


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.page_captures(warc.assemble(warc.read(spark, path)))


def op2_quality_divergence(spark: SparkSession, sf_dir: str, robust: bool = False) -> DataFrame:
    rows = quality.score(_table(spark, sf_dir, "documents"), robust=robust)
    return rows.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})  # sums differ in their last bits


def op2_robust_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality_divergence(spark, sf_dir, robust=True)


def op3_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.groups(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.assign(_table(spark, sf_dir, "documents"))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.clean(_table(spark, sf_dir, "pages"), lines.html_text(F.col("html")))
    return rows.select("row.page_id", "host", "n_lines", "n_dropped", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, _tokenizer("byte_bpe_50k.json")).select("doc_id", "_tokens.*")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_store.listing(spark, path).select("doc_id", "start", "n_tokens", token_store.ids_crc32("ids").alias("ids_crc32"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe_tree.encode(docs, _tokenizer("word_bpe_49k.json"))
    return rows.select(
        "row.doc_id", bpe_tree.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix.copies(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), conv_ids=rows)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


OP1_SQL = """
with sized as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), first as (
  select *, min(page_id) over (partition by payload_digest) as f from sized
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> f then f end as refers_to
from first
"""

OP6_SQL = rf"""
with cut as (
  select page_id, nullif(lower(regexp_extract(url, '{lines._HOST}', 1)), '') as host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{lines._HIDDEN}', '', 'g'),
           '{lines._BLOCK}', chr(10), 'g'), '{lines._TAG}', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') as l
  from pages
), totals as (select host, count(*) as pages from cut where host is not null group by host having count(*) >= {lines.MIN_PAGES}
), seen as (select host, line, count(*) as n from (select host, unnest(list_distinct(l)) as line from cut) group by host, line
), drops as (select host, list(line) as common from seen join totals using (host) where n > {lines.RATIO}::double * pages group by host
), kept as (
  select cut.page_id, cut.host, l, case when common is null then l else list_filter(l, lambda x: not list_contains(common, x)) end as k
  from cut left join drops on cut.host = drops.host
)
select page_id, host, len(l)::bigint as n_lines, (len(l) - len(k))::bigint as n_dropped, sha256(coalesce(array_to_string(k, chr(10)), '')) as cleaned_sha256
from kept
"""


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CLASS_SQL = ", ".join(
    f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    for chars in [
        *(
            "".join(
                chr(92) + c if c in "-" + chr(92) + chr(93) else c for c in chars
            ).replace(chr(39), chr(39) * 2) for chars in quality.CLASSES.values()
        ),
        *("".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) for spans in quality.SCRIPTS.values()),
    ]
)

OP2_SQL = rf"""
with base as (
  select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents
), cut as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from base
), windows as (
  select r, i, array_to_string(w[i:i + 4], ' ') as s from (select r, w, unnest(range(1, len(w) - 3)) as i from cut)
), repeated as (
  select r, count(distinct k)::bigint as n from (
    select r, unnest(range(i, i + 5)) as k from (select *, count(*) over (partition by r, s) as c from windows) where c > 1
  ) group by r
), feature as (
  select cut.r, doc_id, lang, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as wc, length(t) as n_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(repeated.n, 0)::bigint as n_repeat_words, [{_CLASS_SQL}] as known,
         list_transform(w, lambda x: translate(trim(x, '{quality.MARKS.replace("'", "''")}'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as lw
  from cut left join repeated on cut.r = repeated.r
), counted as (
  select *, coalesce(wc, 0)::bigint as word_chars, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         list_append(known, n_chars - list_sum(known)::bigint) as classes,
         list_append(list_transform({_sql_list(quality.VOCABULARY)}, lambda v: len(list_filter(lw, lambda x: x = v))), 
                     len(list_filter(lw, lambda x: not list_contains({_sql_list(quality.VOCABULARY)}, x)))) as common
  from feature
), sums as (
  select lang, kind, k, sum(v)::double as v from (
    select lang, 'c' as kind, unnest(classes) as v, generate_subscripts(classes, 1) as k from counted where not base_failed
    union all
    select lang, 'w' as kind, unnest(common) as v, generate_subscripts(common, 1) as k from counted where not base_failed
  ) group by lang, kind, k
), refs as (
  select lang, list(v order by k) filter (where kind = 'c') as rc, list(v order by k) filter (where kind = 'w') as rw
  from sums group by lang having sum(v) filter (where kind = 'w') >= {quality.MIN_REFERENCE_WORDS}
), pairs as (
  select counted.*,
         list_transform(list_zip(classes, rc), lambda z: struct_pack(p := z[1] / list_sum(classes)::double, q := z[2] / list_sum(rc))) as zc,
         list_transform(list_zip(common, rw), lambda z: struct_pack(p := z[1] / list_sum(common)::double, q := z[2] / list_sum(rw))) as zw
  from counted left join refs on counted.lang is not distinct from refs.lang
), far as (
  select *, case when n_chars >= {quality.MIN_CLASS_CHARS} then sqrt(greatest(0, list_sum(list_transform(zc, lambda z:
             case when z.p > 0 then z.p * log2(2 * z.p / (z.p + z.q)) else 0 end + case when z.q > 0 then z.q * log2(2 * z.q / (z.p + z.q)) else 0 end)) / 2)) end as class_distance,
         case when n_words >= {quality.MIN_COMMON_WORDS} then sqrt(greatest(0, list_sum(list_transform(zw, lambda z:
             case when z.p > 0 then z.p * log2(2 * z.p / (z.p + z.q)) else 0 end + case when z.q > 0 then z.q * log2(2 * z.q / (z.p + z.q)) else 0 end)) / 2)) end as common_distance
  from pairs
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(class_distance, 0) <= {quality.MAX_CLASS_DISTANCE}
         and (common_distance is null or common_distance <= {quality.MAX_COMMON_DISTANCE} + {quality.COMMON_NOISE} / sqrt(n_words)) as kept,
       round(class_distance, 6) as class_distance, round(common_distance, 6) as common_distance
from far
"""

OP3_SQL = r"""
with cut as (
  select row_number() over () as r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null and text is not null
), windows as (
  select r, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as s from (select r, doc_id, w, unnest(range(0, len(w) - 49)) as i from cut)
), twice as (
  select distinct doc_id, i from (select *, count(*) over (partition by s) as c from windows) where c > 1
), grouped as (
  select doc_id, i, sum(case when i <= before + 50 then 0 else 1 end) over (partition by doc_id order by i) as g
  from (select *, coalesce(lag(i) over (partition by doc_id order by i), -1000) as before from twice)
)
select doc_id, min(i)::bigint as start, max(i)::bigint + 50 as "end", max(i)::bigint + 50 - min(i)::bigint as n_words from grouped group by doc_id, g
"""

OP4_SQL = r"""
with recursive cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingle as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from cut)
), sizes as (select doc_id, count(*) as n from shingle group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), reach as (
  select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on reach.b = links.a
), found as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join found using (doc_id) left join sizes using (doc_id)
"""

OP5_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from (max(doc_id) over same) as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

OP10_SQL = r"""
with sized as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), ranked as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from sized group by source
), capped as (
  select *, ([5.0::double, 2.0::double, 1.0::double])[(i % 3 + 1)::int] as w, source_size * 2.0::double as cap from ranked
), level as (
  select *, (sum(source_size) over ())::double * 1.5::double as budget,
         coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as spent,
         sum(w) over (order by cap / w, i rows between current row and unbounded following) as open from capped
), filled as (select *, (budget - spent) * w >= cap * open as is_full from level
), plan as (
  select source, source_size, case when is_full then cap else
           (budget - coalesce(sum(cap) filter (where is_full) over (), 0)) * w / (sum(w) filter (where not is_full) over ()) end as target from filled
), drawn as (
  select d.doc_id, d.size, p.source_size, p.target,
         case when p.source_size > 0 then least(p.target / p.source_size, 2.0::double) else 0 end as rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, 'null') || ':' || coalesce(d.text, '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from sized d join plan p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target,
       (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from drawn
"""

OP11_SQL = rf"""
with piece as (
  select r, coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from (select row_number() over () as r, * from documents)
), cut as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece
), phrase as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*)::hugeint as f
  from (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from cut, (values (1), (2), (3), (4)) as size(k)) group by all
), words as (select lang, sum(f)::bigint as n from phrase where k = 1 group by lang
), candidate as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from phrase where k > 1 and f >= {collocations.MIN_COUNT}
), cut_at as (
  select c.lang, c.phrase, c.a, cut, x.f as l, y.f as r, 2000000::hugeint * a // (x.f + y.f) as score
  from (select *, unnest(range(1, k)) as cut from candidate) c
  join phrase x on x.lang = c.lang and x.phrase = array_to_string(w[1:cut], ' ') join phrase y on y.lang = c.lang and y.phrase = array_to_string(w[cut + 1:], ' ')
), scored as (select * from cut_at qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_part as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer
  from (select lang, w, a, m, unnest(range(1, k - m + 2)) as i from candidate, (values (2), (3)) as size(m) where m < k) group by all
), stands as (
  select s.* from scored s left join inner_part b using (lang, phrase) where b.longer is null or 100 * b.longer < 80 * s.a
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from stands)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join words using (lang) where rank <= {collocations.TOP}
"""

_RULES_SQL = ",\n".join(
    f"({i}, '{r.label}', {r.strength}, {r.base}, '{license_rules.compiled(r.signature)}', ' {word} ')"
    for i, (r, word) in enumerate(zip(license_rules.standard_rules(), license_rules.keywords(license_rules.standard_rules()), strict=True))
)
OP13_SQL = rf"""
with rule(id, label, strength, base, pattern, keyword) as (values {_RULES_SQL}
), cut as (
  select row_number() over () as d, doc_id,
         trim(regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.SEPARATORS}', '  ', 'g'), ' ') as t from documents
), doc as (select d, doc_id, case when t = '' then '' else ' ' || t || ' ' end as s from cut
), hit as (
  select d, rule.*, string_split(regexp_replace(s, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) as p
  from doc join rule on contains(s, keyword) and regexp_matches(s, pattern)
), place as (
  select d, id, label, strength, base, len(regexp_replace(array_to_string(p[1:j], ''), '[^ ]', '', 'g')) // 2 as first, len(regexp_replace(split_part(p[j + 1], chr(2), 1), '[^ ]', '', 'g')) // 2 as n
  from (select *, unnest(range(1, len(p))) as j from hit)
), judged as (
  select x.*, not exists (
    select 1 from place y where y.d = x.d and y.first <= x.first and y.first + y.n >= x.first + x.n
      and (y.strength < x.strength or y.strength = x.strength and (y.n > x.n or y.id < x.id))) as stands
  from place x
), per as (
  select d, count(*) filter (where base) as n_base, min(first) filter (where base) as first_word, max(first) filter (where base) as last_word,
         list_sort(list_distinct(list(label) filter (where base))) as bl, list_sort(list_distinct(list(label) filter (where base or stands))) as al,
         max(case strength {" ".join(f"when {k} then {v}" for k, v in license_rules.WEIGHTS.items())} end) filter (where stands) as score
  from judged group by d
)
select doc_id, (len(regexp_replace(s, '[^ ]', '', 'g')) // 2)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(bl, ','), '') as base_labels, coalesce(array_to_string(al, ','), '') as labels, coalesce(score, 0)::double as score
from doc left join per using (d)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_transactions": op1_warc_transactions,
    "op2_quality_divergence": op2_quality_divergence,
    "op2_robust_divergence": op2_robust_divergence,
    "op3_sparse_suffixes": op3_sparse_suffixes,
    "op4_hyperminhash": op4_hyperminhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_site_lines": op6_site_lines,
    "op7_token_counts": op7_token_counts,
    "op8_token_store": op8_token_store,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_source_mix": op10_source_mix,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_transactions": OP1_SQL,
    "op2_quality_divergence": OP2_SQL,
    "op3_sparse_suffixes": OP3_SQL,
    "op4_hyperminhash": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_site_lines": OP6_SQL,
    "op10_source_mix": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_license_scan": OP13_SQL,
}

"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from habitscope.llm import chunk_bpe, conversations, language, line_windows, mixing, secret_crf, site_quality
from habitscope.llm.chunk_dedup import exact_groups
from habitscope.llm.common import hex_digest, table
from habitscope.llm.near_dups import near_groups
from habitscope.llm.projections import nearest
from habitscope.llm.simhash import simhash_groups
from habitscope.llm.token_counts import token_counts
from habitscope.llm.whitening import whiten
from habitscope.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return wrap


@register("op10_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(table(spark, folder, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op4_chunk_bpe")
def _chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk_bpe.decode(chunk_bpe.encode(table(spark, folder, "documents")))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register(
    "op2_exact_dedup",
    """
    with t as (select doc_id, coalesce(text, '') as text from documents),
    g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256
    from t join g using (text)""",
)
def _exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


@register(
    "op5_mix_sources",
    r"""
    with d as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             md5('20:' || doc_id::varchar || ':' || coalesce(text, '')) as h
      from documents),
    s as (
      select source, sum(size)::bigint as source_size, count(*) as n from d group by 1),
    w as (
      select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
             row_number() over (order by source nulls last) as rk
      from s),
    r as (
      select *, row_number() over o as step,
             (sum(source_size) over () - 3.0::double * coalesce(sum(source_size) over
                (order by source_size / weight, rk rows between unbounded preceding and 1 preceding), 0))::double
             / (sum(weight) over () - coalesce(sum(weight) over
                (order by source_size / weight, rk rows between unbounded preceding and 1 preceding), 0)) as rate
      from w window o as (order by source_size / weight, rk)),
    f as (select min(step) as step, arg_min(rate, step) as rate from r where not rate * weight > 3.0 * source_size),
    t as (
      select r.source, r.source_size, r.n, r.rk,
             (case when r.step < f.step then 3.0 * r.source_size else f.rate * r.weight end)::double as target
      from r cross join f),
    seats as (
      select source, rk, target / (2 * i - 1) as q, i
      from t, generate_series(1, (select ceil(sum(target) / 16)::bigint + 1 from t)) g(i)
      where target > 0 and i <= 2 + ceil(target / 16)),
    quota as (
      select source, count(*) as quota from (
        select source, row_number() over (order by q desc, rk, i) as place from seats)
      where place <= (select round(sum(target) / 16)::bigint from t) group by 1),
    p as (
      select d.*, t.source_size, t.target, coalesce(quota.quota, 0) as source_quota,
             ('0x' || substr(h, 25, 8))::bigint % least(4096, ceil(t.n / 1000.0))::bigint as shard
      from d join t on d.source is not distinct from t.source left join quota on d.source is not distinct from quota.source),
    z as (select source, shard, sum(size)::bigint as shard_size, any_value(source_quota) as source_quota from p group by 1, 2),
    zq as (
      select source, shard, count(*) as quota from (
        select source, shard, source_quota, row_number() over (partition by source order by shard_size / (2 * i - 1) desc, shard, i) as place
        from z, generate_series(1, (select max(source_quota) from z)) g(i) where shard_size > 0 and i <= source_quota)
      where place <= source_quota group by 1, 2),
    v as (
      select p.*, z.shard_size, least(coalesce(zq.quota, 0) * 16, 3 * z.shard_size) as read,
             sum(size) over (partition by p.source, p.shard order by h, doc_id, size) - size as start
      from p join z on p.source is not distinct from z.source and p.shard = z.shard
        left join zq on p.source is not distinct from zq.source and p.shard = zq.shard)
    select doc_id, size, source_size, target,
           (case when shard_size = 0 then 0 else
              (read // shard_size) * size + greatest(0, least(size, read - (read // shard_size) * shard_size - start)) end)::bigint as taken
    from v""",
)
def _mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register(
    "op9_line_windows",
    """
    with l as (
      select doc_id, row_number() over (order by doc_id nulls last, text) as id, string_split(coalesce(text, ''), chr(10)) as lines
      from documents),
    e as (select doc_id, id, lines, unnest(range(len(lines))) as pos from l),
    w as (
      select id, pos, lines[pos + 1] as a, lines[pos + 2] as b, lines[pos + 3] as c
      from e where pos + 3 <= len(lines)),
    later as (
      select id, pos from (
        select id, pos, row_number() over (partition by a, b, c order by id, pos) as n from w) where n > 1),
    gone as (select distinct id, unnest([pos, pos + 1, pos + 2]) as pos from later),
    kept as (
      select any_value(e.doc_id) as doc_id, e.id, count(*) as n_lines, count(g.pos) as n_removed,
             coalesce(string_agg(e.lines[e.pos + 1], chr(10) order by e.pos) filter (where g.pos is null), '') as text
      from e left join gone g on e.id = g.id and e.pos = g.pos group by e.id)
    select doc_id, n_lines, n_removed, sha256(text) as text_sha256 from kept""",
)
def _line_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_windows.without_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", hex_digest(F.col("text")).alias("text_sha256"))


@register("op7_near_dups")
def _near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


@register("op3_language_id")
def _language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))))
    told = language.identify(docs, model)
    return told.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@register("op1_secret_crf")
def _secret_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_crf.find_secrets(docs, secret_crf.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        hex_digest(secret_crf.spans_text(base)).alias("base_sha256"),
        secret_crf.spans_text(F.col("spans")).alias("spans"),
    )


@register("op6_projected_neighbours")
def _projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


@register("op8_site_quality")
def _site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no URL: the source is the host, and its part in one language the path."""
    docs = table(spark, folder, "documents")
    model = site_quality.fit(docs, table(spark, folder, "labels"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return site_quality.posteriors(docs, model, F.col("source"), path)


def _edited(value: str, cost: str, edit: str) -> str:
    """Cost in six digits and audit as one text, which compares by cost and then by audit, after one edit before it."""
    return f"lpad((left({value}, 6)::int + {cost})::varchar, 6, '0') || '{edit}' || substr({value}, 7)"


# v0 to v3: cheapest way from a place to the end in the states nothing, after s, after u, after a.
_KEPT = {
    0: f"case initial when 's' then {_edited('v1', 'more', 'K')} when 'u' then {_edited('v2', 'more', 'K')} end",
    1: f"case initial when 'u' then {_edited('v2', 'more', 'K')} end",
    2: f"case initial when 'a' then {_edited('v3', 'more', 'K')} end",
    3: f"case initial when 'u' then {_edited('v2', 'more', 'K')} end",
}
_BEST = ", ".join(
    f"least({_edited(f'v{s}', '3', 'D')}, case when fault not in ('blank', 'duplicate') then {kept} end, "
    f"case when fault not in ('blank', 'duplicate') then {_edited('v3' if s == 2 else 'v2', '2 + more', 'R')} end) as b{s}"
    for s, kept in _KEPT.items()
)
_REPAIR_SQL = rf"""
    with recursive c as (
      select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as chars
      from conversations),
    w as (
      select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295,
               flatten(list_transform(chars, lambda x: [ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 20 as way
      from c),
    e as (
      select conv_id, turn, case when way = 4 then 'user' else role end as role,
             case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(range(case way when 0 then 0 when 3 then 2 else 1 end)) as copy
      from w),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from e),
    r as (
      select conv_id, turn, role, text, i, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as prior,
             case when not regexp_matches(text, '[^ 	-
]') then 'blank'
                  when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                  when not regexp_matches(text, '[.!?][ 	-
]*$') then 'truncated' else '' end as fault
      from o),
    g as (
      select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
             count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
             count(*) filter (fault = 'truncated') as truncated,
             count(*) filter (prior is not null and prior || initial not in ('su', 'ua', 'au')) as illegal
      from r group by 1),
    dp as (
      select conv_id, n + 1 as i, '000000' as v0, '000004II' as v1, '000002I' as v2, '000000' as v3 from g
      union all
      select conv_id, i, least(b0, {_edited('f2', '2', 'I')}), least(b1, {_edited('f2', '2', 'I')}), f2, f3 from (
        select *, least(b2, {_edited('b3', '2', 'I')}) as f2, least(b3, {_edited('b2', '2', 'I')}) as f3 from (
          select conv_id, i, {_BEST} from (
            select r.*, case when fault = 'truncated' then 1 else 0 end as more, v0, v1, v2, v3
            from dp join r on dp.conv_id is not distinct from r.conv_id and r.i = dp.i - 1)))),
    best as (select conv_id, left(v0, 6)::bigint as cost, substr(v0, 7) as audit from dp where i = 1),
    walk as (
      select conv_id, audit, 1 as pos, 1::bigint as i, '' as state, '' as done from best
      union all
      select conv_id, audit, pos + 1, case when edit = 'I' then i else i + 1 end, case when edit = 'D' then state else left(said, 1) end,
             case when edit = 'D' then done when done = '' then said else done || chr(10) || said end
      from (select z.*, case edit when 'K' then r.role || ':' || r.text when 'R' then new_role || ':' || r.text when 'I' then new_role || ':' end as said
            from (select *, substr(audit, pos, 1) as edit, case when state = 'u' then 'assistant' else 'user' end as new_role
                  from walk where pos <= length(audit)) z
            left join r on r.conv_id is not distinct from z.conv_id and r.i = z.i)),
    fixed as (select conv_id, done from walk where pos = length(audit) + 1),
    ids as (select distinct conv_id from conversations)
    select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
           sha256(coalesce(done, '')) as repaired_sha256
    from ids left join g on ids.conv_id is not distinct from g.conv_id left join best on ids.conv_id is not distinct from best.conv_id
      left join fixed on ids.conv_id is not distinct from fixed.conv_id"""


@register("op11_conversation_repair", _REPAIR_SQL)
def _conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


@register("op12_embedding_whitening")
def _embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


@register("op13_simhash_groups")
def _simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""The operators over their whole tables, with production parameters; oracle SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, exact_topk, merkle, mixing, ngram_jaccard, packing, perplexity, secrets, sharding, toxicity, transport_stream, url_filter
from .common import LOWER, UPPER, table

#: The rules of the URL query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat_format.format_pairs(chat_format.with_foreign_reply(turns))
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", *[chat_format.spans_text(F.col(f"{c}_mask")).alias(f"{c}_mask") for c in ("chosen", "rejected")])


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity.quality(table(spark, sf_dir, "documents"), trusted)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digest(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Categories of the chain, in order: of low quality, toxic.
CATEGORIES = ["low_quality", "toxic"]


def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, label_columns(spark, sf_dir), CATEGORIES)
    return toxicity.score(docs, chain).select("doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_preference_formatting": op1_preference_formatting,
    "op2_kneser_ney_quality": op2_kneser_ney_quality,
    "op3_exact_topk": op3_exact_topk,
    "op4_transport_streams": op4_transport_streams,
    "op5_url_filters": op5_url_filters,
    "op6_mixing": op6_mixing,
    "op7_secret_scans": op7_secret_scans,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_virtual_slots": op12_virtual_slots,
    "op13_collocations": op13_collocations,
}



def _rounds(table: str, source: str) -> str:
    """`source` with (x, n, keys): x permuted, round by round."""
    mirror = "((k.centre + n - a.centre) % n)"
    bit = f"(((greatest(a.centre, {mirror}) + k.shift) % 2147483647 * k.factor % 2147483647 >> 9) & 1)"
    step = f"lambda a, k: struct_pack(centre := case when {bit} = 1 then {mirror} else a.centre end, shift := 0::bigint, factor := 0::bigint)"
    return f"{table} as (select * exclude (x), list_reduce(keys, {step}, struct_pack(centre := x, shift := 0::bigint, factor := 0::bigint)).centre as x from {source})"


_MIXING = rf"""
with d as (
  select doc_id, source, coalesce('s' || source, 'n') as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, row_number() over () as r from documents
), s as (
  select key, source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by key, source
), w as (select *, rank % 3 + 1 as weight, source_size * 3 as cap from s
), c as (
  select *, (select sum(source_size) from s) as total, coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as free, row_number() over (order by cap / weight, rank) as o from w
), l as (select coalesce(arg_min((total - capped) / free, o) filter ((total - capped) / free * weight <= cap and total > 0), 0) as share from c
), t as (
  select key, source_size, rank, least(cap::double, share * weight) as target, ceil(source_size / 64)::bigint as blocks from w, l
), k as (
  select *, least(case when source_size > 0 then round(target * blocks / source_size)::bigint else 0 end, 3 * blocks) as slots from t
), f as (select *, coalesce(sum(slots) over (order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as before, (sum(slots) over ())::bigint as total from k
), seeds as (select 0::bigint as seed, max(total) as n from f union all select rank * 3 + turn + 1, blocks from f, range(3) t(turn)
), kv as (select seed, n, r, i, (seed * 24 + r) * 4 + i as v from seeds, range(24) a(r), range(4) b(i)
), ku as (select *, ((v & 2147483647) + (v >> 31) + 1013904223) % 2147483647 as u from kv
), ks as (select *, u * 48271 % 2147483647 as s from ku
), kx as (select seed, n, r, i, ((s * s + 12345) % 2147483647 * 69621 + u) % 2147483647 as x from ks
), kr as (select seed, n, r, max(x) filter (i = 0) as a, max(x) filter (i = 1) as b, max(x) filter (i = 2) as c, max(x) filter (i = 3) as d from kx group by all
), keys as (select seed, list(struct_pack(centre := (a * 2147483647 + b) % greatest(n, 1), shift := c, factor := d + 1) order by r) as keys from kr group by seed
), {_rounds("dealt", "(select key, before + j as x, total as n, keys from (select *, unnest(range(slots)) as j from f), (select keys from keys where seed = 0))")}
, counts as (select key, x // 16384 as shard, count(*) as n from dealt group by all
), based as (select *, coalesce(sum(n) over (partition by key order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as base from counts
), numbered as (select key, shard, base + i as j from (select *, unnest(range(n)) as i from based)
), {_rounds("slots", "(select key, shard, j % blocks as x, blocks as n, keys from numbered join f using (key) join keys on seed = rank * 3 + j // blocks + 1)")}
, b as (
  select key, x as block, count(*) as times, min(shard) as first_shard from slots group by all
), o as (
  select r, doc_id, key, size, coalesce(sum(size) over (partition by key order by doc_id nulls last, size, r rows between unbounded preceding and 1 preceding), 0)::bigint as pos from d
), e as (
  select r, key, pos, size, unnest(range(pos // 64, (pos + size - 1) // 64 + 1)) as block from o where size > 0
), x as (
  select r, sum((least((block + 1) * 64, pos + size) - greatest(block * 64, pos)) * times)::bigint as taken, min(first_shard) as first_shard from e join b using (key, block) group by r
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_shard from o join t using (key) left join x using (r)"""



def _digest(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in fields) + ")"


#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(8 * length(s)), lambda i: case when i % 8 = 0 then ascii(s[(i // 8 + 1)::int])::bigint else 0::bigint end),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint), 4294967295::bigint)"""

_MERKLE = f"""
with recursive d as (
  select row_number() over () as r, *, coalesce('s' || lang, 'n') as key, coalesce(doc_id::varchar, '') as s, {_digest('doc_id', 'source', 'lang', 'n_chars', 'text')} as leaf from documents
), c as (select *, case when doc_id is not null and {_CRC} % 7 = 0 then {_digest('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')} else leaf end as claim from d
), o as (select r, doc_id, key, leaf, claim, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by key) as n from c
), t(key, lvl, i, n, node) as (
  select key, 0, i, n, leaf from o union all
  select key, lvl + 1, i // 2, (n + 1) // 2, sha256(node || coalesce(next, '')) from (select *, lead(node) over (partition by key order by i) as next from t where n > 1) where i % 2 = 0
), s as (select key, lvl as h, node as subroot, row_number() over (order by key) - 1 as rank, count(*) over () as n from t where n = 1
), u(lvl, i, n, node) as (
  select 0, rank, n, subroot from s union all
  select lvl + 1, i // 2, (n + 1) // 2, sha256(node || coalesce(next, '')) from (select *, lead(node) over (order by i) as next from u where n > 1) where i % 2 = 0
), g as (select range as lvl from range(64)
), e as (
  select o.r, g.lvl as step, (o.i >> g.lvl) % 2 as side, x.node as sib from o join s using (key) join g on g.lvl < s.h left join t x on x.key = o.key and x.lvl = g.lvl and x.i = xor(o.i >> g.lvl, 1)
  union all select o.r, s.h + g.lvl, (s.rank >> g.lvl) % 2, x.node from o join s using (key) join g on g.lvl < (select max(lvl) from u) left join u x on x.lvl = g.lvl and x.i = xor(s.rank >> g.lvl, 1)
), p as (select r, string_agg(sib, '' order by step) as proof from e group by r
), f(r, step, node) as (
  select r, 0, claim from o union all
  select f.r, f.step + 1, sha256(case when side = 0 then node || coalesce(sib, '') else sib || node end) from f join e on e.r = f.r and e.step = f.step
), z as (select r, arg_max(node, step) as folded_root from f group by r)
select doc_id, leaf, subroot, (select node from u where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = (select node from u where n = 1) as verified
from o join s using (key) join z using (r) left join p using (r)"""

_COLLOCATIONS = rf"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?
-
]')) as piece from documents
), w as materialized (select lang, regexp_extract_all(piece, '[^ 	]+') as w from p
), n as (select lang, sum(len(w))::bigint as n from w group by lang
), i as (select lang, w, unnest(range(1, len(w) + 1)) as i from w
), g as (select lang, 1 as m, w[i] as phrase from i union all select lang, 2, w[i] || ' ' || w[i + 1] from i where i < len(w) union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from i where i + 1 < len(w)
), f as materialized (select lang, m, phrase, count(*) as f from g group by all
), c as materialized (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 10
), k as (select *, unnest(range(1, m)) as k from c
), y as materialized (select lang, phrase, m, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from k
), x as (
  select y.lang, y.phrase, y.m, a, k, l.f as l, r.f as r, (1000000::hugeint * a * a // (l.f::hugeint * r.f))::bigint as score
  from y join f l on l.lang = y.lang and l.phrase = y.first join f r on r.lang = y.lang and r.phrase = y.rest
), b as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1
), h as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where m = 3
), s as (select b.* from b left join (select lang, phrase, max(a) as held from h group by all) h on h.lang = b.lang and h.phrase = b.phrase where coalesce(100 * held < 50 * a, true)
)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from s join n on n.lang = s.lang qualify rank <= 2000"""

ORACLES = {
    "op1_preference_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls last, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null
), a as (select conv_id, max(i) filter (role = 'assistant') as last from t group by conv_id
), y as (select xor(conv_id, 1) as conv_id, text as reply from t join a using (conv_id) where i = last
), p as (
  select conv_id, i, role, text as c, case when i = last then coalesce(reply, '') else text end as r from t join a using (conv_id) left join y using (conv_id)
), n as (select conv_id, coalesce(min(i) filter (c <> r) - 1, max(i)) as n from p group by conv_id
), x as (
  select conv_id, n, i, role, '<|' || role || E'|>\n' || c || E'<|end|>\n' as c, '<|' || role || E'|>\n' || r || E'<|end|>\n' as r from p join n using (conv_id)
), m as (
  select *, coalesce(sum(length(c)) over w, 0)::bigint as cs, coalesce(sum(length(r)) over w, 0)::bigint as rs
  from x window w as (partition by conv_id, i > n order by i rows between unbounded preceding and 1 preceding)
)
select conv_id, n::int as n_prompt_turns, coalesce(string_agg(c, '' order by i) filter (i <= n), '') as prompt,
       coalesce(string_agg(c, '' order by i) filter (i > n), '') as chosen, coalesce(string_agg(r, '' order by i) filter (i > n), '') as rejected,
       coalesce(string_agg((cs + length(role) + 5) || ':' || (cs + length(c) - 1), ',' order by i) filter (i > n and role = 'assistant'), '') as chosen_mask,
       coalesce(string_agg((rs + length(role) + 5) || ':' || (rs + length(r) - 1), ',' order by i) filter (i > n and role = 'assistant'), '') as rejected_mask
from m group by conv_id, n""",
    "op3_exact_topk": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from (select distinct * from v where vec_id % 100 = 0) q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 10""",
    "op5_url_filters": r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u
), r(verdict, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m as (
  select page_id, host, path, rhost || rpath as rule, r.verdict, length(rhost || rpath) as n
  from h left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m
qualify row_number() over (partition by page_id, host, path order by n desc nulls last) = 1""",
    "op6_mixing": _MIXING,
    "op11_merkle_manifest": _MERKLE,
    "op13_collocations": _COLLOCATIONS,
    "op7_secret_scans": r"""
with p(kind, rank, pat, grp, least) as (values
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24)
), d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents
), a as (
  select r, 'assign' as kind, 0 as rank, 6 as least, regexp_extract_all(text, (select pat from p where rank = 0)) as ms, regexp_extract_all(text, (select pat from p where rank = 0), 2) as gs, regexp_split_to_array(text, (select pat from p where rank = 0)) as gaps from d
  union all select r, 'access', 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') from d
  union all select r, 'hex', 2, 24, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') from d
), e as (
  select r, kind, rank, least, unnest(ms) as m, unnest(gs) as g, unnest(gaps[1:len(ms)]) as gap, generate_subscripts(ms, 1) as i from a where len(ms) > 0
), s as (
  select r, kind, rank, least, g, sum(length(gap)) over w + sum(length(m)) over w - length(m) as start, sum(length(gap)) over w + sum(length(m)) over w as stop
  from e window w as (partition by r, kind order by i rows unbounded preceding)
), f as (
  select r, count(*) filter (rank = 0) as a, count(*) filter (rank = 1) as b, count(*) filter (rank = 2) as c,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, rank) as spans
  from s where length(g) >= least group by r
)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join f using (r)""",
}

"""The registered queries of this package and their DuckDB SQL.

Each applies its operator with production parameters to its whole table. Operators whose
results SQL cannot express are tested in tests/llm against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, divergence, extraction, fingerprint, mixing, packing, quality, ranking, shingles, substrings, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


OP1 = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), p as (
  select doc_id, len(w) as n, unnest(range(1, len(w) - 18)) as s, w from d where len(w) >= 20
), g as (
  select doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) as h from p
), late as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as k from g) where k > 1
), gone as (
  select distinct doc_id, unnest(range(s, s + 20)) as i from late
), each as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d
), kept as (
  select e.doc_id, string_agg(word, ' ' order by e.i) as t, count(*) as n from each e anti join gone using (doc_id, i) group by e.doc_id
)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id
"""


def op2_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(_table(spark, sf_dir, "embeddings"))


OP2 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select vec_id as a, vec_id as b from v union select r.a, u.b from reach r join u on r.b = u.a
), c as (
  select a, min(b) as component_id from reach group by a
), n as (
  select a, count(*) as n from u group by a
)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.component_id, e.vec_id) as component_id, e.vec_id = coalesce(c.component_id, e.vec_id) as kept
from embeddings e left join c on c.a = e.vec_id left join n on n.a = e.vec_id
"""


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.link(_table(spark, sf_dir, "documents"))


OP10 = r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), g as (
  select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d
), n as (
  select doc_id, count(*) as n from g group by doc_id
), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all
), u as (
  select o.a, o.b from o join n x on x.doc_id = o.a join n y on y.doc_id = o.b where 100 * o.o >= 85 * (x.n + y.n - o.o)
), reach as (
  select doc_id as a, doc_id as b from d union select r.a, u.b from reach r join u on r.b = u.a
), c as (
  select a, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from d left join n using (doc_id) join c on c.a = d.doc_id
"""


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.feature_table(_table(spark, sf_dir, "documents"))
    model, _ = quality.fit(features, _table(spark, sf_dir, "labels"))
    return quality.score(features, model)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.sql(f"select -1L as conv_id, stack(2, 0L, 'user', '{probe}', 1L, 'assistant', '{probe}') as (turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digest(chat.format_chats(turns))


_CONTROL = chat.PATTERN.replace("'", "''")
_LEN = {k: len(v) for k, v in (("start", chat.START), ("sep", chat.SEP), ("next", chat.NEXT), ("end", chat.END))}
OP8 = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g')) as n_text, length(regexp_replace(role, '{_CONTROL}', '\\\1', 'g')) as n_role
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n_text + case when before = role then {_LEN["next"]} else n_role + {_LEN["start"] + _LEN["sep"] + _LEN["end"]} end) as bigint) as formatted_chars
from e group by conv_id
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9 = rf"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by encode(source) nulls last) - 1 as k from d group by source
), w as (
  select *, cast(1 + k % 3 as double) as w, {mixing.CAP}::double * source_size as cap from s
), o as (
  select *, row_number() over (order by cap / w, k) as k1,
    (sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from w window b as (order by cap / w, k rows between unbounded preceding and 1 preceding)
), f as (
  select k1 as free, level from o where level * w <= cap order by k1 limit 1
), g as (
  select source, source_size, case when k1 < free then cap else least(f.level * w, cap) end as target,
    ('0x' || substr(md5('20:' || coalesce('s' || source, 'n')), 1, 8))::bigint / 4294967296.0::double as u
  from o, f
), r as (
  select doc_id, size, source_size, target, u, case when source_size > 0 then target / source_size else 0 end as rate,
    row_number() over (partition by d.source order by size, doc_id % (select greatest({mixing.SHARES}, count(*) // {mixing.SHARE_ROWS}) from documents), doc_id) as place
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  cast(case when size > 0 then (floor(place * rate + u) - floor((place - 1) * rate + u)) * size else 0 end as bigint) as taken
from r
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11 = rf"""
with d as (
  select doc_id, row_number() over () as i, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), s as (
  select count(*) filter (len(w) > 0) as n, sum(len(w))::bigint as l from d
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark
), t as (
  select i, term, count(*) as tf from (select i, unnest(w) as term from d) semi join q using (term) group by all
), w as (
  select term, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from t group by term), s
), m as (
  select i, doc_id, 50 + (50 * len(w) * n) // l as m from d, s where len(w) > 0
), x as (
  select t.i, t.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * m)) as score from t join w using (term) join m using (i)
), r as (
  select item_id, doc_id, sum(score)::bigint as score from (select item_id, i, score from q join x using (term)) join m using (i) group by item_id, i, doc_id
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from r where score > 0
qualify rank <= {ranking.TOP}
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP12 = rf"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), t as (
  select lang, source, i, unnest(w) as term from d
), kept as (
  select lang, term from t group by lang, term having count(distinct i) >= {divergence.LEAST_DOCUMENTS}
), g as (
  select distinct lang, source from d
), v as (
  select l.lang, count(k.term)::hugeint as v from (select distinct lang from g) l left join kept k using (lang) group by l.lang
), c as (
  select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all
), n as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c using (lang, source) group by all
), p as (
  select n.lang, n.source, k.term, coalesce(c.n, 0) as n, 1 + ({divergence.SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (total + 2 * v) as p
  from n join v using (lang) join kept k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term
), q as (
  select a.lang, a.term, 1 + ({divergence.SCALE}::hugeint * (a.n + 2)) // (b.total + 2 * v) as q
  from (select lang, term, sum(n)::hugeint as n from c group by all) a join (select lang, sum(total)::hugeint as total from n group by lang) b using (lang) join v using (lang)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(max(s.f), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join (
    select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as f
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) s on s.lang = a.lang and s.source = a.source and s.item = b.source
  group by all
), terms as (
  select p.lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, term) where n > 0 and p > q
), ranked as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms)
)
select * from ranked where part = 'pair' or rank <= {divergence.TOP}
"""


def op13_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


OP13 = rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as i from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), p as (
  select item_id, len(w) as n, w, unnest(range(1, greatest(len(w) - {decontamination.WINDOW - 2}, 2))) as s from b where len(w) > 0
), phrases as (
  select item_id, least(n, {decontamination.WINDOW}) as n, array_to_string(list_slice(w, s, s + {decontamination.WINDOW - 1}), ' ') as h from p
), sizes as (
  select distinct n from phrases
), places as (
  select i, sizes.n, w, unnest(range(1, len(w) - sizes.n + 2)) as s from w, sizes where len(w) >= sizes.n
), hits as (
  select x.i, x.s, x.n, f.item_id from (select i, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as h from places) x join phrases f using (n, h)
), covered as (
  select i, count(distinct k) as n_hit from (select distinct i, unnest(range(s, s + n)) as k from hits) group by i
), items as (
  select i, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct i, item_id::varchar as name from hits where item_id is not null) group by i
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (i) left join items using (i)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_relative_lz_dedup": op1_relative_lz_dedup,
    "op2_grid_order_join": op2_grid_order_join,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_multiset_fingerprints": op4_multiset_fingerprints,
    "op5_pu_quality": op5_pu_quality,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxic_spans": op7_toxic_spans,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_source_mixing": op9_source_mixing,
    "op10_prefix_tree_join": op10_prefix_tree_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_fm_decontamination": op13_fm_decontamination,
}
ORACLE: dict[str, str] = {
    "op1_relative_lz_dedup": OP1,
    "op2_grid_order_join": OP2,
    "op8_chat_formatting": OP8,
    "op9_source_mixing": OP9,
    "op10_prefix_tree_join": OP10,
    "op11_ranked_search": OP11,
    "op12_source_divergence": OP12,
    "op13_fm_decontamination": OP13,
}

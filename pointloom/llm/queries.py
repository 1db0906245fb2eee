"""The numbered queries, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import documents, shared_folder
from pointloom.llm.pipeline import MIX


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.langid import fit, identify

    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir), budget=0.5, weights=MIX)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.quality import fit, score_quality

    docs = documents(spark, sf_dir)
    return score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.decontam import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.rlz import remove_duplicates

    return remove_duplicates(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.merkle import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), n=4, num=85, den=100)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.rindex import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.divergence import divergence

    return divergence(documents(spark, sf_dir), least_documents=10, top=10)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.fim import fill_in_middle, restored

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = fill_in_middle(documents(spark, sf_dir), middle_percent=90, spm_percent=20, epoch=1)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.token_files import default_tokenizer, read_tokens, write_tokens

    folder = f"{shared_folder(spark)}/pointloom-tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder, default_tokenizer("word_bpe_49k.json"), end=2)
    return read_tokens(spark, folder)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_mix_sources, op4_quality, op5_decontaminate, op6_substring_dedup, op7_secret_scan, op8_fingerprints, op9_ngram_join, op10_suffix_dedup, op11_source_divergence, op12_fill_in_middle, op13_token_files, pipeline)}


def _fill(table: str, parent: str, names: str) -> str:
    """SQL of one level of budgeting: table has cap, weight, budget and the names of parent and child."""
    over = f"over (partition by {parent} order by level, {names} rows between"
    return f"""
      select *, case when filled = 1 then cap when weight > 0 and vacant > 0 then least(cap, cast(floor((budget - spent) * weight / vacant) as bigint)) else 0 end as got
      from (select *, sum(case when filled = 1 then cap else 0 end) over (partition by {parent}) as spent,
                   sum(case when filled = 0 then weight else 0.0 end) over (partition by {parent}) as vacant
            from (select *, min(case when weight > 0 and cap <= (budget - before) * weight / after then 1 else 0 end) {over} unbounded preceding and current row) as filled
                  from (select *, coalesce(sum(cap) {over} unbounded preceding and 1 preceding), 0) as before,
                               sum(weight) {over} current row and unbounded following) as after
                        from (select *, case when weight > 0 then cap / weight else 'infinity'::double end as level from {table}))))"""


def _mix_sql(budget: float, weights: dict[str, float], most_epochs: int = 4, seed: int = 17) -> str:
    weight = lambda c: "case " + c + "".join(f" when '{k}' then {v}" for k, v in weights.items()) + " else 1.0 end"
    return f"""
    with doc as (
      select doc_id, 'd' || cast(('0x' || substr(md5(coalesce(source, '(none)')), 1, 4))::bigint % 4 as varchar) as domain, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
             cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens, md5(coalesce(text, '')) as digest from documents),
    tok as (select * from doc where n_tokens > 0),
    leaf as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) * {most_epochs} as bigint) as cap from tok group by all),
    dom as (select 0 as root, domain, cast(sum(cap) as bigint) as cap, {weight("domain")} as weight, (select cast(floor(sum(tokens) * {budget}) as bigint) from leaf) as budget from leaf group by domain),
    dom_got as ({_fill("dom", "root", "domain")}),
    lan as (select l.domain, l.lang, cast(sum(l.cap) as bigint) as cap, {weight("l.lang")} as weight, any_value(d.got) as budget from leaf l join dom_got d using (domain) group by l.domain, l.lang),
    lan_got as ({_fill("lan", "domain", "lang")}),
    src as (select l.*, {weight("l.source")} as weight, g.got as budget from leaf l join lan_got g using (domain, lang)),
    src_got as ({_fill("src", "domain, lang", "source")}),
    plan as (select domain, lang, source, cast(got // tokens as bigint) as whole, cast(got % tokens as bigint) as want from src_got),
    per as (select t.*, p.whole, p.want, ('0x' || substr(md5('{seed}:' || p.whole || ':' || t.doc_id || ':' || t.digest), 1, 13))::bigint as u from tok t join plan p using (domain, lang, source)),
    part as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by u, doc_id, digest rows between unbounded preceding and 1 preceding), 0) as before from per)
    select doc_id, domain, lang, source, cast(e as integer) as epoch, n_tokens, n_tokens as take_tokens from per, unnest(range(whole)) as r(e)
    union all
    select doc_id, domain, lang, source, cast(whole as integer), n_tokens, cast(least(n_tokens, want - before) as bigint) from part where before < want"""


SUBSTRING_SQL = """
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') as g from doc, unnest(range(1, len(w) - 11)) as r(i)),
least_doc as (select g, min(doc_id) as d from win group by g having min(doc_id) < max(doc_id)),
cut as (select distinct doc_id, i + o as j from win join least_doc using (g), unnest(range(13)) as s(o) where doc_id > d),
gone as (select doc_id, list(j) as js from cut group by doc_id),
word as (select doc.doc_id, j, w[j] as word from doc, unnest(range(1, len(w) + 1)) as r(j)),
kept as (select word.doc_id, string_agg(word, ' ' order by word.j) as t, count(*) as n from word anti join cut on word.doc_id = cut.doc_id and word.j = cut.j group by word.doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc left join kept using (doc_id)"""

JOIN_SQL = """
with recursive doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingle as (select distinct doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') as s from doc, unnest(range(1, greatest(len(w) - 2, 2))) as r(i) where len(w) > 0),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from pair join size p on p.doc_id = x join size q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
side as (select x, y from link union all select y, x from link),
reach(x, y) as (select doc_id, doc_id from size union select r.x, s.y from reach r join side s on s.x = r.y),
least_of as (select x, min(y) as m from reach group by x)
select doc.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(m, doc.doc_id) as component_id
from doc left join size using (doc_id) left join least_of on least_of.x = doc.doc_id"""

SUFFIX_SQL = """
with doc as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, md5_number(h[2 * i + 1:2 * i + 200]) as g from doc, unnest(range(len(h) // 2 - 99)) as r(i)),
firsts as (select g, min(struct_pack(d := doc_id, i := i)) as f from win group by g having count(*) > 1),
late as (select doc_id, i from win join firsts using (g) where struct_pack(d := doc_id, i := i) > f),
edge as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from late),
grp as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from edge),
span as (select doc_id, k, min(i) as a, max(i) + 100 as b from grp group by doc_id, k),
gap as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as z from span),
piece as (select g.doc_id, string_agg(h[2 * z + 1:2 * a], '' order by a) as kept, cast(sum(b - a) as bigint) as gone, count(*) as n, max(b) as tail from gap g join doc using (doc_id) group by g.doc_id)
select doc.doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(gone, 0) as n_removed, coalesce(n, 0) as n_spans,
       sha256(unhex(case when tail is null then h else kept || h[2 * tail + 1:] end)) as kept_sha256
from doc left join piece using (doc_id)"""


DIVERGENCE_SQL = """
with doc as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
hit as (select r, lang, source, unnest(w) as term from doc),
cnt as (select lang, source, term, count(*) as n, count(distinct r) as df from hit group by all),
kept as (select lang, term, cast(sum(n) as bigint) as n from cnt group by lang, term having sum(df) >= 10),
vocab as (select lang, count(*) as v, cast(sum(n) as bigint) as n from kept group by lang),
grp as (select distinct lang, source from doc),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as all_n from grp g join kept k using (lang) left join cnt c using (lang, source, term)),
grp_n as (select lang, source, cast(sum(n) as bigint) as n from grid group by all),
share as (select lang, source, term, d.n as n, 1 + 1000000000::hugeint * (d.n + 2) // (g.n + 2 * v) as p, 1 + 1000000000::hugeint * (all_n + 2) // (w.n + 2 * v) as q
          from grid d join grp_n g using (lang, source) join vocab w using (lang)),
pair as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value
         from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
whole as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value
          from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pair p on p.lang = a.lang and p.source = a.source and p.item = b.source),
term as (select lang, source, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from share where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from whole
union all
select * from (select lang, source, 'term' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from term) where rank <= 10"""

MIDDLE_SQL = """
with doc as (select doc_id, coalesce(text, '') as t, sha256('1:' || cast(doc_id as varchar)) as h from documents),
cut as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from doc),
spot as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b from cut),
part as (select doc_id, t, cast(n as bigint) as n, coalesce(array_to_string(w[1:a], ''), '') as pre, coalesce(array_to_string(w[a + 1:b], ''), '') as mid, coalesce(array_to_string(w[b + 1:], ''), '') as suf,
                case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from spot)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from part"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": _mix_sql(0.5, MIX), "op6_substring_dedup": SUBSTRING_SQL, "op9_ngram_join": JOIN_SQL, "op10_suffix_dedup": SUFFIX_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_fill_in_middle": MIDDLE_SQL}

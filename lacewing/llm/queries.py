"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, filter_audit, hmm, licenses, linededup, ngram_join, quality, secrets, sharding, substring_dedup, token_store
from .store import Workspace

SHARDS = 40
QUALITY_POLICY = "v2"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_documents(spark, sf_dir), 3, Fraction(9, 10))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), SHARDS)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_key")


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.stored_ledger(_documents(spark, sf_dir), Workspace(spark, "quality"))
    base = sum(quality.bit(r) for r in quality.BASE_RULES)
    failed = F.col("failed")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (failed.bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
        quality.verdict(failed, QUALITY_POLICY).alias("kept"),
        "n_lines", "n_upper", "failed", quality.decisive(failed, QUALITY_POLICY).alias("decisive"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "tokens")
    manifest = token_store.write(_documents(spark, sf_dir), ws.path("files"), public_tokenizers.path("word_bpe_49k.json"), 2, ws)
    return token_store.read(manifest)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_hmm_scores": op5_hmm_scores,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op11_license_scan": op11_license_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_quality_rules"] = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') text, {_WORDS} w from documents),
g as (select r, unnest(range(1, len(w) - 1)) i, w from d),
h as (select r, i, list_slice(w, i, i + 2) k from g),
dup as (select r, k from h group by r, k having count(*) > 1),
cov as (select distinct h.r, unnest([h.i, h.i + 1, h.i + 2]) p from h join dup on h.r = dup.r and h.k = dup.k),
c as (select r, count(*) n from cov group by r),
l as (select r, unnest(string_split(text, chr(10))) line from d),
u as (select r, count(*) n, count(distinct line) u from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
m as (select doc_id, cast(len(w) as bigint) n_words,
        cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
        cast(coalesce(u.n - u.u, 0) as bigint) n_dup_lines, cast(coalesce(c.n, 0) as bigint) n_repeat_words,
        cast(coalesce(u.n, 0) as bigint) n_lines,
        cast(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as bigint) n_upper
      from d left join c using (r) left join u using (r)),
f as (select *, cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when word_chars < 2 * n_words then 8 else 0 end)
        + (case when word_chars > 25 * n_words then 16 else 0 end) + (case when 10 * n_dup_lines > 5 * n_lines then 32 else 0 end)
        + (case when 10 * n_upper > 7 * word_chars then 64 else 0 end) as bigint) failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 base_failed, (failed & 63) = 0 kept,
       n_lines, n_upper, failed, cast(case when (failed & 63) & ((failed & 63) - 1) = 0 then failed & 63 else 0 end as bigint) decisive from f
"""

ORACLE_SQL["op4_decontamination"] = f"""
with d as (select doc_id, row_number() over () r, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
b1 as (select item_id, w, least(len(w), 13) t from b where len(w) > 0),
bi as (select item_id, w, t, unnest(range(1, len(w) - t + 2)) i from b1),
bw as (select distinct item_id, t, array_to_string(list_slice(w, i, i + t - 1), ' ') k from bi),
ts as (select distinct t from b1),
di as (select r, w, t, unnest(range(1, len(w) - t + 2)) i from d, ts where len(w) >= t),
dw as (select r, t, i, array_to_string(list_slice(w, i, i + t - 1), ' ') k from di),
hit as (select r, dw.t, i, item_id from dw join bw on dw.t = bw.t and dw.k = bw.k),
pos as (select distinct r, unnest(range(i, i + t)) p from hit),
n as (select r, count(*) n from pos group by r),
it as (select r, count(distinct item_id) n, string_agg(distinct item_id, ',' order by item_id) s from hit group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n.n, 0) as bigint) n_hit, cast(coalesce(it.n, 0) as bigint) n_items,
       sha256(coalesce(it.s, '')) items_sha256, coalesce(n.n, 0) > 0 and 20 * coalesce(n.n, 0) >= len(w) contaminated
from d left join n using (r) left join it using (r)
"""

ORACLE_SQL["op8_substring_dedup"] = f"""
with d as (select row_number() over () r, doc_id, {_WORDS} w from documents),
i as (select r, doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13),
k as (select r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') k from i),
m as (select k, min(doc_id) m from k group by k),
p as (select distinct r, unnest(range(i, i + 13)) p from k join m using (k) where m.m < k.doc_id),
x as (select r, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
kept as (select x.r, string_agg(word, ' ' order by x.p) s, count(*) n from x left join p on x.r = p.r and x.p = p.p where p.r is null group by x.r)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) n_removed, sha256(coalesce(kept.s, '')) kept_sha256
from d left join kept using (r)
"""

ORACLE_SQL["op9_line_dedup"] = """
with d as (select row_number() over () r, doc_id, text, string_split(coalesce(text, ''), chr(10)) l from documents),
x as (select r, doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) p from d),
u as (select r, doc_id, line, p, row_number() over (partition by r order by p) j from x where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w as (select r, doc_id, j, line || chr(10) || lead(line, 1) over (partition by r order by j) || chr(10) || lead(line, 2) over (partition by r order by j) k from u),
f as (select k, min({'d': doc_id, 'j': j}) f from w where k is not null group by k),
g as (select distinct r, unnest([j, j + 1, j + 2]) j from w join f using (k) where {'d': w.doc_id, 'j': w.j} > f.f),
gone as (select u.r, u.p from u join g on u.r = g.r and u.j = g.j),
n as (select r, count(*) n from u group by r),
c as (select r, count(*) n from gone group by r),
kept as (select x.r, string_agg(line, chr(10) order by x.p) s from x left join gone on x.r = gone.r and x.p = gone.p where gone.r is null group by x.r)
select doc_id, cast(coalesce(n.n, 0) as bigint) n_lines, cast(coalesce(c.n, 0) as bigint) n_removed, sha256(coalesce(kept.s, '')) kept_sha256
from d left join n using (r) left join c using (r) left join kept using (r)
"""

ORACLE_SQL["op1_ngram_join"] = f"""
with recursive d as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') w from documents),
i as (select doc_id, w, least(len(w), 3) t, unnest(range(1, len(w) - least(len(w), 3) + 2)) i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + t - 1), ' ') k from i),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
pairs as (select a, b from e union all select b, a from e),
reach(doc_id, other) as (select a, b from pairs union select reach.doc_id, pairs.b from reach join pairs on reach.other = pairs.a),
m as (select doc_id, least(doc_id, min(other)) m from reach group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(m.m, d.doc_id) component_id
from d left join n using (doc_id) left join m using (doc_id)
"""

ORACLE_SQL["op12_filter_audit"] = f"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text, {_WORDS} w, min(doc_id) over (partition by coalesce(text, '')) f from documents),
lab as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, [
        len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > f, false)] fails
      from d left join lab using (doc_id)),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) x, unnest([1, 2, 3, 4, 5]) i),
p as (select a.x || b.x || c.x || d.x || e.x filter_order, [a.i, b.i, c.i, d.i, e.i] o from l a, l b, l c, l d, l e
      where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select filter_order, step, o[step] own, o[1:step - 1] before from p, (select unnest([1, 2, 3, 4, 5]) step)),
g as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
x as (select part, filter_order, step, own, n, good, toxic, fails[own] bad, len(list_filter(before, lambda j: fails[j])) > 0 gone, len(list_filter(fails, lambda v: v)) = 1 alone from g, s),
r as (select part, filter_order, step, own, sum(case when not bad and not gone then n else 0 end) kept, sum(case when bad and not gone then n else 0 end) removed,
        sum(case when bad and gone then n else 0 end) redundant, sum(case when bad and alone then n else 0 end) unique_fails,
        sum(case when bad and not gone then good else 0 end) good_lost, sum(case when bad and not gone then toxic else 0 end) toxic_lost
      from x group by all)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
       cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) shapley from r
"""

ORACLE_SQL["op13_collocations"] = f"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
n as (select lang, sum(len(w)) n from w group by lang having sum(len(w)) > 0),
i as (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select unnest([1, 2, 3, 4]) k) where len(w) >= k),
f as (select lang, k, list_slice(w, i, i + k - 1) p, count(*) f from i group by 1, 2, 3 having count(*) >= 30),
cut as (select lang, k, p, f a, unnest(range(1, k)) c from f where k > 1),
s as (select cut.*, x.f l, y.f r, (2000000::hugeint * a) // (x.f + y.f) score
      from cut join f x on x.lang = cut.lang and x.p = list_slice(cut.p, 1, c) join f y on y.lang = cut.lang and y.p = list_slice(cut.p, c + 1, cut.k)),
b as (select lang, p, a, min({{'score': score, 'c': c, 'l': l, 'r': r}}) b from s group by all),
h as (select lang, f, p, k, unnest(range(2, k)) j from f where k > 2),
sub as (select lang, f, j, p, unnest(range(1, k - j + 2)) i from h),
m as (select lang, list_slice(p, i, i + j - 1) p, max(f) f from sub group by 1, 2),
k as (select b.lang, array_to_string(b.p, ' ') phrase, a, b.b.l l, b.b.r r, b.b.score score from b left join m on m.lang = b.lang and m.p = b.p where m.f is null or 100 * m.f < 80 * a),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from k)
select lang, rank, phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r, cast(n as bigint) n, cast(score as bigint) score from t join n using (lang) where rank <= 2000
"""

_TEMPLATES = ", ".join(f"({n}, '{t.label}', {t.base}, {t.words}, {t.key.split()}, {t.key_at})" for n, t in enumerate(licenses.TEMPLATES))
ORACLE_SQL["op11_license_scan"] = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
t(t, label, base, words, key, key_at) as (values {_TEMPLATES}),
i as (select r, w, unnest(range(1, len(w) + 1)) i from d),
h as (select r, t, label, base, words, i, w, i - key_at o from i join t on w[i] = key[1] and list_slice(w, i, i + len(key) - 1) = key),
m as (select r, label, base, i - 1 place, len(words) size, len(list_filter(range(0, len(words)), lambda j: o + j >= 1 and w[o + j] = words[j + 1])) matched from h),
f as (select * from m where base or 2 * matched >= size),
g as (select r, count(*) filter (base) n_base, min(place) filter (base) first_word, max(place) filter (base) last_word,
        coalesce(string_agg(distinct label, ',' order by label) filter (base), '') base_labels, string_agg(distinct label, ',' order by label) labels, max(matched / size) score from f group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, first_word, last_word,
       coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0) score from d left join g using (r)
"""

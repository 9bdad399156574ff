"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import mark_benchmark
from .jaccard import near_duplicates
from .lines import drop_repeated_lines
from .mixing import mix
from .quality import score_quality
from .sharding import shard_documents
from .shared import table
from .substrings import drop_repeated_windows
from .topk import top_k
from .toxicity import score_toxicity
from .urls import Rule, judge_urls

RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))
#: Target shares of sources; all others together have what is left.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, "src4": 0.05}
REST = 0.5
MIX_SEED = 11


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), weights=(1.0,) * 40, grown_weight=1.0)


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies, shuffled with their texts; the text is told by its length."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), WEIGHTS, rest=REST, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "copy", F.octet_length("text").cast("long").alias("size"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), RULES, corpus=pages.select("html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op4_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join("item_ids", ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=9, den=10)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rendezvous_shards, op2_poisson_mix, op3_url_filter, op4_benchmark_windows, op5_repeated_windows, op6_quality, op7_repeated_lines, op8_ngram_jaccard, op9_exact_top_k, op10_toxicity)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]+"


def _mix_sql() -> str:
    """The counts of ``mix``: a recursive Poisson distribution for each source, and the same hash."""
    named = ", ".join(f"'{k}'" for k in WEIGHTS)
    wanted = ", ".join(f"('{k}', {v}::double)" for k, v in WEIGHTS.items())
    return f"""with recursive d as (select doc_id, source, case when source in ({named}) then source else '*' end as g, strlen(coalesce(text, '')) as size, ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 12))::bigint as h from documents),
s as (select g, sum(size) as size from d group by 1), w(g, w) as (values {wanted}, ('*', {REST}::double)),
r as (select g, case when size > 0 then (select sum(size) from s) * w / (select sum(w) from s join w using (g) where size > 0) / size else 1 end as rate from s join w using (g)),
p(g, rate, k, term, total) as (select g, rate, 0, exp(-rate), exp(-rate) from r union all select g, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) from p where k < rate + 60),
n as (select doc_id, source, size, count(*) filter (least(1, total) <= (h + 0.5::double) * pow(2.0::double, -48)) as n from d join p using (g) group by d.doc_id, d.source, d.size)
select doc_id, source, unnest(range(0, n))::int as copy, size::bigint as size from n where n > 0"""


_DECONTAM_SQL = f"""with d as (select doc_id, regexp_extract_all({_LOWERED}, '{_ALPHANUMERIC}') as ws from documents), b as (select item_id::varchar as item, regexp_extract_all({_LOWERED}, '{_ALPHANUMERIC}') as ws from benchmark),
iw as (select distinct item, n, array_to_string(ws[i : i + n - 1], ' ') as win from (select item, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as win from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from iw) where len(ws) >= n)),
h as (select doc_id, i, n, item from dw join iw using (n, win)), c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from h) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c using (doc_id) left join t using (doc_id)"""

_SUBSTRING_SQL = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}') as ws from documents),
w as (select doc_id, i, array_to_string(ws[i : i + 19], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d where len(ws) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as rn from w) where rn > 1), c as (select distinct doc_id, unnest(range(i, i + 20)) as p from r),
k as (select doc_id, p, ws[p] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from d) a anti join c using (doc_id, p)), t as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as kept from k group by 1)
select doc_id, len(ws)::bigint as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (doc_id)"""

_LINE_SQL = """with d as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
w as (select doc_id, i, array_to_string(ls[i : i + 2], chr(10)) as win from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as i from d where len(ls) >= 3)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as rn from w) where rn > 1), c as (select distinct doc_id, unnest(range(i, i + 3)) as p from r),
k as (select doc_id, p, ls[p] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as p from d) a anti join c using (doc_id, p)), t as (select doc_id, count(*) as n, string_agg(line, chr(10) order by p) as kept from k group by 1)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(ls) - coalesce(n, 0), 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join d using (doc_id) left join t using (doc_id)"""

_JACCARD_SQL = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWERED}, '{_NOT_SPACE}') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i : i + 2], ' ') end as g from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= 90 * (a.n + b.n - c)),
reach(x, y) as (select x, y from l union select r.x, l.y from reach r join l on r.y = l.x)
select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce((select min(y) from reach where x = doc_id), doc_id)) as component_id from d left join n using (doc_id)"""

_TOP_K_SQL = """with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(embedding) > 0),
s as (select a.row, a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.row <> b.row and a.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s) where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """Sharding has none since no SQL function here makes a CRC-32; the url filter and the classifiers have trained parts."""
    return {"op2_poisson_mix": _mix_sql(), "op4_benchmark_windows": _DECONTAM_SQL, "op5_repeated_windows": _SUBSTRING_SQL, "op7_repeated_lines": _LINE_SQL, "op8_ngram_jaccard": _JACCARD_SQL, "op9_exact_top_k": _TOP_K_SQL}

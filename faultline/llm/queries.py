"""Queries of the corpus operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, langid, line_dedup, ngram_join, packing, pii, quality, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "closest_lang", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *(pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.MORE))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(more)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


#: The rules of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"), F.array_join("words", " ").alias("words"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, lines removed, and digest and length of what is left."""
    cleaned = line_dedup.dedup(table(spark, sf_dir, "documents"), short=line_dedup.SHORT)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pack, op3_language_id, op4_ngram_join, op5_quality_rules, op6_pii, op7_chat_format, op8_token_counts, op9_url_filter, op10_line_dedup)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') g from (select *, unnest(generate_series(1, greatest(1, len(w) - 9))) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') g from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
words as (select doc_id, count(distinct p) k from (select doc_id, unnest(generate_series(i, i + n - 1)) p from hit) group by doc_id),
items as (select doc_id, count(*) k, string_agg(item, ',' order by item) s from (select distinct doc_id, cast(item_id as varchar) item from hit) group by doc_id),
pos as (select doc_id, unnest(w) t, unnest(generate_series(1, len(w))) p from d),
freq as (select t, count(*) f from pos group by t),
gs as (select g, unnest(string_split(g, ' ')) t, unnest(generate_series(1, n)) o from (select distinct g, n from bw)),
anchor as (select g, arg_min(gs.t, (coalesce(f, 0), o)) t from gs left join freq on gs.t = freq.t group by g),
terms as (select g, t, count(*) over (partition by g) k from (select distinct g, t from gs)),
met as (select a.g, x.doc_id, x.p from anchor a join pos x on a.t = x.t),
full_met as (select met.g, met.doc_id, met.p from met join terms on met.g = terms.g join pos y on y.doc_id = met.doc_id and y.t = terms.t and abs(y.p - met.p) <= {decontaminate.SLOP} group by all having count(distinct y.t) = any_value(terms.k)),
near as (select doc_id, count(distinct item_id) k from full_met join bw on full_met.g = bw.g group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(words.k, 0) as bigint) n_hit, cast(coalesce(items.k, 0) as bigint) n_items, sha256(coalesce(items.s, '')) items_sha256, coalesce(words.k, 0) > 0 contaminated, cast(coalesce(near.k, 0) as bigint) n_near
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id left join near on d.doc_id = near.doc_id"""

NGRAM_JOIN_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, array_to_string(w[i:i+least(len(w), 4)-1], ' ') s from (select *, unnest(generate_series(1, greatest(1, len(w) - 3))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from g group by doc_id),
p as (select x.doc_id a, y.doc_id b, count(*) k from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
r as (select doc_id, doc_id as c from d union select l.b, r.c from r join l on r.doc_id = l.a)
select d.doc_id, cast(coalesce(max(n.n), 0) as bigint) n_shingles, min(r.c) component_id from d join r on d.doc_id = r.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in (x.decode() for x in chat.CONTROLS):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
s as (select *, length('<|im_start|>') + length({_escaped_sql('role')}) + 1 + length({_escaped_sql('text')}) + length('<|im_end|>') + 1 as n from t)
select conv_id, cast(count(*) as bigint) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256, cast(sum(n) as bigint) formatted_chars
from s group by conv_id"""

ORACLES: dict[str, str] = {"op1_decontaminate": DECONTAMINATE_SQL, "op4_ngram_join": NGRAM_JOIN_SQL, "op7_chat_format": CHAT_SQL}

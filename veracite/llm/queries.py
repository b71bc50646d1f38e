"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, lines, packing, pieces, quality, simhash, spotsigs, substrings, token_counts, toxicity
from .common import fold_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 4) == 2
    model = quality.fit(docs.where(~held_out), labels, held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels, held_out=fold_of("doc_id", 3) == 1)
    return toxicity.score(docs, net).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), window=35)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), words=3, distance=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.array_join("removed_lines", ",").alias("removed_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_ann": op2_ann,
    "op3_toxicity": op3_toxicity,
    "op4_substrings": op4_substrings,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_pieces": op7_pieces,
    "op8_spotsigs": op8_spotsigs,
    "op9_token_counts": op9_token_counts,
    "op10_lines": op10_lines,
}

_OP4 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w from documents),
h as (select doc_id, case when len(w) >= 35 then [md5(array_to_string(w[i : i + 34], ' ')) for i in range(1, len(w) - 33)] else [] end as hs from d),
p as (select doc_id, unnest(hs) as h, generate_subscripts(hs, 1) as s from h),
r as (select doc_id, list(s) as starts from p where h in (select h from p group by h having count(*) > 1) group by doc_id),
c as (select doc_id, list_distinct(flatten([range(s, s + 35) for s in starts])) as gone from r),
x as (select d.doc_id, w, c.gone, unnest(case when len(w) = 0 then [null] else w end) as word, generate_subscripts(case when len(w) = 0 then [null] else w end, 1) as i from d left join c using (doc_id)),
k as (select doc_id, any_value(len(w)) as n_words, count(*) filter (word is not null and gone is not null and list_contains(gone, i)) as n_removed,
  coalesce(string_agg(word, ' ' order by i) filter (gone is null or not list_contains(gone, i)), '') as kept from x group by doc_id)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from k"""

_OP10 = r"""
with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as k from l),
w as (select doc_id, k, doc_id * 1000000 + k as pos, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') as w from e),
v as (select pos, len(w) as n, unnest([array_to_string(case when i = 0 then w else list_concat(w[1 : i - 1], w[i + 1 :]) end, ' ') for i in range(0, case when len(w) >= 5 then len(w) + 1 else 1 end)]) as v,
  unnest(range(0, case when len(w) >= 5 then len(w) + 1 else 1 end)) as i from w where len(w) > 0),
whole as (select v, min(pos) as first, min(pos) filter (n >= 5) as first5 from v where i = 0 group by v),
same as (select v, i, min(pos) as first from v where i > 0 group by v, i),
less as (select v, min(pos) as first from v where i > 0 group by v),
g as (select distinct v.pos from v left join whole using (v) left join same on same.v = v.v and same.i = v.i left join less on less.v = v.v
  where (v.i = 0 and whole.first < v.pos) or (v.i > 0 and (same.first < v.pos or whole.first5 < v.pos)) or (v.i = 0 and n >= 5 and less.first < v.pos))
select doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(case when g.pos is not null then k end, ',' order by k), '') as removed_lines
from w left join g using (pos) group by doc_id"""

ORACLE: dict[str, str] = {"op4_substrings": _OP4, "op10_lines": _OP10}

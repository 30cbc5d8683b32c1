"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm.lines import SQL as LINES_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals (by doc_id's checksum) are appended and compacted; the rows are what the last version holds."""
    from corvina.llm._base import shared_root
    from corvina.llm.shards import ShardStore

    store = ShardStore(spark, f"{shared_root(spark)}/shards-{uuid.uuid4().hex}", target_bytes=64 << 20)
    docs = table(spark, sf_dir, "documents")
    store.append(docs.withColumn("arrival_no", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(8))), "arrival_no")
    version = store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(version).cast("long").alias("version"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm.langid import identify

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return identify(table(spark, sf_dir, "documents"), held_out)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm._base import Scratch
    from corvina.llm.mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing")).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm._base import Scratch
    from corvina.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "neardup"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm._base import Scratch
    from corvina.llm.lines import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Scratch(spark, "lines"), counts=True)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm._base import Scratch
    from corvina.llm.jaccard import groups

    return groups(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard", counted=True), counts=True)


#: A model file given to the project; another may be named in the environment.
PIECES = os.environ.get("CORVINA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's pieces, and the text that they decode to."""
    from corvina.llm.pieces import encode_and_decode

    both = encode_and_decode(table(spark, sf_dir, "documents"), PIECES)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages are written as archives, read back, and assembled; bodies are checked against their digests and not kept."""
    from corvina.llm import warc
    from corvina.llm._base import Scratch

    scratch = Scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), f"{scratch.root}/archives", scratch)
    captures = warc.assemble(scratch.save(warc.read(spark, f"{scratch.root}/archives", bodies=False)))
    r = F.col("response")
    return captures.select("page_id", r.payload_bytes.alias("payload_bytes"), r.payload_digest.alias("payload_digest"), r.type.alias("record_type"), "refers_to", F.coalesce(r.whole, F.lit(True)).alias("whole"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm.quality import quality

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm._base import Scratch
    from corvina.llm.resample import resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "resample"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The byte-level tokenizer's file; another may be named in the environment.
BYTE_LEVEL = os.environ.get("CORVINA_BYTE_LEVEL", "/opt/tokenizers/byte_bpe_50k.json")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm._base import Scratch
    from corvina.llm.align import align

    return align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, Scratch(spark, "align"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash of the base rules' spans, and all spans."""
    from corvina.llm._base import Scratch
    from corvina.llm.pii import BASE, detect, digest

    found = detect(table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint) as n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_mixing, op4_embedding_neardup, op5_line_dedup, op6_html, op7_jaccard_join, op8_sentencepiece, op9_warc, op10_quality, op11_resample, op12_align, op13_pii)}

OP1_SQL = "select doc_id, lang, source, n_chars, md5(text) as text_md5, 2::bigint as version from documents"

OP9_SQL = """
with d as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
e as (select *, octet_length(encode(html))::bigint as n, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (1 + 5 * i)::int, 5))::bigint >> b) & 31) + 1)::int, 1)), '')), '') as digest from d),
m as (select *, max(page_id) over (partition by digest, n) as original from e)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id = original then null else original end as refers_to, true as whole from m
"""

GROUPED = """select {id}, r as component_id from (
  with recursive e as (select x, y from l union all select y, x from l), g(v, r) as (select {id}, {id} from {all} union select e.y, g.r from g join e on e.x = g.v)
  select v as {id}, min(r) as r from g group by v)"""

#: Quadratic in a label's vectors: for small tables.
OP4_SQL = f"""
with v as (select distinct vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null and label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select *, sqrt(list_dot_product(e, e)) as norm from v),
l as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
n as (select v as vec_id, count(*) as n from (select x as v from l union all select y from l) group by v),
c as ({GROUPED.format(id="vec_id", all="embeddings")})
select m.vec_id, coalesce(n, 0)::bigint as n_links, component_id::bigint as component_id, m.vec_id = component_id as kept from embeddings m join c on c.vec_id = m.vec_id left join n on n.vec_id = m.vec_id
"""

#: A join on shingles: for small tables.
OP7_SQL = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 80 * (a.n + b.n - i)),
k as (select v as doc_id, count(*) as k from (select x as v from l union all select y from l) group by v),
c as ({GROUPED.format(id="doc_id", all="documents")})
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id::bigint as component_id, coalesce(k, 0)::bigint as n_links
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id left join k on k.doc_id = d.doc_id
"""

#: Buckets by a CRC-32 of its own, whose table is made from the polynomial. Exact counts; logarithms in doubles.
OP11_SQL = r"""
with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
txt as (select row_number() over () as r, 0 as side, doc_id, text from documents union all select row_number() over (), 1, null, text from benchmark),
w as (select r, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from txt),
b as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))::bigint), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::int, 2))::bigint)),
    lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::int])), 4294967295) % 10000 as b from (select distinct w from w), crc),
f as (select r, side, b from w join b using (w)),
n as (select b, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f group by b),
all_n as (select count(*) filter (side = 0) as s_all, count(*) filter (side = 1) as t_all from f),
g as (select b, floor(1000 * ln(((t + 1)::double * (s_all + 10000)::double) / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from n, all_n),
d as (select r, count(*) as n, floor(sum(gain)::bigint / count(*))::bigint as weight from f join g using (b) where side = 0 group by r),
h as (select r, doc_id, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from txt where side = 0),
z as (select doc_id, r, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from h left join d using (r)),
k as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features, r) end as place, (select count(*) from z where n_features >= 20) as eligible from z)
select doc_id, n_features, weight, score, case when place <= 10 * eligible // 100 then place end as rank from k
"""

ORACLES: dict[str, str] = {"op1_sharding": OP1_SQL, "op4_embedding_neardup": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op5_line_dedup": LINES_SQL, "op9_warc": OP9_SQL, "op11_resample": OP11_SQL}

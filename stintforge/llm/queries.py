"""The registered queries of this subpackage: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, mixing, packing, quality, secrets, simhash, tokens, toxicity, transport
from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
#: Rows of one Arrow batch: whole texts pass, so batches are kept small.
BATCH = "512"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return table(spark, sf_dir, "documents")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), cap=3).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = language.learn(docs.where("not held_out"))
    return language.predict(docs, model, keep=["doc_id", "held_out"])


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    counts = [F.size(F.expr(f"filter(secrets, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.rendered(base).cast("binary"), 256).alias("base_sha256"), secrets.rendered(F.col("secrets")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = transport.read(transport.store(documents(spark, sf_dir)))
    last = F.when(F.size("times") > 0, F.element_at("times", -1)).otherwise(-1)
    feature = F.concat_ws(
        ";", F.concat(F.lit("programs="), "programs"), F.concat(F.lit("streams="), "streams"), F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), "elementary_packets"),
        F.concat(F.lit("gaps="), "continuity_gaps"), F.concat(F.lit("repeats="), "repeated_packets"), F.concat(F.lit("faults="), "faults"), F.concat(F.lit("last="), last), F.concat(F.lit("random="), F.size("random_access")),
    )
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_mixing, op2_language, op3_fingerprint, op4_secrets, op5_packing, op6_quality, op7_transport, op8_simhash, op9_tokens, op10_toxicity)
}

_CLOSE = """
free{k} as (
  select r.source, r.v, r.size, abs(t.gap - r.size) as off from rest r join state{j} t on r.source is not distinct from t.source
  where {better} and not list_contains(t.picks, {{'v': r.v, 'size': r.size}})
), pick{k} as (
  select source, v, size from free{k} qualify row_number() over (partition by source order by off, v, size) = 1
), state{k} as (
  select t.source, t.gap - coalesce(p.size, 0) as gap, case when p.v is null then t.picks else list_append(t.picks, {{'v': p.v, 'size': p.size}}) end as picks
  from state{j} t left join pick{k} p on t.source is not distinct from p.source
),"""
_STEPS = "".join(_CLOSE.format(j=k - 1, k=k, better="t.gap - r.size >= 0" if k < mixing.CLOSERS else "abs(t.gap - r.size) < t.gap") for k in range(1, mixing.CLOSERS + 1))

#: The same rows in SQL.  The other operators hash, train, tokenise or iterate in ways SQL cannot express.
ORACLE: dict[str, str] = {
    "op1_mixing": rf"""
with hashed as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 12))::bigint as digest
  from documents
), repeats as (
  select *, row_number() over (partition by doc_id, source, size, digest) as nth, length(bin(size)) as weight from hashed
), base as (
  select *, ((case when nth = 1 then digest else ('0x' || substr(md5(digest::varchar || ':' || nth::varchar), 1, 12))::bigint end)::double + 0.5) / 281474976710656.0 as u from repeats
), classes as (
  select source, weight, sum(size)::bigint as words from base group by source, weight
), sums as (
  select source, sum(words)::bigint as source_size from classes group by source
), weighed as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as share, source_size * 3 as most from sums
), levelled as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by most::double / share, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(share) over (order by most::double / share, source nulls last rows between current row and unbounded following))::double as level from weighed
), goals as (
  select source, source_size, least(most::double, (max(case when level * share <= most then level end) over ()) * share) as target from levelled
), filled as (
  select c.weight, c.words, g.*, (coalesce(sum(words) over (partition by c.source order by weight desc rows between unbounded preceding and 1 preceding), 0) * 3)::bigint as taken_up,
    (sum(weight * words) over (partition by c.source order by weight desc rows between current row and unbounded following))::bigint as open
  from classes c join goals g on c.source is not distinct from g.source
), inner_level as (
  select *, case when open > 0 then (target - taken_up) / open::double end as level from filled
), expected as (
  select *, least(3.0::double, (max(case when level * weight <= 3 then level end) over (partition by source)) * weight) as copies from inner_level
), split as (
  select *, floor(copies) as whole, copies - floor(copies) as part from expected
), plan as (
  select *, target - (sum(whole::bigint * words) over (partition by source))::bigint as room from split
), ranked as (
  select b.doc_id, b.size, b.nth, p.source, p.source_size, p.target, p.whole, p.part, p.room,
    case when part > 0 then ((u / (1 - u)) / (part / (1 - part))) / (1 + (u / (1 - u)) / (part / (1 - part))) end as v
  from base b join plan p on b.source is not distinct from p.source and b.weight = p.weight
), sampled as (
  select *, sum(size) over (partition by source order by v range between unbounded preceding and current row) <= room as chosen from ranked where v is not null and size > 0
), rest as (
  select source, v, size from sampled where not chosen
), state0 as (
  select source, any_value(room) - sum(case when chosen then size else 0 end) as gap, []::struct(v double, size bigint)[] as picks from sampled group by source
),{_STEPS} final as (
  select r.*, whole + case when r.v is not null and r.size > 0 and (coalesce(s.chosen, false) or list_contains(t.picks, {{'v': r.v, 'size': r.size}})) then 1 else 0 end as n
  from ranked r left join (select distinct source, v, size, chosen from sampled) s on r.source is not distinct from s.source and r.v = s.v and r.size = s.size
  left join state{mixing.CLOSERS} t on r.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * n)::bigint as taken, source, n::bigint as copies from final
""",
}

"""The ``opN_`` queries: each applies its operator with production parameters to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.llm import alignment, chat, ctw, decontam, htmlmain, mixing, mpeg, quality, sharding, simhash, toxicity, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), sharding.text_group(text).alias("text_group"))
    done = sharding.shard(docs, F.col("size"), F.col("text_group"), F.col("doc_id"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract_pages(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L as conv_id, t as turn, element_at(array('user', 'assistant'), cast(t as int) + 1) as role, '</s>[INST] ok [/INST]' as text from (select explode(array(0L, 1L)) as t)")
    records = chat.conversations_to_records(rows.unionByName(extra))
    # The query's contract has role names as they are.
    return chat.digest(chat.format_chat(chat.canonical_turns(records, "record", rename=False)))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.text_round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "second_position")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_inner_products(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _chat_sql() -> str:
    """The chat digests in SQL: escapes lengthen a text by its backslashes and by each control string in it."""
    quoted = [c.replace("'", "''") for c in chat.CONTROLS]
    found = " + ".join(f"cast((length(text) - length(replace(text, '{c}', ''))) / {len(c)} as bigint)" for c in quoted)
    return f"""with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, t, case t when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) x(t)),
    e as (select *, length(text) - length(replace(text, '\\', '')) + {found} as extra from r)
    select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
        cast(sum({len(chat.START)} + length(role) + 1 + length(text) + extra + {len(chat.END)} + 1) as bigint) as formatted_chars
    from e group by conv_id"""


def _floors(scale: int) -> str:
    """(vec_id, label, v): the scaled integer vectors of the rows that hold only finite components."""
    return f"""select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
        where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)"""


def _codes_sql(rounds: int = 6, entries: int = 16) -> str:
    """Codebooks of eight parts in plain SQL: a round is an assignment to the nearest entry and the floors of the members' means."""
    near = """select p.part, p.vec_id, min(list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::hugeint * 16 + entry) as best
        from parts p join book{0} b on p.part = b.part group by p.part, p.vec_id"""
    steps = [
        f"kept as ({_floors(4096)})",
        "parts as materialized (select vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] as q from kept, range(8) t(part))",
        f"book0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, q as c from parts qualify entry < {entries})",
    ]
    for r in range(rounds):
        steps += [
            f"near{r} as materialized ({near.format(r)})",
            f"sums{r} as (select part, n.best % 16 as entry, i, sum(q[i]) as s, count(*) as n from near{r} n join parts using (part, vec_id), range(1, len(q) + 1) t(i) group by all)",
            f"means{r} as (select part, entry, list((s - ((s % n) + n) % n) // n order by i) as c from sums{r} group by part, entry)",
            f"book{r + 1} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from book{r} b left join means{r} m using (part, entry))",
        ]
    steps += [
        f"last as materialized ({near.format(rounds)})",
        "coded as (select vec_id, string_agg(printf('%02x', cast(best % 16 as integer)), '' order by part) as code, cast(sum(best // 16) as bigint) as error from last group by vec_id)",
        f"digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})",
    ]
    return f"""with {", ".join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from coded join kept using (vec_id), digest"""


def _top_k_sql(k: int = 20, every: int = 20) -> str:
    return f"""with kept as materialized ({_floors(64)}),
    scored as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
        from kept q join kept c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored qualify rank <= {k}"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": _chat_sql(), "op11_vector_codes": _codes_sql(), "op12_exact_top_k": _top_k_sql()}

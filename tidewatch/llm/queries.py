"""The queries of this subpackage: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import ann, chat, counts, license, packing, phrases, pii, pq, quality, secrets, simhash, spm, topk
from tidewatch.llm.scratch import cut
from tidewatch.llm.spread import join_spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted text and its loss mask."""
    said = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").union(more.select("conv_id", F.col("turn").cast("long"), "role", "text"))
    out = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    out = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: tuple[str, ...], kind_first: bool) -> Column:
    """Spans by kind as listed (then kinds that the method adds) and start, or by start and then kind."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), s["kind"]), F.lit(0)), F.lit(99)).cast("long")
    keyed = F.transform(spans, lambda s: F.struct(*([rank(s).alias("a"), s["start"].alias("b")] if kind_first else [s["start"].alias("a"), rank(s).alias("b")]), s["end"].alias("c"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(keyed)


def spans_query(found: DataFrame, kinds: tuple[str, ...], kind_first: bool) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("key").alias("doc_id"), *map(count, kinds), F.sha2(span_digest(ordered(F.col("base"), kinds, kind_first)), 256).alias("base_sha256"),
        span_digest(ordered(F.concat("base", "added"), kinds, kind_first)).alias("spans"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_query(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS, True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("key", "doc_id")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 64))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & fine).select("vec_id", whole.alias("vec"))
    out = topk.exact_topk(spark, rows, rows.where(F.col("vec_id") % 20 == 0), 20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_query(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS, False)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = ann.nearest(spark, rows, rows.where(F.col("vec_id") % 100 == 0), 10)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("key", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("key").alias("doc_id"), F.col("host").alias("source"), F.col("path").alias("lang"), "evidence", "prior", "posterior", "keep")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(spark, table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache that is empty at first: every distinct text is a miss, every copy a hit."""
    out = counts.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = pq.fit_codes(spark, table(spark, sf_dir, "embeddings"))
    codes, _ = cut(spark, codes)
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = join_spread(spark, codes, by_label, ["label"])
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(pq.book_digest(book)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_simhash, op3_pii, op4_packing, op5_exact_topk, op6_secrets, op7_ann, op8_sentencepiece, op9_quality, op10_license,
        op11_collocations, op12_token_counts, op13_vector_codes,
    )
}


def rounds_sql(rounds: int) -> str:
    """Each round's codes (nearest entry, ties to the lower index) and codebooks, by part position ``p``, entry ``e`` and component ``w``."""
    near = """
        a{n} as materialized (
            select vec_id, p, arg_min(e, (d, e)) as e, min(d) as d from (
                select x.vec_id, x.p, c.e, cast(list_sum([(y[1] - y[2]) * (y[1] - y[2]) for y in list_zip(x.w, c.w)]) as bigint) as d from x join c{n} c using (p))
            group by vec_id, p)"""
    move = """,
        c{m} as materialized (
            select c.p, c.e, coalesce(s.w, c.w) as w from c{n} c left join (
                select p, e, list(v order by i) as w from (
                    select p, e, i, cast((s - ((s % n) + n) % n) // n as bigint) as v from (
                        select x.p, a.e, t.i, sum(x.w[t.i]) as s, count(*) as n from x join a{n} a using (vec_id, p), range(1, len(x.w) + 1) t(i) group by all))
                group by p, e) s using (p, e)),"""
    return "".join(near.format(n=n) + (move.format(n=n, m=n + 1) if n < rounds else "") for n in range(rounds + 1))


#: Where SQL states the result: op1's digests (its template's own length among them) and op5's exact answer.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
               cast(sum(15 + length(role) + length(text)
                   + length(regexp_replace(role || text, '[^<>\\]', '', 'g'))) as bigint) as formatted_chars,
               cast(0 as bigint) as n_attachments, cast(0 as bigint) as expanded_tokens
        from t group by conv_id
    """,
    "op5_exact_topk": """
        with v as (
            select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as w
            from embeddings where vec_id is not null
              and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
        ),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.w, c.w)]) as bigint) as score
            from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
        ) where rank <= 20
    """,
    "op11_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, row_number() over () as piece, p from (
                select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
                from documents)
        ),
        ws as (
            select lang, w as w1, lead(w, 1) over (partition by piece order by i) as w2, lead(w, 2) over (partition by piece order by i) as w3
            from (select lang, piece, unnest(ws) as w, generate_subscripts(ws, 1) as i
                  from (select lang, piece, [w for w in regexp_split_to_array(p, '[\x20\x09]') if w <> ''] as ws from pieces))
        ),
        f as materialized (
            select lang, 1 as m, w1 as phrase, count(*) as f from ws group by all union all
            select lang, 2, w1 || ' ' || w2, count(*) from ws where w2 is not null group by all union all
            select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from ws where w3 is not null group by all
        ),
        total as (select lang, sum(f) as n from f where m = 1 group by lang),
        cand as materialized (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1 and f >= 10),
        cuts as (
            select lang, phrase, a, k, array_to_string(ws[1 : k], ' ') as head, array_to_string(ws[k + 1 : m], ' ') as tail
            from cand, range(1, 3) t(k) where k < m
        ),
        scored as (
            select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, (1000000 * cast(a as hugeint) * a) // (cast(l.f as hugeint) * r.f) as score
            from cuts c join f l on l.lang = c.lang and l.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.tail
        ),
        lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        inside as (
            select lang, phrase, max(a) as most from (
                select lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) as phrase, a from cand where m = 3)
            group by lang, phrase
        ),
        kept as (select x.* from lowest x left join inside i using (lang, phrase) where i.most is null or 100 * i.most < 50 * x.a)
        select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, cast(a as bigint) as a,
               cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
        from kept join total using (lang) qualify rank <= 2000
    """,
    "op13_vector_codes": f"""
        with v as materialized (
            select vec_id, label, [cast(floor(4096 * cast(x as double)) as bigint) for x in embedding] as w from embeddings
            where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
        ),
        x as materialized (select vec_id, cast(p as int) as p, w[p * (len(w) // 8) + 1 : (p + 1) * (len(w) // 8)] as w from v, range(0, 8) t(p)),
        first as (select vec_id, row_number() over (order by vec_id) - 1 as e from v qualify e < 16),
        c0 as (select p, e, w from first join x using (vec_id)),
        {rounds_sql(6)},
        coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a6 group by vec_id),
        books as (select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) as codebooks_sha256 from c6)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join v using (vec_id), books
    """,
}

"""Text metrics, run metrics and checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ...functions import ids as I
from ...operators import quality, run_metrics, text_metrics
from ...operators.loader import with_batch
from ...operators.quantiles import exact_quantiles
from ..corpus import byte_length, corpus_blocks
from .registry import documents, query, sql_words, table


@query(
    "perplexity_macro_micro",
    """WITH b AS (SELECT user_id, avg(value / 100) AS m FROM events GROUP BY user_id)
    SELECT 'macro' AS mode, round(exp(avg(m)), 6) AS perplexity FROM b
    UNION ALL SELECT 'micro', round(exp(avg(value / 100)), 6) FROM events""",
)
def perplexity_macro_micro(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("loss"))
    both = text_metrics.perplexity(log, "loss", "user_id", "macro").unionByName(
        text_metrics.perplexity(log, "loss", mode="micro")
    )
    return both.withColumn("perplexity", F.round("perplexity", 6))


@query(
    "unigram_perplexity",
    f"""WITH t AS (SELECT doc_id, unnest({sql_words("text")}) AS token FROM documents),
      c AS (SELECT token, count(*) AS c FROM t GROUP BY token), s AS (SELECT sum(c) + count(*) AS s FROM c)
    SELECT doc_id, count(*) AS n_words, round(exp(-avg(ln((c + 1)::DOUBLE / s::DOUBLE))), 3) AS perplexity
    FROM t JOIN c USING (token), s GROUP BY doc_id""",
)
def unigram_perplexity(spark, sf_dir):
    out = text_metrics.unigram_perplexity(documents(spark, sf_dir, "doc_id", "text"))
    return out.withColumn("perplexity", F.round("perplexity", 3))


def _drop_every(n):
    return F.array_join(F.filter(I.words("text"), lambda w, i: (i + 1) % n != 0), " ")


def _sql_drop_every(n):
    return f"array_to_string(list_filter({sql_words('text')}, lambda w, i: i % {n} <> 0), ' ')"


def _sql_grams(source: str, ns) -> str:
    """Rows ``id, src, n, gram`` of the word lists ``w``."""
    return " UNION ALL ".join(
        f"""SELECT id, src, {n} AS n, unnest(list_transform(range(1, len(w) - {n} + 2),
          lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS gram FROM {source} WHERE len(w) >= {n}"""
        for n in ns
    )


def _bleu_sql() -> str:
    ns = range(1, 5)
    pooled = ", ".join(
        f"""coalesce(sum(least(h, r)) FILTER (n = {n}), 0)::BIGINT AS matched_{n},
        coalesce(sum(h) FILTER (n = {n}), 0)::BIGINT AS total_{n}"""
        for n in ns
    )
    logs = " + ".join(f"ln(matched_{n}::DOUBLE / total_{n})" for n in ns)
    columns = ", ".join(f"matched_{n}, total_{n}" for n in ns)
    return f"""WITH p AS (SELECT doc_id AS id, {sql_words(_sql_drop_every(7))} AS h, {sql_words("text")} AS r0,
        {sql_words(_sql_drop_every(5))} AS r1 FROM documents),
      l AS (SELECT id, -1 AS src, h AS w FROM p UNION ALL SELECT id, 0, r0 FROM p UNION ALL SELECT id, 1, r1 FROM p),
      g AS ({_sql_grams("l", ns)}),
      c AS (SELECT id, src, n, gram, count(*) AS c FROM g GROUP BY ALL),
      o AS (SELECT id, n, gram, coalesce(max(c) FILTER (src < 0), 0) AS h, coalesce(max(c) FILTER (src >= 0), 0) AS r
        FROM c GROUP BY ALL),
      q AS (SELECT {pooled} FROM o),
      z AS (SELECT sum(len(h))::BIGINT AS hyp_len, sum(CASE
          WHEN abs(len(r0) - len(h)) < abs(len(r1) - len(h)) THEN len(r0)
          WHEN abs(len(r0) - len(h)) > abs(len(r1) - len(h)) THEN len(r1)
          ELSE least(len(r0), len(r1)) END)::BIGINT AS ref_len, count(*) AS n_pairs FROM p),
      x AS (SELECT *, CASE WHEN hyp_len >= ref_len THEN 1 ELSE exp(1 - ref_len::DOUBLE / hyp_len) END AS bp FROM q, z)
    SELECT {columns}, hyp_len, ref_len, n_pairs, round(bp, 6) AS brevity_penalty, round(bp * exp(({logs}) / 4), 6) AS bleu FROM x"""


@query("corpus_bleu", _bleu_sql())
def corpus_bleu(spark, sf_dir):
    pairs = documents(spark, sf_dir, "doc_id", "text").select(
        F.col("doc_id").alias("id"),
        _drop_every(7).alias("hyp"),
        F.array("text", _drop_every(5)).alias("refs"),
    )
    out = text_metrics.corpus_bleu(pairs)
    return out.withColumns(
        {"brevity_penalty": F.round("brevity_penalty", 6), "bleu": F.round("bleu", 6)}
    )


def _turn_pairs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        _drop_every(7).alias("hyp"),
        F.col("text").alias("ref"),
    )


_PAIR_WORDS = f"""p AS (SELECT conv_id * 1000 + turn AS id, {sql_words(_sql_drop_every(7))} AS h, {sql_words("text")} AS r
  FROM conversations)"""


@query(
    "rouge_n",
    f"""WITH {_PAIR_WORDS}, l AS (SELECT id, -1 AS src, h AS w FROM p UNION ALL SELECT id, 0, r FROM p),
      g AS ({_sql_grams("l", (1, 2))}),
      c AS (SELECT id, n, gram, count(*) FILTER (src < 0) AS h, count(*) FILTER (src >= 0) AS r FROM g GROUP BY ALL),
      s AS (SELECT id, n, sum(least(h, r)) AS b, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL),
      e AS (SELECT id, unnest([1, 2]) AS n FROM p),
      f AS (SELECT id, n, coalesce(CASE WHEN r > 0 THEN b / r::DOUBLE END, 0) AS recall,
        coalesce(CASE WHEN h > 0 THEN b / h::DOUBLE END, 0) AS precision FROM e LEFT JOIN s USING (id, n))
    SELECT n, count(*) AS n_pairs, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
      round(avg(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END), 6) AS f1
    FROM f GROUP BY n""",
)
def rouge_n(spark, sf_dir):
    scores = text_metrics.mean_scores(text_metrics.rouge_n(_turn_pairs(spark, sf_dir)), ["n"])
    return scores.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


# The hypothesis is a subsequence of the reference, so the LCS is the hypothesis.
@query(
    "rouge_l",
    f"""WITH {_PAIR_WORDS}, s AS (SELECT id, len(h) AS lcs, CASE WHEN len(r) > 0 THEN len(h) / len(r)::DOUBLE ELSE 0 END AS recall,
        CASE WHEN len(h) > 0 THEN 1.0::DOUBLE ELSE 0 END AS precision FROM p)
    SELECT id, lcs, round(recall, 6) AS recall, round(precision, 6) AS precision,
      round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1 FROM s""",
)
def rouge_l(spark, sf_dir):
    scores = text_metrics.rouge_l(_turn_pairs(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


# A row of the table of lengths per word of the hypothesis; the prefix maximum carries a length along the row.
@query(
    "rouge_l_turns",
    f"""WITH RECURSIVE p AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS id, {sql_words("text")} AS h,
        lead({sql_words("text")}) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r IS NOT NULL),
      t AS (SELECT id, 0 AS i, list_transform(range(len(r) + 1), lambda j: 0::BIGINT) AS l FROM p UNION ALL
        SELECT id, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
          SELECT t.id, i, list_transform(range(1, len(r) + 2),
            lambda k: greatest(l[k], CASE WHEN k > 1 AND r[k - 1] = h[i + 1] THEN l[k - 1] + 1 ELSE 0 END)) AS c
          FROM t JOIN p ON p.id = t.id AND i < len(h))),
      s AS (SELECT id, l[-1] AS lcs, CASE WHEN len(r) > 0 THEN l[-1] / len(r)::DOUBLE ELSE 0 END AS recall,
        CASE WHEN len(h) > 0 THEN l[-1] / len(h)::DOUBLE ELSE 0 END AS precision FROM p JOIN t USING (id) WHERE i = len(h))
    SELECT id, lcs, round(recall, 6) AS recall, round(precision, 6) AS precision,
      round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1 FROM s""",
)
def rouge_l_turns(spark, sf_dir):
    """Every turn against the one that follows it."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("hyp"), following.alias("ref")
    )
    scores = text_metrics.rouge_l(turns.where(F.col("ref").isNotNull()))
    return scores.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


@query(
    "weighted_f1",
    """WITH p AS (SELECT quality AS t, (n_chars > 200)::INT AS p FROM labels JOIN documents USING (doc_id)),
      k AS (SELECT DISTINCT x AS label FROM (SELECT t AS x FROM p UNION ALL SELECT p FROM p)),
      s AS (SELECT label, (SELECT count(*) FROM p WHERE t = label) AS support, (SELECT count(*) FROM p WHERE p = label) AS predicted,
        (SELECT count(*) FROM p WHERE t = label AND p = label) AS tp FROM k)
    SELECT sum(support)::BIGINT AS n, count(*) FILTER (support > 0) AS n_classes,
      round(sum(2.0::DOUBLE * tp / (support + predicted) * support) / sum(support), 6) AS weighted_f1 FROM s""",
)
def weighted_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") > 200).cast("int").alias("pred")
    )
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    out = text_metrics.weighted_f1(rows, "quality", "pred")
    return out.withColumn("weighted_f1", F.round("weighted_f1", 6))


@query(
    "latency_stats",
    """WITH r AS (SELECT o_orderpriority AS kind, epoch_us(l_shipdate) / 1e6 - epoch_us(o_orderdate) / 1e6 AS s
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT kind, count(*) AS n_runs, round(avg(s), 3) AS mean_s, round(min(s), 3) AS min_s, round(max(s), 3) AS max_s,
      round(quantile_cont(s, 0.5), 3) AS p50_s, round(quantile_cont(s, 0.95), 3) AS p95_s FROM r GROUP BY kind""",
)
def latency_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("kind"), "o_orderdate"
    )
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(orders, "l_orderkey")
    out = run_metrics.latency(runs, "o_orderdate", "l_shipdate", ["kind"])
    return out.withColumns({c: F.round(c, 3) for c in out.columns if c.endswith("_s")})


@query(
    "throughput",
    """WITH t AS (SELECT event_type, count(*) AS n_items, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS e FROM events GROUP BY ALL)
    SELECT event_type, n_items, round(e, 3) AS elapsed_s, round(n_items / e, 6) AS items_per_s FROM t""",
)
def throughput(spark, sf_dir):
    out = run_metrics.throughput(table(spark, sf_dir, "events"), "ts", ["event_type"])
    return out.withColumns(
        {"elapsed_s": F.round("elapsed_s", 3), "items_per_s": F.round("items_per_s", 6)}
    )


@query(
    "length_impact",
    """SELECT CASE WHEN n_chars <= 1024 THEN 1024 WHEN n_chars <= 2048 THEN 2048 WHEN n_chars <= 4096 THEN 4096
        WHEN n_chars <= 8192 THEN 8192 END AS seq_len, count(*) AS n, round(avg(quality), 6) AS mean_quality
    FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
)
def length_impact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out = run_metrics.by_length_bucket(docs.join(table(spark, sf_dir, "labels"), "doc_id"), "n_chars", "quality")
    return out.withColumn("mean_quality", F.round("mean_quality", 6))


@query(
    "consistency",
    """WITH f AS (SELECT user_id, event_type = first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM events),
      s AS (SELECT user_id, count(*) AS n_runs, count(*) FILTER (same) - 1 AS n_same FROM f GROUP BY user_id)
    SELECT user_id, n_runs, n_same, round(n_same / n_runs * 100, 6) AS score,
      CASE WHEN n_runs > 1 THEN round(n_same / (n_runs - 1) * 100, 6) END AS score_of_rest FROM s""",
)
def consistency(spark, sf_dir):
    out = run_metrics.consistency(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("score", "score_of_rest")})


@query(
    "attention_cost",
    """WITH d AS (SELECT octet_length(encode(text)) + 1 AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS b FROM documents),
      p AS (SELECT max(n) OVER (PARTITION BY b) AS n FROM d),
      t AS (SELECT sum(n)::BIGINT AS t FROM d),
      k AS (SELECT unnest(range(t // 2048)) AS i, 2048 AS n FROM t),
      a AS (SELECT 'padded' AS layout, n FROM p UNION ALL SELECT 'packed', n FROM k UNION ALL SELECT 'single', n FROM d)
    SELECT layout, count(*) AS n_sequences, sum(n)::BIGINT AS n_ids, round(sum(4.0::DOUBLE * n * n * 1024) / 1e9, 3) AS gflops
    FROM a GROUP BY layout""",
)
def attention_cost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    single = docs.select("doc_id", byte_length().alias("n"))
    batches = with_batch(single, ["doc_id"], 8)
    # A batch is padded to its longest row.
    padded = batches.groupBy("batch_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    padded = padded.select("n", F.explode(F.array_repeat(F.lit(0), F.col("k").cast("int"))))
    rows = single.select(F.lit("single").alias("layout"), "n").unionByName(
        padded.select(F.lit("padded").alias("layout"), "n")
    )
    # Packing gives full blocks alone, as many as the sum of the lengths says.
    total = single.agg(F.expr("sum(n) div 2048").alias("blocks"))
    size = F.lit(2048).cast("bigint")
    packed = total.where("blocks > 0").select(
        F.lit("packed").alias("layout"),
        F.col("blocks").alias("n_sequences"),
        (F.col("blocks") * size).alias("n_ids"),
        (F.col("blocks") * run_metrics.attention_flops(size)).alias("flops"),
    )
    out = run_metrics.cost_report(rows, ["layout"], "n").unionByName(packed)
    return out.select("layout", "n_sequences", "n_ids", F.round(F.col("flops") / 1e9, 3).alias("gflops"))


@query(
    "attention_rate",
    """WITH r AS (SELECT source, octet_length(encode(text)) + 1 AS n, value AS seconds FROM documents JOIN events ON event_id = doc_id)
    SELECT source, count(*) AS n_runs, count(*) FILTER (seconds > 0) AS n_timed,
      round(max(CASE WHEN seconds > 0 THEN 4.0::DOUBLE * n * n * 1024 / seconds / 1e12 END), 6) AS best_tflops,
      round(avg(CASE WHEN seconds > 0 THEN 4.0::DOUBLE * n * n * 1024 / seconds / 1e12 END), 6) AS mean_tflops
    FROM r GROUP BY source""",
)
def attention_rate(spark, sf_dir):
    """Documents as timed sequences: the event of the same number gives the seconds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", byte_length().alias("n"))
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("seconds"))
    rate = run_metrics.attention_tflops(F.col("n"), F.col("seconds"))
    return docs.join(times, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count(F.when(F.col("seconds") > 0, 1)).alias("n_timed"),
        F.round(F.max(rate), 6).alias("best_tflops"),
        F.round(F.avg(rate), 6).alias("mean_tflops"),
    )


@query(
    "zero_in_zero_out",
    """SELECT vec_id, label FROM embeddings
    WHERE (vec_id % 5 = 0 OR list_max(list_transform(embedding, lambda x: abs(x))) = 0)
      AND vec_id % 10 <> 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0""",
)
def zero_in_zero_out(spark, sf_dir):
    """A step that is given zeros for every fifth vector and gives zeros for every tenth."""
    zeros = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))

    def blank(every):
        return F.when(F.col("vec_id") % every == 0, zeros).otherwise(F.col("embedding"))

    steps = table(spark, sf_dir, "embeddings").select("vec_id", "label", blank(5).alias("given"), blank(10).alias("result"))
    return quality.zero_in_zero_out(steps, "given", "result").select("vec_id", "label")


@query(
    "vector_health",
    """SELECT label, count(*) AS n, 0::BIGINT AS n_null, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf,
      count(*) FILTER (list_min(embedding) < 0 OR list_max(embedding) > 1) AS n_out_of_range,
      count(*) FILTER (list_min(embedding) = 0 AND list_max(embedding) = 0) AS n_zero,
      round(min(list_min(embedding))::DOUBLE, 6) AS min_value, round(max(list_max(embedding))::DOUBLE, 6) AS max_value
    FROM embeddings GROUP BY label""",
)
def vector_health(spark, sf_dir):
    out = quality.vector_health(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("min_value", "max_value")})


@query(
    "snapshot_diff",
    """SELECT count(*) FILTER (vec_id % 10 >= 3 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS n_same,
      count(*) FILTER (vec_id % 10 < 3 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS n_changed,
      count(*) FILTER (vec_id % 7 = 0 AND vec_id % 11 <> 0) AS n_only_left,
      count(*) FILTER (vec_id % 11 = 0 AND vec_id % 7 <> 0) AS n_only_right FROM embeddings""",
)
def snapshot_diff(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    # Two versions of the whole table: changed vectors, and keys that one side lacks.
    k = F.col("key")
    stepped = F.when(
        k % 10 < 3, F.transform("embedding", lambda x: (x + F.lit(1)).cast("float"))
    ).otherwise(F.col("embedding"))
    before = vectors.where(k % 11 != 0)
    after = vectors.where(k % 7 != 0).withColumn("embedding", stepped)
    return quality.snapshot_diff(before, after, "key", "embedding")


@query(
    "shape_check",
    """SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_embedding,
      count(*) FILTER (vec_id % 5 <> 3) AS wrong_parts FROM embeddings""",
)
def shape_check(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn(
        "parts", F.array_repeat(F.lit(0), (F.col("vec_id") % 5).cast("int"))
    )
    return quality.shape_check(df, {"embedding": 64, "parts": 3})


@query(
    "corpus_profile",
    f"""WITH m AS (SELECT source, lang, length(text) AS c, len({sql_words("text")}) AS w FROM documents)
    SELECT source, lang, grouping(source, lang)::INT AS level, count(*) AS n_docs, sum(c)::BIGINT AS n_chars, sum(w)::BIGINT AS n_words,
      min(c) AS min_chars, max(c) AS max_chars, round(avg(c), 6) AS mean_chars FROM m GROUP BY ROLLUP (source, lang)""",
)
def corpus_profile(spark, sf_dir):
    out = quality.corpus_profile(documents(spark, sf_dir, "source", "lang", "text"), ["source", "lang"])
    return out.withColumn("mean_chars", F.round("mean_chars", 6))


@query(
    "corpus_quantiles",
    """WITH q AS (SELECT source, unnest([0.1, 0.5, 0.9]) AS q, quantile_cont(n_chars, [0.1, 0.5, 0.9]) AS v FROM documents GROUP BY source)
    SELECT source, q::DOUBLE AS q, round(CASE q WHEN 0.1 THEN v[1] WHEN 0.5 THEN v[2] ELSE v[3] END, 6) AS quantile FROM q""",
)
def corpus_quantiles(spark, sf_dir):
    out = exact_quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", [0.1, 0.5, 0.9])
    return out.withColumn("quantile", F.round("quantile", 6))


@query(
    "loss_summary",
    """SELECT event_id // 100 AS window_no, count(*) AS n_steps, max(value) FILTER (event_id % 100 = 0) AS logged_loss,
      round(avg(value), 6) AS mean_loss, arg_max(value, event_id) AS last_loss FROM events GROUP BY ALL""",
)
def loss_summary(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("value").alias("loss")
    )
    return run_metrics.loss_summary(log).withColumn("mean_loss", F.round("mean_loss", 6))

"""Score aggregation and quality metrics.

All are declarative aggregates: Spark computes partial aggregates map-side and
shuffles one small row per key and task, so a hot key (one model holding a
third of the rows) costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.fixed_text import PAIRWISE_EPS, RANKING_MARGIN
from glossa.functions.answers import ANSWER_VALUES, normalize_answer, parse_answers, question_weights
from glossa.functions.vectors import harmonic_mean, hinge, l2_distance, mean_of
from glossa.operators.rows import with_index


def system_score(df: DataFrame, score_col: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean segment score (the system score), overall or per key."""
    s = F.col(score_col)
    return df.groupBy(*by).agg(F.avg(s).alias("system_score"), F.count(s).alias("n_scored"),
                               F.count(F.lit(1)).alias("n"))


def parse_report(df: DataFrame, score_col: str = "score", by: Sequence[str] = ("model",),
                 error_col: str | None = None) -> DataFrame:
    """Per key: rows, unparsed scores, their rate, and failed requests when an error column exists."""
    s = F.col(score_col)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(s.isNull()).alias("n_null"),
            (F.count_if(s.isNull()) / F.count(F.lit(1))).alias("null_rate")]
    if error_col:
        aggs.append(F.count_if(F.col(error_col).isNotNull()).alias("n_failed"))
    return df.groupBy(*by).agg(*aggs)


def score_rollup(df: DataFrame, dims: Sequence[str], measures: dict, mode: str = "rollup") -> DataFrame:
    """``ROLLUP`` (or ``CUBE``) over ``dims`` with a ``gid`` column telling subtotal rows apart."""
    aggs = [F.count(F.lit(1)).alias("n")] + [expr.alias(name) for name, expr in measures.items()]
    grouped = df.cube(*dims) if mode == "cube" else df.rollup(*dims)
    return grouped.agg(F.grouping_id().alias("gid"), *aggs)


def mse(df: DataFrame, pred_col: str, label_col: str) -> DataFrame:
    d = F.col(pred_col) - F.col(label_col)
    return df.agg(F.avg(d * d).alias("mse"), F.count(d).alias("n"))


def pair_score(src_score: str, mt_score: str) -> F.Column:
    """Quality of a pair as the mean of its source-side and target-side scores."""
    return mean_of(F.col(src_score), F.col(mt_score))


def triplet_distances(df: DataFrame, eps: float = PAIRWISE_EPS, margin: float = RANKING_MARGIN) -> DataFrame:
    """Per triplet: src- and ref-anchored hinge losses and harmonic pos / neg distances."""
    src, ref, pos, neg = (F.col(c) for c in ("src", "ref", "pos", "neg"))
    return df.select(
        "*",
        hinge(l2_distance(src, pos, eps), l2_distance(src, neg, eps), margin).alias("loss_src"),
        hinge(l2_distance(ref, pos, eps), l2_distance(ref, neg, eps), margin).alias("loss_ref"),
        harmonic_mean(l2_distance(pos, src, eps), l2_distance(pos, ref, eps)).alias("distance_pos"),
        harmonic_mean(l2_distance(neg, src, eps), l2_distance(neg, ref, eps)).alias("distance_neg"))


def triplet_metrics(df: DataFrame, eps: float = PAIRWISE_EPS, margin: float = RANKING_MARGIN) -> DataFrame:
    """Mean triplet loss (src anchor + ref anchor) and mean harmonic distances."""
    t = triplet_distances(df, eps, margin)
    return t.agg((F.avg("loss_src") + F.avg("loss_ref")).alias("loss"),
                 F.avg("distance_pos").alias("distance_pos"),
                 F.avg("distance_neg").alias("distance_neg"),
                 F.count(F.lit(1)).alias("n"))


def answers_long(df: DataFrame, response_col: str = "response", keep: Sequence[str] = ("row_id", "model")) -> DataFrame:
    """Response text -> one row per (row, question): ``qid``, ``raw``, ``answer`` (null if invalid)."""
    # the parse stands inside the explode: of a map column Catalyst would infer that it is not
    # empty and test that below the exchange, parsing every response once more
    x = df.select(*keep, F.explode(parse_answers(response_col)).alias("_k", "raw"))
    return x.select(*keep, F.col("_k").try_cast("int").alias("qid"), "raw",
                    normalize_answer("raw").alias("answer"))


def with_qa_score(df: DataFrame, response_col: str = "response", out: str = "score",
                  weights: dict | None = None, questions: int = 25) -> DataFrame:
    """QA score per row: weighted mean of YES=1 / MAYBE=.5 / NO=0 over the bank's questions.

    Narrow (no shuffle). The response is parsed once into a map column (a
    separate projection, so the parse is not repeated per question); the
    weighted sum and the weight total are one codegen'd expression each. Answers
    to keys outside the bank are not scored; null when no scored answer is valid.
    """
    w = question_weights(weights, questions)
    values = "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in ANSWER_VALUES.items()) + ")"
    parsed = df.withColumn("_answers", parse_answers(response_col))
    terms = []
    for k, wk in w.items():
        key = k.replace("'", "")
        v = f"try_element_at({values}, upper(trim(try_element_at(_answers, '{key}'))))"
        terms.append((v, f"{float(wk)!r}D"))
    # SQL text for the 2 x len(weights) generated terms: one parse per column
    num = " + ".join(f"coalesce({v} * {wk}, 0D)" for v, wk in terms)
    den = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {wk} ELSE 0D END" for v, wk in terms)
    sums = parsed.select("*", F.expr(num).alias("_num"), F.expr(den).alias("_den"))
    return (sums.withColumn(out, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")))
                .drop("_answers", "_num", "_den"))


def answer_tallies(long: DataFrame, by: Sequence[str] = ("qid", "model")) -> DataFrame:
    a = F.col("answer")
    return long.groupBy(*by).agg(F.count_if(a == "YES").alias("yes"), F.count_if(a == "NO").alias("no"),
                                 F.count_if(a == "MAYBE").alias("maybe"),
                                 F.count_if(a.isNull()).alias("invalid"))


def answer_pivot(long: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Answer counts as columns (YES / NO / MAYBE, plus invalid) per key."""
    from glossa.functions.answers import ANSWER_VALUES
    x = long.withColumn("answer", F.coalesce(F.col("answer"), F.lit("INVALID")))
    return x.groupBy(*by).pivot("answer", list(ANSWER_VALUES) + ["INVALID"]).count().na.fill(0)


def with_segment_ids(df: DataFrame, by: Sequence[str] = ("model",), order_col: str = "row_id",
                     out: str = "segment_id") -> DataFrame:
    """0-based segment id in input order within each key (skew-safe numbering)."""
    return with_index(df, order_col, by=by, out=out)


def score_document(segments: DataFrame, by: Sequence[str] = ("model",), model_info: dict | None = None) -> DataFrame:
    """The summary half of a scoring document, one row per key.

    The segment list itself stays a table (``write_document`` writes it next to
    the summary); collecting it into one value would put a whole key in one row.
    """
    info = F.struct(*[F.lit(v).alias(k) for k, v in (model_info or {}).items()]) if model_info else None
    aggs = [F.avg("score").alias("system_score"), F.count(F.lit(1)).alias("n_segments"),
            F.count_if(F.col("error_spans").isNotNull()).alias("n_with_spans")]
    out = segments.groupBy(*by).agg(*aggs)
    return out.withColumn("model_info", info) if info is not None else out

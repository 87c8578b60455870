"""Text classification and segmentation queries over the labelled documents and the order facts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vitrine.catalog.registry import query
from vitrine.functions import text
from vitrine.ml import lemma, mixed, segments, sentiment, words
from vitrine.plans import dashboards
from vitrine.session import durable, scratch_path

_W = text.WHITE
_CLEAN = (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(review_text), '(http|www)[^{_W}]+', '', 'g'), '[^a-z0-9{_W} áéíóúãõçñ]', '', 'g'), '[{_W}]+', ' ', 'g'))")
_PREPARED = f"""prep AS (SELECT doc_id, {_CLEAN} AS review_text, CASE WHEN review_score >= 4 THEN 'Positive' ELSE 'Negative' END AS sentiment FROM reviews
WHERE len(regexp_split_to_array(regexp_replace(review_text, '^[{_W}]+|[{_W}]+$', '', 'g'), '[{_W}]+')) >= 3 AND length({_CLEAN}) > 0)"""


def _prepared(m):
    return words.prepared(m.reviews(), ["doc_id"])


@query("m01_labelled", "SELECT review_score, md5(review_text) AS text_md5 FROM reviews", "reviews")
def m01(m):
    return words.labelled(m.reviews()).select("review_score", F.md5("review_text").alias("text_md5"))


@query("m02_clean_text", f"WITH {_PREPARED} SELECT doc_id, md5(review_text) AS text_md5, sentiment FROM prep", "reviews")
def m02(m):
    return _prepared(m).select("doc_id", F.md5("review_text").alias("text_md5"), "sentiment")


@query("m03_label_codes", f"WITH {_PREPARED} SELECT sentiment AS label_name, row_number() OVER (ORDER BY sentiment) - 1 AS code FROM (SELECT DISTINCT sentiment FROM prep)", "reviews")
def m03(m):
    return words.label_table(_prepared(m), "sentiment")


@query("m04_stratified_split", f"""WITH {_PREPARED} SELECT doc_id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY md5('30:' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY sentiment) * 0.2) AS is_test FROM prep""", "reviews")
def m04(m):
    return sentiment.split(durable(_prepared(m).select("doc_id", "sentiment")), "doc_id", "sentiment")


_TERMS = f"""{_PREPARED}, tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(review_text, '[a-z0-9áéíóúãõçñ]{{2,}}') AS w FROM prep)),
term AS (SELECT doc_id, word AS term FROM tok UNION ALL SELECT doc_id, word || ' ' || nxt FROM (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tok) WHERE nxt IS NOT NULL),
tc AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY 1, 2)"""
_VOCAB = """voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, ln((1 + (SELECT count(*) FROM prep)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY 1
HAVING count(*) >= 7 AND count(*) <= 0.8 * (SELECT count(*) FROM prep) ORDER BY sum(tf) DESC, term LIMIT 2000)"""


@query("m05_term_counts", f"WITH {_TERMS} SELECT * FROM tc", "reviews")
def m05(m):
    return words.term_counts(_prepared(m), "doc_id")


@query("m06_vocabulary", f"WITH {_TERMS}, {_VOCAB} SELECT term, df, tf, round(idf, 9) AS idf FROM voc", "reviews")
def m06(m):
    return words.vocabulary(_prepared(m)).withColumn("idf", F.round("idf", 9))


@query("m07_tfidf", f"""WITH {_TERMS}, {_VOCAB}, w AS (SELECT doc_id, term, tc.tf * idf AS w FROM tc JOIN voc USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
SELECT doc_id, term, round(w / l, 9) AS weight FROM w JOIN l USING (doc_id)""", "reviews")
def m07(m):
    return words.tfidf(_prepared(m), "doc_id").withColumn("weight", F.round("weight", 9))


def _cleaned(m):
    """Clean texts with their labels, durably, so that the texts are read and cleaned once for all that is learnt from them."""
    return durable(words.with_label(_prepared(m)))


def _fitted_on(rows, **params) -> tuple[PipelineModel, object]:
    rows = sentiment.split(rows, "doc_id")
    return sentiment.train(rows.filter(~F.col("is_test")), {"C": 1.0, **params}), rows.filter("is_test")


def _fitted(m, **params) -> tuple[PipelineModel, object]:
    return _fitted_on(_cleaned(m), **params)


@query("m08_logistic")
def m08(m):
    model, _ = _fitted(m, class_weight="balanced")
    return sentiment.importance(model, top=words.VOCABULARY)


def _training_folds(rows, doc):
    """Training rows of the stratified split, with folds that are even within each label."""
    return sentiment.folded(sentiment.split(rows, doc).filter("not is_test").drop("is_test"), doc)


@query("m09_search")
def m09(m):
    """50 trials of logistic regression over the texts, each judged on five folds of the training rows."""
    rows = _cleaned(m).select("doc_id", "review_text", "label")
    return sentiment.search(_training_folds(rows, "doc_id"), {"logistic": sentiment.LOGISTIC}).drop("var_smoothing")


def _reviewed_orders(m):
    """Order facts whose review is the labelled document of the same number: mixed features, content words, 0/1 label."""
    orders = m.fact_orders().drop("review_score", "review_text", "customer_unique_id", "purchase_date_key")
    # A filter on a generated column is not pushed below it, so the words of labelled texts alone are rewritten, and once.
    content = F.explode_outer(F.array(words.content_words("review_text"))).alias("review_text")
    reviews = m.reviews().select(F.col("doc_id").alias("order_id"), "review_score", content)
    rows = orders.join(reviews, "order_id").withColumn("primary_payment_type", F.concat(F.lit("type "), (F.col("order_id") % 4).cast("string")))
    rows = mixed.complete_rows(rows.withColumn("is_invalid_payment", F.col("total_payment") <= 0)).filter("review_text <> ''")
    rows = rows.withColumn("label", (F.col("review_score") >= 4).cast("double")).withColumn("total_payment", F.col("total_payment").cast("double"))
    return mixed.flags_as_numbers(rows, ["is_late_delivery", "is_invalid_payment"])


@query("m17_feature_search")
def m17(m):
    """50 trials of logistic regression and 50 of Gaussian naive Bayes over the mixed features, vocabulary size among the choices."""
    spaces = {"logistic": sentiment.LOGISTIC | sentiment.FEATURES, "naive_bayes": sentiment.BAYES | sentiment.FEATURES}
    rows = _training_folds(durable(_reviewed_orders(m)), "order_id")
    return sentiment.search(rows, spaces, categories=_MIXED[0], amounts=_MIXED[1], flags=_MIXED[2])


_MOMENTS = ("total_payment", "delivery_days_actual", "is_late_delivery")


@query("m17_moments", """WITH r AS (SELECT order_id % 5 AS fold, CASE WHEN review_score >= 4 THEN 1 ELSE 0 END AS label, CAST(total_payment AS DECIMAL(18,4)) AS total_payment,
CAST(delivery_days_actual AS DECIMAL(18,4)) AS delivery_days_actual, CAST(is_late_delivery::INT AS DECIMAL(18,4)) AS is_late_delivery
FROM fact_orders WHERE delivery_days_actual IS NOT NULL AND is_late_delivery IS NOT NULL AND review_score IS NOT NULL),
u AS (UNPIVOT r ON total_payment, delivery_days_actual, is_late_delivery INTO NAME feature VALUE x),
g AS (SELECT label, CAST(f AS INTEGER) AS held_out, feature, count(*) AS n, sum(x)::DOUBLE AS total, sum(CAST(x AS DECIMAL(19,4)) * CAST(x AS DECIMAL(19,4)))::DOUBLE AS square
    FROM u JOIN (SELECT unnest(range(5)) AS f) ON fold <> f GROUP BY 1, 2, 3)
SELECT *, round(total / n, 6) AS mean, round(square / n - total / n * (total / n), 3) AS variance FROM g""", "fact_orders")
def m17_moments(m):
    """What Gaussian naive Bayes learns from the features that need no fitting: moments by fold and class."""
    rows = m.fact_orders().dropna(subset=["delivery_days_actual", "is_late_delivery", "review_score"])
    rows = rows.select((F.col("order_id") % 5).alias("fold"), (F.col("review_score") >= 4).cast("int").alias("label"), *[F.col(c).cast("int").cast("decimal(18,4)").alias(c) if c.startswith("is_") else
                       F.col(c).cast("decimal(18,4)").alias(c) for c in _MOMENTS])
    return sentiment.fold_moments(rows, _MOMENTS).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 3)})


_CELLS = "c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = p)::DOUBLE AS ok, " + ", ".join(
    f"count(*) FILTER (y = {i} AND p = {i})::DOUBLE AS t{i}, count(*) FILTER (p = {i})::DOUBLE AS s{i}, count(*) FILTER (y = {i})::DOUBLE AS w{i}" for i in (0, 1)) + \
    " FROM (SELECT quality AS y, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE 1 END AS p FROM labels))"
_F = {i: f"coalesce(2 * t{i} / nullif(s{i} + w{i}, 0), 0)" for i in (0, 1)}


def _judged(m):
    """Labels beside a made prediction: the label itself, turned round in every fifth row, else 1."""
    return m.table("labels").select(F.col("quality").alias("label"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(1).alias("prediction"))


@query("m10_metrics", f"WITH {_CELLS} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round({v}, 12) AS value FROM c" for n, v in [
    ("weighted_f1", f"({_F[0]} * w0 + {_F[1]} * w1) / n"), ("macro_f1", f"({_F[0]} + {_F[1]}) / 2"), ("accuracy", "ok / n"),
    *[(f"{name}_{k}", v) for i, name in enumerate(("Negative", "Positive")) for k, v in
      (("precision", f"coalesce(t{i} / nullif(s{i}, 0), 0)"), ("recall", f"coalesce(t{i} / nullif(w{i}, 0), 0)"), ("f1", _F[i]))]]))
def m10(m):
    return sentiment.metrics(_judged(m)).withColumn("value", F.round("value", 12))


@query("m11_confusion_matrix", """SELECT CASE y WHEN 0 THEN 'Negative' ELSE 'Positive' END AS actual, count(*) FILTER (p = 0) AS predicted_negative, count(*) FILTER (p = 1) AS predicted_positive
FROM (SELECT quality AS y, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE 1 END AS p FROM labels) GROUP BY 1""")
def m11(m):
    return sentiment.confusion_matrix(_judged(m))


@query("m11_report", f"WITH {_CELLS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS class_name, round(coalesce(t{i} / nullif(s{i}, 0), 0), 12) AS precision, round(coalesce(t{i} / nullif(w{i}, 0), 0), 12) AS recall, round({_F[i]}, 12) AS f1, CAST(w{i} AS BIGINT) AS support FROM c"
    for i, n in enumerate(("Negative", "Positive"))))
def m11_report(m):
    out = sentiment.report(_judged(m))
    return out.select("class_name", "support", *[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")])


@query("m12_batch_scores")
def m12(m):
    rows = _cleaned(m)
    model, _ = _fitted_on(rows)
    return sentiment.scored(model, rows.select("doc_id", "review_text", "label"))


@query("s14_model_store")
def s14(m):
    """Save a model and its label names, load both, score every document."""
    path = scratch_path(m.spark, "model")
    sentiment.save(_fitted(m)[0], path)
    model, names = sentiment.load(m.spark, path)
    everything = m.table("documents").select("doc_id", text.clean_for_model(F.col("text")).alias("review_text"))
    return sentiment.scored(model, everything, names).select("doc_id", "sentiment_label", "confidence")


def _order_features(m):
    """Complete delivered orders with a 0/1 label from the score."""
    rows = m.fact_orders().withColumn("primary_payment_type", F.concat(F.lit("type "), (F.col("order_id") % 4).cast("string"))).withColumn("is_invalid_payment", F.col("total_payment") <= 0)
    rows = mixed.complete_rows(rows, ["purchase_date_key", "customer_unique_id"])
    rows = rows.withColumn("label", (F.col("review_score") >= 4).cast("double")).withColumn("total_payment", F.col("total_payment").cast("double"))
    return mixed.flags_as_numbers(rows, ["is_late_delivery", "is_invalid_payment"])


_MIXED = (["primary_payment_type", "order_status"], ["delivery_days_actual", "total_payment"], ["is_late_delivery", "is_invalid_payment"])


@query("m13_mixed_features")
def m13(m):
    rows = _order_features(m)
    return mixed.mixed_pipeline(rows, *_MIXED).transform(rows).select("order_id", "label", vector_to_array("features").alias("features"))


def _mixed_split(m):
    """Order features with text, everything fitted on the training rows alone: the pipeline, training rows and test rows."""
    rows = sentiment.split(durable(_order_features(m)), "order_id")
    pipeline = mixed.mixed_pipeline(rows.filter("not is_test"), *_MIXED)
    shaped = durable(pipeline.transform(rows).select("order_id", "label", "features", "is_test").hint("rebalance"))
    return pipeline, shaped.filter("not is_test"), shaped.filter("is_test")


@query("m14_naive_bayes")
def m14(m):
    _, inner, outer = _mixed_split(m)
    return sentiment.metrics(sentiment.naive_bayes(inner).transform(outer))


_ROC = """r AS (SELECT n_chars % 97 AS score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY 1),
t AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM r WINDOW w AS (ORDER BY score DESC))"""


def _points(m):
    rows = m.table("documents").select("doc_id", (F.col("n_chars") % 97).alias("score")).join(m.table("labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return sentiment.roc(rows)


@query("m15_roc_points", f"WITH {_ROC} SELECT score, pos, neg, tp, fp, tp::DOUBLE / p::DOUBLE AS tpr, fp::DOUBLE / n::DOUBLE AS fpr FROM t")
def m15(m):
    return _points(m)


@query("m15_auc", f"WITH {_ROC} SELECT round(sum(neg * (tp - pos / 2.0))::DOUBLE / (max(p) * max(n))::DOUBLE, 9) AS auc FROM t")
def m15_auc(m):
    return sentiment.auc(_points(m)).select(F.round("auc", 9).alias("auc"))


@query("m15_leaderboard")
def m15_board(m):
    """AUC of logistic regression and Gaussian naive Bayes on the test rows of the same order features."""
    _, inner, outer = _mixed_split(m)
    chance = vector_to_array("probability")[1].alias("score")
    fitted = {"Logistic Regression": sentiment.logistic(inner), "Naive Bayes": sentiment.naive_bayes(inner)}
    return sentiment.leaderboard(m.spark, {n: f.transform(outer).select("label", chance) for n, f in fitted.items()})


@query("m16_importance")
def m16(m):
    """Features that tell most, by name: coefficients of logistic regression, differences of the class means of naive Bayes."""
    pipeline, inner, _ = _mixed_split(m)
    names = mixed.feature_names(pipeline, *_MIXED)
    parts = {"Logistic Regression": sentiment.coefficients(names, sentiment.logistic(inner)), "Naive Bayes": sentiment.mean_difference(names, sentiment.naive_bayes(inner).theta)}
    first, second = (df.select(F.lit(n).alias("model"), "feature", "importance") for n, df in parts.items())
    return first.unionAll(second)


@query("m18_complete_rows", "SELECT order_id, customer_unique_id, order_status, total_payment, review_score, review_text, is_late_delivery FROM fact_orders WHERE review_text IS NOT NULL AND is_late_delivery IS NOT NULL", "fact_orders")
def m18(m):
    return mixed.complete_rows(m.fact_orders(), ["purchase_date_key", "delivery_days_actual"])


def _values(name: str, columns: str, rows) -> str:
    """A small table of text and numbers."""
    literal = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


@query("m19_content_words", rf"""WITH {_values("closed", "word", [(w,) for w in lemma.CLOSED_CLASSES if w != "não"])}, {_values("odd", "word, form", lemma.EXCEPTIONS.items())},
{_values("endings", "ending, put, least", lemma.ENDINGS)},
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents)),
v AS (SELECT DISTINCT word FROM t WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM closed)),
cut AS (SELECT word, left(word, length(word) - length(ending)) || put AS form FROM v JOIN endings ON ends_with(word, ending) AND length(word) - length(ending) >= least
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(ending) DESC) = 1),
forms AS (SELECT word, coalesce(odd.form, cut.form, word) AS form FROM v LEFT JOIN odd USING (word) LEFT JOIN cut USING (word))
SELECT doc_id, md5(coalesce(string_agg(form, ' ' ORDER BY i) FILTER (form IS NOT NULL), '')) AS h FROM t LEFT JOIN forms USING (word) GROUP BY 1""")
def m19(m):
    return m.table("documents").select("doc_id", F.md5(words.content_words("text")).alias("h"))


def _behaviour(m):
    orders = m.fact_orders()
    return segments.behaviour(dashboards.rfm(orders, m.fact_order_items(), m.dim_products(), m.dim_customers()), orders)


@query("m20_segments")
def m20(m):
    rows = durable(_behaviour(m))
    return segments.segmented(segments.fit_segments(rows), rows).drop("scaled")


@query("m21_profiles")
def m21(m):
    rows = durable(_behaviour(m))
    return segments.profile_matrix(segments.segmented(segments.fit_segments(rows), rows))

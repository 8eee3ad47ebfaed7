"""Annotated lines and the line classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines
from ..operators import classify as ml
from ..operators import lines as ln
from ..sources.scratch import written
from .line_queries import _LABELLED
from .registry import query
from .views import view

_NOTES = f"WITH {_LABELLED} SELECT receipt_id AS image, line_no AS line_num, round(line_pos, 3) AS line_pos, text, label AS auto_label, '' AS corrected_label FROM lab"


def _notes(spark, sf):
    return ml.annotate(ln.labelled(view(spark, sf, "receipt_lines")))


@query("ml1_annotate", _NOTES)
def ml1(spark, sf):
    return _notes(spark, sf)


@query("ml1_label_counts", f"SELECT auto_label, count(*) AS n FROM ({_NOTES}) GROUP BY auto_label")
def ml1_counts(spark, sf):
    return ml.label_counts(_notes(spark, sf))


_FILES = "SELECT image, line_num, 0 AS file_ord, line_num AS row_ord, auto_label, '' AS corrected_label FROM a UNION ALL SELECT image, line_num, 1, -line_num, auto_label, CASE WHEN line_num % 3 = 0 THEN 'discount' ELSE ' ' END FROM a WHERE line_num % 2 = 0"


def _files(notes):
    """The lines of _FILES, each note's from one row, so that the notes are made once."""
    first = F.struct(F.lit(0).alias("file_ord"), F.col("line_num").alias("row_ord"), F.lit("").alias("corrected_label"))
    again = F.struct(F.lit(1).alias("file_ord"), (-F.col("line_num")).alias("row_ord"), F.when(F.col("line_num") % 3 == 0, "discount").otherwise(" ").alias("corrected_label"))
    lines = F.array_compact(F.array(first, F.when(F.col("line_num") % 2 == 0, again)))
    return notes.select("image", "line_num", "auto_label", F.explode(lines).alias("f")).select("image", "line_num", "f.file_ord", "f.row_ord", "auto_label", "f.corrected_label")


@query("ml2_merge_annotations", f"WITH a AS ({_NOTES}), f AS ({_FILES}) SELECT image, line_num, max(file_ord)::INT AS file_ord, arg_max(corrected_label, file_ord) AS corrected_label FROM f GROUP BY image, line_num")
def ml2(spark, sf):
    files = _files(_notes(spark, sf))
    return ml.merge_annotations(files).select("image", "line_num", "file_ord", "corrected_label")


@query("ml3_effective_label", f"WITH a AS ({_NOTES}), f AS ({_FILES}) SELECT image, line_num, file_ord::INT AS file_ord, CASE WHEN l IN ('metadata', 'discount') THEN 'noise' ELSE l END AS label FROM (SELECT *, coalesce(nullif(trim(corrected_label), ''), auto_label) AS l FROM f)")
def ml3(spark, sf):
    files = _files(_notes(spark, sf))
    return files.select("image", "line_num", "file_ord", ml.effective_label(F.col("corrected_label"), F.col("auto_label")).alias("label"))


def _kinds(rows):
    """Lines alike with how many they are and their label, written once."""
    kinds = ml.alike(rows)
    label = lines.rule_label(F.col("text"), F.col("line_pos"))
    return written(kinds.withColumn("label", ml.effective_label(F.lit(""), label)), "kinds")


@query("ml6_boosted_lines")
def ml6(spark, sf):
    """Softmax boosting fitted on all labelled lines, 10 rounds: how many lines of each label get which label."""
    kinds = _kinds(ml.as_kinds(ln.positioned(view(spark, sf, "receipt_lines"))))
    model = ml.train_line_classifier(kinds, kind="softmax", n="n", trees=10)
    return ml.classify_lines(model, kinds).groupBy("label", "predicted").agg(F.sum("n").alias("n"))


@query("ml9_classify_lines")
def ml9(spark, sf):
    """A small forest fitted on all labelled lines, applied to every line."""
    rows = ml.as_kinds(ln.positioned(view(spark, sf, "receipt_lines")))
    rows = written(rows.select("receipt_id", "line_no", "text", "line_pos"), "lines")
    kinds = _kinds(rows)
    model = ml.train_line_classifier(kinds, kind="forest", n="n", trees=10)
    known = written(ml.classify_lines(model, kinds), "classified")
    return ml.of_kinds(rows, known).select("receipt_id", "line_no", "label", "predicted", F.round("confidence", 4).alias("confidence"))

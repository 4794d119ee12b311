from pyspark.sql import functions as F

from turnloom.operators.models import out_of_fold
from turnloom.plans.fixtures import corpus_turns
from turnloom.plans.registry import gather


def test_every_therapist_row_is_predicted_once(spark):
    d = "/root/testdata/sf0.001"
    n = corpus_turns(spark, d).where("speaker = 'therapist' and behaviour is not null").count()
    assert gather()[0]["behaviour_classifier"](spark, d).agg(F.sum("n")).first()[0] == n > 0


def test_a_class_of_one_fold_only_is_counted(spark):
    rows = [(f, f"{t} them", t) for f in (0, 1) for t in ("ask", "tell") for _ in range(3)] + [(1, "rare them", "rare")]
    got = out_of_fold(spark.createDataFrame(rows, "fold int, text string, label string"), "nb", k=2).collect()
    assert len(got) == 13 and [r.predicted for r in got if r.label == "rare"] == ["(not predicted)"]

"""Functions of whole texts get a hundred rows at a time, not Arrow batches of 10,000 texts."""

import pytest
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.nlp import lemma as L
from skein.sources import feed

FORMS = {
    "F16 split": lambda c: L.lemma_factor(c)["lemmas"],
    "F16 combined": lambda c: L.recombined(c, c),
    "F18": H.markdown,
    "F20": feed.sanitize,
    "F28": H.text_nodes,
    "F25": lambda c: L.stem_text(c, "en"),
}


@pytest.mark.parametrize("name", FORMS)
def test_rows_go_in_small_batches(spark, capsys, name):
    rows = spark.createDataFrame([("<p>two words</p>",), (None,), ("",)], "t string")
    out = rows.select(FORMS[name](F.col("t")).alias("x"))
    out.explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert out.count() == 3 and len(out.collect()) == 3

"""Scores of a saved model from the table of its nodes, in Spark and in DuckDB."""

import duckdb
import pytest

from binroute.operators import features, learning
from binroute.plans import training as plan
from binroute.sources.schemas import FEATURES

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
KEYS = ["bin", "processor_name_encoded"]

DUCK = f"""
WITH RECURSIVE walk AS (
  SELECT r.*, n.* FROM rows r, nodes n WHERE n.node = 0
  UNION ALL
  SELECT w.bin, w.processor_name_encoded, {", ".join("w." + f for f in FEATURES if f not in KEYS)}, n.*
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN CASE w.feature {" ".join(f"WHEN '{f}' THEN w.{f}" for f in FEATURES)} END
    <= w.threshold THEN w."left" ELSE w."right" END
  WHERE w.leaf IS NULL
)
SELECT bin, processor_name_encoded, 1 / (1 + exp(-2 * sum(weight * leaf))) AS score FROM walk WHERE leaf IS NOT NULL GROUP BY 1, 2
"""


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    rows = entry._training(spark, SF).select("bin", *entry.NEEDED)
    ready = plan.prepare(rows, entry._seed(spark), entry.NEEDED)
    cells = learning.training_cells(ready.rows, plan.content_key(KEYS))
    model = learning.train(cells, trees=12)
    path = str(tmp_path_factory.mktemp("model") / "m")
    model.write().save(path)
    candidates = features.candidate_features(entry._candidate_bins(spark, SF), ready.stats, 3).select(*KEYS, *[f for f in FEATURES if f not in KEYS])
    candidates = entry.materialize(candidates, "candidates")
    by_model = {tuple(r[k] for k in KEYS): r["score"] for r in learning.score(model, candidates).collect()}
    return spark, path, candidates, by_model


def test_nodes_give_the_scores_of_the_model(scored):
    spark, path, candidates, by_model = scored
    nodes = learning.node_table(spark, path)
    assert nodes.select("tree").distinct().count() == 12 and nodes.where("leaf IS NULL AND (feature IS NULL OR threshold IS NULL)").isEmpty()
    by_nodes = {tuple(r[k] for k in KEYS): r["score"] for r in learning.score_by_nodes(nodes, candidates, KEYS).collect()}
    assert by_nodes.keys() == by_model.keys() and len({round(s, 6) for s in by_model.values()}) > 5
    assert all(abs(by_nodes[k] - by_model[k]) < 1e-12 for k in by_model)
    with pytest.raises(Exception, match="deeper"):
        learning.score_by_nodes(nodes, candidates, KEYS, depth=1).collect()


def test_another_engine_computes_the_scores_from_the_nodes(scored):
    spark, path, candidates, by_model = scored
    con = duckdb.connect()
    con.register("nodes", learning.node_table(spark, path).toPandas())
    con.register("rows", candidates.toPandas())
    found = {(b, p): s for b, p, s in con.execute(DUCK).fetchall()}
    assert found.keys() == by_model.keys() and all(round(found[k], 6) == round(by_model[k], 6) for k in found)

"""Boosted trees on the feature table, with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.constants import LEARNING_RATE, SAMPLING, SEED, TREE_DEPTH, TREES
from binroute.functions import safe_div
from binroute.sources.schemas import FEATURES
from binroute.sources.scratch import materialize

LABEL = "success_flag"
CELLS_PER_PART = 50_000


def training_cells(rows: DataFrame, key: Column, shards: int = 32) -> DataFrame:
    """Equal training rows as weighted ones: features, label, ``n``.

    All features are functions of BIN, processor and the 3-D flag, so however
    many rows there are, they fall into few distinct cells, and each boosting
    pass costs the cells instead of the rows. A cell is kept in up to ``shards``
    parts, so that row sampling per tree still takes a share of a heavy cell
    and not all or nothing of it.

    The part comes from ``key``, a hash of the row's content, and the cells are
    written in an order of their own: the files that rows lie in do not matter.
    They are dealt over as many partitions as their number asks for, not as the rows
    did: boosting runs some thousand short jobs over them, whose tasks cost more to
    start than to run.
    """
    part = F.pmod(key, F.lit(shards)).cast("int")
    names = [*FEATURES, LABEL]
    cells = rows.select(*names, part.alias("_part")).groupBy(*names, "_part").agg(F.count("*").alias("n"))
    cells = materialize(cells, "cell-parts")
    placed = cells.repartition(1 + cells.count() // CELLS_PER_PART, *names, "_part").sortWithinPartitions(*names, "_part")
    return materialize(placed.drop("_part"), "cells")


def train(
    cells: DataFrame,
    class_weighted: bool = True,
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rate: float = LEARNING_RATE,
    sampling: float = SAMPLING,
    seed: int = SEED,
) -> PipelineModel:
    """Fit on weighted cells; with ``class_weighted`` a positive weighs as much
    as there are negatives per positive."""
    positives = F.sum(F.when(F.col(LABEL) == 1, F.col("n")))
    negatives = F.sum(F.when(F.col(LABEL) == 0, F.col("n")))
    ratio = cells.agg(F.coalesce(safe_div(negatives, positives), F.lit(1.0)).alias("ratio")).scalar()
    positive_weight = ratio if class_weighted else F.lit(1.0)
    weighted = cells.withColumn(
        "weight", F.col("n") * F.when(F.col(LABEL) == 1, positive_weight).otherwise(F.lit(1.0))
    )
    trees_stage = GBTClassifier(
        labelCol=LABEL,
        featuresCol="features",
        weightCol="weight",
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=sampling,
        featureSubsetStrategy=str(sampling),
        maxBins=256,
        maxMemoryInMB=1024,
        seed=seed,
    )
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return Pipeline(stages=[assembler, trees_stage]).fit(weighted)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``score`` (probability of approval) and ``prediction``."""
    return (
        model.transform(rows)
        .withColumn("score", vector_to_array("probability")[1])
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability")
    )


def node_table(spark: SparkSession, model_path: str) -> DataFrame:
    """The trees of a saved model: ``tree, weight, node, feature, threshold, left, right, leaf``.

    An inner node sends a row to ``left`` if the value of ``feature`` is at most
    ``threshold``; a leaf has no feature and the value ``leaf``. Node 0 is the root.
    """
    stored = spark.read.parquet(f"{model_path.rstrip('/')}/stages/1_*/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{model_path.rstrip('/')}/stages/1_*/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    inner = F.col("leftChild") >= 0
    names = F.array(*[F.lit(name) for name in FEATURES])
    nodes = stored.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(inner, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.when(~inner, F.col("prediction")).alias("leaf"),
    )
    return nodes.join(weights, "tree").select("tree", "weight", *[c for c in nodes.columns if c != "tree"])


def score_by_nodes(nodes: DataFrame, rows: DataFrame, keys: list[str], depth: int = TREE_DEPTH) -> DataFrame:
    """``(keys, score)`` from the table of nodes alone, by joins: one level of all trees at a time.

    For checking scores, and for engines that know tables and no models; ``score`` is
    the fast way. Rows must be told apart by ``keys``. Trees deeper than ``depth`` raise.
    """
    nodes = materialize(nodes, "nodes")
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(f).cast("double") for f in FEATURES]))
    roots = nodes.groupBy("tree").agg(F.first("weight").alias("weight"))
    trees = roots.agg(F.collect_list(F.struct("tree", "weight")).alias("trees")).scalar()  # one entry a tree
    at = rows.select(*keys, values.alias("values"), F.explode(trees).alias("one")).select(*keys, "values", "one.tree", "one.weight", F.lit(0).alias("node"))
    steps = nodes.drop("weight")
    for level in range(depth + 1):
        met = at.join(steps, ["tree", "node"])
        goes_left = F.element_at("values", F.col("feature")) <= F.col("threshold")
        # A row at a leaf stays there.
        following = F.when(F.col("leaf").isNotNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        if level == depth:
            deeper = F.raise_error(F.lit(f"a tree is deeper than {depth}")).cast("double")
            at = met.withColumn("leaf", F.coalesce("leaf", deeper))
        else:
            at = met.select(*keys, "values", "tree", "weight", following.alias("node"))
    margin = F.sum(F.col("weight") * F.col("leaf"))
    return at.groupBy(*keys).agg((1 / (1 + F.exp(-2 * margin))).alias("score"))


def training_accuracy(model: PipelineModel, cells: DataFrame) -> DataFrame:
    """Share of training rows that the model gets right, from weighted cells."""
    scored = score(model, cells).withColumn("hit", (F.col("prediction") == F.col(LABEL)).cast("long") * F.col("n"))
    return scored.agg(safe_div(F.sum("hit"), F.sum("n")).alias("accuracy"))

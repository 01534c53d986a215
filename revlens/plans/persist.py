"""Save and load fitted pipelines (all three extractors).

A saved model is a folder: ``model/`` (MLlib ``PipelineModel``), for word2vec
also ``prepare/`` (the preparation stages that run before the distributed
stemming job) and ``vectors/`` (the words' vectors, Parquet), and ``meta.json`` (extractor, classifiers, feature column).
Paths should be on storage every executor sees.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from revlens.operators.word2vec import WordVectors
from revlens.plans.pipelines import FittedPipeline


def save_fitted(spark: SparkSession, fitted: FittedPipeline, path: str, extractor: str) -> None:
    path = path.rstrip("/")
    fitted.model.write().overwrite().save(f"{path}/model")
    if fitted.prepare is not None:
        fitted.prepare.write().overwrite().save(f"{path}/prepare")
    if fitted.vectors is not None:
        fitted.vectors.table.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {"extractor": extractor, "classifiers": list(fitted.classifiers),
            "features_col": fitted.features_col, "id_col": fitted.id_col,
            "stemmed": fitted.prepare is not None,
            "vector_size": None if fitted.vectors is None else fitted.vectors.size}
    # one small JSON row written through Spark, so it lands wherever the model does
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta.json")


def load_fitted(spark: SparkSession, path: str) -> tuple[FittedPipeline, str]:
    path = path.rstrip("/")
    meta = json.loads(spark.read.text(f"{path}/meta.json").first()[0])
    model = PipelineModel.load(f"{path}/model")
    prepare = PipelineModel.load(f"{path}/prepare") if meta["stemmed"] else None
    size = meta.get("vector_size")
    vectors = WordVectors(spark.read.parquet(f"{path}/vectors"), size) if size else None
    return (FittedPipeline(model, meta["features_col"], tuple(meta["classifiers"]), prepare,
                           meta["id_col"], vectors), meta["extractor"])

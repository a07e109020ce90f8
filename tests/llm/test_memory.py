"""Memory that executors give back between the stages of the pipeline."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

CHILD = """
import re
import psutil
from pyspark.sql import SparkSession
import corpus_pipeline

conf = {"spark.master": "local-cluster[1,2,1500]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://%(dir)s/shared", "spark.executor.extraJavaOptions": "-XX:+UseG1GC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()


def executor_mb():
    own = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()) and p.name() == "java"]
    return sum(p.memory_info().rss for p in own) / 1e6


spark.range(0, 2, 1, 2).selectExpr("length(repeat(cast(id as string), 80000000)) n").collect()  # large rows fill the heap for a moment
spark.createDataFrame([(1, "a text")], "doc_id long, text string").write.parquet("%(dir)s/documents.parquet")
spark.createDataFrame([], "doc_id long, toxic int").write.parquet("%(dir)s/labels.parquet")
before = executor_mb()
corpus_pipeline.drop_toxic(spark, spark.read.parquet("%(dir)s/documents.parquet"), "%(dir)s").collect()
print("MB", before, executor_mb())
"""


def test_executors_give_memory_back(tmp_path):
    home = tmp_path / "home"  # executors work in a folder below Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    root = str(Path(__file__).parents[2])
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")]), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CHILD % {"dir": tmp_path}], env=env, cwd=root, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    before, after = map(float, run.stdout.split("MB")[-1].split())
    assert after < before - 100, (before, after)

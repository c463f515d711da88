"""Python-side functions run without the repository at the workers."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
CASES = {
    "chunk": "from lodestone.operators import chunking; assert chunking.chunk(docs, \"doc_id\", \"text\", \"windows\").count() == 6",
    "html_text": "from lodestone.sources import readers; assert readers.html_text(docs, \"doc_id\", \"text\").where(F.length(\"text\") > 0).count() == 6",
    "tolerant_json": "from lodestone.functions import evidence; docs.select(evidence.tolerant_json(F.col(\"text\")).alias(\"j\")).collect()",
    "nfkc": "from lodestone.functions import text; docs.select(text.canonical(F.col(\"text\"), compatibility=True).alias(\"c\")).collect()",
    "stream": "from lodestone.streaming import monitors; e = docs.select(F.col(\"doc_id\").alias(\"event_id\"), F.timestamp_seconds(\"doc_id\").alias(\"ts\"), (F.col(\"doc_id\") % 2).alias(\"user_id\"), F.lit(50.0).alias(\"value\")); e.write.parquet(\"events\"); s = spark.readStream.schema(e.schema).parquet(\"events\"); assert monitors.run_once(monitors.latched(monitors.controlled(s), 2), \"update\").where(\"tripped\").count() == 2",
    "nearest": "from lodestone.operators import retrieval; v = docs.select(\"doc_id\", F.array(F.col(\"doc_id\") + 1.0, F.lit(2.0)).alias(\"v\")); assert retrieval.nearest(v, \"doc_id\", v, \"doc_id\", \"v\", 2).count() == 12",
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_works_as_the_first_call_of_a_session_elsewhere(tmp_path, name):
    """In another folder, on rows that the library did not read, as the first call of its session."""
    script = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()
docs = spark.createDataFrame([(k, f"<p>text number {{k}} of some words</p> and more", ["en", "fr"][k % 2]) for k in range(6)], "doc_id long, text string, lang string")
{CASES[name]}
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]

"""The corpus operators run without the repository at the workers."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
CASES = {
    "encode": "from lodestone.llm import pieces; assert pieces.encode(docs).where(\"parity\").count() == 6",
    "identify": "from lodestone.llm import langid; assert langid.identify(docs).count() == 6",
    "rlz": "from lodestone.llm import rlz; assert rlz.substring_dedup(docs).count() == 6",
    "suffixes": "from lodestone.llm import suffixes; assert suffixes.suffix_dedup(docs).count() == 6",
    "near": "from lodestone.llm import minhash; assert minhash.keep_representatives(docs).count() == 6",
    "exact": "from lodestone.llm import exact_dedup; assert exact_dedup.keep_first(docs).count() == 6",
    "quality": "from lodestone.llm import quality; assert quality.features(docs).count() == 6",
    "links": "from lodestone.llm import rabitq; assert rabitq.near_duplicates(docs.select(F.col(\"doc_id\").alias(\"vec_id\"), F.lit(1).alias(\"label\"), F.array(F.col(\"doc_id\") + 1.0, F.lit(2.0)).alias(\"embedding\"))).count() == 6",
    "whiten": "from lodestone.llm import whitening; assert whitening.whiten(docs.select(F.col(\"doc_id\").alias(\"vec_id\"), F.array(F.col(\"doc_id\") + 1.0, F.lit(2.0)).alias(\"embedding\"))).count() == 12",
    "spelling": "from lodestone.llm import variants; assert variants.spelling_variants(docs.select(\"doc_id\", F.lit(\"spelling spellings\").alias(\"text\"))).count() >= 1",
    "search": "from lodestone.llm import mih; assert mih.nearest(docs.select(F.col(\"doc_id\").alias(\"vec_id\"), F.array(F.col(\"doc_id\") + 1.0, F.lit(2.0)).alias(\"embedding\"))).count() == 5",
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

"""Executors need not have the package: only the driver's path holds it."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[2] + "/shared").config("spark.sql.warehouse.dir", sys.argv[2] + "/warehouse").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
sys.path.insert(0, sys.argv[1])
from siftlode.llm.queries import QUERIES
import corpus_pipeline
for name in ("op2_html_extract", "op5_warc", "op6_quality", "op7_embedding_dedup", "op10_simhash"):
    assert QUERIES[name](spark, sys.argv[3]).count() > 0, name
assert corpus_pipeline.run(spark, sys.argv[3]).count() > 0
print("ALL RAN")
"""


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script), str(REPO), str(tmp_path), "/root/testdata/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ALL RAN" in done.stdout, f"{done.stderr[:6000]}\n...\n{done.stderr[-3000:]}"


def test_shipped_functions_need_no_package(tmp_path):
    """What is sent to workers is read in a process that cannot import the package: no cluster is needed for that."""
    import pickle

    from pyspark import cloudpickle

    from siftlode.llm import embed_dedup, html_extract, importance, quality, simhash, verify, warc, whitening

    sent = [embed_dedup.encode, html_extract.repeated, importance.features, quality.with_scores, simhash.fingerprint, verify.similar_pairs, warc.round_trip, whitening.deviations]
    (tmp_path / "sent").write_bytes(pickle.dumps([cloudpickle.dumps(f) for f in sent]))
    code = "import pickle, sys; [pickle.loads(x) for x in pickle.load(open(sys.argv[1], 'rb'))]; assert not any(m.startswith('siftlode') for m in sys.modules); print('ALL READ')"
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "sent")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ALL READ" in done.stdout, done.stderr

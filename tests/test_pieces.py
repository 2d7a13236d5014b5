"""Python workers hold a batch and its results as Arrow arrays and no more than a piece of it as Python objects."""

import subprocess
import sys

import pyarrow as pa
import pytest
from paths import ROOT

CODE = """
import os, sys
from pathlib import Path
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
from pyspark.sql import SparkSession, functions as F
from corpusmill import queries
conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": "file://FOLDER/shared", "spark.driver.memory": "2g", "spark.sql.shuffle.partitions": "1"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
text = F.concat(F.lit("\\u00dcn\\u00ef "), F.col("id").cast("string"), F.repeat(F.lit(" w\\u00f6rd ein\\u00df zwei drei vier."), 200))
spark.range(8000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("de").alias("lang")).coalesce(1).write.parquet("FOLDER/documents.parquet")
queries.QUERIES["NAME"](spark, "FOLDER").write.format("noop").mode("overwrite").save()
parents = {}
for p in Path("/proc").glob("[0-9]*/status"):
    try:
        status = dict(x.split(":", 1) for x in p.read_text().splitlines() if ":" in x)
    except OSError:
        continue
    parents[int(status["Pid"])] = (int(status["PPid"]), int(status.get("VmHWM", "0 kB").split()[0]) >> 10, status["Name"])
def below(pid):
    while pid in parents:
        if pid == os.getpid():
            return True
        pid = parents[pid][0]
    return False
print("WORKERS", *(mb for pid, (_, mb, name) in parents.items() if "python" in name and pid != os.getpid() and below(pid)))
"""


@pytest.mark.parametrize("name, most", [("minhash_signature", 320), ("rule_symbol_to_word_ratio", 245), ("failure_histogram", 320), ("stage_outcomes", 480)])
def test_workers_of_a_task(tmp_path, name, most):
    """Peaks of all Python processes of one core, the daemon among them, over a batch of 8 000 texts of 5 kB."""
    code = CODE.replace("FOLDER", str(tmp_path)).replace("NAME", name)
    out = subprocess.run([sys.executable, "-c", f"ROOT = {ROOT!r}\n" + code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    peaks = list(map(int, out.stdout.split("WORKERS")[1].split()))
    print(name, peaks)
    assert sum(peaks) <= most, peaks

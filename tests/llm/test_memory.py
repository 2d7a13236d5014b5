"""Very long texts are worked on by pieces: peaks of a process of its own, over what it has when the text is made."""

import subprocess
import sys

import pytest

CODE = """
import resource, sys
import numpy as np, pyarrow as pa
from corpusmill.llm import bpe, decontaminate, langid, quality, secrets, simhash
from corpusmill.llm.common import Words
rng = np.random.default_rng(0)
words = ["w" + str(k) for k in rng.integers(0, 50_000, 200_000)]
part = " ".join(words) + ".\\n"
text = part * (SIZE // len(part) + 1)
column = pa.array([text], pa.string())
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = peak()
NAME
print(peak() - before, len(text) >> 20)
"""
CALLS = {
    "words": "w = Words(column); w.hashes(); del w",
    "simhash": "simhash.fingerprints(column)",
    "quality": "quality.statistics(column)",
    "language": "m = langid.Model(['a', 'b'], np.zeros((langid.BUCKETS + 1, 2), np.float32)); m.logits(column)",
    "decontaminate": "p = decontaminate.Phrases(pa.table({'id': [1], 'text': [' '.join(words[:50])]}), 8, 5); assert decontaminate.find_in_column(column, lambda: [p], 8)",
    "secrets": "secrets.find_in_column(secrets.Scanner(), column)",
}


@pytest.mark.parametrize("name", CALLS)
def test_peak_of_a_long_text(name):
    """At most ten bytes for each byte of text beyond a fixed share."""
    size = 40 << 20
    code = CODE.replace("SIZE", str(size)).replace("NAME", CALLS[name])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    grown, text = map(int, out.stdout.split())
    assert grown <= 10 * text + 250, (name, grown, text)

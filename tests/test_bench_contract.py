"""bench.py prints one JSON line with the fields the driver reads."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_REPEATS="1", BENCH_LLM="0",
               BENCH_WARM_DIR="/nonexistent")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env, capture_output=True, text=True, timeout=900, check=True,
    ).stdout.strip().splitlines()
    assert len(out) == 1
    rec = json.loads(out[0])
    assert rec["unit"] == "sec" and rec["sf"] == 0.001
    assert isinstance(rec["value"], float) and rec["value"] > 0
    assert len(rec["queries"]) == 30 and all(v > 0 for v in rec["queries"].values())

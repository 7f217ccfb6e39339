"""bench.py stays runnable and prints exactly one JSON line."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_WARMUP="0")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "dedup_key", "bulletin_ranked"],
                         env=env, capture_output=True, text=True, timeout=600, cwd="/tmp")
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stderr[-2000:]
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and set(result["queries"]) == {"dedup_key", "bulletin_ranked"}
    assert result["sf"] == 0.001 and "errors" not in result

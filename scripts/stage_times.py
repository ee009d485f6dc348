"""Summarise a Spark event log: slowest stages with their operators.

Usage: BENCH_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) python bench.py
       python scripts/stage_times.py <that folder> [top_n]
"""

from __future__ import annotations

import glob
import io
import json
import sys


def open_log(folder: str):
    path = [p for p in glob.glob(folder + "/**/*", recursive=True) if "events_" in p or p.endswith(".inprogress")]
    if not path:
        raise SystemExit(f"no event log under {folder}")
    f = open(path[0], "rb")
    if path[0].endswith(".zstd"):
        import zstandard
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(f), encoding="utf-8")
    return io.TextIOWrapper(f, encoding="utf-8")


def main() -> None:
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    stages = []
    for line in open_log(folder):
        e = json.loads(line)
        if e.get("Event") != "SparkListenerStageCompleted":
            continue
        si = e["Stage Info"]
        secs = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
        ops = sorted({json.loads(r["Scope"])["name"] for r in si["RDD Info"] if r.get("Scope")})
        stages.append((secs, si["Stage ID"], si["Number of Tasks"], ops))
    print(f"{len(stages)} stages, {sum(s[0] for s in stages):.1f} s of stage wall time")
    for secs, sid, tasks, ops in sorted(stages, reverse=True)[:top]:
        print(f"stage {sid:4d} {secs:7.2f} s {tasks:5d} tasks  {', '.join(ops)[:110]}")


if __name__ == "__main__":
    main()

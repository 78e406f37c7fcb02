"""Raw run folders -> features, against the brute-force definitions."""

import os

import pytest

from tessera.plans.runs import features_from_runs
from tests.test_features import RUN, brute


def test_features_from_run_folders(spark, scratch):
    for sample in ("a", "b"):
        d = os.path.join(scratch, "goodware", sample, "run1")
        os.makedirs(d)
        with open(os.path.join(d, "strace.log"), "w") as f:
            f.write("\n".join(RUN) + "\n")
    d = os.path.join(scratch, "goodware", "a", "run1")
    with open(os.path.join(d, "entropy_timeline.csv"), "w") as f:
        f.write("epoch,mean_entropy,file_count,total_bytes\n10.2,7.25,3,100\n10.4,6.5,3,100\n")
    rows = features_from_runs(spark, scratch).collect()
    ref = brute(RUN)
    by = {(r.sample, r.window_idx): r for r in rows}
    assert len(rows) == 2 * len(ref)
    for s in ("a", "b"):
        for w, e in ref.items():
            assert by[(s, w)].bytes_written_per_sec == e["bw"]
            assert by[(s, w)].io_burstiness_std == pytest.approx(e["std"], abs=1e-9)
    # run a has an entropy timeline: window 0 (t=10.0) sees 10.2 first (|d|<0.5)
    assert by[("a", 0)].mean_file_entropy == 7.25 and by[("b", 0)].mean_file_entropy == 0.0
    assert by[("a", 0)].file_entropy_delta == -0.75 and by[("b", 0)].file_entropy_delta == 0.0
